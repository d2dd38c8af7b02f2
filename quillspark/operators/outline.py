"""Walks over trees that come as parent links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import kept

#: Characters of a title from which on it means something.
LEAST_TITLE = 3
#: Rounds of doubling: a path of 2**40 links.
ROUNDS = 40


def nearest_above(nodes: DataFrame, node: str, parent: str, good: Column) -> DataFrame:
    """(node, above): the nearest ancestor for which ``good`` holds; null where there is none.

    Each round doubles how far a node has looked, so that a chain of n links takes log2(n) joins on the node. Nodes
    that are done leave the rounds. A link to a node that is not there ends a path; links in a circle are an error.
    """
    flagged = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.coalesce(good, F.lit(False)).alias("good"))
    known = flagged.select(F.col("node").alias("at"), F.col("up").alias("further"), "good")
    state = kept(flagged.select("node", "up").join(known, F.col("up") == F.col("at"), "left").select(
        "node", F.when(F.col("good"), F.col("up")).alias("above"), F.when(~F.col("good"), F.col("further")).alias("up"), F.coalesce(~F.col("good") & F.col("further").isNotNull(), F.lit(False)).alias("open")))
    # known: of each node that is passed over, itself if good, else where its own look has come to
    table = flagged.select("node", "good").join(state.select("node", "above", "up", "open"), "node")
    for _ in range(ROUNDS):
        waiting = state.where("open")
        if waiting.isEmpty():
            return state.select("node", "above")
        step = table.select(
            F.col("node").alias("at"), F.when(F.col("good"), F.col("node")).otherwise(F.col("above")).alias("next_above"),
            F.when(~F.col("good") & F.col("open"), F.col("up")).alias("next_up"), (~F.col("good") & F.col("open")).alias("next_open"))
        moved = waiting.join(step, F.col("up") == F.col("at"), "left").select("node", F.col("next_above").alias("above"), F.col("next_up").alias("up"), F.coalesce("next_open", F.lit(False)).alias("open"))
        state = kept(state.where("not open").unionByName(moved))
        table = flagged.select("node", "good").join(state, "node")
    raise ValueError("parent links run in a circle")


def outline(bookmarks: DataFrame, node: str, parent: str, title: str) -> DataFrame:
    """The bookmarks whose title means something, with ``parent_title``: that of the nearest one above that does too."""
    means = F.length(F.trim(title)) >= LEAST_TITLE
    above = nearest_above(bookmarks, node, parent, means).select(F.col("node").alias(node), F.col("above").alias("_above"))
    titles = bookmarks.select(F.col(node).alias("_above"), F.col(title).alias("parent_title"))
    return bookmarks.where(means).join(above, node).join(titles, "_above", "left").drop("_above")
