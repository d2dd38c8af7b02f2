"""Types corrected against rosters, and ids that follow their type renamed in every record that names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutations import spread

#: A string of JSON, with its quotes.
_STRING = r'"(?:[^"\\]|\\.)*"'
#: A quoted id: three parts or more between dots.
_ID = r'^"[^".\s]+\.[^".\s]+\.[^"]+"$'


def id_of_type(id: Column, type: Column) -> Column:
    """The id with its second part replaced by the type; ids of fewer than three parts stay."""
    parts = F.split(id, r"\.")
    return F.when(F.size(parts) < 3, id).otherwise(F.concat_ws(".", F.get(parts, F.lit(0)), F.lower(type), F.array_join(F.slice(parts, 3, F.size(parts)), ".")))


def corrections(records: DataFrame, lookup: DataFrame) -> DataFrame:
    """book, old_id, new_id, type of the records (book, id, name, source, type) to which a lookup (name_key, source_key, type) gives another type and id."""
    known = lookup.select("name_key", "source_key", F.col("type").alias("right_type"))
    # exploded or not, a table that is small as written is not small as a broadcast
    met = records.join(known.hint("merge"), (F.lower("name") == F.col("name_key")) & (F.upper("source") == F.col("source_key")))
    new = met.where("lower(type) <> lower(right_type)").select("book", F.col("id").alias("old_id"), id_of_type(F.col("id"), F.col("right_type")).alias("new_id"), F.col("right_type").alias("type"))
    return new.where("old_id <> new_id")


def renamed(records: DataFrame, renames: DataFrame, key: str, record: str = "record") -> DataFrame:
    """``records`` (key, book, record: JSON) in which each string that is an old id of its book is the new one; ``references`` counts them.

    A record is cut at its strings, wherever they stand in it. Strings of the shape of an id meet the renames in one join
    on (book, id); of a record with hits the strings go back to their places, all others stay as they are.
    """
    rows = records.count()
    strings, gaps = F.regexp_extract_all(F.col(record), F.lit(_STRING), F.lit(0)), F.split(F.col(record), _STRING, -1)
    leaves = records.select(key, "book", F.posexplode(strings).alias("place", "said")).where(F.col("said").rlike(_ID))
    by = renames.select("book", F.concat(F.lit('"'), "old_id", F.lit('"')).alias("said"), F.concat(F.lit('"'), "new_id", F.lit('"')).alias("new"))
    hits = spread(leaves, "book", "said", rows=4 * rows).join(by.hint("merge"), ["book", "said"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("place", "new"))).alias("_new"))
    joined = spread(records, key, rows=rows).join(hits.hint("merge"), key, "left").withColumn("_s", F.when(F.col("_new").isNotNull(), strings)).withColumn("_g", F.when(F.col("_new").isNotNull(), gaps))
    said = F.transform("_s", lambda s, i: F.coalesce(F.try_element_at("_new", i), s))
    whole = F.array_join(F.zip_with("_g", F.concat(said, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    return joined.withColumn(record, F.coalesce(whole, F.col(record))).withColumn("references", F.coalesce(F.size(F.map_keys("_new")), F.lit(0)).cast("long")).drop("_new", "_s", "_g")
