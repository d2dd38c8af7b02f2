"""Quality rules: exact rule statistics of every document, then an isolation forest.

``rule_statistics`` counts words, symbols, repeated lines and repeated 8-word
windows of whole texts.  ``IsolationForest`` is grown on the statistics of a
bounded sample of labelled rows; anomalous documents end in short paths of its
random splits, and the score beyond which a document is rejected is calibrated
on the same labelled rows so that few good ones are lost.

Defined results: a null or empty text has zero words and fails the base rules;
repeated rows are scored each; without labels of both kinds no score is
calibrated, and the base rules alone decide; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .textblock import SPACED, Block, blocks, byte_class, mix, windows

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Words of the windows in which distinct words are counted.
DISTINCT_WINDOW = 200
SYMBOLS = byte_class(b"#*$%&|<>")
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["word_length", "symbol_rate", "distinct_rate"]
#: Most labelled rows that the forest and its threshold are fitted on (those of least hash).
LABELLED_ROWS = 20_000
#: What losing a share of the good rows weighs against keeping the same share of the bad ones.
GOOD_WEIGHT = 20.0


def _per_text(block: Block, wanted: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(wanted, out=sums[1:])
    return np.diff(sums[block.offsets])


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often it occurs, and whether this is its first place."""
    _, first, back, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    lead = np.zeros(len(keys), dtype=bool)
    lead[first] = True
    return count[back], lead


def _owned(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return mix(hashes + owner.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _distinct_in_windows(keys: np.ndarray, owner: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: mean number of distinct words over all windows of its consecutive words, and the words of a window."""
    order = np.argsort(keys, kind="stable")
    before = np.full(len(keys), -1, dtype=np.int64)  # the same word's last place in its text
    again = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    before[order[again + 1]] = order[again]
    head = np.cumsum(words) - words
    wide = np.minimum(words, DISTINCT_WINDOW)
    place = np.arange(len(keys)) - head[owner]
    # starts of the windows in which a word is the first of its kind
    least = np.maximum(np.maximum(before - head[owner] + 1, place - wide[owner] + 1), 0)
    most = np.minimum(place, (words - wide)[owner])
    return np.bincount(owner, np.maximum(most - least + 1, 0), minlength=len(words)) / np.maximum(1, words - wide + 1), wide


def block_statistics(block: Block) -> dict[str, np.ndarray]:
    """The five rule statistics and the forest's features of each text of a block."""
    starts, ends, owner = block.spans(SPACED)
    words = block.counts(owner)
    lead_bytes = (block.data & 0xC0) != 0x80
    chars = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(lead_bytes, out=chars[1:])
    in_words = np.bincount(owner, chars[ends] - chars[starts], minlength=block.n).astype(np.int64)
    hashes = block.hashes(starts, ends)

    keys, at = windows(hashes, owner, WINDOW)
    again = at[_repeats(_owned(keys, owner[at]))[0] > 1]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + WINDOW, -1)
    repeated = np.bincount(owner[np.cumsum(edge[:-1]) > 0], minlength=block.n).astype(np.int64)

    # lines that hold a word: the line of a word starts after the last \n before it, or with its text
    marks = np.union1d(np.flatnonzero(block.data == 10) + 1, block.offsets)
    line = np.unique(np.searchsorted(marks, starts, side="right") - 1)
    line_start = marks[line]
    line_end = marks[line + 1] if len(line) else line_start
    line_end = line_end - ((line_end > line_start) & (block.data[line_end - 1] == 10) if len(line) else 0)
    line_owner = np.searchsorted(block.offsets, line_start, side="right") - 1
    doubled = ~_repeats(_owned(block.hashes(line_start, line_end), line_owner))[1]
    dup_lines = np.bincount(line_owner[doubled], minlength=block.n).astype(np.int64)
    distinct, wide = _distinct_in_windows(_owned(hashes, owner), owner, words)

    symbols = _per_text(block, SYMBOLS[block.data])
    per_word = np.maximum(1, words)
    # distinct words fall with length in natural text; windows end that trend, the power takes it out of shorter texts
    shape = [in_words / per_word, symbols / per_word, distinct / np.maximum(1, wide) ** 0.9]
    return dict(zip(STATISTICS, [words, in_words, symbols, dup_lines, repeated], strict=True)) | dict(zip(FEATURES, shape, strict=True))


def _found(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The statistics and the feature rows of a whole column of texts."""
    parts = [block_statistics(block) for _, _, block in blocks(column)]
    names = [*STATISTICS, *FEATURES]
    found = {x: np.concatenate([p[x] for p in parts]) if parts else np.zeros(0) for x in names}
    return {x: found[x].astype(np.int64) for x in STATISTICS}, np.column_stack([found[x] for x in FEATURES])


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > MAX_REPEAT_PERCENT * found["n_words"])


class IsolationForest:
    """Isolation forest over feature rows; ``score`` is near 1 for rows that few random splits set apart."""

    def __init__(self, rows: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 7):
        random = np.random.default_rng(seed)
        self.depth = max(1, int(np.ceil(np.log2(max(2, min(sample, len(rows)))))))
        self.norm = self._expected(np.array([min(sample, len(rows))]))[0]
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, dtype=np.int32)
        self.split = np.zeros((trees, size))
        self.path = np.zeros((trees, size))
        for tree in range(trees):
            picked = rows[random.choice(len(rows), min(sample, len(rows)), replace=False)]
            self._grow(tree, 0, 0, picked, random)

    @staticmethod
    def _expected(n: np.ndarray) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.asarray(n, dtype=float)
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def _grow(self, tree: int, node: int, level: int, rows: np.ndarray, random: np.random.Generator) -> None:
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        wide = np.flatnonzero(high > low)
        if level >= self.depth or len(rows) < 2 or not len(wide):
            self.path[tree, node] = level + self._expected(np.array([len(rows)]))[0]
            return
        f = int(random.choice(wide))
        cut = random.uniform(low[f], high[f])
        self.feature[tree, node], self.split[tree, node] = f, cut
        left = rows[:, f] < cut
        self._grow(tree, 2 * node + 1, level + 1, rows[left], random)
        self._grow(tree, 2 * node + 2, level + 1, rows[~left], random)

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for tree in range(len(self.feature)):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[tree, node]
                down = 2 * node + 1 + (rows[every, np.maximum(f, 0)] >= self.split[tree, node])
                node = np.where(f >= 0, down, node)
            total += self.path[tree, node]
        return 2.0 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def calibrate(scores: np.ndarray, good: np.ndarray) -> float:
    """The score above which rejection costs least on labelled rows, in the middle of its gap; infinite without both kinds."""
    if not len(scores) or good.all() or not good.any():
        return float("inf")
    order = np.argsort(scores, kind="stable")
    ranked, is_good = scores[order], good[order].astype(float)
    lost = GOOD_WEIGHT * (1 - np.concatenate([[0], np.cumsum(is_good)]) / is_good.sum())
    missed = np.concatenate([[0], np.cumsum(1 - is_good)]) / (1 - is_good).sum()
    cost = lost + missed  # of rejecting all from the i-th on
    cost[1:-1][ranked[1:] == ranked[:-1]] = np.inf
    i = int(np.argmin(cost))
    edges = np.concatenate([[0.0], ranked, [2.0]])
    return float((edges[i] + edges[i + 1]) / 2) if 0 < i < len(ranked) else (0.0 if i == 0 else float("inf"))


class QualityModel:
    def __init__(self, forest: IsolationForest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def verdicts(self, column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        found, rows = _found(column)
        failed = base_failed(found)
        scores = self.forest.score(rows) if self.forest is not None and len(rows) else np.zeros(len(rows))
        return found, failed, scores, ~failed & (scores <= self.threshold)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, rows = _found(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(base_failed(found)), *batch.columns[1:], *[pa.array(rows[:, i]) for i in range(len(FEATURES))]], ["failed", "quality", "labelled_id", *FEATURES])


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> QualityModel:
    """A forest and its threshold from at most ``bound`` labelled rows, the same ones on every run.

    An id labelled both ways counts as bad; rows repeated under an id count once.
    """
    named = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    picked = named.orderBy(F.xxhash64("labelled_id"), "labelled_id").limit(bound)
    # at most ``bound`` rows of two numbers: a proven size
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
    schema = "failed boolean, quality int, labelled_id long, " + ", ".join(f"{x} double" for x in FEATURES)
    measured = map_batches(sample.select("text", "quality", "labelled_id"), _sampled, schema).where("not failed").distinct()
    # an id may stand on several rows of other texts: of all rows, so many as the bound, by hash
    rows = measured.orderBy(F.xxhash64("labelled_id", *FEATURES), "labelled_id", *FEATURES).limit(bound).toPandas().sort_values(["quality", *FEATURES], kind="stable")
    if not len(rows):
        return QualityModel(None, float("inf"))
    values, good = rows[FEATURES].to_numpy(), rows["quality"].to_numpy() == 1
    forest = IsolationForest(values)
    return QualityModel(forest, calibrate(forest.score(values), good))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five statistics, base_failed, anomaly (the forest's score), kept; one row per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # 100 trees: some 1.2 MB at any size of input

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, failed, scores, kept = model.value.verdicts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[x]) for x in STATISTICS], pa.array(failed), pa.array(scores), pa.array(kept)], ["doc_id", *STATISTICS, "base_failed", "anomaly", "kept"])

    schema = "doc_id long, " + ", ".join(f"{x} long" for x in STATISTICS) + ", base_failed boolean, anomaly double, kept boolean"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), judged, schema)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and the forest; no shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    place = docs.columns.index("text")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.verdicts(batch.column(place))[3]))

    return map_batches(docs, filtered, docs.schema)


def op1_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
