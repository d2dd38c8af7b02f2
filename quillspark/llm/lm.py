"""Interpolated modified Kneser-Ney bigram model, stored as sorted hash arrays.

Counting: workers fold each stretch of training text into sorted arrays of
distinct pairs, Spark deals these by hash shard, and each shard becomes one
file of sorted keys and counts.  From the pairs of a shard come partial context
and continuation counts, which are dealt and stored the same way.  Scoring
memory-maps the files, looks up each block's distinct keys by binary search and
sums log10 probabilities; nothing is collected but a list of files and a few
sums for each.

Words are 64-bit hashes for the exact unigram counts, their upper 48 bits in
pairs: of a thousand million distinct words about two thousand share those with
another.  A pair travels as a 64-bit key and 32 bits more, from which both words
come back.  The number of shards follows the size of the text, so a shard stays
small; a pair reaches its shard once for each stretch of text at most, so a
frequent pair is no hot key.

Defined results: a null or empty text is the end token alone; a null doc_id
counts as the empty text; without training documents every probability is 1;
repeated rows are counted and scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, local_path, map_batches, open_input, open_output, shared_folder, table
from .textblock import SPACED, Block, blocks, mix

FOLDS, HELD_OUT = 7, 2
#: Tokens that a worker folds into one set of arrays.
STRETCH_TOKENS = 1 << 22
#: Bytes of text for each shard.
SHARD_BYTES = 1 << 24
#: Shards up to which packets are dealt in one step.
FAN = 1024
#: Shards of a kind that a worker holds where it cannot map them.
HELD_SHARDS = 2
_U = np.uint64
_LOW = _U(0xFFFFFFFF)
END = int(mix(np.array([0x0E4D], dtype=np.uint64))[0])
BEGIN = int(mix(np.array([0x0B36], dtype=np.uint64))[0])
UNIGRAM, PAIR, CONTEXT, CONTINUED = range(4)
_UNMIX = _U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    for _ in range(2):
        x = (x ^ (x >> _U(32))) * _UNMIX
    return x ^ (x >> _U(32))


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of words and end tokens in order, hashes of what stands before each, text index)."""
    starts, ends, owner = block.spans(SPACED)
    counts = block.counts(owner)
    place = np.arange(len(owner)) + owner
    hashes = np.full(len(owner) + block.n, END, dtype=np.uint64)
    hashes[place] = block.hashes(starts, ends)
    whose = np.repeat(np.arange(block.n), counts + 1)
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[np.cumsum(counts + 1) - counts - 1] = BEGIN
    return hashes, before, whose


_CUT = _U(16)


def word_keys(hashes: np.ndarray) -> np.ndarray:
    """The 48 bits of a word that pairs, contexts and continuations know."""
    return hashes >> _CUT << _CUT


def pair_keys(before: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit keys, the 32 bits that the words cannot be told from the key without)."""
    low = hashes >> _CUT & _LOW
    return mix((word_keys(before) | hashes >> _U(48)) ^ mix(low + _U(1))), low


def unpaired(keys: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word keys of both words of each pair."""
    high = unmix(keys) ^ mix(low + _U(1))
    return word_keys(high), (high & _U(0xFFFF)) << _U(48) | low << _CUT


def summed(keys: np.ndarray, values: list[np.ndarray], carried: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order, and the sums of their values; the last ``carried`` columns follow from the key and stay."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = len(values) - carried
    return keys[heads], [np.add.reduceat(v[order], heads) if i < sums else v[order][heads] for i, v in enumerate(values)]


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the upper 32 bits, so that shards are ranges of keys."""
    return ((keys >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


_DEALT = "shard int, kind int, payload binary"


def _packets(kind: int, keys: np.ndarray, values: list[np.ndarray], shards: int) -> pa.RecordBatch:
    """Sorted keys and values as one packed row for each shard that has any."""
    whose = _shards_of(keys, shards)
    heads = np.flatnonzero(np.diff(whose, prepend=-1))
    rows = []
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(keys)], strict=True) if len(keys) else ():
        # a narrow type for counts where they allow it
        parts = []
        for v in values:
            part = v[a:b].astype(np.uint64)
            width = np.uint8 if part.max() < 1 << 8 else np.uint32 if part.max() < 1 << 32 else np.uint64
            parts.append(struct.pack("<B", np.dtype(width).itemsize) + part.astype(width).tobytes())
        rows.append((int(whose[a]), struct.pack("<QB", b - a, len(values)) + keys[a:b].tobytes() + b"".join(parts)))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([kind] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "kind", "payload"])


def _unpacked(payload: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    n, many = struct.unpack_from("<QB", payload)
    keys, at, values = np.frombuffer(payload, np.uint64, n, 9), 9 + 8 * n, []
    for _ in range(many):
        width = {1: np.uint8, 4: np.uint32, 8: np.uint64}[payload[at]]
        values.append(np.frombuffer(payload, width, n, at + 1).astype(np.int64))
        at += 1 + n * np.dtype(width).itemsize
    return keys, values


def _gathered(batches: Iterator[pa.RecordBatch]) -> dict[tuple[int, int], tuple[np.ndarray, list[np.ndarray]]]:
    """(kind, shard) -> summed arrays, of the packets of one task."""
    found: dict[tuple[int, int], list] = {}
    for batch in batches:
        for shard, kind, payload in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
            found.setdefault((kind, shard), []).append(_unpacked(payload))
    out = {}
    for key in sorted(found):
        parts = found.pop(key)
        out[key] = summed(np.concatenate([p[0] for p in parts]), [np.concatenate(c) for c in zip(*[p[1] for p in parts], strict=True)], carried=key[0] == PAIR)
    return out


def write_arrays(stream, keys: np.ndarray, columns: list[np.ndarray]) -> None:
    """n, columns, then the sorted keys, then each column as bytes with 255 standing for what is listed after it."""
    stream.write(struct.pack("<QQ", len(keys), len(columns)) + keys.astype("<u8").tobytes())
    for column in columns:
        big = np.flatnonzero(column >= 255)
        small = np.minimum(column, 255).astype(np.uint8).tobytes()
        stream.write(struct.pack("<Q", len(big)) + small + bytes(-len(small) % 8) + big.astype("<u8").tobytes() + column[big].astype("<u8").tobytes())


class SortedArrays:
    """The bytes of ``write_arrays``, mapped or read."""

    def __init__(self, raw: np.ndarray):
        n, many = (int(x) for x in raw[:16].view("<u8"))
        self.keys = raw[16 : 16 + 8 * n].view("<u8")
        self.columns, at = [], 16 + 8 * n
        for _ in range(many):
            big = int(raw[at : at + 8].view("<u8")[0])
            small = raw[at + 8 : at + 8 + n]
            at += 8 + n + -n % 8
            self.columns.append((small, raw[at : at + 8 * big].view("<u8"), raw[at + 8 * big : at + 16 * big].view("<u8")))
            at += 16 * big

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The columns' values at sorted distinct keys; 0 where a key is missing."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        here = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        out = []
        for small, places, values in self.columns:
            got = np.zeros(len(keys), dtype=np.int64)
            got[here] = small[at[here]]
            large = np.flatnonzero(got == 255)
            if len(large):
                got[large] = values[np.searchsorted(places, at[large])]
            out.append(got)
        return out


class ModelFiles:
    """The model's files of one kind, by shard; mapped when first needed. Of a store without a mount, a few shards are held in memory."""

    def __init__(self, paths: dict[int, str], shards: int, columns: int):
        self.paths, self.shards, self.columns = paths, shards, columns
        self.open: dict[int, SortedArrays] = {}

    def __getstate__(self):
        return {"paths": self.paths, "shards": self.shards, "columns": self.columns, "open": {}}

    def _shard(self, s: int) -> SortedArrays:
        if s not in self.open:
            path = local_path(self.paths[s])
            if path is not None:
                raw = np.memmap(path, dtype=np.uint8, mode="r")
            else:
                while len(self.open) >= HELD_SHARDS:
                    self.open.pop(next(iter(self.open)))
                with open_input(self.paths[s]) as source:
                    raw = np.frombuffer(source.read(), dtype=np.uint8)
            self.open[s] = SortedArrays(raw)
        return self.open[s]

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        distinct, back = np.unique(keys, return_inverse=True)
        out = [np.zeros(len(distinct), dtype=np.int64) for _ in range(self.columns)]
        bounds = np.searchsorted(_shards_of(distinct, self.shards), np.arange(self.shards + 1))
        for s in self.paths:
            a, b = bounds[s], bounds[s + 1]
            if a < b:
                for column, values in zip(out, self._shard(s).find(distinct[a:b]), strict=True):
                    column[a:b] = values
        return [c[back] for c in out]


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more, from how many things are counted 1 to 4 times.

    Repeated texts make these numbers irregular.  An estimate outside (0, count) would leave an unseen word without
    mass, or a seen one; the one absolute discount, or a half, stands in for it.
    """
    n1, n2 = n[:2]
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    absolute = y if 0 < y < 1 else 0.5
    out = [0.0]
    for count, (here, above) in enumerate(zip(n, n[1:], strict=False), 1):
        estimate = count - (count + 1) * y * above / here if here else 0.0
        out.append(estimate if 0 < estimate < count else absolute)
    return np.array(out)


class KneserNey:
    def __init__(self, files: dict[int, ModelFiles], sums: dict[str, list[int]]):
        self.files = files
        self.total, self.vocabulary = sums["unigrams"]
        self.pair_types = sums["continued"][0]
        self.pair_discounts = discounts(sums["pairs"][:4])
        ones, twos, _, _, more = sums["continued"][1:6]
        self.word_discounts = discounts(sums["continued"][1:5])
        self.spare = (self.word_discounts[1:] * [ones, twos, more]).sum() / self.pair_types if self.pair_types else 1.0

    def scores(self, block: Block) -> dict[str, np.ndarray]:
        hashes, before, whose = tokens(block)
        known = self.files[UNIGRAM].find(hashes)[0]
        pairs = self.files[PAIR].find(pair_keys(before, hashes)[0])[0]
        total, ones, twos, more = self.files[CONTEXT].find(word_keys(before))
        continued = self.files[CONTINUED].find(word_keys(hashes))[0]
        lower = np.full(len(hashes), self.spare / (self.vocabulary + 1))
        if self.pair_types:
            lower += (continued - self.word_discounts[np.minimum(continued, 3)]) / self.pair_types
        d = self.pair_discounts
        own = np.maximum(total, 1)
        back_off = np.where(total > 0, (d[1] * ones + d[2] * twos + d[3] * more) / own, 1.0)
        chance = np.where(total > 0, (pairs - d[np.minimum(pairs, 3)]) / own, 0.0) + back_off * lower
        base = np.log10((known + 1) / (self.total + self.vocabulary + 1))
        if not (chance > 0).all():
            raise ArithmeticError("the model leaves a token without probability")
        add = lambda x: np.bincount(whose, x, minlength=block.n)
        return {"n_tokens": np.bincount(whose, minlength=block.n), "n_known": add(known > 0).astype(np.int64), "base_score": add(base), "score": add(np.log10(chance))}


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT


def _wanted(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def fit(docs: DataFrame, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> KneserNey:
    """Counts all of ``docs`` and stores the model in the shared folder.

    Beyond ``fan`` shards, packets are dealt in two steps: to groups of shards first, about as many as a group has,
    folded there anew and dealt to the shards, so that no step makes a packet for each pair of a task and a shard.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("b")).first()["b"] or 0
    shards = groups = max(1, -(-int(size) // shard_bytes))
    if shards > fan:
        groups = math.isqrt(shards - 1) + 1
        shards = groups * -(-shards // groups)  # a multiple, so that groups are runs of shards

    def refolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def fold() -> Iterator[pa.RecordBatch]:
            for kind in sorted(held):
                parts = held.pop(kind)
                yield _packets(kind, *summed(np.concatenate([p[0] for p in parts]), [np.concatenate(c) for c in zip(*[p[1] for p in parts], strict=True)], carried=kind == PAIR), shards)

        for batch in batches:
            files = batch.column(1).to_numpy() >= 10
            yield batch.filter(pa.array(files))
            for kind, payload in zip(*[c.to_pylist() for c in batch.filter(pa.array(~files)).columns[1:]], strict=True):
                held.setdefault(kind, []).append(_unpacked(payload))
                size += len(held[kind][-1][0])
                if size >= STRETCH_TOKENS:
                    yield from fold()
                    size = 0
        yield from fold()

    def dealt(packets: DataFrame) -> DataFrame:
        if groups < shards:
            packets = map_batches(packets.repartition(groups, "shard"), refolded, _DEALT)
        return packets.repartition(shards, "shard")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[np.ndarray] = []
        pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def fold() -> Iterator[pa.RecordBatch]:
            distinct, counts = np.unique(np.concatenate(words), return_counts=True)
            words.clear()
            yield _packets(UNIGRAM, distinct, [counts], groups)
            keys, low = (np.concatenate(part) for part in zip(*pairs, strict=True))
            pairs.clear()
            distinct, at, counts = np.unique(keys, return_index=True, return_counts=True)
            yield _packets(PAIR, distinct, [counts, low[at]], groups)

        for batch in batches:
            for _, _, block in blocks(batch.column(0), lower=True):
                hashes, before, _ = tokens(block)
                words.append(hashes)
                pairs.append(pair_keys(before, hashes))
                if sum(map(len, words)) >= STRETCH_TOKENS:
                    yield from fold()
        if words:
            yield from fold()

    def stored(kind: int, shard: int, keys: np.ndarray, columns: list[np.ndarray], sums: list[int]) -> pa.RecordBatch:
        path = f"{folder}/kind{kind}-{shard:05d}-{uuid.uuid4().hex}"
        with open_output(path) as stream:
            write_arrays(stream, keys, columns)
        row = struct.pack(f"<{len(sums)}q", *sums) + path.encode()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([10 + kind], pa.int32()), pa.array([row], pa.binary())], ["shard", "kind", "payload"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (kind, shard), (keys, (counts, *low)) in _gathered(batches).items():
            if kind == UNIGRAM:
                yield stored(kind, shard, keys, [counts], [int(counts.sum()), len(keys)])
                continue
            yield stored(kind, shard, keys, [counts], [int((counts == r).sum()) for r in (1, 2, 3, 4)])
            before, word = unpaired(keys, low[0].astype(np.uint64))
            yield _packets(CONTEXT, *summed(before, [counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)]), groups)
            yield _packets(CONTINUED, *summed(word, [np.ones(len(keys), dtype=np.int64)]), groups)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packets() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = batch.column(1).to_numpy() >= 10
                files.append(batch.filter(pa.array(done)))
                yield batch.filter(pa.array(~done))

        files: list[pa.RecordBatch] = []
        for (kind, shard), (keys, columns) in _gathered(packets()).items():
            sums = [int(columns[0].sum()), *[int((columns[0] == r).sum()) for r in (1, 2, 3, 4)], int((columns[0] > 2).sum())] if kind == CONTINUED else []
            yield stored(kind, shard, keys, columns, sums)
        yield from files

    train = docs.select(F.col("text").cast("string").alias("text"))
    spread = map_batches(dealt(map_batches(train, counted, _DEALT)), paired, _DEALT)
    manifest = keep_table(map_batches(dealt(spread), closed, _DEALT))

    many = {UNIGRAM: 2, PAIR: 4, CONTEXT: 0, CONTINUED: 6}
    paths: dict[int, dict[int, str]] = {k: {} for k in many}
    totals = {k: [0] * n for k, n in many.items()}
    for row in manifest.toLocalIterator():  # four rows for each shard
        kind, payload = row["kind"] - 10, bytes(row["payload"])
        width = 8 * many[kind]
        totals[kind] = [a + b for a, b in zip(totals[kind], struct.unpack(f"<{many[kind]}q", payload[:width]), strict=True)]
        paths[kind][row["shard"]] = payload[width:].decode()
    columns = {UNIGRAM: 1, PAIR: 1, CONTEXT: 4, CONTINUED: 1}
    return KneserNey({k: ModelFiles(paths[k], shards, columns[k]) for k in many}, {"unigrams": totals[UNIGRAM], "pairs": totals[PAIR], "continued": totals[CONTINUED]})


def lm_scores(docs: DataFrame, model: KneserNey) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity; one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the list of files and a few sums

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, block in blocks(batch.column(1), lower=True):
                got = shared.value.scores(block)
                train = np.full(block.n, shared.value.total, dtype=np.int64)
                perplexity = 10 ** np.minimum(300, -got["score"] / got["n_tokens"])
                arrays = [got["n_tokens"].astype(np.int64), got["n_known"], train, got["base_score"], got["score"], perplexity]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), *map(pa.array, arrays)], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return map_batches(_wanted(docs), scored, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = lm_scores(docs, fit(docs.where(~held_out(F.col("doc_id")))))
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
