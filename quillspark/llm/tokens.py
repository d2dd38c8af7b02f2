"""Token ids in directly addressable files.

Documents are encoded in ascending order of doc_id and written as shards of a
binary format in which any token is reached without decoding a block: every id
is cut into 8-bit chunks, level k holds the k-th chunk of those ids that need
one, a bitmap per level tells which ids go on to the next level, and a rank
directory counts the set bits before each group of 512.

Encoding: what stands between white space is cut further where an ASCII letter
or digit meets ASCII punctuation, which the tokenizer's own splitting does
anyway; distinct pieces are encoded by the library, remembered in a table of
fixed size and gathered from there.  Texts with ``<|``, which may hold a special
token, are encoded whole, and so are all texts if the vocabulary splits otherwise.

Defined results: null and empty texts hold the end id alone; rows with equal
doc_id stand together, by the hash of their texts; rows without a doc_id come
last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_table, map_batches, open_input, open_output, shared_folder, table
from .textblock import Block, blocks, byte_class, same_bytes

END_ID = 2
MAGIC = b"QDAC0002"
CHUNK = 8
#: Bits that an entry of the rank directory covers.
RANK_BITS = 512
#: Tokens after which a shard is closed; bounds what a writer or reader holds.
SHARD_TOKENS = 1 << 21
#: Tokens that a reader decodes at once, or one longer document.
READ_TOKENS = 1 << 16
#: Slots of a worker's table of pieces, and ids in its arena after which it starts anew: some 36 MB.
SLOTS, ARENA_IDS, ARENA_BYTES = 1 << 20, 1 << 22, 1 << 24
#: Bytes of text encoded at once.
BLOCK = 1 << 19
# The normalizer and splitting that the cuts below agree with; texts of other vocabularies are encoded whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_U = np.uint64
_SPACE, _LETTER, _DIGIT, _QUOTE, _MARK, _WIDE = range(6)
_KIND = np.full(256, _MARK, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _QUOTE
_KIND[128:] = _WIDE
_NOT_SPACE = byte_class([0x20, *range(0x09, 0x0E)], negate=True)
# where a piece ends between two bytes of a word: [kind of the byte before][kind of the byte after]
_CUT = np.zeros((6, 6), dtype=bool)
for _a, _b in ((_LETTER, _MARK), (_MARK, _LETTER), (_LETTER, _DIGIT), (_DIGIT, _LETTER), (_DIGIT, _DIGIT), (_DIGIT, _MARK), (_MARK, _DIGIT), (_LETTER, _QUOTE), (_DIGIT, _QUOTE)):
    _CUT[_a, _b] = True


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _cuts_apply(path: str) -> bool:
    """Whether the cuts above agree with the tokenizer's own normalizer and splitting."""
    with open(path, encoding="utf-8") as stream:
        spec = json.load(stream)
    return spec.get("normalizer") == _NORMALIZER and spec.get("pre_tokenizer") == _SPLITTING and not (spec["model"].get("dropout") or spec.get("truncation") or spec.get("padding"))


class PieceEncoder:
    """Encodes blocks of texts; remembers the ids of pieces in a table of fixed size, each at the slot of its hash."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = _cuts_apply(path)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(SLOTS, dtype=np.uint64)
        self.starts = np.zeros(SLOTS, dtype=np.int32)
        self.sizes = np.zeros(SLOTS, dtype=np.int32)
        self.arena = np.zeros(1 << 16, dtype=np.uint32)
        self.filled = 0
        # the pieces' own bytes: a slot's hash is never believed without them
        self.text_starts = np.zeros(SLOTS, dtype=np.int64)
        self.text_sizes = np.full(SLOTS, -1, dtype=np.int32)
        self.texts = np.zeros(1 << 16, dtype=np.uint8)
        self.text_filled = 0

    def _remember(self, slots: np.ndarray, raw: list[bytes]) -> None:
        sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        own = np.frombuffer(b"".join(raw), dtype=np.uint8)
        while self.text_filled + len(own) > len(self.texts):
            self.texts = np.concatenate([self.texts, np.zeros_like(self.texts)])
        self.texts[self.text_filled : self.text_filled + len(own)] = own
        self.text_starts[slots], self.text_sizes[slots] = self.text_filled + np.cumsum(sizes) - sizes, sizes
        self.text_filled += len(own)

    def _learn(self, keys: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where in the arena the ids of each new piece start, and how many they are."""
        pieces = [x.decode() for x in raw]
        many = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        sizes = np.fromiter(map(len, many), dtype=np.int32, count=len(many))
        ids = np.fromiter((i for one in many for i in one), dtype=np.uint32, count=int(sizes.sum()))
        while self.filled + len(ids) > len(self.arena):
            self.arena = np.concatenate([self.arena, np.zeros_like(self.arena)])
        self.arena[self.filled : self.filled + len(ids)] = ids
        starts = (self.filled + np.cumsum(sizes) - sizes).astype(np.int32)
        slots = keys & _U(SLOTS - 1)
        self.keys[slots], self.starts[slots], self.sizes[slots] = keys, starts, sizes
        self._remember(slots, raw)
        self.filled += len(ids)
        return starts, sizes

    def encode(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, tokens of each text); the block is lower-cased."""
        if self.filled > ARENA_IDS or self.text_filled > ARENA_BYTES:
            self._forget()
        data = block.data
        starts, ends, _ = block.spans(_NOT_SPACE)
        if len(starts):
            kind = _KIND[data]
            cut = np.zeros(len(data) + 1, dtype=bool)
            cut[1:-1] = _CUT[kind[:-1], kind[1:]]
            cut[block.offsets] = False
            head, tail = cut, cut.copy()
            head[starts], tail[ends] = True, True
            starts, ends = np.flatnonzero(head), np.flatnonzero(tail)
        owner = np.searchsorted(block.offsets, starts, side="right") - 1
        hashes = block.hashes(starts, ends)
        slots = hashes & _U(SLOTS - 1)
        at, sizes, lengths = self.starts[slots], self.sizes[slots], ends - starts
        known = (self.keys[slots] == hashes) & (self.text_sizes[slots] == lengths)
        some = np.flatnonzero(known)
        known[some] = same_bytes(data, starts[some], self.texts, self.text_starts[slots[some]], lengths[some])
        new = np.flatnonzero(~known)
        if len(new):
            _, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[first]
            alike = lengths[new] == lengths[one[back]]
            alike[alike] = same_bytes(data, starts[new[alike]], data, starts[one[back[alike]]], lengths[new[alike]])
            other = np.flatnonzero(~alike)  # another piece of the same hash
            back[other] = len(one) + np.arange(len(other))
            one = np.concatenate([one, new[other]])
            raw = data.tobytes()
            found, many = self._learn(hashes[one], [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            at[new], sizes[new] = found[back], many[back]
        sizes = sizes.astype(np.int64)
        ids = self.arena[np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        return ids, np.bincount(owner, sizes, minlength=block.n).astype(np.int64)


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, tokens of each text), each text closed by the end id."""
    worker = encoder(path)
    for row, stop, block in blocks(column, lower=worker.cuts, most=BLOCK):
        if worker.cuts:
            ids, counts = worker.encode(block)
            special = (block.data[:-1] == 60) & (block.data[1:] == 124) if len(block.data) > 1 else np.zeros(0, dtype=bool)
            whole = np.unique(np.searchsorted(block.offsets, np.flatnonzero(special), side="right") - 1).tolist()
        else:
            ids, counts, whole = np.zeros(0, dtype=np.uint32), np.zeros(block.n, dtype=np.int64), range(block.n)
        if len(whole):
            bounds = np.concatenate([[0], np.cumsum(counts)])
            parts = [ids[bounds[i] : bounds[i + 1]] for i in range(block.n)]
            for i in whole:
                parts[i] = np.array(worker.tokenizer.encode(column[row + i].as_py() or "", add_special_tokens=False).ids, dtype=np.uint32)
            counts = np.array([len(p) for p in parts], dtype=np.int64)
            ids = np.concatenate([*parts, np.zeros(0, dtype=np.uint32)]).astype(np.uint32)
        out = np.full(len(ids) + block.n, END_ID, dtype=np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(block.n), counts)] = ids
        yield row, stop, out, counts + 1


# -- the file format -------------------------------------------------------------------------------------------------


def write_shard(stream, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, nameless: int = 0) -> None:
    """Header: magic, documents, tokens, levels, how many of the last documents have no id. Then doc_ids, starts (one more), and each level: size, chunks, bitmap, ranks."""
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        words = np.zeros(-(-max(1, len(bits)) // 64) * 64, dtype=np.uint8)
        words[: len(bits)] = bits
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words.reshape(-1, RANK_BITS // 8)).sum(axis=1, dtype=np.int64))]).astype("<i8")
        levels.append(((rest & 0xFF).astype(np.uint8), words, ranks))
        rest = more[goes_on]
        if not len(rest):
            break
    stream.write(MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ids), len(levels), nameless))
    stream.write(doc_ids.astype("<i8").tobytes())
    stream.write(np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes())
    for chunks, words, ranks in levels:
        stream.write(struct.pack("<Q", len(chunks)))
        for part in (chunks, words, ranks):
            stream.write(part.tobytes())


class Shard:
    """A shard's bytes; ``tokens`` reaches any positions, in any order."""

    def __init__(self, raw: bytes | memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token shard")
        docs, self.n, levels, self.nameless = struct.unpack_from("<QQQQ", raw, 8)
        at = 40
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.starts = np.frombuffer(raw, "<i8", docs + 1, at + 8 * docs)
        at += 8 * (2 * docs + 1)
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", raw, at)
            at += 8
            room = -(-max(1, -(-size // 8)) // 64) * 64
            chunks = np.frombuffer(raw, np.uint8, size, at)
            words = np.frombuffer(raw, np.uint8, room, at + size)
            ranks = np.frombuffer(raw, "<i8", room // 64 + 1, at + size + room)
            at += size + room + 8 * (room // 64 + 1)
            self.levels.append((chunks, words, ranks))

    def tokens(self, places: np.ndarray) -> np.ndarray:
        places = np.asarray(places, dtype=np.int64)
        out = np.zeros(len(places), dtype=np.uint32)
        which = np.arange(len(places))
        for level, (chunks, words, ranks) in enumerate(self.levels):
            out[which] |= chunks[places].astype(np.uint32) << np.uint32(CHUNK * level)
            goes_on = (words[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            which, places = which[goes_on], places[goes_on]
            if not len(places):
                break
            places = self._rank(words, ranks, places)
        return out

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Set bits before each place: the directory's entry, then whole 64-bit words of the group, then bits of the last."""
        wide = words.view("<u8")
        group = places // RANK_BITS
        out = ranks[group].copy()
        word = places >> 6
        for step in range(RANK_BITS // 64 - 1):
            at = group * (RANK_BITS // 64) + step
            out += np.where(at < word, np.bitwise_count(wide[at]), 0)
        below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
        return out + np.bitwise_count(wide[word] & below)

    def document(self, i: int) -> np.ndarray:
        return self.tokens(np.arange(self.starts[i], self.starts[i + 1]))

    def checks(self) -> list[int]:
        """The crc32 of each document's ids, some documents decoded at once."""
        out: list[int] = []
        while len(out) < len(self.doc_ids):
            first = len(out)
            past = max(first + 1, int(np.searchsorted(self.starts, self.starts[first] + READ_TOKENS, side="right")) - 1)
            raw = memoryview(self.tokens(np.arange(self.starts[first], self.starts[past])).astype("<u4").tobytes())
            edges = (4 * (self.starts[first : past + 1] - self.starts[first])).tolist()
            out += [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:])]
        return out

    def names(self) -> pa.Array:
        """doc_ids, null for the last ones without an id."""
        return pa.array(self.doc_ids, mask=np.arange(len(self.doc_ids)) >= len(self.doc_ids) - self.nameless)


# -- jobs ------------------------------------------------------------------------------------------------------------

_MANIFEST = "part int, shard int, path string, n_docs long, n_tokens long"


def write_tokens(docs: DataFrame, folder: str, path: str) -> DataFrame:
    """Shards in ascending doc_id order in ``folder``; returns their manifest (part, shard, path, n_docs, n_tokens), itself a kept table."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, counts, doc_ids, size, nameless, shard = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal ids, counts, doc_ids, size, nameless, shard
            # a name of its own for each attempt; the manifest names those of attempts that ended well
            target = f"{folder}/part-{part:06d}-{shard:05d}-{uuid.uuid4().hex}.dac"
            every = np.concatenate(counts)
            with open_output(target) as stream:
                write_shard(stream, np.concatenate(doc_ids), every, np.concatenate(ids), nameless)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [target], "n_docs": [len(every)], "n_tokens": [size]})
            ids, counts, doc_ids, size, nameless, shard = [], [], [], 0, 0, shard + 1
            return row

        for batch in batches:
            unnamed = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            names = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            for row, stop, some, lengths in encoded(batch.column(1), path):
                ids.append(some)
                counts.append(lengths)
                doc_ids.append(names[row:stop])
                size += len(some)
                nameless += int(unnamed[row:stop].sum())
                if size >= SHARD_TOKENS:
                    yield close()
        if size:
            yield close()

    by = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]  # the hash splits the rows of one doc_id, or of none
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
    return keep_table(map_batches(ordered, written, _MANIFEST))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' bytes."""
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per SHARD_TOKENS tokens or partition, not per document
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with open_input(path) as stream:
                    shard = Shard(stream.read())
                yield pa.RecordBatch.from_arrays([shard.names(), pa.array(start + shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(shard.checks(), pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.select("path", "before").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return map_batches(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes all of ``docs`` and reads the files back."""
    return read_tokens(write_tokens(docs, shared_folder(docs.sparkSession), path or vocabulary_path()))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
