"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of every test item.  Training words are
streamed through it; at each word it knows the longest run ending there that
some item holds.  A run of at least ten words, or a whole shorter item, is a
hit.  Words are looked up by vectorised tests first: only stretches in which
each neighbouring pair of words stands in some item reach the automaton, which
changes no result.

The automaton is bounded: items are dealt into blocks of at most
``BLOCK_OF_ITEMS`` bytes of text, one broadcast automaton each.  With more than one
block the texts are still read once: a bitmap of all items' pairs of words picks the
stretches that may hold a hit of any, and the automata stream only these.

Defined results: null and empty texts have no words and no hits; items without
words match nothing; the windows of items without an item_id hit, but such items
are neither counted nor listed; each row of documents
has a result of its own, whatever its doc_id and the number of blocks; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, map_batches, table
from .textblock import ALNUM, Block, blocks, mix, windows

WINDOW = 10
#: Bits of the bitmap by which many blocks of items share one pass over the texts (32 MB to each worker at most).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
_RUN = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of item text in one automaton. Measured at 2 MB: 460 MB while the driver builds it, some 30 MB as arrays.
BLOCK_OF_ITEMS = 2 << 20


class SuffixAutomaton:
    """Over sequences of word numbers; each state also knows which items hold its window."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        self.length, self.link, self.edges = [0], [-1], [{}]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        self.holders: list[set[str | None]] = [set() for _ in self.length]
        #: By state: whole items of fewer words than a window, as (words, item).
        self.short: list[list[tuple[int, str | None]]] = [[] for _ in self.length]
        for name, words in items:
            state = 0
            for word in words:
                state = self.edges[state][word]
                up = state
                while up > 0 and name not in self.holders[up] and self.length[up] >= window:
                    self.holders[up].add(name)
                    up = self.link[up]
            if 0 < len(words) < window:
                while self.length[self.link[state]] >= len(words):
                    state = self.link[state]
                self.short[state].append((len(words), name))
        # the nearest state up the links, itself included, that ends a short item
        self.next_short = [0] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.next_short[state] = state if self.short[state] else self.next_short[self.link[state]]

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.edges.append(edges)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the shorter runs that reach it over ``state``."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.edges[target]))
        self.link[target] = copy
        while state >= 0 and self.edges[state].get(word) == target:
            self.edges[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.edges[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._new(self.length[last] + 1, 0, {})
        state = last
        while state >= 0 and word not in self.edges[state]:
            self.edges[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.edges[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def flat(self) -> FlatAutomaton:
        return FlatAutomaton(self)


class FlatAutomaton:
    """A built automaton as numpy arrays, which is what workers get: edges by state and word, holders and short items by state."""

    def __init__(self, built: SuffixAutomaton):
        self.window = built.window
        self.length, self.link, self.next_short = (np.array(x, dtype=np.int32) for x in (built.length, built.link, built.next_short))
        many = np.array([len(e) for e in built.edges])
        self.edge_at = np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        words = np.fromiter((w for e in built.edges for w in e), dtype=np.int32, count=int(many.sum()))
        targets = np.fromiter((t for e in built.edges for t in e.values()), dtype=np.int32, count=int(many.sum()))
        order = np.lexsort((words, np.repeat(np.arange(len(many)), many)))
        self.edge_word, self.edge_target = words[order], targets[order]
        self.names = sorted({name for held in built.holders for name in held if name is not None} | {name for ends in built.short for _, name in ends if name is not None})
        number = {name: i for i, name in enumerate(self.names)} | {None: -1}
        self.holder_at = np.concatenate([[0], np.cumsum([len(h) for h in built.holders])]).astype(np.int64)
        self.holder = np.array([number[name] for held in built.holders for name in held], dtype=np.int32)
        self.short_at = np.concatenate([[0], np.cumsum([len(x) for x in built.short])]).astype(np.int64)
        self.short_size = np.array([size for ends in built.short for size, _ in ends], dtype=np.int32)
        self.short_name = np.array([number[name] for ends in built.short for _, name in ends], dtype=np.int32)

    def _step(self, state: int, word: int) -> int:
        low, high = self.edge_at[state], self.edge_at[state + 1]
        at = low + np.searchsorted(self.edge_word[low:high], word)
        return int(self.edge_target[at]) if at < high and self.edge_word[at] == word else 0

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """(hit spans of word positions, items of which a window occurs)."""
        state = matched = 0
        spans, found = [], set()
        for at, word in enumerate(words):
            to = self._step(state, word)
            while not to and state:
                state = int(self.link[state])
                matched = int(self.length[state])
                to = self._step(state, word)
            if not to:
                continue
            state = to
            matched += 1
            if matched >= self.window:
                spans.append((at + 1 - matched, at + 1))
                up = state
                while self.length[self.link[up]] >= self.window:
                    up = int(self.link[up])
                found.update(self.holder[self.holder_at[up] : self.holder_at[up + 1]].tolist())
            up = int(self.next_short[state])
            while up:
                for k in range(self.short_at[up], self.short_at[up + 1]):
                    if self.short_size[k] <= matched:
                        spans.append((at + 1 - int(self.short_size[k]), at + 1))
                        found.add(int(self.short_name[k]))
                up = int(self.next_short[self.link[up]])
        return spans, {self.names[i] for i in found if i >= 0}


class Detector:
    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        named, hashes = [], []
        column = pa.array([text for _, text in items], pa.string())
        for row, _, block in blocks(column, lower=True):
            starts, ends, owner = block.spans(ALNUM)
            every = block.hashes(starts, ends)
            for i in range(block.n):
                named.append(items[row + i][0])
                hashes.append(every[owner == i])
        together = np.concatenate([*hashes, np.zeros(0, dtype=np.uint64)])
        whose = np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
        self.vocabulary = np.unique(together)
        self.pairs = np.unique(windows(together, whose, 2)[0])
        self.short = {k: np.unique(np.concatenate([windows(x, np.zeros(k, dtype=int), k)[0] for x in hashes if len(x) == k])) for k in sorted({len(x) for x in hashes}) if 0 < k < window}
        self.automaton = SuffixAutomaton([(n, np.searchsorted(self.vocabulary, h).tolist()) for n, h in zip(named, hashes, strict=True)], window).flat()

    def _stretches(self, hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        return _stretches(hashes, owner, self.window, list(self.short), lambda k, keys: _among(keys, self.short[k] if k else self.pairs))

    def block(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, set[str]], dict[int, list[tuple[int, int]]]]:
        """(word starts, word ends, words of each text; by text with hits: items, merged word spans)."""
        starts, ends, owner = block.spans(ALNUM)
        hashes = block.hashes(starts, ends)
        counts = block.counts(owner)
        items: dict[int, set[str]] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        maybe = np.flatnonzero(self._stretches(hashes, owner)) if len(hashes) else np.zeros(0, dtype=int)
        if len(maybe):
            firsts = np.cumsum(counts) - counts
            cuts = np.flatnonzero((np.diff(maybe) != 1) | (np.diff(owner[maybe]) != 0)) + 1
            for part in np.split(maybe, cuts):
                text = int(owner[part[0]])
                at, found = self.automaton.stream(np.searchsorted(self.vocabulary, hashes[part]).tolist())
                if at:
                    shift = int(part[0] - firsts[text])
                    spans.setdefault(text, []).extend((a + shift, b + shift) for a, b in at)
                    items.setdefault(text, set()).update(found)
        return starts, ends, counts, items, {k: merged(v) for k, v in spans.items()}


def _stretches(hashes: np.ndarray, owner: np.ndarray, window: int, short: list[int], has) -> np.ndarray:
    """Words that may belong to a hit: in runs of pairs that items hold as long as a window's, or of a whole short item. ``has(k, keys)`` tells of runs of k words; 0 stands for pairs."""
    edge = np.zeros(len(hashes) + 1, dtype=np.int32)
    keys, at = windows(hashes, owner, 2)
    if window > 1 and len(keys):
        at = at[has(0, keys)]
        heads = np.flatnonzero(np.diff(at, prepend=-9) != 1)
        runs = np.diff(np.append(heads, len(at)))
        long = runs >= window - 1
        np.add.at(edge, at[heads[long]], 1)
        np.add.at(edge, at[heads[long]] + runs[long] + 1, -1)
    for k in short:
        keys, at = windows(hashes, owner, k)
        at = at[has(k, keys)]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(keys), dtype=bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def detectors(benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_OF_ITEMS) -> Iterator[Detector]:
    """One detector for each block of items; the size of the table decides their number."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) // (block_bytes // 2 if total > block_bytes else block_bytes)))
    for part in range(parts):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield Detector([(r["item_id"], r["text"]) for r in mine.collect()], window)


_FOUND = "doc_id long, n_words long, spans array<struct<first:long,past:long>>, items array<string>"


def _find(docs: DataFrame, detector: Detector) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(detector)  # of at most BLOCK_OF_ITEMS bytes of items

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        for batch in batches:
            for row, stop, block in blocks(batch.column(1), lower=True):
                _, _, counts, items, spans = shared.value.block(block)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, stop - row), pa.array(counts), pa.array([[{"first": a, "past": b} for a, b in spans.get(i, [])] for i in range(block.n)], span), pa.array([sorted(items.get(i, ())) for i in range(block.n)], pa.list_(pa.string()))],
                    ["doc_id", "n_words", "spans", "items"],
                )

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), found, _FOUND)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``docs`` kept with a key of their own, which all passes then read, and the key's name."""
    key = "row_key"
    while any(c.lower().startswith(key) for c in docs.columns):
        key += "_"
    return keep_table(docs.withColumn(key, F.monotonically_increasing_id())), key


def _places(k: int, keys: np.ndarray, bits: int) -> np.ndarray:
    return (mix(keys + np.uint64(k) * _RUN) % np.uint64(bits)).astype(np.int64)


def _run_bitmap(benchmark: DataFrame, window: int) -> tuple[np.ndarray, list[int]]:
    """A bitmap of all items' pairs and whole short items, or-ed together by Spark, and the sizes of those; at most 32 MB."""
    texts = benchmark.select(F.col("text").cast("string").alias("text"))
    bytes_ = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * int(bytes_)).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0), lower=True):
                starts, ends, owner = block.spans(ALNUM)
                hashes, counts = block.hashes(starts, ends), block.counts(owner)
                found = [(0, windows(hashes, owner, 2)[0])]
                for k in sorted({int(n) for n in counts if 0 < n < window}):
                    mine = counts[owner] == k
                    found.append((k, windows(hashes[mine], owner[mine], k)[0]))
                for k, keys in found:
                    at = np.unique(_places(k, keys, bits))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["k", "word", "bits"])

    rows = map_batches(texts, slots, "k int, word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"), F.collect_set("k").alias("ks"))
    out, sizes = np.zeros(bits // 64, dtype=np.uint64), set()
    for batch in rows.toArrow().to_batches():  # as many rows as the bitmap has words, at most
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view(np.uint64)
        sizes.update(batch.column(2).flatten().unique().to_pylist())
    return out, sorted(sizes - {0})


_PARTS = "doc_id long, n_words long, parts array<struct<first:long,words:binary>>"


def _stretched(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words and the stretches that may hold a hit of any item, as their words' hashes; kept.

    The one pass over the texts: what the blocks of items look at further is only this, which is little.
    """
    bitmap, short = _run_bitmap(benchmark, window)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        kind = pa.list_(pa.struct([("first", pa.int64()), ("words", pa.binary())]))

        def has(k: int, keys: np.ndarray) -> np.ndarray:
            at = _places(k, keys, 64 * len(known))
            return (known[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

        for batch in batches:
            for row, stop, block in blocks(batch.column(1), lower=True):
                starts, ends, owner = block.spans(ALNUM)
                hashes, counts = block.hashes(starts, ends), block.counts(owner)
                parts: list[list] = [[] for _ in range(block.n)]
                maybe = np.flatnonzero(_stretches(hashes, owner, window, short, has)) if len(hashes) else np.zeros(0, dtype=int)
                if len(maybe):
                    firsts = np.cumsum(counts) - counts
                    for part in np.split(maybe, np.flatnonzero((np.diff(maybe) != 1) | (np.diff(owner[maybe]) != 0)) + 1):
                        text = int(owner[part[0]])
                        parts[text].append({"first": int(part[0] - firsts[text]), "words": hashes[part].tobytes()})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(counts), pa.array(parts, kind)], ["doc_id", "n_words", "parts"])

    return keep_table(map_batches(rows.select("doc_id", "text"), found, _PARTS))


def _find_in(stretches: DataFrame, detector: Detector) -> DataFrame:
    """doc_id, spans and items of a block of items in the kept stretches; rows without a hit are left out."""
    shared = stretches.sparkSession.sparkContext.broadcast(detector)  # of at most BLOCK_OF_ITEMS bytes of items

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        span = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
        for batch in batches:
            ids, spans, items = [], [], []
            for doc_id, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine: list[tuple[int, int]] = []
                held: set[str] = set()
                for part in parts:
                    words = np.frombuffer(part["words"], dtype=np.uint64)
                    numbers = np.where(_among(words, model.vocabulary), np.searchsorted(model.vocabulary, words), -1)
                    at, names = model.automaton.stream(numbers.tolist())
                    mine += [(a + part["first"], b + part["first"]) for a, b in at]
                    held |= names
                if mine:
                    ids.append(doc_id)
                    spans.append([{"first": a, "past": b} for a, b in merged(mine)])
                    items.append(sorted(held))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], ["doc_id", "spans", "items"])

    rows = stretches.where("size(parts) > 0").select("doc_id", "parts")
    return map_batches(rows, found, "doc_id long, spans array<struct<first:long,past:long>>, items array<string>")


def _found_over_blocks(rows: DataFrame, benchmark: DataFrame, each: Iterator[Detector], window: int) -> DataFrame:
    """What ``_find`` gives, over all blocks of items; rows with a unique doc_id. The texts are read once."""
    stretches = _stretched(rows, benchmark, window)
    every = None
    for detector in each:
        found = _find_in(stretches, detector)
        every = found if every is None else every.unionByName(found)
    joined = every.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = """aggregate(array_sort(spans), cast(array() as array<struct<first:bigint,past:bigint>>),
        (done, s) -> case when size(done) > 0 and element_at(done, -1).past >= s.first
            then concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first, 'past', greatest(element_at(done, -1).past, s.past))))
            else concat(done, array(s)) end)"""
    whole = stretches.select("doc_id", "n_words").join(joined.withColumn("spans", F.expr(union)), "doc_id", "left")
    none = {"spans": "array<struct<first:bigint,past:bigint>>", "items": "array<string>"}
    return whole.select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in none.items()])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_OF_ITEMS) -> DataFrame:
    """doc_id, n_words, spans (merged word spans that items hold), items (ids, sorted as strings); one row per row of ``docs``."""
    each = detectors(benchmark, window, block_bytes)
    first, second = next(each), next(each, None)
    if second is None:
        return _find(docs, first)
    kept, key = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = _found_over_blocks(kept.select(F.col(key).alias("doc_id"), "text"), benchmark, chain([first, second], each), window)
    return kept.select(key, "doc_id").join(found.withColumnRenamed("doc_id", key), key).drop(key)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.0, block_bytes: int = BLOCK_OF_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, without benchmark passages.

    A document of which more than ``most_coverage`` of the words are hit goes;
    from the others the hit words and what stands between them are cut.
    """
    place = docs.columns.index("text")
    each = detectors(benchmark, window, block_bytes)
    first, second = next(each), next(each, None)
    if second is None:
        return _cut(docs, docs.sparkSession.sparkContext.broadcast(first), place, most_coverage)
    kept, key = _keyed(docs)
    found = _found_over_blocks(kept.select(F.col(key).alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark, chain([first, second], each), window).where("size(spans) > 0")
    hits = found.select(F.col("doc_id").alias(key), F.expr("aggregate(spans, 0L, (n, s) -> n + s.past - s.first)").alias("n_hit"), "n_words", "spans")
    hits = hits.select(key, (F.col("n_hit") <= F.lit(most_coverage) * F.col("n_words")).alias(f"{key}_stays"), F.col("spans").alias(f"{key}_spans"))
    judged = kept.join(hits, key, "left").where(F.coalesce(F.col(f"{key}_stays"), F.lit(True))).drop(key, f"{key}_stays")
    return _cut_found(judged, docs, place)


def _without(text: str, spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> str:
    """A text without its words of the spans and what stands between them; ``starts`` and ``ends`` are the bytes of its words."""
    raw, at, kept = text.encode(), 0, []
    for a, b in spans:
        kept.append(raw[at : int(starts[a])])
        at = int(ends[b - 1])
    return b"".join([*kept, raw[at:]]).decode()


def _cut_found(judged: DataFrame, docs: DataFrame, place: int) -> DataFrame:
    """The columns of ``docs``, the spans of the last column cut from the texts."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    for _, _, block in blocks(pa.array([texts[i]], pa.string()), lower=True):
                        starts, ends, _ = block.spans(ALNUM)
                        texts[i] = _without(texts[i], [(s["first"], s["past"]) for s in spans], starts, ends)
            columns = list(batch.columns)[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return map_batches(judged, clean, docs.schema)


def _cut(docs: DataFrame, shared, place: int, most_coverage: float) -> DataFrame:
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, stays = [], []
            for row, _, block in blocks(batch.column(place), lower=True):
                starts, ends, counts, _, spans = shared.value.block(block)
                firsts = np.cumsum(counts) - counts
                for i in range(block.n):
                    text = batch.column(place)[row + i].as_py()
                    hit = spans.get(i, [])
                    stays.append(not hit or sum(b - a for a, b in hit) <= most_coverage * counts[i])
                    if hit and stays[-1]:
                        mine = slice(firsts[i], firsts[i] + counts[i])
                        text = _without(text, hit, starts[mine] - block.offsets[i], ends[mine] - block.offsets[i])
                    texts.append(text)
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(stays, pa.bool_()))

    return map_batches(docs, clean, docs.schema)


def op6_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.past - s.first)")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
