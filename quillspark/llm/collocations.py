"""Phrase collocations: n-gram counts from word-id suffix arrays, scored by how well a phrase holds together.

Texts are cut into pieces at punctuation and line ends and into words between
blanks.  A shard is a run of half a million words of one language.  Its words get
ids, exactly, by their bytes; prefix doubling sorts the shard's suffixes by their
first 1, 2 and 4 words, never past the end of a piece.  In that order phrases of
k words are the intervals whose neighbours share k words, so that one pass over
the common prefix lengths counts all phrases of each length.  The counts of all
shards are summed by Spark under the phrase itself.

This is done twice.  The first pass counts words and phrases of two.  A phrase is
never more frequent than a part of it, so the second pass, over phrases of three
and four, leaves out those that hold a pair below the least count; it knows the
pairs by a bitmap sized by their number, and a pair that the bitmap holds by
mistake only costs a row.

Scores are integers in decimals of 38 digits.  Defined results: a null text is
empty, a null language is ``und``; repeated rows count each time; a text without
words adds nothing; a piece of any length is split among shards, whose last words
look three words ahead; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep_table, map_batches, scratch, table
from .textblock import LOWER, byte_class, mix, text_array

#: A phrase's least count and most words, the share (in hundredths) of its places that a longer phrase takes over, and phrases of a language.
LEAST, LONGEST, TAKEN_OVER, PHRASES = 30, 4, 80, 2000
#: Words of a shard, and bytes of text gathered for one.
SHARD_WORDS, SHARD_BYTES = 1 << 19, 3 << 20
#: Buckets in which a language's phrases are ranked before they meet.
RANK_BUCKETS = 32
#: Bits of the bitmap of frequent pairs for each, at least and at most (32 MB to each worker).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28

#: [.,;:!?\x0A-\x0D] ends a piece, [\x20\x09] a word.
_ENDS = byte_class(b".,;:!?\x0a\x0b\x0c\x0d")
_WORD = ~(_ENDS | byte_class(b" \t"))
_COUNTS = "lang string, words int, phrase string, f long"


def words_of(texts: pa.Array) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words of the texts, lower-cased, and the number of the piece of each."""
    texts = text_array(texts)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = LOWER[np.frombuffer(raw, dtype=np.uint8)[ends[0] : ends[-1]]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    inside = _WORD[data]
    cut = _ENDS[data]
    heads = ends[:-1][np.diff(ends) > 0] - ends[0]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    first[heads] = inside[heads]
    last[:-1] &= ~inside[1:]
    last[heads[1:] - 1] = inside[heads[1:] - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    pieces = np.cumsum(cut, dtype=np.int64)[starts] + np.searchsorted(heads, starts, side="right")
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes())), pieces


def _ranks(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Dense ranks, from 1, of pairs."""
    key = high.astype(np.int64) << 32 | low
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), dtype=np.int64)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_order(ids: np.ndarray, room: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first ``longest`` (2 or 4) words, and how many words each shares with the one before, up to that.

    ``room`` is the number of words from each to its piece's end, itself included; what lies beyond sorts first.
    """
    rank, width = ids.astype(np.int64) + 1, 1
    while width < longest:
        after = np.zeros(len(ids), dtype=np.int64)
        if width < len(ids):
            after[:-width] = np.where(room[:-width] > width, rank[width:], 0)
        rank, width = _ranks(rank, after), 2 * width
    order = np.argsort(rank, kind="stable")
    shared = np.zeros(len(ids), dtype=np.int64)
    a, b = order[1:], order[:-1]
    alike = np.ones(len(a), dtype=bool)
    for k in range(longest):
        x, y = np.minimum(a + k, len(ids) - 1), np.minimum(b + k, len(ids) - 1)
        alike &= (room[a] > k) & (room[b] > k) & (ids[x] == ids[y])
        shared[1:] += alike
    return order, shared


def intervals(order: np.ndarray, shared: np.ndarray, room: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """A place and the count of each phrase of k words; only places below ``own`` count."""
    fits = room[order] >= k
    group = np.cumsum((shared < k) & fits)
    counted = fits & (order < own)
    counts = np.bincount(group[counted], minlength=0)
    at, first = np.unique(group[counted], return_index=True)
    return order[counted][first], counts[at]


def _pair_places(pairs: pa.Array, langs: str, bits: int) -> np.ndarray:
    """A bit for each pair of a language: its bytes folded eight at a time into a hash."""
    pairs = pairs.cast(pa.large_string())
    ends = np.frombuffer(pairs.buffers()[1], dtype=np.int64)[pairs.offset : pairs.offset + len(pairs) + 1]
    sizes = np.diff(ends)
    data = np.frombuffer(pairs.buffers()[2], dtype=np.uint8) if len(pairs) and pairs.buffers()[2] else np.zeros(0, np.uint8)
    seed = np.uint64(int.from_bytes(langs.encode()[:8].ljust(8, b"\0"), "little"))
    h = mix(sizes.astype(np.uint64) + seed)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    step = np.arange(8)
    for i in range(0, int(sizes.max(initial=0)), 8):
        live = np.flatnonzero(sizes > i)
        eight = padded[np.minimum(ends[live, None] + i + step, len(padded) - 1)]
        eight = np.where(i + step < sizes[live, None], eight, 0).astype(np.uint64)
        h[live] = mix(h[live] ^ (eight << (8 * step).astype(np.uint64)).sum(axis=1, dtype=np.uint64))
    return (h % np.uint64(bits)).astype(np.int64)


def _phrases(words: pa.Array, at: np.ndarray, k: int) -> pa.Array:
    if k == 1:
        return words.take(pa.array(at))
    return pc.binary_join_element_wise(*(words.take(pa.array(at + i)) for i in range(k)), pa.scalar(" ", pa.large_string()))


def _shard_counts(lang: str, words: pa.Array, pieces: np.ndarray, own: int, lengths: tuple[int, ...], frequent: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    coded = words.dictionary_encode()
    ids, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    at_end = np.append(np.flatnonzero(np.diff(pieces)), len(pieces) - 1)
    room = at_end[np.searchsorted(at_end, np.arange(len(pieces)))] - np.arange(len(pieces)) + 1
    order, shared = suffix_order(ids, room, 2 if max(lengths) <= 2 else 4)
    if frequent is not None:
        at, _ = intervals(order, shared, room, 2, len(ids))
        places = _pair_places(_phrases(words, at, 2), lang, 64 * len(frequent))
        good = (frequent[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1
        # whether the pair that starts at each place is among the frequent
        pair_of = np.zeros(len(ids), dtype=bool)
        fits = room[order] >= 2
        pair_of[order[fits]] = good[np.cumsum((shared < 2) & fits)[fits] - 1]
    for k in lengths:
        at, f = intervals(order, shared, room, k, own)
        if frequent is not None:
            keep = np.logical_and.reduce([pair_of[at + i] for i in range(k - 1)])
            at, f = at[keep], f[keep]
        phrases = _phrases(known, ids[at], 1) if k == 1 else _phrases(words, at, k)
        for i in range(0, len(at), 1 << 17):
            n = len(at[i : i + (1 << 17)])
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(k, pa.int32()), n), phrases[i : i + n].cast(pa.string()), pa.array(f[i : i + n], pa.int64())], ["lang", "words", "phrase", "f"])


def _counted(docs: DataFrame, lengths: tuple[int, ...], frequent=None, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, f) of each shard; with lengths from 1, also the number of words as phrases of 0 words."""
    longest = max(lengths)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = frequent.value if frequent is not None else None
        held: dict[str, list[pa.Array]] = {}
        sizes: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            words, pieces = words_of(pa.concat_arrays(held.pop(lang)))
            sizes.pop(lang)
            if 1 in lengths and len(words):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([0], pa.int32()), pa.array([""]), pa.array([len(words)], pa.int64())], ["lang", "words", "phrase", "f"])
            for i in range(0, len(words), shard_words):
                stop = min(len(words), i + shard_words)
                ahead = min(len(words), stop + longest - 1)
                yield from _shard_counts(lang, words[i:ahead], pieces[i:ahead], stop - i, lengths, pairs)

        for batch in batches:
            langs, texts = batch.column(0).fill_null("und"), text_array(batch.column(1))
            for lang in pc.unique(langs).to_pylist():
                own = texts.filter(pc.equal(langs, lang))
                held.setdefault(lang, []).append(own)
                sizes[lang] = sizes.get(lang, 0) + own.nbytes
            while sum(sizes.values()) > shard_bytes:
                yield from flush(max(sizes, key=sizes.get))
        for lang in list(held):
            yield from flush(lang)

    return map_batches(docs.select("lang", "text"), shards, _COUNTS)


def _pair_bitmap(pairs: DataFrame):
    """The broadcast bitmap of frequent pairs, or-ed together by Spark."""
    count = pairs.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, count * BITS_EACH) - 1).bit_length()))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                at = _pair_places(batch.column(1).filter(pc.equal(batch.column(0), lang)), lang, bits)
                yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.left_shift(np.uint64(1), (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    rows = map_batches(pairs.select("lang", "phrase"), slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    found = np.zeros(bits // 64, dtype=np.uint64)
    found[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return pairs.sparkSession.sparkContext.broadcast(found)


def phrase_counts(docs: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of 1 to 4 words with f of at least ``least``, and of words 0, whose f is the language's n."""
    def summed(found: DataFrame) -> DataFrame:
        return keep_table(found.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= least)))

    short = summed(_counted(docs, (1, 2), None, shard_words, shard_bytes))
    pairs = _pair_bitmap(short.where("words = 2"))
    return short.unionByName(summed(_counted(docs, (3, 4), pairs, shard_words, shard_bytes)))


def collocations(docs: DataFrame, least: int = LEAST, most: int = PHRASES, shard_words: int = SHARD_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``most`` phrases."""
    counts = keep_table(phrase_counts(docs, least, shard_words, shard_bytes))
    parts = F.split("phrase", " ")
    candidates = counts.where("words >= 2").select("lang", "words", "phrase", parts.alias("w"), F.col("f").alias("a"))
    side = counts.where("words between 1 and 3").select("lang", "phrase", "f")

    longer = candidates.where("words > 2").select("lang", F.col("a").alias("f"), "w", F.explode(F.expr("flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1), i -> struct(i, k))))")).alias("at"))
    inside = longer.select("lang", F.array_join(F.slice("w", F.col("at.i"), F.col("at.k")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = candidates.join(inside, ["lang", "phrase"], "left").where(f"most is null or 100 * cast(most as decimal(20, 0)) < {TAKEN_OVER} * cast(a as decimal(20, 0))").drop("most")

    cuts = kept.select("lang", "phrase", "words", "w", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("head", F.array_join(F.slice("w", 1, F.col("k")), " ")).withColumn("tail", F.array_join(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k")), " ")).drop("w", "words")
    cuts = cuts.join(side.toDF("lang", "head", "l"), ["lang", "head"]).join(side.toDF("lang", "tail", "r"), ["lang", "tail"])
    cuts = cuts.withColumn("score", F.expr("(cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0))) div (cast(l as decimal(20, 0)) + r)"))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # a language may be most of the phrases: the first of each of its buckets come first, and only those meet
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    dealt = best.withColumn("_bucket", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)))
    first = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_place") <= most).drop("_place", "_bucket")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = first.withColumn("rank", place.cast("long")).where(F.col("rank") <= most)
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as spare:
        return spare(keep_table(collocations(table(spark, sf_dir, "documents"))))


def oracle() -> str:
    """DuckDB SQL for op13: every phrase of every piece, grouped."""
    return rf"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
    worded as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
    totals as (select lang, sum(len(w))::bigint as n from worded group by 1),
    placed as (select lang, w, unnest(range(1, len(w) + 1)) as i from worded),
    grams as (select lang, list_slice(w, i, i + k - 1) as g, count(*) as f from placed, range(1, 5) ks(k) where i + k - 1 <= len(w) group by 1, 2 having count(*) >= {LEAST}),
    candidates as (select lang, g, len(g) as k, f as a from grams where len(g) >= 2),
    inner_parts as (select lang, list_slice(g, i, i + k - 1) as g, max(a) as most from (select lang, g, a, unnest(range(2, len(g))) as k from candidates), range(1, 4) starts(i) where i + k - 1 <= len(g) group by 1, 2),
    kept as (select c.* from candidates c left join inner_parts p using (lang, g) where p.most is null or 100 * p.most::hugeint < {TAKEN_OVER} * c.a::hugeint),
    cuts as (select c.lang, c.g, c.a, j as k, l.f as l, r.f as r, 2000000 * c.a::hugeint // (l.f + r.f) as score
      from (select *, unnest(range(1, k)) as j from kept) c join grams l on l.lang = c.lang and l.g = list_slice(c.g, 1, j) join grams r on r.lang = c.lang and r.g = list_slice(c.g, j + 1, c.k)),
    best as (select * from cuts qualify row_number() over (partition by lang, g order by score, k) = 1),
    ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank, array_to_string(g, ' ') as phrase, a, l, r, score from best)
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n, score::bigint as score from ranked join totals using (lang) where rank <= {PHRASES}"""
