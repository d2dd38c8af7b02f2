"""URL filters: rules first, then exact membership of the host in a list, from a cascade of Bloom filters.

The key universe is every distinct host of the corpus.  Level 1 of the cascade
encodes the listed hosts; level 2 those unlisted hosts that level 1 lets pass by
mistake; level 3 the listed hosts that level 2 lets pass; and so on until a level
lets nothing pass by mistake.  A host of the universe is then answered exactly by
the first level that does not hold it, so pages are judged in the scan, without a
join: each level is one array of 64-bit words, which a scalar subquery gives to
the tasks.  A key sets four bits of one word, so that a level is read once.

A level is sized by the number of its keys, up to MOST_WORDS words (16 MB).  Where
more keys are listed than that suits, they are dealt into slices by a hash, each
with a cascade of its own, and each slice's pages are judged in a pass of theirs.
Only DataFrame functions are used.

Defined results: a null url, or one without ``://``, has an empty host and path and
no rule; an empty list blocks nothing; other columns, whatever their names, are
ignored; repeated rows give a row each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_table, scratch, table

#: (allow or block, host, path). Fixed values of the query's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of host names by which the query's list knows its hosts: as a label, or as a part of one between hyphens.
LISTED_WORDS = ("ads", "adult", "bet", "bets", "casino", "pills", "poker", "porn", "spam", "viagra", "xxx")
#: Bits of a level for each key, words of a level at most, and rules at most (they become one expression).
BITS_EACH, MOST_WORDS, MOST_RULES = 16, 1 << 21, 1000
#: Keys that a level of MOST_WORDS suits.
MOST_KEYS = MOST_WORDS * 64 // BITS_EACH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def listed_pattern(words: tuple[str, ...] = LISTED_WORDS) -> str:
    return f"(^|[.-])({'|'.join(words)})([.-]|$)"


def _mask(key: Column, level: int) -> Column:
    """Four of a word's bits, by 24 bits of a hash."""
    h = F.xxhash64(F.lit(2 * level + 1), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _word(key: Column, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(words)).cast("int")


class Cascade:
    """Exact membership for the keys of a universe; ``levels`` are kept tables of (word, bits), with their sizes."""

    def __init__(self, levels: list[tuple[DataFrame, int]]):
        self.levels = levels

    def _held(self, key: Column, i: int) -> Column:
        kept, words = self.levels[i]
        array = kept.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"])).scalar()
        mask = _mask(key, i)
        return F.get(array, _word(key, i, words)).bitwiseAND(mask) == mask

    def holds(self, key: Column) -> Column:
        """Whether the key, of the universe, is listed: the first level that does not hold it decides."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self._held(key, i), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def _level(keys: DataFrame, count: int, i: int) -> tuple[DataFrame, int]:
    words = max(1, -(-count * BITS_EACH // 64))
    masks = keys.select(_word(F.col("key"), i, words).alias("word"), _mask(F.col("key"), i).alias("bits"))
    unset = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    return keep_table(masks.union(unset).groupBy("word").agg(F.bit_or("bits").alias("bits"))), words


def cascade(universe: DataFrame) -> Cascade:
    """The cascade over a kept table of distinct (key string, listed boolean)."""
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    levels: list[tuple[DataFrame, int]] = []
    while count := inside.count():
        levels.append(_level(inside, count, len(levels)))
        passing = keep_table(outside.where(Cascade(levels)._held(F.col("key"), len(levels) - 1)))
        inside, outside = passing, inside
    return Cascade(levels)


def judged(pages: DataFrame, listed: Column, rules: tuple[tuple[str, str, str], ...] = RULES, most_keys: int = MOST_KEYS) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    ``listed`` tells of the column ``key``, a host, whether it is on the list; it is asked once for each distinct host.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = keep_table(parts.select(F.col("host").alias("key")).distinct().select("key", F.coalesce(listed, F.lit(False)).alias("listed")))
    keys = universe.agg(F.count_if("listed"), F.count("*")).first()
    slices = max(1, -(-max(keys[0], keys[1] // 32) // most_keys))

    host, path, rule, verdict = F.col("host"), F.col("path"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(verdict)

    def in_slice(key: str, s: int) -> Column:
        return F.pmod(F.xxhash64(F.lit("slice"), F.col(key)), F.lit(slices)) == s if slices > 1 else F.lit(True)

    passes = []
    for s in range(slices):
        found = cascade(universe.where(in_slice("key", s)))
        own = F.when(found.holds(host), F.lit("block")).otherwise(F.lit("allow"))
        passes.append(parts.where(in_slice("host", s)).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict")))
    return reduce(DataFrame.union, passes)


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as spare:
        return spare(keep_table(judged(table(spark, sf_dir, "pages"), F.col("key").rlike(listed_pattern()))))


def oracle() -> str:
    """DuckDB SQL for op12: every rule tried on every page, the list asked for each page."""
    rows = ", ".join(f"('{act}', '{host}', '{path}')" for act, host, path in RULES)
    return rf"""
    with rules(act, h, p) as (values {rows}),
    parts as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') as host,
      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
    fits as (select host, path, max_by(act, length(h || p)) as act, max_by(h || p, length(h || p)) as rule
      from (select distinct host, path from parts), rules where (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by 1, 2)
    select page_id, host, path, rule, coalesce(act, case when regexp_matches(host, '{listed_pattern()}') then 'block' else 'allow' end) as verdict
    from parts left join fits using (host, path)"""
