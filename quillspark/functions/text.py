"""Column functions over text."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slots of the hashed term space.
TERM_SLOTS = 30_000


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and decimal digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")


def slot_of(term: str) -> str:
    """SQL for the slot of a column: FNV-1a of the UTF-8 bytes, modulo the slots."""
    return f"""pmod(aggregate(transform(sequence(1, octet_length({term})), i -> cast(conv(substr(hex(encode({term}, 'UTF-8')), 2*i-1, 2), 16, 10) as bigint)),
        cast(2166136261 as bigint), (a, b) -> pmod((a ^ b) * 16777619, 4294967296)), {TERM_SLOTS})"""


@lru_cache(maxsize=100_000)
def slot_number(term: str) -> int:
    """``slot_of`` a word, in Python."""
    h = 2166136261
    for byte in term.encode():
        h = (h ^ byte) * 16777619 & 0xFFFFFFFF
    return h % TERM_SLOTS


def term_hash(term: str) -> Column:
    """A column's slot; takes its name."""
    return F.expr(slot_of(term))


def snippet(text: Column, most: int = 240) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def name_key(name: Column) -> Column:
    """Letters and digits only, lower-cased: names that differ in marks are one."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{Nd}]", ""))


def slug(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-"))


def mostly_numeric(text: Column) -> Column:
    """Whether letters are under 40 percent of the text, in whole percents."""
    return F.floor(F.regexp_count(text, F.lit(r"\p{L}")) * 100 / F.length(text)) < 40
