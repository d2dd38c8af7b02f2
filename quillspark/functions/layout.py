"""Column functions over headings, names and the texts of layout blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Categories of headings and the words that decide them, first match wins; anything else is a Rule.
CATEGORIES = (
    ("Spell", ("spell",)),
    ("Monster", ("monster", "bestiary", "creature", "aberration", "beast", "celestial", "dragon", "elemental", "fey", "fiend", "giant", "humanoid", "monstrosit", "ooze", "plant", "undead", "npc", "nonplayer character")),
    ("Item", ("equipment", "gear", "weapon", "armor", "armour", "magic item")),
    ("Class", ("class", "barbarian", "bard", "cleric", "druid", "fighter", "monk", "paladin", "ranger", "rogue", "sorcerer", "warlock", "wizard")),
    ("Trait", ("feat", "trait", "personality")),
    ("Background", ("background",)),
    ("Race", ("race", "species")),
    ("Condition", ("condition",)),
    ("God", ("god", "deity", "deities", "pantheon")),
    ("Plane", ("plane", "cosmology", "multiverse")),
    ("Treasure", ("treasure", "loot", "hoard")),
    ("Encounter", ("encounter", "dungeon")),
    ("Trap", ("trap",)),
    ("Lore", ("lore", "history", "world")),
    ("Combat", ("combat", "attack")),
    ("Adventuring", ("adventuring", "exploration", "resting", "travel", "adventure environment")),
)
# What a category is often mistaken for, what is always offered, and the record type of a category.
CONFUSED = {"Monster": ("Race", "Spell", "Item"), "Race": ("Monster",), "Class": ("Rule",), "Item": ("Treasure",)}
FREQUENT = ("Monster", "Spell", "Item", "Class")
RECORD_TYPES = {"Spell": "Spell", "Monster": "Monster", "Class": "Class", "Race": "Race", "Background": "Background", "Item": "Item", "Condition": "Condition", "God": "God", "Plane": "Plane", "Treasure": "MagicItem", "Trap": "Trap"}
# Words kept small in titles, and acronyms.
SMALL_WORDS = ("a", "an", "the", "and", "but", "or", "for", "nor", "on", "at", "to", "in", "of", "as")
ACRONYMS = ("NPC", "NPCs", "PC", "PCs", "DM", "GP", "SP", "CP", "PP", "EP", "XP", "HP", "AC", "DC", "CR", "AoE", "D&D")
# Short words that stand alone in a heading in capitals.
ALONE = frozenset("A I OF TO IN ON AT BY OR AN AS IT IS BE DO NO SO UP WE XP HP AC DC CR GP SP CP EP PP D4 D6 D8 D10 D12 D20".split())
# Patterns of stat blocks, items and headings.
STAT_LINE = r"(?is)\s+(Tiny|Small|Medium|Large|Huge|Gargantuan)\s+(aberration|beast|celestial|construct|dragon|elemental|fey|fiend|giant|humanoid|monstrosity|ooze|plant|undead|swarm)\b.*$"
SIZE_LINE = r"(?i)^\s*(tiny|small|medium|large|huge|gargantuan)\s+[a-z]"
ITEM_HEADER = r"(?i)\b(weapon|armou?r|ring|rod|staff|wand|potion|scroll|wondrous)\b[^.\n]{0,40}?,\s*(common|uncommon|rare|very rare|legendary|artifact)\b"
OBJECT_SIZE = r"(?i)\b(tiny|small|medium|large|huge|gargantuan)\s+object\b"
WEAPON_DAMAGE = r"(?i)\d*d\d+\s+(slashing|piercing|bludgeoning)"
COST = r"(?i)\b\d+\s?(gp|sp)\b"
NOT_NAMES = (
    r"(?i)^step\s+\d+\b", r"(?i)^challenge\s+\d", r"(?i)^creating\b|\bfeatures$", r"(?i)^appendix", r"(?i)\blair\s*$",
    r"(?i)^(armou?r\s+class|hit\s+points|speed|saving\s+throws|skills|senses|languages|damage\s+(immunities|resistances|vulnerabilities)|condition\s+immunities)\b",
    r"(?i)^(effects\s+of\b|variant\b)", r"(?i)^(actions|reactions|traits|bonus actions|legendary actions|lair actions|regional effects)$",
)
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth|thirteenth|fourteenth|fifteenth|sixteenth|seventeenth|eighteenth|nineteenth|twentieth"
LEVEL_GATES = (rf"\b(?:starting\s+at|beginning\s+at|at|when\s+you\s+reach)\s+(\d{{1,2}}(?:st|nd|rd|th)?|{ORDINALS})\s+level\b", r"\b(\d{1,2}(?:st|nd|rd|th))-level\b")
INLINE_TAG = r"\{@\w+\s+([^}|]+)(\|[^}]*)?\}"


def heading_category(title: Column) -> Column:
    low = F.lower(title)
    out = F.lit(None).cast("string")
    for name, words in reversed(CATEGORIES):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return F.coalesce(out, F.lit("Rule"))


def category_prior(category: Column) -> Column:
    """The category, what it is mistaken for, and what is always offered; each once."""
    confused = F.array().cast("array<string>")
    for name, others in CONFUSED.items():
        confused = F.when(category == name, F.array(*map(F.lit, others))).otherwise(confused)
    return F.array_distinct(F.concat(F.array(category), confused, F.array(*map(F.lit, FREQUENT))))


def record_type(category: Column) -> Column:
    """The type of record that a category's sections give; null for none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair]), category)


def type_prior(category: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(category_prior(category), record_type), lambda t: t.isNotNull()))


def all_capitals(name: Column) -> Column:
    return (F.length(name) > 1) & (name == F.upper(name)) & name.rlike(r"\p{L}")


def scanning_marks(name: Column) -> Column:
    """Whether a name looks misread: all capitals, a letter split off, dots in a row, or case that changes twice in a word."""
    runs = lambda w: F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(w, r"[^\p{L}]", ""), r"\p{Lu}+", "1"), r"[^1]+", "0"))
    mixed = F.exists(F.split(name, "[ -]"), lambda w: runs(w) >= 3)
    return F.coalesce(all_capitals(name) | name.rlike("(?i)(?:^| )[a-z] [a-z]") | name.rlike(r"\.{3,}") | mixed, F.lit(False))


def title_case(name: Column) -> Column:
    """Capitals at each word, also after hyphens; small words stay small but the first, acronyms stay as they are."""
    known = F.create_map(*[F.lit(x) for a in ACRONYMS for x in (a.lower(), a)])

    def word(w: Column, first: Column) -> Column:
        head = F.regexp_extract(w, r"^([^A-Za-z0-9]*)", 1)
        core = F.regexp_extract(w, r"^[^A-Za-z0-9]*(.*?)[^A-Za-z0-9]*$", 1)
        tail = F.substring(w, F.length(head) + F.length(core) + 1, F.length(w))
        low = F.lower(core)
        made = F.coalesce(F.try_element_at(known, low), F.when(~first & low.isin(*SMALL_WORDS), low), F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, F.length(low))))
        return F.when(core == "", w).otherwise(F.concat(head, made, tail))

    parts = F.transform(F.split(name, " "), lambda part, i: F.array_join(F.transform(F.split(part, "-"), lambda w, j: word(w, (i == 0) & (j == 0))), "-"))
    return F.array_join(parts, " ")


def without_stat_line(name: Column) -> Column:
    """The name without a size and kind line run into it."""
    cut = F.trim(F.regexp_replace(name, STAT_LINE, ""))
    return F.when(cut == "", name).otherwise(F.when(name.rlike(STAT_LINE), cut).otherwise(name))


def has(text: Column, phrase: str) -> Column:
    return F.lower(text).contains(phrase)


def complete_stat_block(text: Column) -> Column:
    return has(text, "armor class") & has(text, "hit points") & has(text, "challenge")


def object_stat_block(text: Column) -> Column:
    return has(text, "armor class") & has(text, "hit points") & ~has(text, "challenge") & text.rlike(OBJECT_SIZE)


def magic_item(text: Column) -> Column:
    return has(text, "requires attunement") | has(text, "wondrous item") | text.rlike(ITEM_HEADER)


def plain_item(text: Column) -> Column:
    return text.rlike(WEAPON_DAMAGE) | (has(text, "armor class") & text.rlike(COST))


def level_progression(text: Column) -> Column:
    """Whether features are gained at two levels or more."""
    found = F.concat(*[F.transform(F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(1)), F.lower) for p in LEVEL_GATES])
    return F.size(F.array_distinct(found)) >= 2


def name_like(name: Column) -> Column:
    n = F.trim(name)
    out = n.rlike(r"\p{L}") & ~n.rlike(r"^\p{Nd}")
    for pattern in NOT_NAMES:
        out = out & ~n.rlike(pattern)
    return F.coalesce(out, F.lit(False))


def without_markup(text: Column) -> Column:
    """``{@tag text|source}`` becomes text."""
    return F.regexp_replace(text, INLINE_TAG, "$1")


def despaced(heading: str | None) -> str | None:
    """A heading in capitals whose words came apart, put together.

    Words are taken from the left. One or two letters that are no word join what follows, and what stands before too if
    that ends in their first letter; at the end they join what stands before. A letter that may be a word joins a word
    that was put together after it.
    """
    if not heading or any(c.islower() for c in heading) or not any(c.isalpha() for c in heading):
        return heading
    rest = [(word, False) for word in reversed(heading.split())]
    if len(rest) < 2:
        return heading
    done: list[tuple[str, bool]] = []
    while rest:
        word, made = rest.pop()
        if len(word) > 2 or not word.isalpha() or word in ALONE or not (rest or done):
            done.append((word, made))
            continue
        before = done.pop()[0] if done and (not rest or done[-1][0][-1] == word[0]) else ""
        rest.append((before + word + (rest.pop()[0] if rest else ""), True))
    whole: list[str] = []
    for word, made in done:
        if made and whole and len(whole[-1]) == 1 and whole[-1] in ALONE:
            whole[-1] += word
        else:
            whole.append(word)
    return " ".join(whole)


def semantic_chunks(text: str, most: int) -> list[str]:
    """Blocks of a text packed into chunks of ``most`` tokens (four characters each); blocks end at blank lines, before headings and tables."""
    tokens = lambda s: len(s) // 4
    if tokens(text) <= most:
        return [text]
    lines, blocks = text.split("\n"), [[]]
    ruled = [_table_rule(line) for line in lines[1:]] + [False]
    for line, table_next in zip(lines, ruled, strict=True):
        if line.startswith(("## ", "### ")) or table_next or not line.strip():
            blocks.append([])
        if line.strip():
            blocks[-1].append(line)
    sized: list[str] = []
    for block in ("\n".join(b) for b in blocks if b):
        for piece in block.split("\n") if tokens(block) > most else [block]:
            wide = 4 * most if len(piece) > 4 * most and tokens(block) > most else max(1, len(piece))
            sized += [piece[k : k + wide] for k in range(0, len(piece), wide)]
    out: list[list[str]] = [[]]
    filled = 0
    for piece in sized:
        if out[-1] and filled + tokens(piece) > most:
            out.append([])
            filled = 0
        out[-1].append(piece)
        filled += tokens(piece)
    return [c for c in ("\n".join(b) for b in out) if c.strip()]


def _table_rule(line: str) -> bool:
    body = line.rstrip()
    return len(body) > 2 and body[0] == "|" == body[-1] and not body[1:-1].strip("-| ")


def column_of(function, returns: str):
    """A column function, in Arrow batches, of a function of one string; nulls stay null."""

    @F.pandas_udf(returns)
    def batches(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda x: None if x is None else function(x))

    return batches


_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.I | re.S)
_CELL = re.compile(r"<t[hd]\b[^>]*>(.*?)</t[hd]>", re.I | re.S)
_SCORE = re.compile(r"\b(STR|DEX|CON|INT|WIS|CHA)\b\s*\d")


def table_cells(markup: str) -> list[list[str]] | None:
    """Rows of cells of a table's markup, the column names first; None for under two columns or rows, or a scrap of ability scores."""
    rows = [[" ".join(html.unescape(re.sub(r"<[^>]+>", " ", c)).split()) for c in _CELL.findall(r)] for r in _ROW.findall(markup)]
    rows = [r for r in rows if r]
    scores = sum(bool(_SCORE.search(c)) for r in rows for c in r)
    if len(rows) < 2 or len(rows[0]) < 2 or (len(rows) == 2 and scores >= 3):
        return None
    return rows


# How spell schools, levels and stat lines read once scanned.
_SCHOOL = re.compile(r"abjurati[ao]n|conjuration|divination|enchantment|evocation|illusion|necromancy|transmutation", re.I)
_LEVEL = re.compile(r"\d.{0,4}leve", re.I)
_CANTRIP = re.compile(r"\bca[l]*[nl]trip\b", re.I)
_LEVEL_WORD = re.compile(r"\b(ca[l]*[nl]trip|lst|ist)\b", re.I)
_STAT = re.compile(r"^\s*(Casting Time|Range|Components|Duration|At Higher Levels|Ritual|Concentration)\b", re.I)


def _told_level(text: str) -> bool:
    return bool(_LEVEL.search(text) or _SCHOOL.search(text) or _CANTRIP.search(text))


def _name_before_level(text: str) -> str:
    """What stands before a spell's level and school."""
    digit, word, cantrip = re.search(r"\d", text), _LEVEL_WORD.search(text), _CANTRIP.search(text)
    if digit:
        return text[: min(digit.start(), word.start()) if word else digit.start()].strip()
    if cantrip:
        last = next((m for m in reversed(list(_SCHOOL.finditer(text, 0, cantrip.start()))) if not text[m.end() : cantrip.start()].strip()), None)
        return text[: last.start() if last else cantrip.start()].strip()
    return text[: word.start()].strip() if word else text.strip()


class Promoter:
    """Turns a book's layout blocks, in order, into items: spell names become headings, stat lines in headings become text, and ``X TRAITS`` the race's name."""

    def __init__(self) -> None:
        self.last: str | None = None
        self.seen: set[str] = set()

    @staticmethod
    def _key(name: str) -> str:
        return "".join(c for c in name.lower() if c.isalnum())

    def _heading(self, name: str, level: int) -> tuple[str, str, int]:
        self.last = self._key(name)
        self.seen.add(self.last)
        return ("section_header", name, level)

    def _promoted(self, name: str) -> list[tuple[str, str, int]]:
        key = self._key(name)
        return [self._heading(name, 2)] if 2 <= len(name) <= 40 and key and key != self.last else []

    def items(self, kind: str, text: str | None, level: int | None, markup: str | None, before: str | None, after: str | None) -> list[tuple[str, str, int | None]]:
        text = (text or "").strip()
        if kind.lower() == "table" and (markup or "").strip():
            return [("table", text, None)]
        if not text:
            return []
        out: list[tuple[str, str, int | None]] = []
        first = text.split("\n")[0]
        if not level and len(text) <= 90 and _told_level(text) and "casting time" in (after or "").lower():
            out += self._promoted(_name_before_level(text) or _name_before_level(before or ""))
        if level:
            if _STAT.search(text):
                return [*out, ("text", text, None)]
            race = text[:-7].strip() if len(text) <= 40 and text.upper().endswith(" TRAITS") else ""
            if race and self._key(race) and self._key(race) not in self.seen:
                return [*out, self._heading(race, level)]
            name = _name_before_level(text) if not text.upper().endswith(" TRAITS") and len(text) <= 90 and _told_level(text) else ""
            return [*out, self._heading(name or text, level)]
        if kind.lower() == "text":
            casts = "casting time" in text.lower()
            if (casts and _told_level(text[:60])) or (not casts and len(first) <= 55 and _told_level(first)):
                out += self._promoted(_name_before_level(first))
            out.append(("text", text, None))
        return out
