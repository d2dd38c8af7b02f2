"""Personal data: exact base patterns, and a linear-chain CRF over word shapes.

The base kinds (email, ip, card, phone) are leftmost non-overlapping pattern
matches over the whole text.  The CRF labels words from their shape, their
neighbours' shapes and cue words; it is trained here on a small labelled table
and decoded by Viterbi over numpy batches.  Its spans are added where no base
span stands: credentials, and base kinds that the patterns miss.

Sequences are lines.  A word is *safe* if it and both its neighbours have the
plain shape; the trained weights prove that no best labelling gives a safe word
another label than O (``Tagger.safe``), so only the stretches between safe words
are decoded, which changes no result.

Defined results: null and empty texts have no spans; other columns are ignored;
repeated rows give a result each; digit runs of any length take linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table
from .textblock import SPACED, Block, blocks

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
_EMAIL_RUN = re.compile(r"[A-Za-z0-9._%+@-]++")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match cannot begin inside a run of digits if it did not begin with the run
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches lie within runs of the pattern's characters, so only runs with an @ are searched."""
    out, at = [], text.find("@")
    while at >= 0:
        first = at
        while first > 0 and (text[first - 1].isascii() and (text[first - 1].isalnum() or text[first - 1] in "._%+-@")):
            first -= 1
        run = _EMAIL_RUN.match(text, first)
        past = run.end()
        from_ = first
        while (mark := text.find("@", from_, past)) >= 0:
            found = _EMAIL.match(text, from_) if mark > from_ else None
            if found:
                out.append(found.span())
                from_ = found.end()
            else:
                from_ = mark + 1
        at = text.find("@", past)
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    found: dict[str, list[tuple[int, int]]] = {"email": _emails(text) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found["phone"].append(m.span())
    return found


# -- word shapes -----------------------------------------------------------------------------------------------------

#: Words that tell what follows, by class.
CUES = {1: ("token", "secret", "key", "apikey", "api_key", "password", "passwd", "bearer", "auth"), 2: ("mail", "email", "e-mail", "contact"), 3: ("tel", "phone", "call", "fax", "mobile"), 4: ("card", "visa", "ip", "host", "address")}
N_CUES = 5
_RADIX = (4, 2, 2, 2, 2, 2, 4)
N_SHAPES = int(np.prod(_RADIX)) + 1
#: The shape beyond either end of a line.
EDGE = N_SHAPES - 1
_IS_DIGIT = np.zeros(256, dtype=np.int32)
_IS_DIGIT[48:58] = 1
_IS_HEX = _IS_DIGIT.copy()
_IS_HEX[97:103] = 1


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(chars)] = 1
    return out


_FLAGS = (_flag(b"@"), _flag(b"."), _flag(b"+()"), _flag(b"=_"))


def shapes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A shape number for each word: digits (none, few, half, all but marks), hex, @, inner dots, plus or brackets, = or _, length."""

    def within(wanted: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(block.data) + 1, dtype=np.int32)
        np.cumsum(wanted[block.data], out=sums[1:])
        return sums[ends] - sums[starts]

    length = (ends - starts).astype(np.int32)
    digits = within(_IS_DIGIT)
    share = np.where(digits == 0, 0, np.where(digits * 3 < length, 1, np.where(digits * 5 < length * 3, 2, 3)))
    hexed = (within(_IS_HEX) * 10 >= length * 8) & (digits > 0) & (length >= 16)
    dots = within(_FLAGS[1])
    parts = (share, hexed, within(_FLAGS[0]) > 0, (dots >= 3) & (digits >= 4), within(_FLAGS[2]) > 0, within(_FLAGS[3]) > 0, np.digitize(length, (4, 12, 24)) * ((digits > 0) | (length >= 24)))
    number = np.zeros(len(starts), dtype=np.int64)
    for part, radix in zip(parts, _RADIX, strict=True):
        number = number * radix + part
    return number


PLAIN = 0


def cue_classes(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), dtype=np.int64)
    hashes = block.hashes(starts, ends)
    for kind, known in _cue_hashes().items():
        out[np.isin(hashes, known)] = kind
    return out


_CUE_HASHES: dict[int, np.ndarray] = {}


def _cue_hashes() -> dict[int, np.ndarray]:
    if not _CUE_HASHES:
        for kind, words in CUES.items():
            raw = [w + end for w in words for end in ("", ":", "=")]
            for _, _, block in blocks(pa.array([" ".join(raw)]), lower=True):
                s, e, _ = block.spans(SPACED)
                _CUE_HASHES[kind] = block.hashes(s, e)
    return _CUE_HASHES


def features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text index, line number, feature rows) of the words of a lower-cased block.

    A feature row: shape, shape before, shape after, cue among the two words before.
    """
    starts, ends, owner = block.spans(SPACED)
    shape, cue = shapes(block, starts, ends), cue_classes(block, starts, ends)
    breaks = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum(block.data == 10, out=breaks[1:])
    line = breaks[starts] + owner  # lines of different texts differ: owner grows between them
    before, after, cued = np.full(len(shape), EDGE), np.full(len(shape), EDGE), np.zeros(len(shape), dtype=np.int64)
    if len(shape) > 1:
        same = line[1:] == line[:-1]
        before[1:][same], after[:-1][same] = shape[:-1][same], shape[1:][same]
        cued[1:][same] = cue[:-1][same]
        same2 = line[2:] == line[:-2]
        older = cued[2:] == 0
        cued[2:][same2 & older] = cue[:-2][same2 & older]
    return starts, ends, owner, line, np.column_stack([shape, before, after, cued])


# -- the labelled table ----------------------------------------------------------------------------------------------


def labelled_table(rows: int = 500, seed: int = 11) -> list[list[tuple[str, str]]]:
    """A small labelled table: lines of (word, label), made by rule from a seed."""
    random = np.random.default_rng(seed)
    syllables = ["ba", "con", "de", "er", "fi", "gar", "hol", "in", "ka", "lu", "mo", "nen", "or", "pra", "st", "ti", "un", "ver", "zu"]

    def digits(n: int) -> str:
        return "".join(map(str, random.integers(0, 10, n)))

    def word() -> str:
        made = "".join(random.choice(syllables, random.integers(1, 5)))
        return made + str(random.choice(["", "", "", ",", ".", "!!", "***", ";", "?"]))

    def hexes(n: int) -> str:
        return "".join(random.choice(list("0123456789abcdef"), n))

    def email() -> list[tuple[str, str]]:
        return [(f"{word().strip('.,!*;?')}.{digits(2)}@{random.choice(['mail', 'post', 'x'])}{digits(1)}.example.{random.choice(['com', 'org'])}", "email")]

    def ip() -> list[tuple[str, str]]:
        return [(".".join(str(i) for i in random.integers(0, 256, 4)), "ip")]

    def card() -> list[tuple[str, str]]:
        return [(digits(16), "card")] if random.random() < 0.6 else [(digits(4), "card") for _ in range(4)]

    def phone() -> list[tuple[str, str]]:
        return [(f"+{random.integers(1, 99)}", "phone"), (f"({digits(3)})", "phone"), (f"{digits(3)}-{digits(4)}", "phone")]

    def secret() -> list[tuple[str, str]]:
        value = hexes(int(random.choice([24, 32, 40, 64])))
        lead = [(str(random.choice(["token", "secret", "api_key", "password"])), "O"), ("=", "O")] if random.random() < 0.8 else []
        return [*lead, (f'"{value}"' if random.random() < 0.7 else value, "secret")]

    def harmless() -> list[tuple[str, str]]:
        kind = random.integers(0, 7)
        made = [digits(int(random.integers(1, 6))), f"{digits(1)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(2)}.{digits(1)}", f"{word()}{digits(2)}", "".join(word().strip(".,!*;?") for _ in range(10)), f"{word().strip('.,!*;?')}_{word().strip('.,!*;?')}"][kind]
        return [(made, "O")]

    table_rows = []
    for i in range(rows):
        row = [(word(), "O") for _ in range(random.integers(1, 9))]
        for make in random.choice([email, ip, card, phone, secret, harmless], random.integers(0, 3)):
            row += [*make(), *[(word(), "O") for _ in range(random.integers(0, 6))]]
        if random.random() < 0.15:
            row += [(str(random.choice([c for k in CUES.values() for c in k])), "O"), *[(word(), "O") for _ in range(random.integers(0, 4))]]
        table_rows.append(row)
    return table_rows


class Tagger:
    """Linear-chain CRF: emission weights by feature value, transitions, start and end weights."""

    def __init__(self, rows: list[list[tuple[str, str]]], rounds: int = 90, rate: float = 0.3, decay: float = 0.02):
        sizes = [N_SHAPES, N_SHAPES, N_SHAPES, N_CUES]
        self.base = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        n, k = len(LABELS), sum(sizes)
        column = pa.array([" ".join(w for w, _ in row) for row in rows])
        parts = [features(b)[2:] for _, _, b in blocks(column, lower=True, most=1 << 30)]
        owner, _, rows_of = parts[0]
        longest = int(np.bincount(owner).max())
        x = np.zeros((len(rows), longest, 4), dtype=np.int64)
        y = np.zeros((len(rows), longest), dtype=np.int64)
        live = np.zeros((len(rows), longest), dtype=bool)
        for i, row in enumerate(rows):
            mine = rows_of[owner == i]
            x[i, : len(mine)], live[i, : len(mine)] = mine + self.base, True
            y[i, : len(mine)] = [LABELS.index(label) for _, label in row]
        weights = [np.zeros((k, n)), np.zeros((n, n)), np.zeros(n), np.zeros(n)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        for step in range(1, rounds + 1):
            slope = self._slope(weights, x, y, live)
            for w, g, m, v, d in zip(weights, slope, first, second, (decay, 100 * decay, 100 * decay, 100 * decay), strict=True):
                g = g - d * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) / (1 + step / 60)
        self.emit, self.move, self.begin, self.finish = weights
        self.safe = self._proves_safe()

    @staticmethod
    def _slope(weights, x, y, live):
        """Gradient of the conditional log-likelihood, by forward and backward sums over padded rows."""
        emit, move, begin, finish = weights
        n, longest = y.shape
        score = emit[x].sum(axis=2)
        lens = live.sum(axis=1)
        ahead = np.zeros((n, longest, len(begin)))
        ahead[:, 0] = begin + score[:, 0]
        for t in range(1, longest):
            step = ahead[:, t - 1, :, None] + move
            top = step.max(axis=1, keepdims=True)
            ahead[:, t] = np.log(np.exp(step - top).sum(axis=1)) + top[:, 0] + score[:, t]
        back = np.zeros_like(ahead)
        ends = np.arange(n), lens - 1
        back[ends] = finish
        for t in range(longest - 2, -1, -1):
            step = move + (score[:, t + 1] + back[:, t + 1])[:, None, :]
            top = step.max(axis=2, keepdims=True)
            value = np.log(np.exp(step - top).sum(axis=2)) + top[:, :, 0]
            inner = t < lens - 1
            back[inner, t] = value[inner]
        last = ahead[ends] + finish
        top = last.max(axis=1)
        whole = np.log(np.exp(last - top[:, None]).sum(axis=1)) + top
        belief = np.exp(ahead + back - whole[:, None, None]) * live[:, :, None]
        gold = np.eye(len(begin))[y] * live[:, :, None]
        change = gold - belief
        slopes = [np.zeros_like(emit), np.zeros_like(move), change[:, 0].sum(axis=0), change[ends].sum(axis=0)]
        for f in range(x.shape[2]):
            np.add.at(slopes[0], x[:, :, f][live], change[live])
        for t in range(1, longest):
            on = live[:, t]
            pair = ahead[on, t - 1, :, None] + move + (score[on, t] + back[on, t])[:, None, :] - whole[on, None, None]
            slopes[1] -= np.exp(pair).sum(axis=0)
            np.add.at(slopes[1], (y[on, t - 1], y[on, t]), 1)
        return slopes

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return self.emit[rows + self.base].sum(axis=1)

    def _proves_safe(self) -> bool:
        """O beats any label at a plain word between plain words by more than two transitions can give back."""
        sides = np.array([[PLAIN, a, b, c] for a in (PLAIN, EDGE) for b in (PLAIN, EDGE) for c in range(N_CUES)])
        score = self.scores(sides)
        margin = (score[:, 0] - score[:, 1:].max(axis=1)).min()
        steps = np.concatenate([self.move.ravel(), self.begin, self.finish])
        return bool(margin > 2 * (steps.max() - steps.min()))

    def decode(self, rows: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Labels of all words; rows of one line stand together."""
        labels = np.zeros(len(rows), dtype=np.int64)
        sides = (PLAIN, EDGE)
        if self.safe:
            open_ = ~((rows[:, 0] == PLAIN) & np.isin(rows[:, 1], sides) & np.isin(rows[:, 2], sides))
        else:
            open_ = np.ones(len(rows), dtype=bool)
        at = np.flatnonzero(open_)
        if not len(at):
            return labels
        new = np.ones(len(at), dtype=bool)
        new[1:] = (np.diff(at) != 1) | (line[at[1:]] != line[at[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        score = self.scores(rows[at])
        order = np.argsort(sizes, kind="stable")
        low = 0
        while low < len(order):
            high = min(len(order), low + max(1, (1 << 16) // max(1, int(sizes[order[low]]))))
            while high - low > 1 and int(sizes[order[high - 1]]) * (high - low) > 1 << 18:
                high = low + (high - low) // 2
            self._viterbi(score, at, heads[order[low:high]], sizes[order[low:high]], rows, labels)
            low = high
        return labels

    def _viterbi(self, score, at, heads, sizes, rows, labels) -> None:
        longest = int(sizes.max())
        place = np.minimum(heads[:, None] + np.arange(longest), (heads + sizes - 1)[:, None])
        first, last = rows[at[heads]], rows[at[heads + sizes - 1]]
        best = score[place[:, 0]] + np.where((first[:, 1] == EDGE)[:, None], self.begin, self.move[0])
        from_ = np.zeros((longest, len(heads), len(LABELS)), dtype=np.int8)
        ending = np.where((last[:, 2] == EDGE)[:, None], self.finish, self.move[:, 0])
        for t in range(1, longest):
            step = best[:, :, None] + self.move
            from_[t] = step.argmax(axis=1)
            on = (t < sizes)[:, None]
            best = np.where(on, step.max(axis=1) + score[place[:, t]], best)
        now = (best + ending).argmax(axis=1)
        every = np.arange(len(heads))
        for t in range(longest - 1, -1, -1):
            on = t < sizes
            labels[at[place[on, t]]] = now[on]
            if t:
                now = np.where(on, from_[t, every, now], now)


_TAGGERS: dict[int, Tagger] = {}


def tagger() -> Tagger:
    """The tagger of the standard table, trained once per process; the same everywhere."""
    if not _TAGGERS:
        _TAGGERS[0] = Tagger(labelled_table())
    return _TAGGERS[0]


# -- spans -----------------------------------------------------------------------------------------------------------

_TRIM = "\"'`()[]{}<>,;:!?.*$%&#|="
_ENOUGH = {"email": re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]"), "ip": re.compile(r"(?:[0-9]+\.){3}[0-9]"), "card": re.compile(r"(?:[0-9][ -]?){13}"), "phone": re.compile(r"(?:[0-9][ ().-]*){9}"), "secret": re.compile(r"[^\s]{16}")}


def _overlaps(spans: list[tuple[int, int]], first: int, past: int) -> bool:
    return any(a < past and first < b for a, b in spans)


def tagged_spans(text: str, found: list[tuple[str, int, int]], base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """The method's spans (code points), trimmed of marks, where no base span stands."""
    taken = [s for spans in base.values() for s in spans]
    out: dict[str, list[tuple[int, int]]] = {}
    for kind, first, past in found:
        part = text[first:past]
        first += len(part) - len(part.lstrip(_TRIM))
        past -= len(part) - len(part.rstrip(_TRIM))
        if first < past and _ENOUGH[kind].search(text[first:past]) and (kind != "card" or _luhn(_NOT_DIGIT.sub("", text[first:past]))) and not _overlaps(taken, first, past):
            out.setdefault(kind, []).append((first, past))
    return out


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans.get(kind, [])))


def block_tags(block: Block, model: Tagger) -> dict[int, list[tuple[str, int, int]]]:
    """By text: (kind, first, past) in code points of runs of words with one label."""
    starts, ends, owner, line, rows = features(block)
    labels = model.decode(rows, line)
    at = np.flatnonzero(labels)
    out: dict[int, list[tuple[str, int, int]]] = {}
    if not len(at):
        return out
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (labels[at[1:]] != labels[at[:-1]]) | (line[at[1:]] != line[at[:-1]])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    chars = np.zeros(len(block.data) + 1, dtype=np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=chars[1:])
    for head, tail in zip(at[heads].tolist(), at[tails].tolist(), strict=True):
        text = int(owner[head])
        zero = chars[block.offsets[text]]
        out.setdefault(text, []).append((LABELS[labels[head]], int(chars[starts[head]] - zero), int(chars[ends[tail]] - zero)))
    return out


def personal_data(docs: DataFrame, labelled: list[list[tuple[str, str]]] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points, end exclusive), n_secret, has_personal_data; one row per row of ``docs``.

    ``labelled`` is the table to train on, lines of (word, label); by default ``labelled_table``.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger() if labelled is None else Tagger(labelled))  # weights of some thousand features: a fixed size

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, block in blocks(batch.column(1), lower=True):
                tags = block_tags(block, model.value)
                counts, base_text, all_text, counted = [], [], [], []
                for i in range(block.n):
                    text = batch.column(1)[row + i].as_py() or ""
                    base = base_spans(text)
                    more = tagged_spans(text, tags.get(i, []), base)
                    counts.append([len(base[k]) for k in KINDS[:4]])
                    counted.append(len(base.get("secret", [])) + len(more.get("secret", [])))
                    base_text.append(joined(base))
                    all_text.append(joined({k: base.get(k, []) + more.get(k, []) for k in KINDS}))
                numbers = np.array(counts, dtype=np.int64).reshape(-1, 4)
                digests = [hashlib.sha256(b.encode()).hexdigest() for b in base_text]
                secrets = np.array(counted, dtype=np.int64)
                some = np.array([bool(t) for t in all_text], dtype=bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), *[pa.array(numbers[:, j]) for j in range(4)], pa.array(digests, pa.string()), pa.array(all_text, pa.string()), pa.array(secrets), pa.array(some)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_secret", "has_personal_data"])

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(wanted, found, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, has_personal_data boolean")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
