"""Vectorised word and line arithmetic over blocks of whole texts.

A block is a run of UTF-8 texts laid end to end in one byte array.  Words,
lines and their 64-bit hashes come from a handful of numpy passes, with no
Python object per word.  Every word class used here is a set of bytes: code
points above 0x7F are encoded with bytes above 0x7F only, so a byte table and
a code point class select the same words.

Nulls count as empty texts.  Results do not depend on how rows are grouped
into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporary arrays of a worker.
BLOCK_BYTES = 1 << 19

_U = np.uint64
_STEP, _SEED = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
#: What is left of eight bytes read from a span's last 0 to 8 bytes on.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def byte_class(chars: bytes | range | list[int], negate: bool = False) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return ~table if negate else table


#: [^\x20\x09-\x0D]+
SPACED = byte_class([0x20, *range(0x09, 0x0E)], negate=True)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text)
ALNUM = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)], negate=True)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _further(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(span, place) of the second and further eight bytes of spans that have some."""
    more = (sizes - 1) // 8
    owner = np.repeat(np.arange(len(sizes)), more)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1


def same_bytes(data: np.ndarray, starts: np.ndarray, other: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of ``data`` and of ``other``, of the same sizes, hold the same bytes."""
    a, b = eight_bytes(data), eight_bytes(other)
    same = (a[starts] ^ b[at]) & _MASKS[np.minimum(sizes, 8)] == 0
    long = np.flatnonzero(same & (sizes > 8))
    if len(long):
        owner, place = _further(sizes[long])
        i = long[owner]
        differ = (a[starts[i] + 8 * place] ^ b[at[i] + 8 * place]) & _MASKS[np.minimum(sizes[i] - 8 * place, 8)] != 0
        same[i[differ]] = False
    return same


class Block:
    """Texts laid end to end: ``data`` uint8, ``offsets`` int64 (one more than texts)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets.astype(np.int64)
        self.n = len(offsets) - 1

    def spans(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, text index) of the maximal runs of bytes in the class; none crosses texts."""
        size = len(self.data)
        if not size:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        inside = table[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = self.offsets[:-1][np.diff(self.offsets) > 0]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[heads[1:] - 1] = inside[heads[1:] - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, the same wherever the span stands.

        Each eight bytes are mixed with their place in the span before they are added, so that bytes that change
        places change the sum; spans of one length of up to eight bytes never share a hash.
        """
        eights, sizes = eight_bytes(self.data), ends - starts
        out = mix(eights[starts] & _MASKS[np.minimum(sizes, 8)])
        long = np.flatnonzero(sizes > 8)
        if len(long):
            owner, place = _further(sizes[long])
            at = long[owner]
            found = mix((eights[starts[at] + 8 * place] & _MASKS[np.minimum(sizes[at] - 8 * place, 8)]) ^ mix(place.astype(np.uint64) * _STEP))
            out[long] += np.add.reduceat(found, np.flatnonzero(place == 1))
        return mix(out + sizes.astype(np.uint64) * _SEED)

    def counts(self, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, minlength=self.n).astype(np.int64)


def words(block: Block, table: np.ndarray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The maximal runs of bytes in the class themselves, and the index of each one's text."""
    starts, ends, owner = block.spans(table)
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(block.data[table[block.data]].tobytes())), owner


def windows(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of the first word) of all k consecutive words of the same text."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(owner[:m] == owner[k - 1 :])
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(k):
        out = out * _U(0x9DDFEA08EB382D69 | 1) + hashes[at + j]
    return mix(out + _U(k)), at


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A string column with nulls as empty texts and 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def blocks(column: pa.Array, lower: bool = False, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, Block) over a string column; a text over ``most`` bytes has a block to itself."""
    column = text_array(column)
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + most, side="right")) - 1)
        stop = min(stop, len(column))
        yield row, stop, Block(data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], lower)
        row = stop
