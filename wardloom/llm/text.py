"""Words of whole texts as 64-bit hashes, a block of bytes at a time.

A word is a longest run of bytes that are no white space (0x20, 0x09-0x0D), with A-Z lower-cased. The hash is
a polynomial over random byte values with a final mix, so equal words have equal hashes everywhere and two
different words meet with probability about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 15  # bytes hashed at once; bounds the memory for a text of any length
PIECE = 1 << 22  # bytes of the texts worked on together

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLOSING = np.zeros(256, bool)
_CLOSING[list(b".,;:!?")] = True
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have a bounded number of bytes together, or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, low = np.cumsum(lengths), 0
    while low < batch.num_rows:
        reached = (int(total[low - 1]) if low else 0) + size
        high = max(low + 1, int(np.searchsorted(total, reached, "right")))
        yield batch.slice(low, high - low)
        low = high


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    values[65:91] = values[97:123]
    return values


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_VALUES = _byte_values()
_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def _hash_block(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[raw] * _UP[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def _hash_long(raw: np.ndarray) -> int:
    """Hash of one word longer than a block, by Horner's rule over blocks."""
    total, scale = 0, 1
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        total += int((_VALUES[part] * _UP[: len(part)]).sum(dtype=np.uint64)) * scale
        scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    total = (total + len(raw)) % (1 << 64)
    return int(mix(np.array([total], np.uint64))[0])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and where each row begins (one more entry than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at -= at[0]
    if column.null_count:  # a null row has no bytes of its own in a well-formed array, but may have
        lengths = np.diff(at) * np.asarray(column.is_valid())
        if lengths.sum() != at[-1]:
            raw = np.frombuffer(b"".join((x or "").encode() if isinstance(x, str) else (x or b"") for x in column.to_pylist()), np.uint8)
            at = np.concatenate([[0], np.cumsum(lengths)])
    return raw, at


def _endings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The last two bytes of each word before a closing mark, as one number."""
    last = ends - 1
    last = last - (_CLOSING[raw[last]] & (last > starts))
    before = np.maximum(last - 1, starts)
    return _LOWER[raw[last]].astype(np.int32) * 256 + _LOWER[raw[before]]


def _beginnings(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first four bytes of each word, or as many as it has, as one number."""
    out = np.zeros(len(starts), np.uint32)
    for k in range(4):
        out = out * np.uint32(256) + np.where(starts + k < ends, _LOWER[raw[np.minimum(starts + k, len(raw) - 1)]], 0).astype(np.uint32)
    return out


def word_hashes(column: pa.Array, endings: bool = False, beginnings: bool = False) -> tuple[np.ndarray, ...]:
    """Hashes of all words of all rows in order, and where each row's words begin (one more entry than rows).

    With ``endings`` also a number below 65536 for how each word ends, with ``beginnings`` one for how it begins. Null and
    empty rows have no words.
    """
    raw, rows = _bytes_of(column)
    hashes, starts_at, ends_in, begins_in = [], [], [], []
    for low, high in _blocks(raw, rows):
        if high - low > BLOCK:  # one word longer than a block
            hashes.append(np.array([_hash_long(raw[low:high])], np.uint64))
            starts_at.append(np.array([low], np.int64))
            ends_in.append(_endings(raw, np.array([low]), np.array([high])))
            begins_in.append(_beginnings(raw, np.array([low]), np.array([high])))
            continue
        part = raw[low:high]
        space = np.ones(len(part) + 2, bool)
        space[1:-1] = _SPACE[part]
        inside = rows[np.searchsorted(rows, low, "right") : np.searchsorted(rows, high, "left")] - low
        begins = ~space[1:-1]
        ends_here = begins.copy()
        begins &= space[:-2]
        ends_here &= space[2:]
        if len(inside):  # a word also begins where a row begins
            held = inside[inside < len(part)]
            begins[held] |= ~space[held + 1]
            held = inside - 1
            ends_here[held] |= ~space[held + 1]
        starts = np.flatnonzero(begins)
        ends = np.flatnonzero(ends_here) + 1
        hashes.append(_hash_block(part, starts, ends))
        starts_at.append(starts + low)
        if endings:
            ends_in.append(_endings(part, starts, ends))
        if beginnings:
            begins_in.append(_beginnings(part, starts, ends))
    if not hashes:
        hashes, starts_at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        ends_in, begins_in = [np.zeros(0, np.int32)], [np.zeros(0, np.uint32)]
    found = [np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), rows, "left")]
    found += [np.concatenate(ends_in)] if endings else []
    return (*found, np.concatenate(begins_in)) if beginnings else tuple(found)


def _blocks(raw: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts at white space or between rows, no block longer than BLOCK unless one word is."""
    low = 0
    while low < len(raw):
        high = min(low + BLOCK, len(raw))
        if high < len(raw):
            back = np.flatnonzero(_SPACE[raw[low:high]])
            row = rows[np.searchsorted(rows, high, "right") - 1]
            cut = max(low + int(back[-1]) + 1 if len(back) else low, int(row))
            if cut == low:  # no cut in the block: go on to the end of this word
                cut, row_end = high, int(rows[np.searchsorted(rows, low, "right")])
                while cut < row_end:
                    ahead = np.flatnonzero(_SPACE[raw[cut : min(cut + BLOCK, row_end)]])
                    if len(ahead):
                        cut += int(ahead[0])
                        break
                    cut = min(cut + BLOCK, row_end)
            high = cut
        yield low, high
        low = high


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= np.uint64(_BASE)
        out += words[k : k + n]
    return mix(out)


def sequence_hash(words: np.ndarray) -> int:
    """Hash of a whole short sequence, apart from all shingle hashes of another length."""
    total = len(words)
    for w in words.tolist():
        total = (total * _BASE + w) % (1 << 64)
    return int(mix(np.array([total], np.uint64))[0])


class HashTable:
    """Rows by 64-bit key, found for whole arrays at once by linear probing."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * max(len(keys), 1)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.rows = np.full(1 << bits, -1, np.int32)
        slots, left = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]
            self.keys[at[free]] = keys[left[free]]
            left = left[self.rows[slots[left]] != left]
            slots[left] = (slots[left] + 1) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is not held."""
        if len(keys) > BLOCK:  # parts that stay in the processor's cache
            return np.concatenate([self.find(keys[at : at + BLOCK]) for at in range(0, len(keys), BLOCK)])
        slots = (keys >> self.shift).astype(np.int64)
        out = self.rows[slots]
        left = np.flatnonzero((out >= 0) & (self.keys[slots] != keys))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            at = slots[left]
            out[left] = self.rows[at]
            left = left[(out[left] >= 0) & (self.keys[at] != keys[left])]
        return out
