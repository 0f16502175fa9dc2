"""Vectorised word scanning and hashing over the raw bytes of Arrow string columns.

A document's words are runs of word bytes; every word gets a 64-bit hash from differences of
one running polynomial sum, so no Python object is made per word. All callers work on groups
of documents of about ``GROUP`` bytes, whatever the size of an Arrow batch; a longer document
is hashed piece by piece.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP = 1 << 19
STRIP = 1 << 15
LONG_WORD = 256

_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_WINDOW = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
LETTERS[0x41:0x5B] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit. Works in place on uint64."""
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def _power(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(lane)
    if have is None or len(have[0]) < n:
        size = max(n, GROUP + 1)
        base = _BASES[lane]
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64)))) for b in (np.uint64(base), np.uint64(inverse)))
        have = _powers[lane] = (up, down)
    return have


def running_sums(buf: np.ndarray, lane: int) -> np.ndarray:
    """What ``hash_spans`` takes differences of; callers that hash spans of one buffer twice compute it once."""
    up, _ = _power(lane, len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    for k in range(0, len(buf), STRIP):  # a strip's numbers stay in the processor's cache
        values = buf[k : k + STRIP].astype(np.uint64)
        values += np.uint64(1)
        values *= up[k : k + len(values)]
        values[:1] += sums[k : k + 1]
        np.cumsum(values, out=sums[k + 1 : k + 1 + len(values)])
    return sums


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int, sums: np.ndarray | None = None) -> np.ndarray:
    if sums is None:
        sums = running_sums(buf, lane)
    _, down = _power(lane, len(buf) + 1)
    out = sums[ends] - sums[starts]
    out *= down[starts]
    lengths = (ends - starts).astype(np.uint64)
    out += lengths * np.uint64(_WINDOW[lane])
    mix(out)
    for i in np.flatnonzero(ends - starts > LONG_WORD):  # sums of powers are weak on long inputs
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def spans(buf: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; no word goes across a position of ``cuts``."""
    inside = word[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = cuts[(cuts > 0) & (cuts < len(buf))]
    first[at] = inside[at]
    last[at - 1] = inside[at - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def text_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data bytes and offsets (int64) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


_kept: dict[str, dict] = {}


def kept(operator: str) -> dict:
    """What a worker keeps between tasks of one operator (models, automata, word tables).

    Workers outlive stages, so one operator's things go when another operator starts.
    """
    if operator not in _kept:
        _kept.clear()
        _powers.clear()
        settle()
        _kept[operator] = {}
    return _kept[operator]


def settle() -> None:
    """Gives freed memory back to the system: workers live long, and large arrays come and go."""
    pa.default_memory_pool().release_unused()
    try:
        _libc().malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@functools.cache
def _libc() -> ctypes.CDLL:
    return ctypes.CDLL("libc.so.6")


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets from 0) of consecutive rows that have about GROUP bytes together."""
    data, offsets = text_parts(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + GROUP, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    settle()


def pieces(buf: np.ndarray, word: np.ndarray) -> Iterator[np.ndarray]:
    """A long document in parts of about GROUP bytes that end between words."""
    at = 0
    while at < len(buf):
        end = at + GROUP
        while end < len(buf):
            gap = np.flatnonzero(~word[buf[end : end + GROUP]])
            if len(gap):
                end += int(gap[0])
                break
            end += GROUP
        yield buf[at:end]
        at = min(end, len(buf))


def word_hashes(buf: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED, lower: bool = False, lanes: int = 1) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words per document of a group, and a hash of each word by lane."""
    if len(offsets) == 2 and len(buf) > 4 * GROUP:
        parts = [word_hashes(x, np.array([0, len(x)]), word, lower, lanes) for x in pieces(buf, word)]
        return sum(p[0] for p in parts), [np.concatenate([p[1][k] for p in parts]) for k in range(lanes)]
    if lower:
        buf = LOWER[buf]
    starts, ends = spans(buf, offsets, word)
    counts = np.diff(np.searchsorted(starts, offsets))
    return counts, [hash_spans(buf, starts, ends, k) for k in range(lanes)]


def window_hashes(hashes: np.ndarray, width: int, lane: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes (across documents too: mask them)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    factor = np.uint64(_WINDOW[lane])
    for k in range(1, width):
        out *= factor
        out += hashes[k : k + n]
    return mix(out)


def whole_windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start as a word of the group) of each window that lies in one document."""
    each = np.maximum(counts - width + 1, 0)
    begin = np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), each)
    within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return doc, begin[doc] + within


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of ``starts``."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + width, n), -1)
    return np.cumsum(marks[:n]) > 0


def shingle_sets(counts: np.ndarray, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by document: (document, hash), sorted by both.

    A document with fewer words, but not none, has its whole sequence as its one shingle.
    """
    doc, start = whole_windows(counts, width)
    wide = window_hashes(hashes, width)[start] if len(start) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        begin = (np.cumsum(counts) - counts)[short]
        own = np.empty(len(short), np.uint64)
        for i, (d, b) in enumerate(zip(short, begin)):
            part = hashes[b : b + counts[d]]
            own[i] = window_hashes(np.concatenate((part, np.array([len(part)], np.uint64))), len(part) + 1)[0]
        doc, wide = np.concatenate((doc, short)), np.concatenate((wide, own))
    order = np.lexsort((wide, doc))
    doc, wide = doc[order], wide[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (wide[1:] != wide[:-1])
    return doc[keep], wide[keep]
