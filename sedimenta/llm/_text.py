"""Vectorised text primitives shared by the operators: Arrow slices, word and n-gram hashes, minimiser segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..operators.graphs import checkpoint_dir, cut

__all__ = ["NON_ALNUM", "SPACES", "Words", "checkpoint_dir", "cut", "merged", "mix", "segments", "slices", "spans_hash", "window_min"]

#: Bytes of text handled at once; a single longer document is still handled whole.
SLICE_BYTES = 1 << 21

_rng = np.random.default_rng(20240117)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

_b = np.arange(256)
#: Separators of whitespace-delimited words.
SPACES = np.isin(_b, [9, 10, 11, 12, 13, 32])
#: Separators of alphanumeric words; every byte of a non-ASCII character counts as a letter.
NON_ALNUM = ~((_b >= 128) | ((_b >= 48) & (_b <= 57)) | ((_b >= 65) & (_b <= 90)) | ((_b >= 97) & (_b <= 122)))


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of base modulo 2^64, and of its inverse."""
    known = _powers.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, SLICE_BYTES + 1024)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        known = (made[0], made[1])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = known
    return known


def spans_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _WORD_BASE) -> np.ndarray:
    """A polynomial hash of values[start:end] for each span, from prefix sums."""
    power, inverse = _pow(base, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * inverse[start])


def slices(array: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, UTF-8 bytes, offsets) of runs of whole texts of about limit bytes. Null reads as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return
    if array.null_count:
        array = pc.fill_null(array, b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    off = np.frombuffer(array.buffers()[1], np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = min(len(array), max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1))
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of some texts: hash, start and end byte of each, and the offsets of each text's words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        inside = ~separators[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        before[edges], after[edges - 1] = False, False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.hash = spans_hash(_BYTE[data], self.start, self.end, _BASE) if len(data) else np.empty(0, np.uint64)
        self.offsets = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.offsets))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether they lie in one text."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        at = np.arange(m)
        return spans_hash(self.hash, at, at + n), self.doc[:m] == self.doc[n - 1 :]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each width consecutive values."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(out[:n], out[width - span : width - span + n])


def segments(words: Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first word and last word + 1 of each run of k-word windows with the same minimiser.

    The minimiser of a window is its least m-word hash, so that equal windows, wherever they lie, have the same one:
    data that is routed by it meets all its equals, and only 2 / (k - m + 2) rows a word are needed.
    """
    n = len(words.hash) - k + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    least = window_min(words.grams(m)[0], k - m + 1)
    good = words.doc[:n] == words.doc[k - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (words.doc[1:n] != words.doc[: n - 1]) | ~good[:-1]
    at = np.flatnonzero(good)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    first = np.flatnonzero(new & good)
    run = np.cumsum((new & good)[at]) - 1
    last = np.zeros(len(first), np.int64)
    last[run] = at  # the last write of a run stays
    return least[first].view(np.int64), first, last + k


def merged(start: np.ndarray, end: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The unions of spans that touch or overlap, within each group."""
    if not len(start):
        return start, end, group
    order = np.lexsort((start, group))
    s, e, g = start[order], end[order], group[order]
    shift = g - g.min()
    width = int(e.max()) + 2
    reach = np.maximum.accumulate(e + shift * width)
    new = np.ones(len(s), bool)
    new[1:] = (s + shift * width)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(s)) - 1
    return s[first], (reach - shift * width)[stop], g[first]
