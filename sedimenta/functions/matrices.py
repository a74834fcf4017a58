"""Burndown matrices of one project or file: interpolation to single ticks, and sampling back."""

from __future__ import annotations

import numpy as np


def interpolate(matrix: np.ndarray, granularity: int, sampling: int) -> np.ndarray:
    """ticks x ticks from samples x bands: lines at the end of each tick by tick of birth.

    Within the sample in which a band is written its lines grow evenly; afterwards they decay evenly between samples. Where
    a band ends inside a sample, the height at its end is carried on from the growth of the sample before (or since the band
    began, if that was within it); where the sample ends higher than that, the height is what the next sample's decay leads
    back to.
    """
    samples, bands = matrix.shape
    out = np.zeros((samples * sampling, bands * granularity))
    for y in range(bands):
        begin, end = y * granularity, (y + 1) * granularity
        for x in range(samples):
            first, last = x * sampling, (x + 1) * sampling
            if begin >= last:
                continue
            height, before = float(matrix[x, y]), float(matrix[x - 1, y]) if x else 0.0
            if end >= last:
                _grow(out, begin, end, first, last, before, height)
            elif end > first:
                whole = x > 0 and first - sampling >= begin
                earlier = float(matrix[x - 2, y]) if whole and x > 1 else 0.0
                peak = before + (before - earlier) / (sampling if whole or not x else max(1, first - begin)) * (end - first)
                if height > peak:
                    leaves = (height - float(matrix[x + 1, y])) / sampling if x + 1 < samples else 0.0
                    peak = height + leaves * (last - end)
                _grow(out, begin, end, first, end, before, peak)
                _decay(out, begin, end, end, last, peak, height)
            else:
                _decay(out, begin, end, first, last, before, height)
    return out


def _grow(out: np.ndarray, begin: int, end: int, first: int, last: int, before: float, height: float) -> None:
    start = max(first, begin)
    fresh = last - start
    if before and begin < start:
        for t in range(start, last):
            scale = 1.0 if height >= before else 1 + (height / before - 1) * (t + 1 - start) / fresh
            out[t, begin:start] = out[start - 1, begin:start] * scale
    gain = height - min(before, height) if begin < start else height
    for t in range(start, last):
        out[t, start : t + 1] = gain / fresh


def _decay(out: np.ndarray, begin: int, end: int, first: int, last: int, before: float, height: float) -> None:
    if not before:
        return
    base = out[first - 1, begin:end].copy()
    for t in range(first, last):
        out[t, begin:end] = base * (1 + (height / before - 1) * (t + 1 - first) / (last - first))


def resample(ticks: np.ndarray, granularity: int, sampling: int) -> np.ndarray:
    """samples x bands, read from the last tick of each sample."""
    n = ticks.shape[0]
    rows = [min(n, (k + 1) * sampling) - 1 for k in range(-(-n // sampling))]
    cuts = range(0, ticks.shape[1], granularity)
    return np.array([[ticks[r, c : c + granularity].sum() for c in cuts] for r in rows]).reshape(len(rows), len(cuts))


def merge(parts: list[tuple[np.ndarray, int, int, int]]) -> tuple[np.ndarray, int, int]:
    """The sum of (matrix, granularity, sampling, first tick) at the finest of their granularities and samplings."""
    granularity, sampling = min(p[1] for p in parts), min(p[2] for p in parts)
    base = min(at for *_, at in parts)
    size = max(at - base + max(m.shape[0] * s, m.shape[1] * g) for m, g, s, at in parts)
    rows = np.array([min(size, (k + 1) * sampling) - 1 for k in range(-(-size // sampling))])
    cuts = np.arange(0, size, granularity)
    total = np.zeros((len(rows), len(cuts)))
    for m, g, s, at in parts:  # one repository's ticks at a time; what is kept is samples by bands
        t, lo = interpolate(m, g, s), at - base
        band = np.zeros((t.shape[0], len(cuts)))
        own = (lo + np.arange(t.shape[1])) // granularity
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        band[:, own[first]] = np.add.reduceat(t, first, axis=1)
        later = rows >= lo
        total[later] += band[np.minimum(rows[later] - lo, t.shape[0] - 1)]
    return total, granularity, sampling
