"""Kernels against naive versions and literal vectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.functions import diff, matrices
from sedimenta.operators.graphs import toposort
from sedimenta.operators.series import best_roll

LISTS = st.lists(st.integers(0, 3), max_size=14)


def lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


@settings(deadline=None, max_examples=400)
@given(LISTS, LISTS)
def test_scripts_are_shortest_and_apply(a, b):
    script, out, i, j = diff.edits(a, b), [], 0, 0
    for op, n in script:
        if op == "=":
            assert a[i : i + n] == b[j : j + n]
            out += a[i : i + n]
        if op == "+":
            out += b[j : j + n]
        i, j = i + n * (op != "+"), j + n * (op != "-")
    assert out == b and i == len(a)
    assert sum(n for op, n in script if op == "=") == lcs(a, b)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 6), st.integers(0, 6)), max_size=20))
def test_line_map_is_a_list(moves):
    held, plain, total = diff.LineMap(), [], {}
    for tick, (at, come, gone) in enumerate(moves):
        at = min(at, len(plain))
        gone = min(gone, len(plain) - at)
        for _, born, n in held.update(tick, at, come, gone):
            total[born] = total.get(born, 0) + n
        plain[at : at + gone] = [tick] * come
        assert [v for v, n in held.runs for _ in range(n)] == plain
    assert {k: v for k, v in total.items() if v} == {k: plain.count(k) for k in set(plain)}


def test_line_map_vector():
    held = diff.LineMap([(0, 100)])
    for step in ((1, 20, 30, 0), (2, 20, 0, 5), (3, 20, 0, 5), (4, 20, 10, 0)):
        held.update(*step)
    assert held.starts() == [(0, 0), (20, 4), (30, 1), (50, 0), (130, -1)]
    held.update(5, 45, 0, 10)
    held.update(6, 45, 5, 0)
    assert held.starts() == [(0, 0), (20, 4), (30, 1), (45, 6), (50, 0), (125, -1)]
    with pytest.raises(ValueError):
        held.update(7, 120, 0, 6)


def test_merged_branches():
    a, b = diff.LineMap([((5, "x"), 2), (None, 1)]), diff.LineMap([((3, "y"), 1), ((5, "x"), 1), (None, 1)])
    assert diff.merge_maps([a, b], (9, "m")).runs == [((3, "y"), 1), ((5, "x"), 1), ((9, "m"), 1)]
    with pytest.raises(ValueError):
        diff.merge_maps([a, diff.LineMap([((1, "x"), 1)])], (9, "m"))


def test_line_stats():
    assert diff.line_stats([("=", 3), ("-", 4), ("+", 6), ("=", 1), ("-", 2)]) == (2, 2, 4)
    assert diff.line_stats([("+", 207)]) == (207, 0, 0) and diff.line_stats([("-", 12)]) == (0, 12, 0)


def test_similarity():
    assert diff.similarity("a\nb\nc\n", "a\nb\nc\n") == 100 and diff.similarity("", "") == 100
    assert diff.similarity("abcd\n", "abxd\n") == 80
    assert diff.binary_similar(bytes(range(200)) * 3, bytes(range(200)) * 3 + b"tail")
    assert not diff.binary_similar(b"a" * 100, b"b" * 100)


def test_interpolation_is_undone_by_sampling():
    m = np.array([[13430, 0, 0, 0], [7698, 23316, 0, 0], [7181, 18750, 55841, 0], [6345, 16704, 17110, 55981]], float)
    assert np.abs(matrices.resample(matrices.interpolate(m, 30, 30), 30, 30) - m).max() <= 1
    assert np.abs(matrices.merge([(m, 30, 30, 0)] * 2)[0] - 2 * m).max() <= 1


def test_warping_and_windows():
    assert diff.dtw(np.array([1.0, 2, 3]), np.array([1.0, 2, 2, 3])) == 0
    assert diff.dtw(np.array([0.0, 1]), np.array([2.0])) == 3
    w = diff.slepian(9)
    assert np.allclose(w, w[::-1]) and abs(w.sum() - 1) < 1e-9 and w.argmax() == 4


def test_order_and_roll():
    assert toposort({"b": ["c"], "a": ["c"], "c": ["d"]}) == ["a", "b", "c", "d"]
    with pytest.raises(ValueError):
        toposort({"a": ["b"], "b": ["a"]})
    assert best_roll([1, 2, 3], [2, 3, 1]) == (1, 0)


def test_long_unlike_texts_are_replaced():
    a, b = [f"a{k}" for k in range(30_000)], [f"b{k}" for k in range(30_000)]
    assert diff.edits(["x", *a], ["x", *b, "y"]) == [("=", 1), ("-", 30_000), ("+", 30_001)]
    assert diff.edits(a, a[:100] + ["new"] + a[200:]) == [("=", 100), ("-", 100), ("+", 1), ("=", 29_800)]
    assert diff.edits(list("abcabba"), list("cbabac"), limit=0) == [("-", 7), ("+", 6)]
