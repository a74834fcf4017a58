"""The index against brute force: recall, work, copies, ties and odd vectors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import ann

SF = "/root/testdata/sf0.1"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")


def brute(ids, x, asked, k):
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(x[np.isin(ids, asked)] @ x.T, 9)  # equal vectors tie, however the sum is rounded
    s[ids[np.isin(ids, asked)][:, None] == ids[None, :]] = -2
    return {(int(q), int(ids[j])) for q, row in zip(ids[np.isin(ids, asked)], s) for j in np.lexsort((ids, -row))[:k]}


def test_query_recall(spark):
    own = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in own]), np.array([r["embedding"] for r in own], np.float32)
    want = brute(ids, x, ids[ids % 20 == 0], 10)
    out = ann.op8_neighbours(spark, SF).collect()
    got = {(r["vec_id"], r["neighbor_id"]) for r in out}
    assert {r["vec_id"] for r in out} == set(ids[ids % 20 == 0].tolist()) and len(out) == len(want)
    assert len(got & want) >= 0.9 * len(want)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = {int(i): k for k, i in enumerate(ids)}
    assert all(abs(unit[at[r["vec_id"]]] @ unit[at[r["neighbor_id"]]] - r["similarity"]) < 1e-5 for r in out)


def test_clustered_vectors_need_few_comparisons(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(400, 64))
    x = (centres[np.arange(8000) % 400] + 0.3 * rng.normal(size=(8000, 64))).astype(np.float32)
    ids = np.arange(8000)
    df = frame(spark, zip(ids.tolist(), x.tolist()))
    got = {(r[0], r[1]) for r in ann.neighbours(df, queries=F.col("vec_id") % 20 == 0).collect()}
    want = brute(ids, x, ids[ids % 20 == 0], 10)
    assert len(got & want) >= 0.9 * len(want)


def test_losses_rank_cells():
    """A vector's own cell has loss 0, and probes() lists just the cells within the reach."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for h in (ann.Hashes(16, 3, 2, 3, 7), ann.Hashes(16, 3, 0, 5, 7), ann.Hashes(16, 3, 1, 0, 7)):
        for t in range(3):
            row, code = h.probes(x, t, 0.2)
            sizes = [a.shape[1] for a in h.axes(x, t)]
            for i in range(50):
                total = np.zeros(1)
                for loss in h.losses(x, t):
                    total = (total[:, None] + loss[i][None, :]).ravel()
                assert sorted(code[row == i].tolist()) == np.flatnonzero(total <= 0.2).tolist()
            assert (np.array([h.own(x, t)[i] in code[row == i] for i in range(50)])).all() and math.prod(sizes) > code.max()
        assert np.allclose(h.least_loss(x, x), 0)


def test_cells_follow_the_table():
    for n in (10, 500, 50_000, 10**7, 10**10):
        h = ann.Hashes.fitting(n, 64, 16, 1)
        cells = 128**h.whole * max(1, 2 * h.rest)
        assert 0.4 <= max(1, n / ann.CELL) / cells <= 2.5


def test_copies_and_hot_cells(spark, monkeypatch):
    """A third of the rows are one vector; cells of more than a few vectors are split."""
    monkeypatch.setattr(ann, "HOT", 8)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[::3] = x[0]
    ids = np.arange(90) * 7
    got = {(r[0], r[1]) for r in ann.neighbours(frame(spark, zip(ids.tolist(), x.tolist())), k=4, recall=1.0).collect()}
    assert got == brute(ids, x, ids, 4)


@pytest.mark.parametrize("bad", [[math.inf, 1], [math.nan, 1], [0, 0], [None, 1], [], None])
def test_what_is_no_vector(spark, bad):
    df = frame(spark, [(1, [1, 0]), (2, [1, 1]), (3, bad), (None, [1, 0])])
    assert sorted((r[0], r[1]) for r in ann.neighbours(df).collect()) == [(1, 2), (2, 1)]


def test_large_and_small_lengths(spark):
    df = frame(spark, [(1, [1e38, 1e38]), (2, [1e-30, 1e-30]), (3, [1, -1])])
    assert sorted(tuple(r)[:3] for r in ann.neighbours(df, k=1).collect())[:2] == [(1, 2, 1), (2, 1, 1)]


def test_mixed_dimensions(spark):
    rows = [(k, [1.0, k]) for k in range(40)] + [(k, [1.0, k, 2.0]) for k in range(40, 80)]
    with pytest.raises(ValueError):
        ann.neighbours(frame(spark, rows)).collect()


def test_ties_go_by_id_across_batches(spark):
    df = frame(spark, [(k, [1, 0]) if k else (0, [0.6, 0.8]) for k in range(3000)]).repartition(7)
    got = sorted(tuple(r)[:3] for r in ann.neighbours(df, k=3, queries=F.col("vec_id").isin(0, 2999, 1)).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2999, 1, 1), (2999, 2, 2), (2999, 3, 3)]
