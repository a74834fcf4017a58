"""Very long and endlessly repeating texts, hot groups, and kernels against plain Python."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_brute_force import naive_assign, naive_tiles

from sedimenta.llm import decontamination, html, language_id, line_dedup, packing, quality, substring_dedup


def test_line_dedup_of_long_repeated_texts(spark):
    text = "\n".join(f"line {k * 7919 % 100_003} of a text" for k in range(64_000))
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    began = time.time()
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert time.time() - began < 60
    lines = text.split("\n")
    ends = line_dedup.chunk_ends([line_dedup.line_hash(x.encode()) for x in lines], 2, 4)
    single = [lines[a] for a, b in zip([0, *ends], ends) if b - a == 1]
    assert got[1]["text"] == text and got[1]["n_removed"] == 0
    assert got[2]["text"].split("\n") == single and got[2]["n_removed"] == 64_000 - len(single)


def test_line_dedup_keeps_one_of_many(spark):
    """One passage in every row: one place keeps it, whatever the ids."""
    head = "\n".join(f"license line {k}" for k in range(40))
    rows = [(None if k % 3 == 0 else k, f"{head}\nown {k}\ntext {k}") for k in range(600)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == 600 and all(f"own {k}" in " ".join(r["text"] for r in out) for k in (0, 1, 599))
    assert sum(r["n_removed"] == 0 for r in out) == 1


def test_tiles_by_length():
    rng = random.Random(8)
    for k in range(300):
        p, t = ([rng.randrange(1 + k % 4) for _ in range(rng.randrange(2, 22))] for _ in range(2))
        got = decontamination._tiles_by_length(np.array(p, np.uint64), np.array(t, np.uint64), 3)
        assert sorted(got) == sorted(naive_tiles(p, t, 3))


def test_endless_repeats_take_bounded_memory(spark):
    import tracemalloc

    one, many = np.full(5_000, 7, np.uint64), np.full(200_000, 7, np.uint64)
    tracemalloc.start()
    assert decontamination.tiles(one, many, 5) == [(0, 0, 5_000)]
    broken = many.copy()
    broken[100::101] = np.arange(len(broken[100::101])) + 10
    assert sorted(decontamination.tiles(one, broken, 5)) == [(100 * k, 101 * k, 100) for k in range(50)]
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    docs = spark.createDataFrame([(1, "word " * 200_000), (2, "word " * 3)], "doc_id bigint, text string")
    tests = spark.createDataFrame([(k, "word " * 5_000) for k in range(3)], "item_id bigint, text string")
    assert sorted(map(tuple, decontamination.find(docs, tests).collect())) == [(1, k, 5_000, 5_000, 1.0) for k in range(3)]


def test_packing_over_shards(spark):
    """Rows without an id, of one id and of one text, over several shards, each packed as plain Python does."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randrange(1, 300))) for _ in range(500)]
    rows = [(None, texts[0])] * 400 + [(7, texts[1])] * 400 + list(enumerate(texts)) + [(None, t) for t in texts]
    out = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), capacity=200, shard_sequences=64).toPandas()
    out["shard"] = out["sequence"] // 2**32
    assert len(out["shard"].unique()) >= 10
    for odd in (out[out["doc_id"].isna()], out[out["doc_id"] == 7]):
        assert odd["shard"].value_counts().max() < 0.4 * len(odd)
    encode = packing.encoder(f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    assert out["n_tokens"].sum() == sum(len(encode(t)) for _, t in rows)
    for _, own in out.groupby("shard"):
        # equal pieces may stand in any order, and get the same multiset of sequences
        own = own.sort_values(["n_tokens", "sequence"], ascending=[False, True])
        tokens, costs = own["n_tokens"].tolist(), own["cost"].tolist()
        want = sorted(zip([-n for n in tokens], naive_assign(tokens, costs, 200)))
        assert [(-n, s % 2**32) for n, s in zip(tokens, own["sequence"])] == want
        assert own.groupby("sequence")["n_tokens"].sum().max() <= 200


def test_passages_are_located_by_the_automaton():
    """locate() against all windows, over texts that share, nest and repeat passages."""
    rng, k = random.Random(12), 4
    for _ in range(150):
        pool = [[rng.choice("abcdefgh") for _ in range(rng.randrange(3, 12))] for _ in range(4)]
        texts = [[w for _ in range(rng.randrange(1, 5)) for w in (rng.choice(pool) if rng.random() < 0.7 else [rng.choice("xyzuvw")])] for _ in range(5)]
        low = np.array([rng.randrange(6) for _ in texts])
        high = low + np.array([rng.randrange(2) for _ in texts])
        owners = defaultdict(set)
        for words, a, b in zip(texts, low.tolist(), high.tolist()):
            for i in range(len(words) - k + 1):
                owners[tuple(words[i : i + k])] |= {a, b}
        want = set()
        for n, words in enumerate(texts):
            spans: list = []
            for i in range(len(words) - k + 1):
                if len(owners[tuple(words[i : i + k])]) > 1:
                    if spans and i <= spans[-1][1]:
                        spans[-1][1] = i + k
                    else:
                        spans.append([i, i + k])
            want |= {(n, a, b) for a, b in spans}
        got = substring_dedup.locate([" ".join(x).encode() for x in texts], low, high, k)
        assert set(zip(*(x.tolist() for x in got))) == want


def test_equal_hashes_of_other_bytes_are_no_passage(monkeypatch):
    """With a hash that takes all words for one, only what the automaton finds twice stays."""
    real = substring_dedup.Words

    class Blind(real):
        def __init__(self, *args):
            super().__init__(*args)
            self.hash = np.zeros_like(self.hash)

    monkeypatch.setattr(substring_dedup, "Words", Blind)
    assert [x.tolist() for x in substring_dedup.locate([b"a b c d", b"e f g h"], np.array([1, 2]), np.array([1, 2]), 4)] == [[], [], []]


def test_equal_pages_lose_nothing_to_themselves(spark):
    body = "one two three four five six seven eight"
    rows = [(1, "http://a.org/x", f"<p>{body}"), (2, "http://a.org/x?s=1", f"<div>{body}</div>"), (3, "http://a.org/y", "<p>zero one two three four five six"), (4, "http://b.org/", "<p>" + "w " * 100_000), (5, "http://b.org/", "<p>" + "w " * 100_000)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "seven eight" and got[3] == "zero" and got[4] == got[5] == " ".join(["w"] * 100_000)


def test_ftrl_is_its_recurrence():
    """Weights of a small run, updated one coordinate at a time."""
    rng = np.random.default_rng(4)
    n, classes, epochs, batch = 24, 3, 2, 5
    dense = np.zeros((n, language_id.BUCKETS), np.float32)
    for row in dense:
        row[rng.choice(12, 4, replace=False)] = rng.random(4)
    y = rng.integers(0, classes, n)
    got = language_id.ftrl(language_id.Rows(iter([dense])), y, np.arange(n), classes, epochs, batch, alpha=2.0, beta=1.0, l1=0.02, l2=0.01, seed=7)
    z, s, w = ([[0.0] * classes for _ in range(12)] for _ in range(3))
    order_of = np.random.default_rng(7)
    for _ in range(epochs):
        order = order_of.permutation(np.arange(n)).tolist()
        for lo in range(0, n, batch):
            own = order[lo : lo + batch]
            g = [[0.0] * classes for _ in range(12)]
            for r in own:
                score = [sum(float(dense[r, f]) * w[f][c] for f in range(12)) for c in range(classes)]
                total = sum(math.exp(x) for x in score)
                for c in range(classes):
                    p = math.exp(score[c]) / total - (y[r] == c)
                    for f in range(12):
                        g[f][c] += float(dense[r, f]) * p
            for f in range(12):
                for c in range(classes):
                    sigma = (math.sqrt(s[f][c] + g[f][c] ** 2) - math.sqrt(s[f][c])) / 2.0
                    z[f][c] += g[f][c] - sigma * w[f][c]
                    s[f][c] += g[f][c] ** 2
                    w[f][c] = 0.0 if abs(z[f][c]) <= 0.02 else -(z[f][c] - math.copysign(0.02, z[f][c])) / ((1 + math.sqrt(s[f][c])) / 2.0 + 0.01)
    assert np.allclose(got[:12], w, atol=1e-3) and not got[12:].any() and (got[:12] == 0).sum() == (np.array(w) == 0).sum()


def test_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 400)
    logits = 6 * (np.eye(3)[y] + rng.normal(size=(400, 3)))
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(400), y]).mean()
    assert loss(language_id.temperature(logits, y)) <= min(loss(t) for t in np.geomspace(0.05, 20, 400)) + 1e-6


def test_bradley_terry_descends_the_pairs_loss():
    """fit() against Adam in plain Python, with differences of whole feature vectors."""
    rng = np.random.default_rng(9)
    n = 10
    form = rng.random((n, quality.FORM))
    doc, bucket, value = np.repeat(np.arange(n), 3), np.concatenate([rng.choice(8, 3, replace=False) for _ in range(n)]), rng.random(3 * n)
    better, worse = rng.integers(0, 5, 20), rng.integers(5, 10, 20)
    got = quality.fit((form, doc, bucket, value), better, worse, epochs=40, rate=0.05, l2=1e-3)
    x = np.zeros((n, quality.FORM + 8))
    x[:, : quality.FORM] = form
    x[doc, quality.FORM + bucket] = value
    w, m, v = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, 41):
        g = 1e-3 * w
        for a, b in zip(better, worse):
            d = x[a] - x[b]
            g = g - d / (1 + math.exp(w @ d)) / len(better)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    used = np.unique(bucket)
    assert np.allclose(got[: quality.FORM], w[: quality.FORM], atol=1e-6) and np.allclose(got[quality.FORM + used], w[quality.FORM + used], atol=1e-6)


def test_quality_ties_with_the_threshold_stay(spark):
    df = spark.createDataFrame([(k, "same text for all of them") for k in range(30)], "doc_id bigint, text string")
    w = np.ones(quality.FORM + (1 << quality.BITS))
    at = quality.score_quantile(df, w, 0.5)
    assert quality.rank(df, quality.Ranking(w, at, 1.0)).where("keep").count() == 30


@pytest.mark.parametrize("text", ["", "\n", "\n\n", "a\nb"])
def test_short_lines_stay(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").withColumn("n_removed", F.lit(9))
    assert [(r["text"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()] == [(text, 0)]
