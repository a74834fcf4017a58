"""Each operator against a brute-force version, on small tables."""

import os
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import ann, decontamination, html, language_id, line_dedup, packing, pii, quality, queries, simhash, substring_dedup
from sedimenta.llm._text import NON_ALNUM, Words, slices

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def naive_tiles(p, t, least):
    """Greedy string tiling, straight from its definition."""
    used, seen, out = set(), set(), []
    while True:
        best, found = least, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and i + n not in used and j + n not in seen:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if not used & set(range(i, i + best)) and not seen & set(range(j, j + best)):
                used |= set(range(i, i + best))
                seen |= set(range(j, j + best))
                out.append((i, j, best))


def test_tiles():
    rng = random.Random(1)
    for _ in range(150):
        p, t = ([rng.randrange(4) for _ in range(rng.randrange(2, 18))] for _ in range(2))
        got = decontamination.tiles(np.array(p, np.uint64), np.array(t, np.uint64), 3)
        assert sorted(got) == sorted(naive_tiles(p, t, 3))


def test_decontamination_finds_reordered_passages(spark):
    words = [f"w{k}" for k in range(40)]
    item = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    shuffled = " ".join(["clean"] * 9 + words[20:] + ["between"] * 5 + words[:20])
    df = spark.createDataFrame([(1, shuffled), (2, "quite another text with no passage of it"), (3, " ".join(words[:15]))], "doc_id bigint, text string")
    assert [tuple(r) for r in decontamination.find(df, item).collect()] == [(1, 7, 40, 40, 1.0)]


def test_benchmark_pairs(spark, docs):
    import re

    tests = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r[0], r[1]) for r in decontamination.find(docs, tests).collect()}
    token = re.compile(r"[a-z0-9\x80-\U0010ffff]+")
    items = [(r["item_id"], token.findall(r["text"].lower())) for r in tests.collect()]
    want = set()
    for r in docs.collect():
        words = token.findall((r["text"] or "").lower())
        grams = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for i, item in items:
            if len(item) >= 5 and any(tuple(item[k : k + 5]) in grams for k in range(len(item) - 4)):
                code = {w: k for k, w in enumerate({*words, *item})}
                cover = sum(x[2] for x in decontamination.tiles(np.array([code[w] for w in item], np.uint64), np.array([code[w] for w in words], np.uint64), 5))
                if cover >= len(item) / 2:
                    want.add((r["doc_id"], i))
    assert got == want and got


def brute_groups(texts, radius=28):
    """{id: kept id} from all pairs of fingerprints."""
    ids = sorted(i for i, t in texts if t is not None)
    by = dict(texts)
    import pyarrow as pa

    array = pa.array([by[i].lower() for i in ids], pa.string())
    sums = np.zeros(1 << simhash.BUCKET_BITS, np.int64)
    n = simhash._present(array, sums)
    idf = (np.log((1 + n) / (1 + sums)) + 0.1).astype(np.float32)
    (_, _, data, off) = next(slices(array, 1 << 40))
    h, d = simhash._distinct(Words(data, off, NON_ALNUM))
    fp = simhash.fingerprints(h, d, len(ids), idf)
    some = np.unique(d)
    far = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(axis=2)
    label = {i: i for i in range(len(ids))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in some:
        for b in some:
            if a < b and far[a, b] <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {ids[i]: ids[root(i)] for i in some if root(i) != i}


def test_simhash(docs):
    got = dict(map(tuple, simhash.near_duplicates(docs).collect()))
    want = brute_groups([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) > 0


def test_bk_tree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, (40, simhash.LANES), dtype=np.uint64)
    prints = np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, base.shape, dtype=np.uint64)), base])
    forest = simhash.Forest(np.zeros(len(prints), np.int64), prints)
    at = np.arange(len(prints))
    got = {(int(a), int(b)) for q, t in forest.within(9, at, forest.root) for a, b in zip(q, t)}
    far = np.bitwise_count(prints[:, None, :] ^ prints[None, :, :]).sum(axis=2)
    assert got == {(int(a), int(b)) for a, b in np.argwhere(far <= 9)}


def test_substring_dedup(docs):
    k, owners, texts = 40, defaultdict(set), {}
    for r in docs.select("doc_id", "text").collect():
        texts[r[0]] = (r[1] or "").split()
        for i in range(len(texts[r[0]]) - k + 1):
            owners[tuple(texts[r[0]][i : i + k])].add(r[0])
    want = set()
    for d, words in texts.items():
        spans = []
        for i in range(len(words) - k + 1):
            if len(owners[tuple(words[i : i + k])]) > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + k
                else:
                    spans.append([i, i + k])
        want |= {(d, a, b, b - a) for a, b in spans}
    assert {tuple(r) for r in substring_dedup.repeated(docs).collect()} == want and want


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    assert model.heldout_accuracy >= 0.95 and 0 < (model.weights != 0).mean() < 0.5
    out = language_id.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert out.where("language = lang").count() >= 0.95 * out.count()


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    assert model.heldout_accuracy >= 0.9
    out = quality.rank(docs, model).join(labels, "doc_id")
    assert out.where("keep and quality = 1 and toxic = 0").count() >= 0.95 * out.where("quality = 1 and toxic = 0").count()


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    least, hosts = 6, defaultdict(list)
    for r in html.extract(pages, least=10**6).collect():
        hosts[r["host"]].append((r["page_id"], r["text"].split()))
    want = {}
    for own in hosts.values():
        where = defaultdict(set)
        for n, (_, words) in enumerate(own):
            for i in range(len(words) - least + 1):
                where[tuple(words[i : i + least])].add(n)
        for _, (i, words) in enumerate(own):
            gone = {k + j for k in range(len(words) - least + 1) if len(where[tuple(words[k : k + least])]) > 1 for j in range(least)}
            want[i] = [w for k, w in enumerate(words) if k not in gone]
    got = {r["page_id"]: r["text"].split() for r in html.extract(pages).collect()}
    assert got == want


def test_ann_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    own = df.collect()
    x = np.array([r["embedding"] for r in own], np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    ids = np.array([r["vec_id"] for r in own])
    want = {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.argsort(-s[i], kind="stable")[:10]}
    got = {(r["vec_id"], r["neighbor_id"]) for r in ann.neighbours(df).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_line_dedup_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet{"/*.parquet" if os.path.isdir(f"{SF}/documents.parquet") else ""}')")
    want = con.sql(queries.SQL["op9_line_dedup"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in line_dedup.op9_line_dedup(spark, SF).collect())


def test_line_chunks_shift():
    lines = [line_dedup.line_hash(f"line {k}".encode()) for k in range(200)]
    ends = line_dedup.chunk_ends(lines, 2, 4)
    moved = line_dedup.chunk_ends([1, 2, 3, *lines], 2, 4)
    assert {e + 3 for e in ends[1:]} <= set(moved)


def naive_assign(tokens, costs, capacity):
    size = max(1, -(-sum(tokens) // capacity))
    room, cost, out = [capacity] * size, [0.0] * size, []
    for n, c in zip(tokens, costs):
        fit = [k for k in range(len(room)) if room[k] >= n]
        if not fit:
            room.append(capacity)
            cost.append(0.0)
            fit = [len(room) - 1]
        k = min(fit, key=lambda k: (cost[k], k))
        room[k] -= n
        cost[k] += c
        out.append(k)
    return out


def test_packing(docs):
    rng = random.Random(2)
    tokens = sorted((rng.randrange(1, 100) for _ in range(300)), reverse=True)
    costs = [n + n * n / 64 for n in tokens]
    assert packing.assign(np.array(tokens), np.array(costs), 100).tolist() == naive_assign(tokens, costs, 100)
    out = packing.pack(docs)
    assert out.groupBy("sequence").agg(F.sum("n_tokens").alias("n")).where("n > 4096").isEmpty()
    encode = packing.encoder(f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    want = {r["doc_id"]: len(encode(r["text"])) for r in docs.collect() if r["text"]}
    assert dict(map(tuple, out.groupBy("doc_id").agg(F.sum("n_tokens")).collect())) == want


def test_pii(spark):
    plain = [f"common words of line {k} go here" for k in range(60)]
    own = ["zanzibar wrote common words from ann@example.org today", "again zanzibar has ann@example.org in common words", "phone 415-555-0132 here", "api_key = sk-abcdef0123456789abcd", "host 10.1.2.3 and card 4111 1111 1111 1111"]
    df = spark.createDataFrame(list(enumerate(plain + own)), "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    assert all(out[k]["text"] == plain[k] and not out[k]["n_entities"] for k in range(60))
    assert "zanzibar" not in out[60]["text"] and "common words" in out[60]["text"] and "<EMAIL>" in out[60]["text"] and "zanzibar" not in out[61]["text"]
    assert "<PHONE>" in out[62]["text"] and "<SECRET>" in out[63]["text"] and "<IP>" in out[64]["text"] and "<CARD>" in out[64]["text"]


def test_pii_shares(spark):
    """Each (entity, term)'s share, counted line by line."""
    import math

    texts = ["alpha beta a@b.org", "alpha gamma a@b.org", "beta gamma delta", "beta beta", "gamma delta"] + ["filler delta"] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    lines = [set(t.split()) for t in texts]
    keep = {}
    for term in ("alpha", "beta", "gamma"):
        both = sum(term in x and "a@b.org" in x for x in lines)
        share = 1 - math.log2(sum(term in x for x in lines) / both) / math.log2(len(lines) / 2)
        keep[term] = both < 2 or share < 0.75
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    for k in (0, 1):
        want = [w for w in texts[k].split() if w == "a@b.org" or keep[w]]
        assert got[k].split() == ["<EMAIL>" if w == "a@b.org" else w for w in want]


def test_pipeline(spark, docs):
    """run() against its stages done by brute force."""
    model = language_id.train(docs)
    kept = {r["doc_id"] for r in language_id.identify(docs, model).collect() if r["keep"]}
    table = docs.where(F.col("doc_id").isin(*kept)).select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("d", table)
    lines = con.sql("WITH " + line_dedup.LINE_DEDUP_CTE.format(table="d") + "SELECT doc_id, text, n_removed FROM deduped").fetchall()
    left = {i: t for i, t, n in lines if not n or t.strip(" ")}
    for i in brute_groups(list(left.items()), simhash.NEAR):
        del left[i]
    df = spark.createDataFrame(list(left.items()), "doc_id bigint, text string")
    for r in decontamination.find(df, spark.read.parquet(f"{SF}/benchmark.parquet")).collect():
        left.pop(r["doc_id"], None)
    encode = packing.encoder(f"{packing.TOKENIZERS}/byte_bpe_50k.tiktoken").encode_ordinary
    want = {i: len(encode(t)) for i, t in left.items() if t}
    got = dict(map(tuple, corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("n_tokens")).collect()))
    assert got == want
