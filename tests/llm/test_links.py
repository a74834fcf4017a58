"""Links of near copies against all pairs of fingerprints: counts, groups, hot keys."""

import random
from collections import defaultdict

import numpy as np
from test_brute_force import brute_groups

from sedimenta.llm import simhash

SF = "/root/testdata/sf0.001"


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def edited(rng, words, n):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"w{rng.randrange(4000)}"
    return out


def brute_links(rows, radius):
    """{id: (kept id, links)}: the fingerprints from plain Python integers, then all pairs."""
    import pyarrow as pa

    from sedimenta.llm._text import NON_ALNUM, Words, slices

    rows = sorted(set(rows))
    array = pa.array([t.lower() for _, t in rows])
    sums = np.zeros(1 << simhash.BUCKET_BITS, np.int64)
    n = simhash._present(array, sums)
    prints = []
    for _, _, data, off in slices(array, 1 << 40):
        w = Words(data, off, NON_ALNUM)
        for k in range(len(rows)):
            total = [0.0] * 256
            for h in sorted({int(x) >> 20 for x in w.hash[w.offsets[k] : w.offsets[k + 1]]}):
                weight = float(np.float32(np.log((1 + n) / (1 + sums[h >> (44 - simhash.BUCKET_BITS)])) + 0.1))
                for lane in range(4):
                    x = (h + 0x632BE59BD9B4E019 * (lane + 1)) % 2**64
                    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                    x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                    x ^= x >> 31
                    for bit in range(64):
                        total[64 * lane + bit] += weight if x >> bit & 1 else -weight
            prints.append(sum(1 << b for b in range(256) if total[b] > 0))
    near, count = defaultdict(set), defaultdict(int)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and (prints[a] ^ prints[b]).bit_count() <= radius:
                near[a].add(b)
                count[rows[a][0]] += 1
    kept = {}
    for a in range(len(rows)):
        group, left = {a}, [a]
        while left:
            new = near[left.pop()] - group
            group |= new
            left += new
        kept[rows[a][0]] = min(rows[b][0] for b in group)
    return {i: (kept[i], n) for i, n in count.items()}


def corpus():
    rng = random.Random(9)
    rows = []
    for _ in range(30):
        base = prose(rng, 120)
        rows += [base, base, edited(rng, base, 2), edited(rng, base, 5)]
    rows += [prose(rng, 80) for _ in range(40)]
    return [(i * 3 % 1009, " ".join(t)) for i, t in enumerate(rows)]


def held(df):
    return {r[0]: (r[1], r[2]) for r in df.collect()}


def test_links_and_groups(spark):
    rows = corpus()
    got = held(simhash.links(spark.createDataFrame(rows, "doc_id bigint, text string"), 45))
    assert got == brute_links(rows, 45) and len(got) >= 110


def test_hot_keys_are_split(spark, monkeypatch):
    """Keys of more than a few fingerprints, all of one group, in blocks that are compared with one another."""
    monkeypatch.setattr(simhash, "TASK_ROWS", 6)
    rng = random.Random(3)
    base = prose(rng, 150)
    rows = [(k, " ".join(edited(rng, base, 1))) for k in range(60)] + [(k, " ".join(prose(rng, 20))) for k in range(60, 160)]
    got = held(simhash.links(spark.createDataFrame(rows, "doc_id bigint, text string"), 60))
    assert got == brute_links(rows, 60) and len(got) == 60


def test_whole_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [tuple(r) for r in df.select("doc_id", "text").collect()]
    got = held(simhash.links(df))
    assert {i: kept for i, (kept, _) in got.items() if i != kept} == brute_groups(texts, 45)


def test_shards_meet_and_count_once():
    rng = np.random.default_rng(2)
    shards = simhash.Shards(1000, 45)
    a = rng.integers(0, 1 << 63, (4000, simhash.LANES), dtype=np.uint64)
    flip = np.zeros((4000, 256), np.uint8)
    for row in flip:
        row[rng.choice(256, 45, replace=False)] = 1
    b = a ^ np.packbits(flip, axis=1, bitorder="little").view(np.uint64)
    same = shards.keys(a) == shards.keys(b)
    assert same.any(axis=1).mean() >= 0.99
    q, shard = np.nonzero(same)
    once = shards.first((a ^ b)[q], shard)
    assert np.bincount(q[once], minlength=4000).max() == 1 and once.sum() == same.any(axis=1).sum()
    assert simhash.Shards(1 << 34, 45).bits == 26 and simhash.Shards(1 << 34, 15).count >= 256 // 26


def test_shared_ids_and_nulls(spark):
    words = " ".join(f"word{k}" for k in range(50))
    rows = [(5, words), (5, "another text of the same id, with words of its own"), (7, words), (7, words), (None, words), (8, None), (9, "?!"), (10, "")]
    assert held(simhash.links(spark.createDataFrame(rows, "doc_id bigint, text string"))) == {5: (5, 1), 7: (5, 1)}
