"""Near-duplicate groups from SimHash fingerprints in sharded BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import components
from ._text import NON_ALNUM, Words, cut, mix, slices
from .sketch import frequencies

#: Words of 64 bits in a fingerprint, bits of a bucket of the document frequencies, least bits of a shard's key.
LANES, BUCKET_BITS, KEY_BITS = 4, 18, 12
#: The share of pairs as far apart as the radius that share a shard; of nearer pairs there are more.
RECALL = 0.995
#: The bits that near copies lie apart at most; unrelated documents lie 70 or more apart.
NEAR = 45
#: Fingerprints of one key beyond which they are split, and that a task holds at once; pairs that it compares at once.
TASK_ROWS, PAIRS = 1 << 17, 1 << 20


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """44 bits of the hash, and the text, of each distinct word of each text."""
    key = np.sort(words.doc.astype(np.uint64) << np.uint64(44) | words.hash >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return key & np.uint64((1 << 44) - 1), (key >> np.uint64(44)).astype(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44 - BUCKET_BITS)).astype(np.int64)


def _present(texts: pa.Array, sums: np.ndarray) -> int:
    n = 0
    for _, _, data, off in slices(texts):
        h, d = _distinct(Words(data, off, NON_ALNUM))
        sums += np.bincount(_bucket(h), minlength=len(sums))
        n += len(np.unique(d))
    return n


def fingerprints(h: np.ndarray, d: np.ndarray, rows: int, idf: np.ndarray, block: int = 1024) -> np.ndarray:
    """The SimHash of each of rows texts from its distinct words: the signs of the weighted sums of the words' bits."""
    sums = np.zeros((rows, 64 * LANES), np.float32)
    for lo in range(0, len(h), block):
        x, own, weight = h[lo : lo + block], d[lo : lo + block], idf[_bucket(h[lo : lo + block])]
        bits = np.empty((len(x), LANES), np.uint64)
        for lane in range(LANES):
            bits[:, lane] = mix(x + np.uint64(0x632BE59BD9B4E019 * (lane + 1) & (1 << 64) - 1))
        one = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(np.float32)
        first = int(own[0])
        n = int(own[-1]) - first + 1
        if n <= 32:
            of = np.zeros((n, len(x)), np.float32)
            of[own - first, np.arange(len(x))] = weight
            sums[first : first + n] += 2 * (of @ one) - of.sum(axis=1)[:, None]
        else:
            has, at = np.unique(own, return_index=True)
            sums[has] += np.add.reduceat((2 * one - 1) * weight[:, None], at, axis=0)
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).reshape(rows, LANES)


class Shards:
    """Keys of some of a fingerprint's bits: bits wide, as many as nodes need, and so many that pairs meet."""

    def __init__(self, nodes: int, radius: int):
        self.bits = min(40, max(KEY_BITS, math.ceil(math.log2(max(1, nodes))) - 8))
        meet = (1 - min(radius, 64 * LANES - 1) / (64 * LANES)) ** self.bits
        self.count = max(math.ceil(math.log(1 - RECALL) / math.log1p(-meet)), 64 * LANES // self.bits)
        rng, per = np.random.default_rng(20240503), 64 * LANES // self.bits
        orders = [np.arange(64 * LANES), *(rng.permutation(64 * LANES) for _ in range(-(-self.count // per) - 1))]
        self.of = np.concatenate([o[: per * self.bits].reshape(per, self.bits) for o in orders])[: self.count]
        chosen = np.zeros((self.count, 64 * LANES), np.uint8)
        np.put_along_axis(chosen, self.of, 1, axis=1)
        self.masks = np.packbits(chosen, axis=1, bitorder="little").view(np.uint64)

    def keys(self, prints: np.ndarray) -> np.ndarray:
        """The keys of each fingerprint, a column a shard; the shard's number stands above the bits."""
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
        out = np.zeros((len(prints), self.count), np.int64)
        for k in range(self.bits):
            out |= bits[:, self.of[:, k]].astype(np.int64) << k
        return out + (np.arange(self.count, dtype=np.int64) << 41)

    def first(self, apart: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Whether shard is the first one that each pair, with these bits apart, shares: so that it is counted once."""
        out, left = np.ones(len(apart), bool), np.arange(len(apart))
        for k, mask in enumerate(self.masks):
            left = left[shard[left] > k]
            if not len(left):
                break
            met = ((apart[left] & mask) == 0).all(axis=1)
            out[left[met]] = False
            left = left[~met]
        return out


class Forest:
    """BK-trees, one for each key, in flat arrays; rows must come sorted by key."""

    def __init__(self, key: np.ndarray, prints: np.ndarray):
        self.key, self.prints = key, prints
        n = len(key)
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1] if n else np.empty(0, np.int64)
        left = np.flatnonzero(~new)
        parent = self.root[left]
        edges = []
        while len(left):
            # children are keyed by their distance to the parent; the first of each distance is the child, the others go below it
            d = self.distance(left, parent)
            code = parent * 512 + d
            order = np.argsort(code, kind="stable")
            head = np.ones(len(order), bool)
            head[1:] = code[order][1:] != code[order][:-1]
            child = left[order][head]
            edges.append((parent[order][head], d[order][head], child))
            below = child[np.cumsum(head) - 1]
            left, parent = left[order][~head], below[~head]
        p, d, c = (np.concatenate(x) if edges else np.empty(0, np.int64) for x in (zip(*edges) if edges else ((),) * 3))
        order = np.argsort(p, kind="stable")
        self.edge, self.child = d[order], c[order]
        self.first = np.searchsorted(p[order], np.arange(n + 1))

    def distance(self, a: np.ndarray, b: np.ndarray, prints: np.ndarray | None = None) -> np.ndarray:
        left = self.prints if prints is None else prints
        d = np.zeros(len(a), np.int64)
        for lane in range(self.prints.shape[1]):
            d += np.bitwise_count(left[a, lane] ^ self.prints[b, lane])
        return d

    def within(self, radius: int, query: np.ndarray, node: np.ndarray, prints: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a query's row and a tree's row no further apart than radius; node: the root to begin from."""
        stack = [(query, node)]
        while stack:
            q, at = stack.pop()
            if len(q) > PAIRS:
                half = len(q) // 2
                stack += [(q[half:], at[half:]), (q[:half], at[:half])]
                continue
            d = self.distance(q, at, prints)
            hit = d <= radius
            if hit.any():
                yield q[hit], at[hit]
            n = self.first[at + 1] - self.first[at]
            if not n.any():
                continue
            edge = np.repeat(self.first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            follow = np.abs(self.edge[edge] - np.repeat(d, n)) <= radius
            stack.append((np.repeat(q, n)[follow], self.child[edge][follow]))


def linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least row of each row's connected component."""
    label = np.arange(n)

    def roots() -> None:
        while True:
            up = label[label]
            if (up == label).all():
                return
            label[:] = up

    for a, b in pairs:
        while True:
            roots()
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    roots()
    return label


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about TASK_ROWS rows, cut between keys; the rows come sorted by key."""
    held: list = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= TASK_ROWS:
            t = pa.Table.from_batches(held).combine_chunks()
            keys = t.column("key").to_numpy()
            upto = int(np.searchsorted(keys, keys[-1], "left"))
            if upto:
                yield t.slice(0, upto)
                held, rows = t.slice(upto).to_batches(), rows - upto
    if rows:
        yield pa.Table.from_batches(held)


def _crowded(prints: DataFrame, shards: Shards, buckets: int = 1 << 16) -> bool:
    """Whether any of a fixed number of buckets of keys has more than TASK_ROWS nodes, as it has if a key in it does."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                keys = shards.keys(np.stack([c.to_numpy(zero_copy_only=False) for c in b.slice(lo, 1024).columns], axis=1))
                total += np.bincount((mix(keys.ravel().astype(np.uint64)) % np.uint64(buckets)).astype(np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    most = prints.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) > TASK_ROWS


def links(docs: DataFrame, radius: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept_id, n_links) of each document that has a near copy: the least id of its group, and how many documents
    lie no further than radius from it.

    A document's fingerprint has 256 bits, the signs of the sums of its distinct words' hash bits, weighted by inverse
    document frequency over the whole table (counted in 2^18 buckets). Groups are the connected components of pairs of
    fingerprints no further apart than radius. Documents of one fingerprint are one node, however many they are. Each node is
    put into shards by some of its bits, 12 or more as the nodes need, and is looked up in the BK-tree of each: so many
    shards that a pair as far apart as radius meets in one with probability RECALL, and nearer ones more surely (pairs up to
    15 apart always). A shard's tree is built where the shard's queries are brought together, by one shuffle of fingerprints:
    what is sent to every executor is the table of frequencies alone, whose size is fixed. A pair is counted in the first
    shard that it shares. A key that more than TASK_ROWS nodes have is split into blocks, each of which is compared with each.

    A document with no word (null, empty or only signs) is never a duplicate. Rows of one id are one document; if their texts
    differ, it has the links of each, and belongs to the group of least id. Rows with a null id are left out. Ties don't
    arise, since the least id stays. An empty table gives an empty result; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t")).where("id is not null and t is not null")
    kind = src.schema["id"].dataType.simpleString()
    spark = docs.sparkSession
    n, df = frequencies(src.select("t"), 1 << BUCKET_BITS, _present)
    weights = spark.sparkContext.broadcast((np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in slices(b.column(1)):
                h, d = _distinct(Words(data, off, NON_ALNUM))
                fp = fingerprints(h, d, hi - lo, weights.value)
                some = np.unique(d)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + some)), *(pa.array(fp[some, k].view(np.int64)) for k in range(LANES))], ["id", *lanes])

    lanes = [f"f{k}" for k in range(LANES)]
    bigints = ", ".join(f"{x} bigint" for x in lanes)
    made = cut(src.mapInArrow(prints, f"id {kind}, {bigints}").distinct())
    nodes = cut(made.groupBy(*lanes).agg(F.min("id").alias("node"), F.count("*").alias("copies")).withColumn("row", F.monotonically_increasing_id()))
    shards = Shards(nodes.count(), radius)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                keys = shards.keys(np.stack([part.column(2 + k).to_numpy(zero_copy_only=False) for k in range(LANES)], axis=1))
                at = pa.array(np.repeat(np.arange(len(keys)), shards.count))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(c.take(at) for c in part.columns)], ["key", "row", "copies", *lanes])

    keyed = nodes.select("row", "copies", *lanes).mapInArrow(spread, f"key bigint, row bigint, copies bigint, {bigints}")
    keyed = keyed.withColumn("shard", F.shiftright("key", 41).cast("int")).withColumn("side", F.lit(0))
    if _crowded(nodes.select(*lanes), shards):  # else no key has more than TASK_ROWS, and none need be counted by itself
        hot = cut(keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > TASK_ROWS).select("key", F.ceil(F.col("size") * 2 / TASK_ROWS).alias("parts")))
        blocks = cut(hot.select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), "parts").select("key", "parts", "i", F.explode(F.expr("sequence(i, parts - 1)")).alias("j")).withColumn("block", F.monotonically_increasing_id() + F.lit(1 << 60)))
        dealt = keyed.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("row"), "parts")).where("own = i or own = j")
        side = F.when(F.col("i") == F.col("j"), 0).when(F.col("own") == F.col("i"), 1).otherwise(2)
        dealt = dealt.withColumn("side", side).withColumn("key", F.col("block")).select(keyed.columns)
        keyed = keyed.join(hot, "key", "left_anti").unionByName(dealt)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _keyed(batches):
            key, row, copies, shard, side = (t.column(c).to_numpy() for c in ("key", "row", "copies", "shard", "side"))
            fp = np.stack([t.column(x).to_numpy() for x in lanes], axis=1).view(np.uint64)
            tree = np.flatnonzero(side != 1)
            forest = Forest(key[tree], np.ascontiguousarray(fp[tree]))
            ask = np.flatnonzero(side != 2)
            at = np.searchsorted(key[tree], key[ask])
            met = at < len(tree)
            met[met] = key[tree][at[met]] == key[ask][met]
            count = np.zeros(len(key), np.int64)

            def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for q, node in forest.within(radius, ask[met], at[met], fp):
                    other = tree[node]
                    q, other = q[q != other], other[q != other]
                    new = shards.first(fp[q] ^ fp[other], shard[q])
                    np.add.at(count, q[new], copies[other[new]])
                    new &= side[q] == 1  # a block's own pairs come in both orders
                    np.add.at(count, other[new], copies[q[new]])
                    yield q, other

            label = linked(len(key), pairs())
            at = np.flatnonzero(label != np.arange(len(key)))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([row[at], row[some]])), pa.array(np.concatenate([row[label[at]], row[some]])), pa.array(np.concatenate([np.zeros(len(at), np.int64), count[some]]))], ["a", "b", "n"])

    found = cut(keyed.repartition("key").sortWithinPartitions("key", "row").mapInArrow(search, "a bigint, b bigint, n bigint"))
    root = components(found.where("a <> b").select("a", "b"))
    counted = found.where("a = b").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n"))
    rows = nodes.join(root.select(F.col("node").alias("row"), F.col("root").alias("top")), "row", "left").join(counted, "row", "left")
    rows = rows.select(*lanes, "node", F.coalesce("top", "row").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    top = rows.groupBy("root").agg(F.min("node").alias("kept"))
    of = made.join(rows.select(*lanes, "root", "n"), lanes).join(top, "root")
    kept = f"kept_{id_col}"
    return of.groupBy("id").agg(F.min("kept").alias("kept"), F.sum("n").alias("n_links")).where("n_links > 0 or id <> kept").select(F.col("id").alias(id_col), F.col("kept").alias(kept), "n_links")


def near_duplicates(docs: DataFrame, radius: int = 28, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, kept_id) of each document to drop, and the one of its group that stays; links() says what a group is, and what
    nulls, empty texts, repeated rows and empty tables give."""
    found = links(docs, radius, id_col, text_col)
    own, kept, _ = found.columns
    return found.where(F.col(own) != F.col(kept)).select(own, kept)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))
