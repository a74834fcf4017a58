"""Approximate nearest neighbours by cross-polytope hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import cut

#: Vectors that a cell holds on average; members of a cell beyond which it is split; similarities that are held at once.
CELL, HOT, PAIRS = 96, 1 << 15, 1 << 21
#: Queries that the reach of the probes is fitted on.
SAMPLE = 256


def signs(dim: int, tables: int, seed: int) -> np.ndarray:
    """The random signs of three pseudo-rotations for each table; dim is a power of two."""
    return np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (tables, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row."""
    n, step = x.shape[1], 1
    x = x.copy()
    while step < n:
        v = x.reshape(len(x), n // (2 * step), 2, step)
        a, b = v[:, :, 0, :] + v[:, :, 1, :], v[:, :, 0, :] - v[:, :, 1, :]
        v[:, :, 0, :], v[:, :, 1, :] = a, b
        step *= 2
    return x / np.sqrt(n)


@dataclass(frozen=True)
class Hashes:
    """tables concatenations of cross-polytope hashes over dim axes (a power of two); the last of each uses rest axes only,
    so that the count of cells follows the count of vectors."""

    dim: int
    tables: int
    whole: int
    rest: int
    seed: int

    @staticmethod
    def fitting(n: int, dim: int, tables: int, seed: int) -> Hashes:
        """As many hashes as leave about CELL of n vectors in each of a table's cells."""
        wide = 1 << (dim - 1).bit_length()
        cells = max(1.0, n / CELL)
        whole = int(math.log(cells) / math.log(2 * wide)) if wide > 1 else 0
        return Hashes(wide, tables, whole, min(wide, round(cells / (2 * wide) ** whole / 2)), seed)

    def axes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """The signed axes' coordinates, for each hash of one table."""
        full = np.pad(x, ((0, 0), (0, self.dim - x.shape[1])))
        k = self.whole + (self.rest > 0)
        out = []
        for h, flips in enumerate(signs(self.dim, self.tables * max(1, k), self.seed)[table * k : (table + 1) * k]):
            y = full
            for f in flips:
                y = hadamard(y * f)
            y = y if h < self.whole else y[:, : self.rest]
            out.append(np.concatenate([y, -y], axis=1))
        return out

    def own(self, x: np.ndarray, table: int) -> np.ndarray:
        """The cell of each row: the nearest signed axis of every hash."""
        code = np.zeros(len(x), np.int64)
        for both in self.axes(x, table):
            code = code * both.shape[1] + both.argmax(axis=1)
        return code

    def losses(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """By how much each axis lies behind the nearest one: the squared difference of their coordinates."""
        return [np.square(both.max(axis=1, keepdims=True) - both) for both in self.axes(x, table)]

    def probes(self, x: np.ndarray, table: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every cell whose losses add up to no more than reach."""
        row, code, spent = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x), np.float32)
        for loss in self.losses(x, table):
            ok = spent[:, None] + loss[row] <= reach
            at, axis = np.nonzero(ok)
            row, code, spent = row[at], code[at] * loss.shape[1] + axis, spent[at] + loss[row[at], axis]
        return row, code

    def least_loss(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The reach from which on row k of a meets row k of b in a table."""
        best = np.full(len(a), np.inf, np.float32)
        for table in range(self.tables):
            code, total = self.own(b, table), np.zeros(len(a), np.float32)
            for loss in reversed(self.losses(a, table)):
                code, axis = np.divmod(code, loss.shape[1])
                total += loss[np.arange(len(a)), axis]
            best = np.minimum(best, total)
        return best


def best(query: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best distinct neighbours of each query; ties go to the lesser neighbour.

    A pair that was compared in several cells may have similarities that differ in the last bit; the greatest stays.
    """
    order = np.lexsort((-score, near, query))
    q, n = query[order], near[order]
    same = np.zeros(len(q), bool)
    same[1:] = (q[1:] == q[:-1]) & (n[1:] == n[:-1])
    order = order[~same]
    order = order[np.lexsort((near[order], -score[order], query[order]))]
    q = query[order]
    first = np.searchsorted(q, q, "left")
    return order[np.arange(len(q)) - first < k]


def top(x: np.ndarray, members: np.ndarray, names: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of x, name, similarity) of the k best members for each row; ties go to the lesser name."""
    step = max(1, PAIRS // max(1, len(members)))
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ members.T
        n = min(k, len(members))
        # whoever ties with the last of the best comes along, so that ties can go by name
        q, m = np.nonzero(s >= -np.partition(-s, n - 1, axis=1)[:, n - 1, None])
        keep = best(q, names[m], s[q, m], k)
        yield lo + q[keep], names[m[keep]], s[q[keep], m[keep]]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Tables of about limit rows, cut where the first column changes; the rows come sorted by it."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= limit:
            t = pa.Table.from_batches(held).combine_chunks()
            key = t.column(0).to_numpy()
            upto = int(np.searchsorted(key, key[-1], "left"))
            if upto:
                yield t.slice(0, upto)
                held, rows = t.slice(upto).to_batches(), rows - upto
    if rows:
        yield pa.Table.from_batches(held)


def neighbours(vectors: DataFrame, k: int = 10, tables: int = 16, recall: float = 0.95, seed: int = 11, id_col: str = "vec_id", vector_col: str = "embedding", queries: Column | None = None) -> DataFrame:
    """(id, neighbor_id, rank, similarity) of the k nearest other vectors by cosine, for each vector or those that queries,
    a condition on id_col, holds for.

    Each table turns the unit vectors by rounds of random signs and Hadamard transforms and puts each into a cell: the
    nearest signed axis of each of several hashes, as many as leave about CELL vectors in a cell whatever the size of the
    table. A query looks into every cell whose axes lie no further behind its nearest ones than a reach, and is compared
    exactly with what lies there; the best of all cells are merged. The reach is fitted on SAMPLE queries, which are compared
    with all vectors: it is what finds a share of recall of their k nearest. Every vector is in the index.

    Equal vectors are one: the index holds it once, and its k + 1 least ids share what is found. Cells of more than HOT
    vectors are split over several tasks.

    Null vectors, those with an element that is null, not a number or infinite, those of length 0, and rows without an id
    have no row and are nobody's neighbour. Vectors are filled up with zeros to a power of two; all must have one dimension,
    else an error is raised. Rows that share an id are one vector, the least. Ties in similarity go by id. A vector with fewer
    than k others has as many rows as there are others found. An empty table gives no rows; other columns are ignored. Ids are
    whole numbers.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    src = src.where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = float('inf')) and exists(v, x -> x <> 0)").groupBy("id").agg(F.min("v").alias("v"))

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            size = b.column(1).value_lengths().to_numpy()
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            for lo, hi in zip(np.cumsum(size) - size, np.cumsum(size)):
                x = flat[lo:hi] / np.abs(flat[lo:hi]).max()
                raw.append((x / np.sqrt(x @ x)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["id", "v"])

    units = cut(src.mapInArrow(unit, "id bigint, v binary"))
    few = units.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)  # cut down before the shuffle
    index = cut(few.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")))
    n, low, high = index.agg(F.count("*"), F.min(F.octet_length("v")), F.max(F.octet_length("v"))).first()
    if n and low != high:
        raise ValueError("vectors must have one dimension")
    dim = (low or 4) // 4
    hashes = Hashes.fitting(n, dim, tables, seed)
    asked = units if queries is None else units.withColumnRenamed("id", id_col).where(queries).withColumnRenamed(id_col, "id")
    asked = cut(asked.select(F.col("id").alias("q"), "v").join(index.select("v", "id"), "v").select("q", "id"))
    wanted = index.join(asked.select("id").distinct(), "id", "left_semi").select("id", "v")
    reach = _fitted(index, wanted, hashes, dim, k, recall)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                x = _matrix(part.column(1), dim)
                for t in range(tables):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.own(x, t) * tables + t), *part.columns], ["cell", "id", "v"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                x = _matrix(part.column(1), dim)
                for t in range(tables):
                    row, code = hashes.probes(x, t, reach)
                    for a in range(0, len(row), 1 << 14):
                        at = pa.array(row[a : a + (1 << 14)])
                        yield pa.RecordBatch.from_arrays([pa.array(code[a : a + (1 << 14)] * tables + t), part.column(0).take(at), part.column(1).take(at)], ["cell", "id", "v"])

    kinds = "cell bigint, id bigint, v binary"
    members, probes = index.select("id", "v").mapInArrow(placed, kinds), wanted.mapInArrow(probing, kinds)
    hot = cut(members.groupBy("cell").agg(F.count("*").alias("size")).where(F.col("size") > HOT).select("cell", F.ceil(F.col("size") / HOT).alias("parts")))
    if not hot.isEmpty():  # a hot cell's members are dealt over its parts, each of which all its queries see
        part = F.coalesce("parts", F.lit(1))
        members = members.join(hot, "cell", "left").select(F.xxhash64("cell", F.pmod(F.xxhash64("id"), part)).alias("cell"), "id", "v")
        probes = probes.join(hot, "cell", "left").select("cell", "id", "v", F.explode(F.sequence(F.lit(0), part - 1)).alias("p")).select(F.xxhash64("cell", F.col("p").cast("bigint")).alias("cell"), "id", "v")
    both = members.withColumn("asks", F.lit(False)).union(probes.withColumn("asks", F.lit(True)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1 << 15):
            cell, ids, asks = (run.column(c).to_numpy() for c in ("cell", "id", "asks"))
            x = _matrix(run.column("v"), dim)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
            found: list = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                middle = lo + int(np.searchsorted(asks[lo:hi], True))
                if lo < middle < hi:
                    found += [(ids[middle + q], m, s) for q, m, s in top(x[middle:hi], x[lo:middle], ids[lo:middle], k + 1)]
            if found:
                q, m, s = (np.concatenate(z) for z in zip(*found))
                at = best(q, m, s, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(m[at]), pa.array(s[at])], ["q", "n", "s"])

    pairs = both.repartition("cell").sortWithinPartitions("cell", "asks").mapInArrow(compare, "q bigint, n bigint, s float")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 1 << 16):
            q, m, s = (run.column(c).to_numpy() for c in range(3))
            at = best(q, m, s, k + 1)
            yield pa.RecordBatch.from_arrays([pa.array(q[at]), pa.array(m[at]), pa.array(s[at].astype(np.float64))], ["q", "n", "s"])

    merged = pairs.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "rep bigint, n bigint, s double")
    each = merged.join(index.select(F.col("id").alias("n"), "ids"), "n").select("rep", "s", F.explode("ids").alias("n"))
    out = asked.withColumnRenamed("id", "rep").join(each, "rep").where("q <> n")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(id_col), F.col("n").alias("neighbor_id"), "rank", F.col("s").alias("similarity"))


def _fitted(index: DataFrame, wanted: DataFrame, hashes: Hashes, dim: int, k: int, recall: float) -> float:
    """The reach that finds a share of recall of the k nearest of SAMPLE queries, drawn by a hash of the id."""
    drawn = wanted.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    ids = drawn.column("id").to_numpy()
    if not len(ids):
        return 0.0
    x = _matrix(drawn.column("v"), dim)
    held = index.sparkSession.sparkContext.broadcast((ids, x))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = held.value
        rest: list = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, object)]
        for b in batches:
            own, m = b.column(0).to_numpy(), _matrix(b.column(1), dim)
            order = np.argsort(own)
            for row, near, s in top(q, m, own, k + 1):
                raw = np.array([m[order[j]].tobytes() for j in np.searchsorted(own[order], near).tolist()], object)
                rest = [np.concatenate([old, new]) for old, new in zip(rest, (names[row], near, s, raw))]
            at = best(*rest[:3], k + 1)
            rest = [r[at] for r in rest]
        yield pa.RecordBatch.from_arrays([pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2].astype(np.float32)), pa.array(rest[3].tolist(), pa.binary())], ["q", "n", "s", "v"])

    near = index.select("id", "v").mapInArrow(exact, "q bigint, n bigint, s float, v binary").where("q <> n")
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "n"))).where(F.col("at") <= k).select("q", "v").toArrow()
    if not near.num_rows:
        return 0.0
    order = np.argsort(ids)
    a = x[order[np.searchsorted(ids[order], near.column("q").to_numpy())]]
    return float(np.quantile(hashes.least_loss(a, _matrix(near.column("v"), dim)), recall, method="higher")) + 1e-6


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 20, among all vectors."""
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), queries=F.col("vec_id") % 20 == 0)
