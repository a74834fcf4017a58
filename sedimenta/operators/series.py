"""Distances and orders of people: time warping, angles, ranks, embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import diff


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): the mean vector of each label, summed up by position in the JVM."""
    cells = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("at", "x")).groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return cells.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("vector"))


def angles(vectors: DataFrame) -> DataFrame:
    """(label1, label2, cosine, angle) of each two of vectors (label, vector)."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    unit = vectors.withColumn("vector", F.transform("vector", lambda x: x / norm))
    b = unit.select(F.col("label").alias("label2"), F.col("vector").alias("v2"))
    dot = F.aggregate(F.zip_with("vector", "v2", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    pairs = unit.withColumnRenamed("label", "label1").join(b, F.col("label1") < F.col("label2")).withColumn("cosine", dot)
    return pairs.select("label1", "label2", "cosine", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))).alias("angle"))


def warped(series: DataFrame) -> DataFrame:
    """(author1, author2, distance): exact time warping of each two of series (author, values), each scaled to sum 1."""
    b = series.select(F.col("author").alias("author2"), F.col("values").alias("v2"))
    pairs = series.withColumnRenamed("author", "author1").join(b, F.col("author1") < F.col("author2"))
    kind = dict(series.dtypes)["author"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            scaled = [[np.asarray(x, float) / max(1e-300, float(np.sum(x))) for x in p[c]] for c in ("values", "v2")]
            yield p[["author1", "author2"]].assign(distance=[diff.dtw(x, y) for x, y in zip(*scaled)])

    return pairs.mapInPandas(run, f"author1 {kind}, author2 {kind}, distance double")


def seriated(distances: pd.DataFrame, cluster_gap: float = 2.0) -> pd.DataFrame:
    """(author, position, cluster): a short tour by nearest neighbours, bettered by reversals; a cluster ends at a step longer
    than cluster_gap times the median. Runs in the driver, over the people of one report."""
    names = sorted(set(distances["author1"]) | set(distances["author2"]))
    at = {n: i for i, n in enumerate(names)}
    d = np.zeros((len(names), len(names)))
    for a, b, x in distances[["author1", "author2", "distance"]].itertuples(index=False):
        d[at[a], at[b]] = d[at[b], at[a]] = x
    if not names:
        return pd.DataFrame({"author": [], "position": [], "cluster": []})
    tour, left = [0], set(range(1, len(names)))
    while left:
        tour.append(min(left, key=lambda j: (d[tour[-1], j], j)))
        left.remove(tour[-1])
    better = True
    while better:
        better = False
        for i in range(len(tour) - 1):
            for j in range(i + 1, len(tour)):
                before = (d[tour[i - 1], tour[i]] if i else 0) + (d[tour[j], tour[j + 1]] if j + 1 < len(tour) else 0)
                after = (d[tour[i - 1], tour[j]] if i else 0) + (d[tour[i], tour[j + 1]] if j + 1 < len(tour) else 0)
                if after < before - 1e-12:
                    tour[i : j + 1] = tour[i : j + 1][::-1]
                    better = True
    steps = np.array([d[a, b] for a, b in zip(tour, tour[1:])])
    far = steps > cluster_gap * np.median(steps) if len(steps) else steps
    return pd.DataFrame({"author": [names[i] for i in tour], "position": range(len(tour)), "cluster": np.concatenate([[0], np.cumsum(far)]).astype(int)})


def best_roll(a: list[int], b: list[int]) -> tuple[int, int]:
    """(shift, loss) of the cyclic shift of b with the least sum of differences from a; of equals, the least."""
    return min(((k, int(np.abs(np.asarray(a) - np.roll(b, k)).sum())) for k in range(len(b))), key=lambda x: (x[1], x[0]), default=(0, 0))


def embedded(pairs: DataFrame, size: int = 16, seed: int = 3) -> DataFrame:
    """(id, vector): embeddings of co-occurrence (a, b, n) by factorising positive mutual information with alternating least
    squares; a substitute for a trained neural model."""
    from pyspark.ml.recommendation import ALS

    total = pairs.agg(F.sum("n").alias("t"))  # one row
    ra, rb = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    info = F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))
    cells = pairs.join(ra, "a").join(rb, "b").crossJoin(F.broadcast(total)).select("a", "b", F.greatest(F.lit(0.0), info).cast("float").alias("v"))
    model = ALS(rank=size, userCol="a", itemCol="b", ratingCol="v", seed=seed, maxIter=10).fit(cells)
    return model.userFactors.select("id", F.col("features").alias("vector"))
