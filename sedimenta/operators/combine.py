"""Results of many repositories made one."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import matrices
from .identity import union_identities


def header(results: DataFrame) -> DataFrame:
    """One row from (repo, begin, end, commits, run_time): the names joined, first begin, last end, sums."""
    return results.agg(F.array_join(F.array_sort(F.collect_set("repo")), " & ").alias("repo"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum("commits").alias("commits"), F.sum("run_time").alias("run_time"))


def devs(results: DataFrame, starts: DataFrame) -> DataFrame:
    """Sums of (repo, tick, author, lang, ...) by tick, author and lang, once each repository's ticks are moved by what it
    begins later than the first; starts (repo, start) counts ticks. Starts are a name and a number a repository, and broadcast: a
    shuffle by repository would be as many tasks as there are repositories."""
    first = starts.agg(F.min("start").alias("_first"))  # one row
    shift = starts.crossJoin(F.broadcast(first)).select("repo", (F.col("start") - F.col("_first")).alias("_by"))
    moved = results.join(F.broadcast(shift), "repo").withColumn("tick", F.col("tick") + F.col("_by"))
    return moved.groupBy("tick", "author", "lang").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("commits", "added", "removed", "changed")])


def couples(results: DataFrame) -> DataFrame:
    return results.groupBy("file1", "file2").agg(F.sum("n").cast("bigint").alias("n"))


def couples_results(*results: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sums of (file pairs (file1, file2, n), people pairs (author1, author2, n), file lines (path, lines)) of several
    repositories. People go by label: labels that share a name or an address become one; null is whoever isn't known."""
    pairs, people, sizes = zip(*results)
    labels = [p.select(F.col("author1").alias("label")).union(p.select(F.col("author2"))).where("label is not null").distinct() for p in people]
    names = union_identities(*labels)

    def renamed(df: DataFrame, column: str) -> DataFrame:
        key = names.select(F.col("key").alias("_key"), F.col("label").alias("_label")).dropDuplicates(["_key"])
        return df.join(key, F.element_at(F.split(column, r"\|"), 1) == F.col("_key"), "left").withColumn(column, F.col("_label")).drop("_key", "_label")

    files = reduce(DataFrame.unionByName, pairs).groupBy("file1", "file2").agg(F.sum("n").cast("bigint").alias("n"))
    who = renamed(renamed(reduce(DataFrame.unionByName, people), "author1"), "author2").groupBy("author1", "author2").agg(F.sum("n").cast("bigint").alias("n"))
    return files, who, reduce(DataFrame.unionByName, sizes).groupBy("path").agg(F.sum("lines").cast("bigint").alias("lines"))


def merged(results: list[dict[str, DataFrame]], only: str | None = None) -> tuple[dict[str, DataFrame], list[str]]:
    """The results of several runs, by leaf, as one, and what couldn't be merged. With only just that leaf is merged."""
    known = {"Devs": ("tick", "author"), "Languages": ("tick", "author", "lang"), "Couples": ("file1", "file2"), "CouplesPeople": ("author1", "author2"), "Churn": ("tick", "author"), "Overwrites": ("author", "kind", "other"), "Shotness": ("path", "node"), "ImportsPerDeveloper": ("author", "lang", "import", "tick"), "FileHistory": ("path", "author"), "Ownership": ("path", "author")}
    out: dict[str, DataFrame] = {}
    errors = []
    for name in dict.fromkeys(n for r in results for n in r if not n.startswith("_") and only in (None, n)):
        parts = [r[name] for r in results if name in r]
        if len(parts) > 1 and name not in known:
            errors.append(f"{name}: results can't be merged")
            continue
        if len({tuple(sorted(p.columns)) for p in parts}) > 1:
            errors.append(f"{name}: results have other columns")
            continue
        keys = [c for c in known.get(name, ()) if c in parts[0].columns]
        sums = [F.sum(c).cast("bigint").alias(c) for c in parts[0].columns if c not in keys]
        out[name] = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*sums) if len(parts) > 1 else parts[0]
    return out, errors


def burndown(results: DataFrame) -> DataFrame:
    """(key, sample, band, lines) from (key, repo, granularity, sampling, start, sample, band, lines): each repository's matrix is
    interpolated to single ticks, moved by its start, added and sampled at the finest setting. One group a key."""
    kind = dict(results.dtypes)["key"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for (_, g, s, start), own in pdf.groupby(["repo", "granularity", "sampling", "start"], sort=True):
            m = np.zeros((int(own["sample"].max()) + 1, int(own["band"].max()) + 1))
            m[own["sample"].to_numpy(), own["band"].to_numpy()] = own["lines"]
            parts.append((m, int(g), int(s), int(start)))
        total = matrices.merge(parts)[0]
        sample, band = np.indices(total.shape)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "sample": sample.ravel(), "band": band.ravel(), "lines": np.trunc(np.round(total.ravel(), 6)).astype(np.int64)})

    return results.groupBy("key").applyInPandas(one, f"key {kind}, sample bigint, band bigint, lines bigint")


def resampled(cells: DataFrame, granularity: int, sampling: int, origin: str, unit: str = "year") -> DataFrame:
    """(period, day, lines) from (sample, band, lines): bands become periods of the calendar by interpolation; origin is the
    day of tick 0. The matrix of one project is handled in one task."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((int(pdf["sample"].max()) + 1, int(pdf["band"].max()) + 1))
        m[pdf["sample"].to_numpy(), pdf["band"].to_numpy()] = pdf["lines"]
        ticks = matrices.interpolate(m, granularity, sampling)
        days = pd.date_range(origin, periods=max(ticks.shape), freq="D")
        period = days.to_period({"year": "Y", "month": "M", "day": "D"}[unit]).astype(str)
        out = []
        for p in dict.fromkeys(period[: ticks.shape[1]]):
            own = np.flatnonzero(period[: ticks.shape[1]] == p)
            for k in range(sampling - 1, ticks.shape[0], sampling):
                out.append((p, str(days[k].date()), float(ticks[k, own].sum())))
        return pd.DataFrame(out, columns=["period", "day", "lines"])

    return cells.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(lambda pdf: one(pdf), "period string, day string, lines double")
