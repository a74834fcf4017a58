"""Line survival: how much of what was written when is still there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import cut


def deltas(lives: DataFrame) -> DataFrame:
    """(path, author, actor, cur_tick, prev_tick, delta): lines written at prev_tick come or go at cur_tick."""
    born = lives.select("path", "author", F.col("author").alias("actor"), F.col("birth").alias("cur_tick"), F.col("birth").alias("prev_tick"), F.col("lines").alias("delta"))
    gone = lives.select("path", "author", F.col("remover").alias("actor"), F.col("death").alias("cur_tick"), F.col("birth").alias("prev_tick"), (-F.col("lines")).alias("delta"))
    return born.unionByName(gone)


def sampled(changes: DataFrame, granularity: int, sampling: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, sample, band, lines) of all cells that aren't 0: the lines of each band of birth at the end of each sample.

    Each band's changes are summed up in order, and the sum stands until the next change; no grid of all cells is joined.
    """
    per = changes.groupBy(*keys, F.floor(F.col("cur_tick") / sampling).alias("sample"), F.floor(F.col("prev_tick") / granularity).alias("band")).agg(F.sum("delta").alias("delta"))
    last = changes.agg(F.floor(F.max("cur_tick") / sampling).alias("last"))  # one row
    w = Window.partitionBy(*keys, "band").orderBy("sample")
    runs = per.withColumn("lines", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("sample").over(w))
    runs = runs.where("lines <> 0").crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(F.col("next") - 1, "last"))
    return runs.select(*keys, F.explode(F.sequence("sample", "until")).alias("sample"), "band", F.col("lines").cast("bigint"))


def dense(cells: DataFrame) -> DataFrame:
    """cells (sample, band, lines) of one project with the zeros between; the grid has as many rows as the matrix."""
    size = cells.agg(F.max("sample").alias("s"), F.max("band").alias("b"))
    grid = size.select(F.explode(F.sequence(F.lit(0).cast("bigint"), "s")).alias("sample"), "b").select("sample", F.explode(F.sequence(F.lit(0).cast("bigint"), "b")).alias("band"))
    return grid.join(cells, ["sample", "band"], "left").withColumn("lines", F.coalesce("lines", F.lit(0).cast("bigint")))


def _own() -> Column:
    return (F.col("delta") > 0) & F.col("author").eqNullSafe(F.col("actor"))


def overwrites(changes: DataFrame, pieces: int | None = None) -> DataFrame:
    """(author, kind, other, lines): own lines written (self), removed by nobody known (unknown) and by each author (by).

    Pairs of authors are next to as many as the changes, so that these are dealt over so many pieces, where they are given."""
    kind = F.when(_own(), "self").when(F.col("actor").isNull(), "unknown").otherwise("by")
    other = F.when(kind == "by", F.col("actor"))
    rows = changes.where("author is not null").select("author", kind.alias("kind"), other.alias("other"), "delta")
    rows = rows.repartition(pieces, "author", "other") if pieces else rows
    return rows.groupBy("author", "kind", "other").agg(F.sum("delta").cast("bigint").alias("lines"))


def overwrites_of_best(changes: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The rows of overwrites whose author is one of the k with most own lines, and these authors; equals go by author.

    Own lines are a row an author; the pairs of authors, which are next to as many as the changes, are made for the best alone.
    """
    own = changes.where("author is not null").where(_own()).groupBy("author").agg(F.sum("delta").cast("bigint").alias("lines"))
    best = cut(own.orderBy(F.desc("lines"), "author").limit(k).select("author"))
    return overwrites(changes.join(F.broadcast(best), "author", "left_semi")), best  # k rows


def normalised(matrix: DataFrame) -> DataFrame:
    """(author, other, share): lines removed by other, over the lines written; an author without own lines has 0."""
    own = matrix.where("kind = 'self'").select("author", F.col("lines").alias("own"))
    gone = matrix.where("kind <> 'self'").join(own, "author", "left")
    return gone.select("author", "other", F.when(F.coalesce("own", F.lit(0)) == 0, 0.0).otherwise(-F.col("lines") / F.col("own")).alias("share"))


def ownership(lives: DataFrame, horizon: Column) -> DataFrame:
    """(path, author, lines) alive at the tick horizon; no author reads as -1."""
    alive = lives.where((F.col("birth") <= horizon) & (F.col("death") > horizon))
    return alive.groupBy("path", F.coalesce("author", F.lit(-1)).alias("author")).agg(F.sum("lines").alias("lines"))


def ranked_owners(owned: DataFrame) -> DataFrame:
    """owned (path, author, lines) with rank: the owners of each file by lines, the greatest first."""
    return owned.withColumn("rank", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("lines"), "author")).cast("bigint"))


def labelled(cells: DataFrame, granularity: int, sampling: int, origin: str) -> DataFrame:
    """cells with day, that on which the sample ends, and label, the days 'from - to' of the band; origin is that of tick 0."""
    def day(ticks: Column) -> Column:
        return F.date_add(F.to_date(F.lit(origin)), ticks.cast("int"))

    first = F.col("band") * granularity
    label = F.concat_ws(" - ", day(first).cast("string"), day(first + granularity).cast("string"))
    return cells.withColumn("day", day((F.col("sample") + 1) * sampling).cast("string")).withColumn("label", label)


def first_appearance(cells: DataFrame, key: str) -> DataFrame:
    """The first sample in which each key has lines."""
    return cells.where("lines > 0").groupBy(key).agg(F.min("sample").alias("sample"))


def survival(lives: DataFrame, horizon: Column) -> DataFrame:
    """(age, at_risk, deaths, survival): Kaplan-Meier over lines; what is alive at the tick horizon is censored there."""
    seen = lives.where(F.col("birth") <= horizon)
    died = F.col("death") <= horizon
    per = seen.groupBy((F.least("death", horizon) - F.col("birth")).alias("age")).agg(F.sum(F.when(died, F.col("lines")).otherwise(0)).alias("deaths"), F.sum("lines").alias("ended"))
    w = Window.orderBy("age")  # a row for each age in ticks
    risk = per.withColumn("at_risk", F.sum("ended").over(w.rowsBetween(0, Window.unboundedFollowing)))
    left = F.when(F.col("deaths") == F.col("at_risk"), F.lit(float("-inf"))).otherwise(F.log(1 - F.col("deaths") / F.col("at_risk")))
    return risk.select("age", "at_risk", "deaths", F.exp(F.sum(left).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("survival"))
