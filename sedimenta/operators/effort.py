"""Who did how much, when and in what language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ranges import carried, ranged

STATS = ("added", "removed", "changed")


def effort() -> Column:
    """Lines added, removed and changed."""
    return F.col("added") + F.col("removed") + F.col("changed")


def _sums() -> list[Column]:
    return [F.sum(c).cast("bigint").alias(c) for c in STATS]


def plain(log: DataFrame) -> DataFrame:
    """log without merge commits, where it tells them (is_merge)."""
    return log.where("not coalesce(is_merge, false)") if "is_merge" in log.columns else log


def devs(log: DataFrame, empty_commits: DataFrame | None = None) -> DataFrame:
    """tick, author, commits and lines; commits without a change count only if their table (commit, author, tick) is given.

    A merge commit counts as a commit; its lines are those of the commits it merges, and don't count again.
    """
    if "is_merge" in log.columns:
        own = ~F.coalesce("is_merge", F.lit(False))
        log = log.withColumns({c: F.when(own, F.col(c)).otherwise(0) for c in STATS})
    per = log.groupBy("tick", "author", "commit").agg(*_sums())  # one row a commit, so that no distinct count is needed
    if empty_commits is not None:
        bare = empty_commits.join(log.select("commit").distinct(), "commit", "left_anti")
        per = per.unionByName(bare.select("tick", "author", "commit", *[F.lit(0).cast("bigint").alias(c) for c in STATS]))
    return per.groupBy("tick", "author").agg(F.count("*").alias("commits"), *_sums())


def by_language(log: DataFrame) -> DataFrame:
    return plain(log).groupBy("tick", "author", "lang").agg(*_sums())


def totals(log: DataFrame) -> DataFrame:
    per = log.groupBy("author", "commit").agg(F.sum(effort()).cast("bigint").alias("lines"))
    return per.groupBy("author").agg(F.count("*").alias("commits"), F.sum("lines").alias("lines"))


def top(df: DataFrame, by: str, k: int, *ties: str) -> DataFrame:
    """The k rows of greatest by; ties go by the other columns."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def top_with_others(df: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """df with who: key for the k keys of greatest total value, 'others' for the rest. The list of k is broadcast."""
    best = top(df.groupBy(key).agg(F.sum(value).alias("_total")), "_total", k, key).select(F.col(key).alias("_key"))
    joined = df.join(F.broadcast(best), F.col(key) == F.col("_key"), "left")
    return joined.withColumn("who", F.coalesce(F.col("_key").cast("string"), F.lit("others"))).drop("_key")


def cumulative_efforts(log: DataFrame, k: int = 20) -> DataFrame:
    """who, tick, effort, total: running sums for the k most active authors and all others together."""
    daily = log.groupBy("author", "tick").agg(F.sum(effort()).cast("bigint").alias("effort"))
    per = top_with_others(daily, "author", "effort", k).groupBy("who", "tick").agg(F.sum("effort").alias("effort"))
    return per.withColumn("total", F.sum("effort").over(Window.partitionBy("who").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)))


def old_vs_new(log: DataFrame) -> DataFrame:
    return log.groupBy("tick").agg(F.sum("added").cast("bigint").alias("new_lines"), F.sum(F.col("removed") + F.col("changed")).cast("bigint").alias("old_lines"))


def languages(log: DataFrame) -> DataFrame:
    """author, lang, lines, rank; text without a language is left out."""
    per = log.where("lang <> ''").groupBy("author", "lang").agg(F.sum(effort()).cast("bigint").alias("lines"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy("author").orderBy(F.desc("lines"), "lang")).cast("bigint"))


def commits_stat(log: DataFrame) -> DataFrame:
    """commit, tick, author and files: a list of (path, lang, added, removed, changed), in order of path; no merge commits."""
    return plain(log).groupBy("commit", "tick", "author").agg(F.sort_array(F.collect_list(F.struct("path", "lang", *STATS))).alias("files"))


def churn(log: DataFrame, by_author: bool = False) -> DataFrame:
    """tick, added, removed, without pairing of the two; with by_author a row for each author."""
    gained, lost = F.col("added") + F.col("changed"), F.col("removed") + F.col("changed")
    return log.groupBy("tick", *["author"] * by_author).agg(F.sum(gained).cast("bigint").alias("added"), F.sum(lost).cast("bigint").alias("removed"))


def file_people(log: DataFrame) -> DataFrame:
    return plain(log).groupBy("path", "author").agg(*_sums())


def live(log: DataFrame) -> DataFrame:
    """path of each file whose last change isn't a deletion."""
    return log.groupBy("path").agg(F.max_by("action", F.struct("ts", "commit")).alias("last")).where("last <> 'D'").select("path")


def file_commits(log: DataFrame) -> DataFrame:
    """path and commits, in order, of each live file; an insertion begins the list anew, and merge commits don't count.

    For files that were renamed, give couples.renamed(log, alias): a file inherits what it was under its former names.
    """
    seen = F.struct("ts", "commit")
    rows = plain(log).groupBy("path").agg(F.max(F.when(F.col("action") == "I", seen)).alias("begin"), F.sort_array(F.collect_list(seen)).alias("all"), F.max_by("action", seen).alias("last"))
    kept = F.filter("all", lambda x: F.col("begin").isNull() | (x >= F.col("begin")))
    return rows.where("last <> 'D'").select("path", F.transform(kept, lambda x: x["commit"]).alias("commits"))


def file_commits_once(rows: DataFrame) -> DataFrame:
    """file_commits() from one row a file and commit: (path, commit, ts, last, inserted) with the last of its actions by name
    and whether one of them inserted."""
    seen = F.struct("ts", "commit")
    per = rows.groupBy("path").agg(F.max(F.when(F.col("inserted"), seen)).alias("begin"), F.sort_array(F.collect_list(seen)).alias("all"), F.max_by("last", seen).alias("last"))
    kept = F.filter("all", lambda x: F.col("begin").isNull() | (x >= F.col("begin")))
    return per.where("last <> 'D'").select("path", F.transform(kept, lambda x: x["commit"]).alias("commits"))


def imports(log: DataFrame) -> DataFrame:
    """How often each author used each import in each tick. A commit's files that share an import count each; merges don't."""
    return plain(log).groupBy("author", "lang", "import", "tick").agg(F.count("*").alias("n"))


def rollup(log: DataFrame, *columns: str) -> DataFrame:
    """Sums for every prefix of columns, in one pass; null stands for all."""
    return log.rollup(*columns).agg(*_sums(), F.grouping_id().cast("bigint").alias("level"))


def global_rank(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """df with name: the place of each row by value, descending, then tie, descending.

    The rows are put in ranges of their order, whose counts are summed up beside them: a row for each range, and no task gets
    all rows, however many differ in value.
    """
    held = carried(ranged(df, F.desc(value), F.desc(tie)), F.count("*"), F.sum)
    place = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc(value), F.desc(tie)))
    return held.withColumn(name, (F.coalesce("_before", F.lit(0)) + place).cast("bigint")).drop("_before", "_part")


def moving_average(df: DataFrame, key: str, order: str, value: str, radius: int) -> DataFrame:
    """df with smooth: the mean of value over the rows at most radius before and after."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-radius, radius)))
