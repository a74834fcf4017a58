"""History adapters: views that recast tables as change logs.

Canonical columns: commit, path, author, ts, tick, lang, added, removed, changed, action (I, M or D); where many repositories
are held, repo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import parts

#: Lines that a task brings together.
LINES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession, sf_dir: str) -> int:
    """As many as leave each about LINES lines; the count is read off the files' footers."""
    return parts(spark, table(spark, sf_dir, "lineitem").count(), LINES)


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """commit, author, ts, tick of each order; the tick counts days since the first."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"))
    start = orders.agg(F.min("ts").cast("date").alias("start"))  # one row
    return orders.crossJoin(F.broadcast(start)).withColumn("tick", F.datediff(F.col("ts").cast("date"), "start").cast("bigint")).drop("start")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each commit and path: the lines added, removed and changed by it. Returned items remove, accepted ones add.

    Lines go to their commit at once, and not by commit and path first: what a task sums up there is next to nothing, and all of it
    is held.
    """
    line, flag = table(spark, sf_dir, "lineitem"), F.col("l_returnflag")

    def of(what: str) -> Column:
        return F.sum(F.when(flag == what, F.col("l_quantity")).otherwise(0)).cast("bigint")

    held = line.select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), "l_quantity", "l_returnflag").repartition(partitions(spark, sf_dir), "commit")
    files = held.groupBy("commit", "path").agg(of("A").alias("added"), of("R").alias("removed"), of("N").alias("changed"), F.min(F.when(flag == "A", "1I").when(flag == "N", "2M").otherwise("3D")).alias("action"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_type").alias("lang"), F.col("p_brand").alias("import"), F.col("p_name").alias("name"))
    return files.withColumn("action", F.substring("action", 2, 1)).join(commits(spark, sf_dir), "commit").join(parts, "path")


def lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, author, remover, birth, death (ticks) and lines of each block of lines; death is the later of the two dates.

    About LINES lines meet their commits in a task, however many there are."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("remover"), F.col("l_shipdate").cast("date").alias("shipped"), F.col("l_quantity").cast("bigint").alias("lines"))
    both = line.repartition(partitions(spark, sf_dir), "commit").join(commits(spark, sf_dir), "commit")
    shipped = F.col("tick") + F.datediff("shipped", F.col("ts").cast("date"))
    return both.select("path", "author", "remover", F.least("tick", shipped).alias("birth"), F.greatest("tick", shipped).alias("death"), "lines")


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo, path, tick, author, text: each turn of a conversation is a new version of one file."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("tick"), F.col("role").alias("author"), "text")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author, repo: the region of each customer stands for a repository."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("author"), F.col("r_name").alias("repo"))
