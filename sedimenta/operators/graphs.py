"""Commit graphs and alias graphs: reachability, components, chains, order."""

from __future__ import annotations

import heapq
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's; a temporary one only in local mode, where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="history-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from (a, b): the least node of each connected component, by alternating large and small stars.

    Each round is two shuffles over the edges that are left; their number falls as the logarithm of the longest path.
    """
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def state() -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state()  # edges that are stars already take one round
    while True:
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        e = cut(small.where("a <> b").distinct())
        now = state()
        if now == before:
            break
        before = now
    roots = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def largest_component(edges: DataFrame) -> DataFrame:
    """The nodes of the component with most of them; of equals, the one of least root."""
    found = cut(components(edges))
    best = found.groupBy("root").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(1)
    return found.join(F.broadcast(best), "root").select("node")  # one row


#: Generations that are walked one by one before lines are followed by jumps.
GENERATIONS = 64
#: Commits of a generation up to which it is broadcast.
NEAR = 100_000


def ancestors(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """Every commit that is reached from heads (commit) over parents (commit, parent), heads included.

    The first generations are walked one at a time, by one pass over the edges each, which are held in columns for that. Where a
    history goes on beyond them, the rest is followed by jumps.
    """
    edge = parents.where("parent is not null").select("commit", "parent").distinct().persist()
    front = cut(heads.select("commit").distinct())
    seen = front
    for _ in range(GENERATIONS):
        near = F.broadcast(front) if front.count() <= NEAR else front
        new = edge.join(near, "commit").select(F.col("parent").alias("commit")).distinct()
        front = cut(new.join(seen, "commit", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    else:
        seen = _followed(edge, cut(seen), front)
    edge.unpersist()
    return seen


def _followed(edge: DataFrame, seen: DataFrame, front: DataFrame) -> DataFrame:
    """seen with all that is reached from front, a part of it, over edge (commit, parent).

    One parent of each commit makes lines, which are followed whole by jumps of 1, 2, 4 and so on; what hangs on them by other
    parents begins the next round. So a history takes as many rounds as merges lie within merges, not as many as it has
    generations.
    """
    jump = cut(edge.groupBy("commit").agg(F.min("parent").alias("to")))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        nxt = jump.select(F.col("commit").alias("_c"), F.col("to").alias("_t"))
        jump = cut(jump.join(nxt, F.col("to") == F.col("_c")).select("commit", F.col("_t").alias("to")))
    while True:
        reach = front
        for j in reversed(jumps):  # each distance is a sum of powers of two, so that every commit of the line is met
            reach = cut(reach.unionByName(reach.join(j, "commit").select(F.col("to").alias("commit"))).distinct())
        new = cut(reach.join(seen, "commit", "left_anti"))
        seen = cut(seen.unionByName(new))
        side = reach.join(edge, "commit").select(F.col("parent").alias("commit")).distinct()
        front = cut(side.join(seen, "commit", "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def first_parents(commits: DataFrame) -> DataFrame:
    """(commit, parent) along first parents alone, from (commit, parents)."""
    return commits.select("commit", F.get("parents", F.lit(0)).alias("parent"))


def unique_parents(commits: DataFrame) -> DataFrame:
    """commits (commit, parents) with each parent once, in the order of first mention, without the commit itself."""
    return commits.withColumn("parents", F.array_distinct(F.filter("parents", lambda p: p != F.col("commit"))))


def chain(renames: DataFrame) -> DataFrame:
    """(path, live): the last name of each path, from (from_path, to_path), by doubling of the jumps. Of a path that has been
    renamed more than once, the least target counts; the names of a circle stand for themselves."""
    step = cut(renames.where("from_path <> to_path").groupBy(F.col("from_path").alias("path")).agg(F.min("to_path").alias("live")))
    while True:
        nxt = step.select(F.col("path").alias("_p"), F.col("live").alias("_l"))
        new = cut(step.join(nxt, F.col("live") == F.col("_p"), "left").where("_l is null or _l <> path").select("path", F.coalesce("_l", "live").alias("live")))
        moved = new.join(step.select("path", F.col("live").alias("_o")), "path").where("live <> _o").isEmpty()
        if moved and new.count() == step.count():
            return new
        step = new


def toposort(edges: dict[str, list[str]]) -> list[str]:
    """The nodes of a small graph, each behind those that lead to it; what is free at once goes by name."""
    nodes = set(edges) | {x for v in edges.values() for x in v}
    waits = {n: 0 for n in nodes}
    for v in edges.values():
        for x in v:
            waits[x] += 1
    free = [n for n in nodes if not waits[n]]
    heapq.heapify(free)
    out = []
    while free:
        n = heapq.heappop(free)
        out.append(n)
        for x in edges.get(n, []):
            waits[x] -= 1
            if not waits[x]:
                heapq.heappush(free, x)
    if len(out) < len(nodes):
        raise ValueError(f"a circle among {sorted(nodes - set(out))}")
    return out
