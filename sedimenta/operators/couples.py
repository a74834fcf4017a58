"""What changes together: co-occurrence of files and of people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graphs import cut
from .ranges import parts

#: Pairs that a task counts.
PAIRS = 4_000_000


def capped(changes: DataFrame, max_files: int = 1000) -> DataFrame:
    """The lists of distinct paths of commits of at most max_files files; larger ones say nothing of what belongs together."""
    lists = changes.groupBy("commit").agg(F.collect_set("path").alias("paths"))
    return lists.where(F.size("paths") <= max_files).select("paths")


def files(changes: DataFrame, max_files: int = 1000) -> DataFrame:
    """(file1, file2, n): in how many commits both changed; on the diagonal, in how many the file did.

    The pairs are made within a commit's list.
    """
    return paired(capped(changes, max_files))


def paired(lists: DataFrame) -> DataFrame:
    """(keys, file1, file2, n) from (keys, paths), whose other columns are the keys: in how many lists both are.

    Each pair is sent and counted one way and then given both ways. Hardly any pair comes twice in the lists of one task, so nothing
    is summed up before the shuffle, which has as many partitions as there are pairs for.
    """
    keys = [c for c in lists.columns if c != "paths"]
    held = cut(lists.withColumn("paths", F.sort_array("paths")))
    size = F.size("paths").cast("bigint")
    n = parts(held.sparkSession, held.agg(F.sum(size * (size + 1) / 2)).first()[0] or 0, PAIRS)
    one = held.select(*keys, "paths", F.posexplode("paths").alias("_at", "file1"))
    pairs = one.select(*keys, "file1", F.explode(F.slice("paths", F.col("_at") + 1, F.size("paths"))).alias("file2"))
    return _both_ways(pairs.repartition(n, *keys, "file1", "file2").groupBy(*keys, "file1", "file2").agg(F.count("*").alias("n")), "file1", "file2")


def _both_ways(half: DataFrame, a: str, b: str) -> DataFrame:
    """half, which has each pair one way, with the other way beside it; the diagonal stays once."""
    there, back = F.struct(a, b), F.struct(F.col(b).alias(a), F.col(a).alias(b))
    ways = F.when(F.col(a).eqNullSafe(F.col(b)), F.array(there)).otherwise(F.array(there, back))
    rest = [c for c in half.columns if c not in (a, b)]
    return half.select(*rest, F.explode(ways).alias("_way")).select(*[F.col(f"_way.{c}") if c in (a, b) else c for c in half.columns])


def contexts(changes: DataFrame, max_files: int = 1000) -> DataFrame:
    """The rows of changes (commit, path, action, seq, is_merge) that make up a commit's context: what it inserts or modifies.

    A merge commit only adds the files that no earlier commit of at most max_files files has shown; files are seen in order of
    seq. One shuffle by commit for the sizes, one by path for the first showing.
    """
    touched = changes.where("action <> 'D'")
    sizes = touched.withColumn("_size", F.count("*").over(Window.partitionBy("commit")))
    by = Window.partitionBy("path").orderBy("seq", "commit").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max((F.col("_size") <= max_files).cast("int")).over(by), F.lit(0)) > 0
    return sizes.withColumn("_before", before).where("not coalesce(is_merge, false) or not _before").drop("_size", "_before")


def contributions(changes: DataFrame, max_files: int = 1000) -> DataFrame:
    """The rows that count for people: contexts, and the deletions of commits that aren't merges. No author reads as -1."""
    gone = changes.where("action = 'D' and not coalesce(is_merge, false)")
    return contexts(changes, max_files).unionByName(gone).withColumn("author", F.coalesce("author", F.lit(-1)))


def propagated(pairs: DataFrame, alias: DataFrame, live: DataFrame) -> DataFrame:
    """(file1, file2, n) between live files (path), from pairs over all names, with what their former names (alias: path, live)
    had in common with the others added on both sides."""
    ends = live.select(F.col("path").alias("file1")), live.select(F.col("path").alias("file2"))
    kept = pairs.where("n > 0").join(ends[0], "file1", "left_semi").join(ends[1], "file2", "left_semi")
    final = _aliases(kept, alias)
    name = final.select(F.col("path").alias("file2"), F.col("live").alias("_to"))
    old = pairs.join(final.select(F.col("path").alias("file1"), F.col("live").alias("_final")), "file1")
    old = old.join(name, "file2", "left").groupBy(F.col("_final").alias("file1"), F.coalesce("_to", "file2").alias("file2")).agg(F.sum("n").alias("_more"))
    old = old.join(kept.withColumnRenamed("n", "_base"), ["file1", "file2"])
    both = old.unionByName(old.where("file1 <> file2").select(F.col("file2").alias("file1"), F.col("file1").alias("file2"), "_more", "_base"))
    more = both.groupBy("file1", "file2").agg(F.sum("_more").alias("_more"), F.max("_base").alias("_base"))
    return kept.join(more, ["file1", "file2"], "left").select("file1", "file2", (F.coalesce("_base", "n") + F.coalesce("_more", F.lit(0))).cast("bigint").alias("n"))


def _aliases(kept: DataFrame, alias: DataFrame) -> DataFrame:
    """The aliases whose live name occurs in kept pairs."""
    known = kept.select(F.col("file1").alias("live")).distinct()
    return alias.where("path <> live").join(known, "live", "left_semi")


def propagated_people(counts: DataFrame, kept: DataFrame, alias: DataFrame, live: DataFrame) -> DataFrame:
    """(author, path, n) of people_files with the counts of former names added to the live ones; names that are neither live
    nor former stay as they are."""
    final = _aliases(kept, alias).select("path", F.col("live").alias("_to"))
    moved = counts.join(final, "path").select("author", F.col("_to").alias("path"), "n")
    stay = counts.join(final, "path", "left_anti").unionByName(counts.join(final, "path", "left_semi").join(live.select("path"), "path", "left_semi"))
    return stay.select("author", "path", "n").unionByName(moved).groupBy("author", "path").agg(F.sum("n").alias("n"))


def file_lines(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(path, lines) of each file that pairs name; sizes (path, lines) comes from the last snapshot."""
    return pairs.select(F.col("file1").alias("path")).distinct().join(sizes, "path", "left").select("path", F.coalesce("lines", F.lit(0).cast("bigint")).alias("lines"))


def people_files(changes: DataFrame) -> DataFrame:
    """(author, path, n): in how many commits an author changed a file."""
    return changes.select("commit", "author", "path").distinct().groupBy("author", "path").agg(F.count("*").alias("n"))


def people(changes: DataFrame) -> DataFrame:
    """(author1, author2, n): summed over the files of both, the lesser of the counts of their changes."""
    return shared(people_files(changes))


def shared(counts: DataFrame, block: int = 512) -> DataFrame:
    """(author1, author2, n) from (author, path, n): summed over the files of both, the lesser of their counts.

    Counts are brought together by file and paired within lists. The authors of a file are dealt over lists of about block, each
    of which is paired with each, so that a file that all have changed is many tasks' work. A pair is sent and counted one way and
    then given both ways; nothing is summed up before the shuffle, since hardly any pair comes twice in a task. Partitions are as
    many as there are pairs for.
    """
    held = cut(counts.select("author", "path", "n"))
    sizes = held.groupBy("path").agg(F.count("*").alias("_size"))
    n = parts(held.sparkSession, sizes.agg(F.sum(F.col("_size") * (F.col("_size") + 1) / 2)).first()[0] or 0, PAIRS)
    sized = held.join(sizes.select("path", F.ceil(F.col("_size") / block).cast("int").alias("_parts")), "path")
    dealt = sized.withColumn("_part", F.pmod(F.xxhash64("author"), F.col("_parts")).cast("int"))
    # both sides of the join make these lists, and cut them by place: so they are in order
    lists = dealt.groupBy("path", "_part", "_parts").agg(F.sort_array(F.collect_list(F.struct("author", "n"))).alias("who"))
    left = lists.select("path", F.col("_part").alias("i"), F.explode(F.sequence("_part", F.col("_parts") - 1)).alias("j"), F.col("who").alias("a"))
    right = lists.select("path", F.explode(F.sequence(F.lit(0), "_part")).alias("i"), F.col("_part").alias("j"), F.col("who").alias("b"))
    met = left.repartition(n, "path", "i", "j").join(right.repartition(n, "path", "i", "j"), ["path", "i", "j"])
    one = met.select(F.posexplode("a").alias("_at", "a"), "b", (F.col("i") == F.col("j")).alias("_same"))
    pairs = one.select("a", F.explode(F.slice("b", F.when(F.col("_same"), F.col("_at") + 1).otherwise(1), F.size("b"))).alias("b"))
    turned = F.struct("b.author") < F.struct("a.author")  # no author comes before all others
    first, second = (F.when(turned, F.col(f"{x}.author")).otherwise(F.col(f"{y}.author")) for x, y in ("ba", "ab"))
    half = pairs.select(first.alias("author1"), second.alias("author2"), F.least("a.n", "b.n").alias("n"))
    summed = half.repartition(n, "author1", "author2").groupBy("author1", "author2").agg(F.sum("n").alias("n"))
    return _both_ways(summed, "author1", "author2")


def author_files(changes: DataFrame) -> DataFrame:
    return people_files(changes).groupBy("author").agg(F.sort_array(F.collect_list("path")).alias("paths"))


def clipped(pairs: DataFrame, share: float = 0.99) -> DataFrame:
    """pairs with n cut off at its quantile share (linear between neighbours), which is taken from a histogram."""
    histogram = pairs.groupBy("n").agg(F.count("*").alias("times"))
    limit = histogram.agg(F.percentile("n", share, F.col("times")).alias("limit"))  # one row
    return pairs.crossJoin(F.broadcast(limit)).withColumn("n", F.least(F.col("n").cast("double"), "limit")).drop("limit")


def renamed(changes: DataFrame, alias: DataFrame) -> DataFrame:
    """changes with each path replaced by its live name; alias (path, live) comes from graphs.chain."""
    return changes.join(alias, "path", "left").withColumn("path", F.coalesce("live", "path")).drop("live")


def symmetric(pairs: DataFrame, a: str, b: str, n: str = "n") -> DataFrame:
    """(a, b, n) summed over both directions; the diagonal counts once."""
    back = pairs.where(F.col(a) != F.col(b)).select(F.col(b).alias(a), F.col(a).alias(b), n)
    return pairs.select(a, b, n).unionByName(back).groupBy(a, b).agg(F.sum(n).alias(n))
