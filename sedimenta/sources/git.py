"""Repositories as tables: commits, snapshots and blobs, read by the executors through git's own commands."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import cut

COMMITS = "repo string, commit string, seq bigint, parents array<string>, name string, email string, ts timestamp"
#: Commits whose trees one task lists, and blobs that one task fetches.
COMMITS_PER_TASK, BLOBS_PER_TASK = 256, 4096


def _git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], input=given, capture_output=True, check=False)
    if done.returncode:
        raise ValueError(f"git {args[0]} of {repo}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout


def commits(spark: SparkSession, *repos: str, first_parent: bool = False, head: bool = False, only: list[str] | None = None) -> DataFrame:
    """The commits of each repository (a path that all executors see) that are reached from HEAD, parents first; along first
    parents alone, or HEAD alone, or only those named. seq counts them from 0 in each repository. A repository's list is made
    in one task; it is as long as its history."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo in b["repo"]:
                scope = ["--first-parent"] * first_parent + ["--max-count=1"] * head
                names = only if only is not None else ["HEAD"]
                walk = ["--no-walk=unsorted"] if only is not None else ["--topo-order", "--reverse"]
                raw = _git(repo, "log", *walk, *scope, "--format=%H%x1f%P%x1f%an%x1f%ae%x1f%at", *names).decode("utf-8", "replace")
                rows = [x.split("\x1f") for x in raw.splitlines() if x]
                yield pd.DataFrame([(repo, c, k, p.split(), n, e, pd.Timestamp(int(t), unit="s", tz="UTC")) for k, (c, p, n, e, t) in enumerate(rows)], columns=["repo", "commit", "seq", "parents", "name", "email", "ts"])

    held = spark.createDataFrame([(r,) for r in repos], "repo string").repartition(max(1, len(repos)))
    return held.mapInPandas(read, COMMITS)


def snapshots(commits: DataFrame) -> DataFrame:
    """(repo, commit, seq, path, blob) of every file of every commit; links to other repositories are left out."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                for entry in _git(r.repo, "ls-tree", "-r", "-z", r.commit).split(b"\0")[:-1]:
                    what, _, path = entry.partition(b"\t")
                    kind, blob = what.split()[1:3]
                    if kind == b"blob":
                        out.append((r.repo, r.commit, r.seq, path.decode("utf-8", "replace"), blob.decode()))
            yield pd.DataFrame(out, columns=["repo", "commit", "seq", "path", "blob"])

    dealt = _dealt(commits.select("repo", "commit", "seq"), COMMITS_PER_TASK, "repo", "commit")
    return dealt.mapInPandas(read, "repo string, commit string, seq bigint, path string, blob string")


def blobs(snapshots: DataFrame) -> DataFrame:
    """(repo, blob, data, text) of each distinct blob; text is null where the bytes are no UTF-8."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for repo, own in b.groupby("repo"):
                raw, at, out = _git(repo, "cat-file", "--batch", given="\n".join(own["blob"]).encode() + b"\n"), 0, []
                while at < len(raw):
                    end = raw.index(b"\n", at)
                    name, *rest = raw[at:end].split()
                    if rest[0] == b"missing":
                        at = end + 1
                        continue
                    data = raw[end + 1 : end + 1 + int(rest[1])]
                    at = end + 2 + len(data)
                    try:
                        text = data.decode()
                    except UnicodeDecodeError:
                        text = None
                    out.append((repo, name.decode(), data, text))
                yield pd.DataFrame(out, columns=["repo", "blob", "data", "text"])

    dealt = _dealt(snapshots.select("repo", "blob").distinct(), BLOBS_PER_TASK, "repo", "blob")
    return dealt.mapInPandas(read, "repo string, blob string, data binary, text string")


def _dealt(df: DataFrame, size: int, *by: str) -> DataFrame:
    """df in partitions of about size rows."""
    held = cut(df)
    return held.repartition(max(1, -(-held.count() // size)), *by)


def merges(commits: DataFrame) -> DataFrame:
    """commits with is_merge: two different parents or more."""
    return commits.withColumn("is_merge", F.size(F.array_distinct("parents")) > 1)
