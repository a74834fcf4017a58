"""python -m sedimenta: runs leaves over tables or a repository, combines results, lists what there is."""

from __future__ import annotations

import argparse
import os
import re
import sys
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import combine
from .plans.registry import registry
from .plans.session import History
from .sources import git, sinks


def _flag(name: str) -> str:
    return "--" + name.replace("_", "-")


def parser() -> argparse.ArgumentParser:
    """The command line; every option of every registered operator is a flag of run."""
    top = argparse.ArgumentParser("sedimenta", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run leaves over a folder of Parquet tables, or over a repository")
    source = run.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with NAME.parquet for each table")
    source.add_argument("--repository", action="append", help="path of a repository that all executors see")
    scope = run.add_mutually_exclusive_group()
    scope.add_argument("--first-parent", action="store_true", help="follow first parents alone")
    scope.add_argument("--head", action="store_true", help="the last commit alone")
    scope.add_argument("--commits", help="file with the commits to read, one a line")
    run.add_argument("--leaf", action="append", default=[], choices=[o.name for o in registry.leaves()], help="what to compute; may be repeated")
    run.add_argument("--feature", action="append", default=[], help="a feature to switch on")
    run.add_argument("--dry-run", action="store_true", help="only work out the order")
    run.add_argument("--dump-dag", help="file for the order as a graph")
    run.add_argument("--out", help="folder for the results; without it they are printed as YAML")
    seen = set()
    for o in registry.operators.values():
        for x in o.options:
            if x.name in seen:
                continue
            seen.add(x.name)
            about = f"{x.help} ({o.name}; {x.default!r} if not given)"
            if isinstance(x.default, bool):
                run.add_argument(_flag(x.name), action=argparse.BooleanOptionalAction, default=None, help=about)
            elif isinstance(x.default, tuple):
                run.add_argument(_flag(x.name), type=lambda v: tuple(filter(None, v.split(","))), default=None, help=about)
            else:
                run.add_argument(_flag(x.name), type=type(x.default), default=None, help=about)
    both = commands.add_parser("combine", help="make the results of several runs one")
    both.add_argument("results", nargs="+", help="folders that run --out wrote")
    both.add_argument("--only", help="the one leaf to combine")
    both.add_argument("--out", required=True, help="folder for what comes of it")
    commands.add_parser("list", help="list leaves, features and options")
    made = commands.add_parser("plugin", help="print the skeleton of a module that registers a leaf")
    made.add_argument("name", help="name of the leaf")
    return top


PLUGIN = """from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta import Operator, Option, registry


def {low}(log: DataFrame, {low}_least: int) -> dict[str, DataFrame]:
    counts = log.groupBy("path").agg(F.count("*").alias("n"))
    return {{"{low}": counts.where(F.col("n") >= {low}_least)}}


registry.register(Operator("{name}", ("log",), ("{low}",), {low}, (Option("{low}_least", 1, "changes of a file from which on it counts"),), leaf=True))
"""


def plugins() -> None:
    """Imports the modules that SEDIMENTA_PLUGINS names, parted by commas, so that what they register is there."""
    for name in filter(None, os.environ.get("SEDIMENTA_PLUGINS", "").split(",")):
        import_module(name)


def _tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    if args.tables:
        names = sorted(x.removesuffix(".parquet") for x in os.listdir(args.tables) if x.endswith(".parquet"))
        return {n: spark.read.parquet(f"{args.tables}/{n}.parquet") for n in names}
    only = [r["commit"] for r in sinks.read_commit_list(spark, args.commits).orderBy("at").collect()] if args.commits else None
    found = git.merges(git.commits(spark, *args.repository, first_parent=args.first_parent, head=args.head, only=only))
    trees = git.snapshots(found)
    texts = git.blobs(trees).select("blob", F.coalesce("text", F.lit("\0")).alias("text")).dropDuplicates(["blob"])
    return {"commits": found.withColumn("author", F.lower("email")), "snapshots": trees.select("seq", "path", "blob"), "blobs": texts}


def run(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    known = {x.name for o in registry.operators.values() for x in o.options}
    options = {k: v for k, v in vars(args).items() if k in known and v is not None}
    history = History(spark, **_tables(spark, args))
    order = registry.resolve(args.leaf, tuple(args.feature), tuple(history.tables))
    if args.dump_dag:
        with open(args.dump_dag, "w") as f:
            f.write(registry.dot(order))
    own = {x.name for o in order for x in o.options}
    return history.run(args.leaf, tuple(args.feature), args.dry_run, **{k: v for k, v in options.items() if k in own})


def main(argv: list[str] | None = None) -> int:
    plugins()
    args = parser().parse_args(argv)
    if args.command == "plugin":
        low = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|\W+", "_", args.name).lower()
        print(PLUGIN.format(name=args.name, low=low), end="")
        return 0
    if args.command == "list":
        for o in registry.operators.values():
            print(f"{o.name}{' (leaf)' * o.leaf}{f' [{o.feature}]' * bool(o.feature)}: {', '.join(o.requires)} -> {', '.join(o.provides)}")
            for x in o.options:
                print(f"  {_flag(x.name)} {x.default!r}: {x.help}")
        return 0
    spark = SparkSession.builder.appName("sedimenta").getOrCreate()
    if args.command == "combine":
        parts = [{n: spark.read.parquet(f"{folder}/{n}") for n in sorted(os.listdir(folder)) if not n.startswith(("_", "."))} for folder in args.results]
        out, errors = combine.merged(parts, args.only)
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
        print("\n".join(errors), file=sys.stderr, end="\n" * bool(errors))
        return 0
    out = run(spark, args)
    if args.out:
        for name, df in out.items():
            df.write.mode("overwrite").parquet(f"{args.out}/{name}")
    else:
        print(sinks.yaml({n: df for n, df in out.items() if not n.startswith("_")}, {"leaves": ", ".join(args.leaf)}), end="")
    return 0


if __name__ == "__main__":
    sys.exit(main())
