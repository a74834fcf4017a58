"""Operators on small fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedimenta import History, Operator, Registry, registry
from sedimenta.functions import text
from sedimenta.operators import burndown, combine, couples, graphs, identity, lines, nodes, renames, series, ticks
from sedimenta.sources import sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tree_diff_and_renames(spark):
    a, b = (spark.createDataFrame(x, "path string, blob string") for x in ([("x", "1"), ("y", "2"), ("z", "3")], [("x", "1"), ("y", "4"), ("w", "3")]))
    assert rows(renames.tree_diff(a, b).select("path", "action")) == [("w", "I"), ("y", "M"), ("z", "D")]
    body = "\n".join(f"line {k} of the file" for k in range(20))
    own = spark.createDataFrame([(1, "a", "D", body), (1, "b", "I", body), (1, "c", "D", body + "x"), (1, "lib/c", "I", body + "\nmore"), (1, "d", "I", "nothing like it, but long enough to be looked at " * 9), (2, "e", "D", body)], "commit int, path string, action string, text string")
    assert rows(renames.detect(own)) == [(1, "a", "b"), (1, "c", "lib/c")]
    assert rows(renames.leftover(own, renames.detect(own)).select("path")) == [("d",), ("e",)]


def test_couples(spark):
    log = spark.createDataFrame([(1, "a", 0), (1, "b", 0), (2, "a", 1), (2, "b", 1), (2, "c", 1), (3, "c", 0)], "commit int, path string, author int")
    assert rows(couples.files(log)) == [("a", "a", 2), ("a", "b", 2), ("a", "c", 1), ("b", "a", 2), ("b", "b", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 1), ("c", "c", 2)]
    assert rows(couples.files(log, max_files=2)) == [("a", "a", 1), ("a", "b", 1), ("b", "a", 1), ("b", "b", 1), ("c", "c", 1)]
    assert rows(couples.people(log)) == [(0, 0, 3), (0, 1, 3), (1, 0, 3), (1, 1, 3)]
    alias = graphs.chain(spark.createDataFrame([("a", "x"), ("x", "y")], "from_path string, to_path string"))
    assert rows(alias) == [("a", "y"), ("x", "y")]
    assert rows(couples.renamed(log, alias).where("commit = 1").select("path")) == [("b",), ("y",)]


def test_dense_vector(spark):
    d = spark.createDataFrame([(0, 0, 1145), (30, 0, -681), (30, 30, 369)], "cur_tick bigint, prev_tick bigint, delta bigint")
    assert rows(burndown.dense(burndown.sampled(d, 30, 30))) == [(0, 0, 1145), (0, 1, 0), (1, 0, 464), (1, 1, 369)]


def test_line_fold(spark):
    files = spark.createDataFrame([("f", 0, "x", "a\nb\nc\n"), ("f", 1, "y", "a\nB\nc\nd\n"), ("g", 0, "y", "q"), ("g", 2, "x", None)], "path string, tick bigint, author string, text string")
    folded = lines.fold(files)
    assert rows(lines.ownership(folded)) == [("f", "x", 2), ("f", "y", 2)]
    assert rows(folded.where("kind = 'delta'").groupBy("path").agg(F.sum("delta"))) == [("f", 4), ("g", 0)]
    assert rows(lines.line_stats(files)) == [("f", 0, "x", 3, 0, 0), ("f", 1, "y", 1, 0, 1), ("g", 0, "y", 1, 0, 0), ("g", 2, "x", 0, 1, 0)]


def test_typos(spark):
    v = spark.createDataFrame([(1, "f", "int recieve = 1;\n", "int receive = 1;\n"), (2, "f", "int recieve = 1;\n", "int receive = 1;\n"), (3, "f", "foo\n", "something_else\n")], "commit int, path string, old string, new string")
    assert rows(lines.typo_fixes(v)) == [("recieve", "receive", 1, "f", 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 9)], "a int, b int")
    assert rows(graphs.components(edges)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 9)]
    assert rows(graphs.largest_component(edges)) == [(1,), (2,), (3,)]
    commits = spark.createDataFrame([("d", ["b", "c"]), ("b", ["a"]), ("c", ["a"]), ("a", []), ("z", [])], "commit string, parents array<string>")
    head = spark.createDataFrame([("d",)], "commit string")
    every = commits.select("commit", F.explode("parents").alias("parent"))
    assert rows(graphs.ancestors(every, head)) == [("a",), ("b",), ("c",), ("d",)]
    assert rows(graphs.ancestors(graphs.first_parents(commits), head)) == [("a",), ("b",), ("d",)]


def test_identities(spark):
    a, b = (spark.createDataFrame(x, "label string, at int") for x in ([("one|one@one", 0), ("two|aaa@two", 1)], [("two|aaa@two", 0), ("three|one@one", 1)]))
    assert rows(identity.union_literal(a, b)) == [("one|one@one", 0, -1), ("three|one@one", -1, 1), ("two|aaa@two", 1, 0)]
    assert {r["label"] for r in identity.union_identities(a, b).collect()} == {"one|three|one@one", "two|aaa@two"}
    sig = spark.createDataFrame([("Ann", "ANN@x"), ("Bob", "b@x"), ("Eve", "e@x")], "name string, email string")
    keys = spark.createDataFrame([("ann@x", 0), ("bob", 1), ("Eve <e@x>", 2)], "key string, author int")
    assert rows(identity.lookup(sig, keys).select("name", F.coalesce("author", F.lit(-1)))) == [("Ann", 0), ("Bob", 1), ("Eve", -1)]
    assert rows(identity.lookup(sig, keys, True).where("author is not null").select("name", "author")) == [("Eve", 2)]


def test_text(spark):
    df = spark.createDataFrame([("a/b.py", "import os\nfrom x.y import z\n", "Ann <a@x> Old <o@x>"), ("c.go", "", "no mail"), ("d", "x\0y", "<a@x>")], "path string, data string, line string")
    out = df.select("path", text.language("path").alias("lang"), text.line_count("data").alias("n"), text.mailmap("line").alias("m"), "data")
    assert [(r["lang"], r["n"]) for r in out.collect()] == [("Python", 2), ("Go", 0), ("", None)]
    assert [r["m"] and tuple(r["m"]) for r in out.collect()] == [("Ann", "a@x", "Old", "o@x"), None, (None, "a@x", None, None)]
    assert rows(out.select("path", text.imports("lang", "data")).where("path = 'a/b.py'")) == [("a/b.py", ["os", "x.y"])]
    c = spark.createDataFrame([("This function fixes the broken() parser   state.",), ("// no",), ("Licensed under the Apache license, version two",), ("x = 1 + 2 + 3 + 4 + 5 + 6 + 7",)], "t string")
    assert [r[0] for r in c.select(text.clean_comment("t")).collect()] == ["This function fixes the parser state.", None, None, None]
    assert spark.createDataFrame([("a\x07b",)], "t string").select(text.printable("t")).first()[0] == "ab"


def test_nodes(spark):
    comments = spark.createDataFrame([("f", 1, 1, "a"), ("f", 2, 3, "b"), ("f", 6, 6, "c")], "path string, start int, end int, text string")
    assert rows(nodes.merged_comments(comments)) == [("f", 1, 3, "a\nb"), ("f", 6, 6, "c")]
    tree = spark.createDataFrame([("f", "m1", 1, 5), ("f", "m2", 6, 9)], "path string, node string, start int, end int")
    edit = spark.createDataFrame([(1, "f", 2), (1, "f", 3), (1, "f", 7), (2, "f", 9)], "commit int, path string, line int")
    changed = nodes.touched(tree, edit)
    assert rows(nodes.hotness(changed)) == [("f", "m1", 1), ("f", "m2", 2)]
    assert rows(nodes.couples(changed)) == [("f", "m1", "m2", 1), ("f", "m2", "m1", 1)]
    m = nodes.mood(spark.createDataFrame([(1, 0.9), (1, 0.5), (2, 0.1)], "tick int, score double"))
    assert rows(m) == [(1, 0.9, 1), (2, 0.1, 1)]
    assert abs(nodes.mood_totals(m).first()["delta"]) < 1e-9


def test_ticks(spark):
    df = spark.createDataFrame([(1, "2020-01-01 05:00:00"), (2, "2020-01-04 00:00:00"), (3, "2020-01-02 00:00:00"), (40_000, "2020-01-03 00:00:00")], "seq bigint, t string").select("seq", F.to_timestamp_ntz("t").alias("ts"))
    assert rows(ticks.clamped(df, "ts", "seq").select("seq", "tick")) == [(1, 0), (2, 3), (3, 3), (40_000, 3)]


def test_series(spark):
    d = pd.DataFrame({"author1": ["a", "a", "b"], "author2": ["b", "c", "c"], "distance": [1.0, 9.0, 8.0]})
    out = series.seriated(d, 1.5)
    assert out["author"].tolist() in (["a", "b", "c"], ["c", "b", "a"]) and out["cluster"].nunique() == 2
    df = spark.createDataFrame([(1, 2, 5), (2, 1, 5), (1, 1, 3), (2, 2, 4)], "a int, b int, n int")
    assert series.embedded(df, 2).count() == 2


def test_sinks(spark, tmp_path):
    cells = spark.createDataFrame([(0, 1, 5), (0, 3, 7), (2, 0, 1)], "r bigint, c bigint, v bigint")
    packed = sinks.csr(cells, "r", "c", "v")
    assert rows(packed.select("row", "indptr")) == [(0, 2), (2, 3)] and rows(sinks.coo(packed)) == rows(cells)
    dense = spark.createDataFrame([(0, 0, 5), (0, 1, -2), (0, 2, 0), (1, 0, 0), (1, 1, 3)], "sample bigint, band bigint, lines bigint")
    assert rows(sinks.truncated_rows(dense)) == [(0, [5]), (1, [0, 3])]
    assert sinks.yaml({"devs": cells.limit(1)}, {"name": 'a"b'}).startswith('header:\n  name: "a\\"b"\ndevs:\n  - {r: 0')
    sinks.json(cells, f"{tmp_path}/j", "cells")
    assert spark.read.json(f"{tmp_path}/j").where("type = 'cells'").count() == 3
    (tmp_path / "list").write_text("c1\n\nc2\n")
    assert [r["commit"] for r in sinks.read_commit_list(spark, f"{tmp_path}/list").orderBy("at").collect()] == ["c1", "c2"]


def test_combined_burndown(spark):
    cells = [("p", repo, 30, 30, 0, s, b, n) for repo in ("x", "y") for s, b, n in ((0, 0, 1145), (1, 0, 464), (1, 1, 369))]
    df = spark.createDataFrame(cells, "key string, repo string, granularity int, sampling int, start int, sample bigint, band bigint, lines bigint")
    got = {(s, b): n for _, s, b, n in rows(combine.burndown(df))}
    assert all(abs(got[s, b] - 2 * n) <= 1 for _, r, _, _, _, s, b, n in cells if r == "x")


def test_history(spark):
    log = spark.createDataFrame([(1, "a", 0, 0, "go", 3, 0, 0), (2, "a", 1, 1, "go", 0, 1, 2)], "commit int, path string, author int, tick int, lang string, added int, removed int, changed int").withColumn("ts", F.current_timestamp())
    out = History(spark, log=log).run(["Devs", "Couples", "Churn"], churn_people=True, max_files=10)
    assert rows(out["Devs"]) == [(0, 0, 1, 3, 0, 0), (1, 1, 1, 0, 1, 2)] and "author" in out["Churn"].columns
    assert out["_common"].first()["commits"] == 2
    with pytest.raises(ValueError):
        History(spark, log=log).run(["Devs"], nonsense=1)


def test_resolver():
    own = Registry()
    for name, need, give in (("TreeDiff", (), "changes"), ("BlobCache", ("changes",), "blobs"), ("Renames", ("blobs", "changes"), "changes"), ("FileDiff", ("blobs", "changes"), "file_diff"), ("Ticks", (), "tick"), ("Burndown", ("file_diff", "changes", "blobs", "tick"), "burndown")):
        own.register(Operator(name, need, (give,), lambda **x: {}))
    assert [o.name for o in own.resolve(["Burndown"])] == ["Ticks", "TreeDiff", "BlobCache", "Renames", "FileDiff", "Burndown"]
    own.register(Operator("Other", (), ("tick",), lambda **x: {}))
    with pytest.raises(ValueError):
        own.resolve(["Burndown"])
    assert '"[changes]"' in own.dot(own.resolve(["Renames"])) and registry.leaves()
