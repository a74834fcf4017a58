"""Repositories, the wire format, readers of what is written, the command line, and folds over forks."""

import os
import subprocess
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta import __main__ as cli
from sedimenta.operators import combine, lines, renames
from sedimenta.sources import git, sinks, wire

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """Four commits and a merge of a side branch; one file is renamed, one is binary."""
    at = str(tmp_path_factory.mktemp("repo"))
    env = os.environ | {"GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}

    def run(*args, who="Ann", day=1):
        dates = {f"GIT_{x}_DATE": f"2020-01-{day:02d}T12:00:00Z" for x in ("AUTHOR", "COMMITTER")}
        names = {f"GIT_{x}_{y}": who if y == "NAME" else f"{who.lower()}@x" for x in ("AUTHOR", "COMMITTER") for y in ("NAME", "EMAIL")}
        subprocess.run(["git", "-C", at, *args], check=True, env=env | dates | names, capture_output=True)

    def write(name, data):
        os.makedirs(os.path.dirname(f"{at}/{name}"), exist_ok=True)
        with open(f"{at}/{name}", "wb") as f:
            f.write(data)

    body = [f"line {k} of the file\n" for k in range(20)]
    run("init", "-b", "main")
    write("a.py", "".join(body).encode())
    write("raw.bin", b"\xff\0\xfe")
    run("add", ".")
    run("commit", "-m", "one", day=1)
    run("checkout", "-b", "side")
    write("side/b.py", b"import os\n")
    run("add", ".")
    run("commit", "-m", "side", who="Bob", day=2)
    run("checkout", "main")
    run("mv", "a.py", "c.py")
    write("c.py", "".join([*body[:5], "new\n", *body[6:]]).encode())
    run("add", ".")
    run("commit", "-m", "two", day=3)
    run("merge", "--no-ff", "side", "-m", "merge", day=4)
    return at


def test_repository(spark, repo):
    found = git.merges(git.commits(spark, repo))
    own = {r["seq"]: r for r in found.collect()}
    assert [own[k]["name"] for k in range(4)] in (["Ann", "Ann", "Bob", "Ann"], ["Ann", "Bob", "Ann", "Ann"]) and own[3]["is_merge"] and not own[2]["is_merge"]
    assert git.commits(spark, repo, first_parent=True).count() == 3 and git.commits(spark, repo, head=True).first()["commit"] == own[3]["commit"]
    assert [r["commit"] for r in git.commits(spark, repo, only=[own[2]["commit"], own[0]["commit"]]).orderBy("seq").collect()] == [own[2]["commit"], own[0]["commit"]]
    trees = git.snapshots(found)
    assert {r["path"] for r in trees.where("seq = 3").collect()} == {"c.py", "raw.bin", "side/b.py"}
    blobs = {r["blob"]: r for r in git.blobs(trees).collect()}
    raw = trees.where("seq = 0 and path = 'raw.bin'").first()["blob"]
    assert bytes(blobs[raw]["data"]) == b"\xff\0\xfe" and blobs[raw]["text"] is None and len(blobs) == 4
    with pytest.raises(Exception, match="git log"):
        git.commits(spark, "/nonexistent").collect()


def test_command_line_over_a_repository(spark, repo, tmp_path, capsys):
    out, dag = str(tmp_path / "out"), str(tmp_path / "dag")
    assert cli.main(["run", "--repository", repo, "--first-parent", "--leaf", "Ownership", "--leaf", "Devs", "--out", out, "--dump-dag", dag, "--tick-size", "86400"]) == 0
    assert rows(spark.read.parquet(f"{out}/Ownership")) == [("c.py", "ann@x", 20), ("side/b.py", "ann@x", 1)]
    assert {r["commits"] for r in spark.read.parquet(f"{out}/Devs").collect()} == {1} and "LineFold" in open(dag).read()
    assert cli.main(["combine", out, out, "--only", "Ownership", "--out", f"{out}2"]) == 0
    assert rows(spark.read.parquet(f"{out}2/Ownership")) == [("c.py", "ann@x", 40), ("side/b.py", "ann@x", 2)]
    assert cli.main(["list"]) == 0 and "--granularity 30" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["run", "--tables", out, "--leaf", "Nonsense"])


def test_module_runs_without_installation():
    done = subprocess.run([sys.executable, "-m", "sedimenta", "list"], cwd=HERE, capture_output=True, text=True, timeout=120, check=True)
    assert "Burndown (leaf)" in done.stdout


def test_plugins_register_leaves(tmp_path, capsys):
    assert cli.main(["plugin", "HotFiles"]) == 0
    (tmp_path / "hot_files_plugin.py").write_text(capsys.readouterr().out)
    env = os.environ | {"PYTHONPATH": str(tmp_path), "SEDIMENTA_PLUGINS": "hot_files_plugin"}
    done = subprocess.run([sys.executable, "-m", "sedimenta", "list"], cwd=HERE, env=env, capture_output=True, text=True, timeout=120, check=True)
    assert "HotFiles (leaf): log -> hot_files" in done.stdout and "--hot-files-least 1" in done.stdout


def test_wire_vectors():
    assert wire.encode("Lines", {"added": 150}) == b"\x08\x96\x01" and wire.encode("Lines", {"removed": -1}) == b"\x10" + b"\xff" * 9 + b"\x01"
    assert wire.encode("Row", {"columns": [3, 270, 86942]}) == b"\x0a\x06\x03\x8e\x02\x9e\xa7\x05" and wire.encode("Matrix", {"name": "testing"}) == b"\x0a\x07testing"
    assert wire.decode("Lines", b"\x08\x01\x48\x05\x52\x01x") == {"added": 1, "removed": 0, "changed": 0}
    for bad in (b"\x08", b"\x0a\x05abc", b"\x0b"):
        with pytest.raises(ValueError):
            wire.decode("Matrix", bad)


NUMBER = st.integers(-(2**63), 2**63 - 1)


@settings(deadline=None, max_examples=150)
@given(st.dictionaries(NUMBER, st.dictionaries(NUMBER, st.fixed_dictionaries({"commits": NUMBER, "stats": st.fixed_dictionaries({"added": NUMBER, "removed": NUMBER, "changed": NUMBER}), "languages": st.dictionaries(st.text(max_size=5), st.fixed_dictionaries({"added": NUMBER, "removed": NUMBER, "changed": NUMBER}), max_size=2)}), max_size=3), max_size=3), st.lists(st.text(max_size=6), max_size=3))
def test_wire_round_trip(ticks, people):
    value = {"ticks": {k: {"devs": v} for k, v in ticks.items()}, "people": people, "tick_size": 86400}
    assert wire.decode("Devs", wire.encode("Devs", value)) == value


def test_protobuf_reports(spark):
    pairs = spark.createDataFrame([("a", "a", 2), ("a", "b", 1), ("b", "a", 1)], "file1 string, file2 string, n bigint")
    people = spark.createDataFrame([(0, 0, 3)], "author1 int, author2 int, n bigint")
    sizes = spark.createDataFrame([("a", 10)], "path string, lines bigint")
    couples = sinks.couples_message(pairs, people, sizes)
    devs = sinks.devs_message(spark.createDataFrame([(1, "x", 2, 3, 4, 5)], "tick int, author string, commits int, added int, removed int, changed int"), spark.createDataFrame([(1, "x", "go", 3, 4, 5)], "tick int, author string, lang string, added int, removed int, changed int"))
    header, found = sinks.read_protobuf(sinks.protobuf({"Couples": couples, "Devs": devs}, {"repository": "r", "commits": 3, "run_time_per_item": {"x": 0.5}}))
    assert header["repository"] == "r" and header["run_time_per_item"] == {"x": 0.5}
    assert found["Couples"]["files"] == {"index": ["a", "b"], "matrix": {"rows_count": 2, "columns_count": 2, "data": [2, 1, 1], "indices": [0, 1, 0], "indptr": [0, 2, 3]}} and found["Couples"]["files_lines"] == [10, 0]
    assert found["Devs"]["ticks"][1]["devs"][0]["languages"] == {"go": {"added": 3, "removed": 4, "changed": 5}} and found["Devs"]["people"] == ["x"]
    with pytest.raises(ValueError):
        sinks.read_protobuf(b"")


def test_yaml_json_and_projector_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", \\ c', [1, 2], True), (2, "x: y", [], False)], "k int, s string, l array<int>, b boolean")
    header, sections = sinks.read_yaml(sinks.yaml({"one": df, "two": df.limit(0)}, {"name": "r, [x]", "n": 3}))
    assert header == {"name": "r, [x]", "n": 3} and sections == {"one": [r.asDict() for r in df.collect()], "two": []}
    sinks.json(df, f"{tmp_path}/j", "kind")
    assert rows(sinks.read_json(spark, f"{tmp_path}/j", "kind").select("k", "s")) == rows(df.select("k", "s"))
    sinks.projector(spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "id int, vector array<double>"), spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), f"{tmp_path}/p")
    assert '"tensorShape": [2, 2]' in spark.read.text(f"{tmp_path}/p/config").first()[0]
    assert [r[0] for r in spark.read.text(f"{tmp_path}/p/vectors").collect()] == ["3.0\t4.0", "1.0\t2.0"]


def test_couples_of_two_repositories(spark):
    def result(names, people, sizes, files):
        return (
            spark.createDataFrame([(a, b, n) for a, b, n in files], "file1 string, file2 string, n bigint"),
            spark.createDataFrame([(names[a] if a is not None else None, names[b] if b is not None else None, n) for a, b, n in people], "author1 string, author2 string, n bigint"),
            spark.createDataFrame(sizes, "path string, lines bigint"),
        )

    one = result(["one|one@one", "two|aaa@two"], [(0, 1, 100), (None, 0, 300), (None, 1, 400)], [("one", 1), ("two", 2)], [("one", "two", 5)])
    two = result(["two|aaa@two", "three|one@one"], [(0, 0, 10), (None, 0, 30), (None, 1, 40)], [("two", 2), ("three", 3)], [("one", "two", 1), ("two", "three", 2)])
    files, people, sizes = combine.couples_results(one, two)
    first, second = "one|three|one@one", "two|aaa@two"
    assert rows(people) == sorted([(first, second, 100), (second, second, 10), (None, first, 340), (None, second, 430)], key=str)
    assert rows(files) == [("one", "two", 6), ("two", "three", 2)] and rows(sizes) == [("one", 1), ("three", 3), ("two", 4)]


def test_what_cant_be_combined_is_told(spark):
    a = {"Devs": spark.createDataFrame([(0, 1, 2)], "tick int, author int, commits bigint"), "Typos": spark.createDataFrame([("a", "b")], "wrong string, correct string"), "Churn": spark.createDataFrame([(1, 2, 3)], "tick int, added int, removed int")}
    b = {**a, "Churn": spark.createDataFrame([(1, 9, 2, 3)], "tick int, author int, added int, removed int")}
    out, errors = combine.merged([a, b])
    assert rows(out["Devs"]) == [(0, 1, 4)] and set(out) == {"Devs"} and sorted(x.split(":")[0] for x in errors) == ["Churn", "Typos"]
    assert combine.merged([a, b], "Devs")[1] == []


def test_lines_of_forks_and_merges(spark):
    """Two branches edit a file; the merge keeps both, and adds a line of its own."""
    files = [("f", "a", [], 0, "x", "1\n2\n3\n"), ("f", "b", ["a"], 1, "y", "1\nB\n3\n"), ("f", "c", ["a"], 2, "z", "1\n2\n3\nC\n"), ("f", "m", ["b", "c"], 3, "w", "1\nB\n3\nC\nM\n")]
    folded = lines.fold_graph(spark.createDataFrame(files, "path string, commit string, parents array<string>, tick bigint, author string, text string"))
    assert rows(lines.ownership(folded)) == [("f", "w", 1), ("f", "x", 2), ("f", "y", 1), ("f", "z", 1)]
    assert sum(n for *_, n in rows(folded.where("kind = 'delta'").groupBy("path").agg(F.sum("delta")))) == 5
    straight = [("f", "a", [], 0, "x", "1\n2\n"), ("f", "b", ["a"], 1, "y", "1\nB\n"), ("f", "d", ["b"], 2, "y", None)]
    df = spark.createDataFrame(straight, "path string, commit string, parents array<string>, tick bigint, author string, text string")
    assert rows(lines.fold_graph(df)) == rows(lines.fold(df))


def test_large_commits_have_one_candidate(spark, monkeypatch):
    body = "".join(f"line {k} of the file\n" for k in range(20))
    df = spark.createDataFrame([(1, "d/a.py", "D", body + "x")] + [(1, f"e/{n}.py", "I", body if n == "zz" else "quite other text " * 22) for n in ("a", "zz")], "commit int, path string, action string, text string")
    assert rows(renames.detect(df)) == [(1, "d/a.py", "e/zz.py")]
    monkeypatch.setattr(renames, "SET_SIZE", 2)
    assert rows(renames.detect(df)) == []
