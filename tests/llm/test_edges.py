"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sedimenta.llm import ann, decontamination, html, language_id, line_dedup, packing, pii, quality, simhash, substring_dedup

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, t string, key bigint, keep boolean, language string, gone int, _id int, _th int, n int, score double, row int, item int, n_removed bigint"
EXTRA = ("x", "y", 1, True, "fr", 1, 2, 3, 4, 0.5, 6, 7, 8)
LONG = "\n".join(f"this is line number {k} of the very long text" for k in range(60_000))
TEXTS = [(1, "the cat sat on the mat and looked at the dog"), (1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (None, "a text that has no id but some words to say"), (4, LONG), (5, "\n\n\n"), (6, "?!"), (1, "another text under the same id"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None, None, *EXTRA) for k, (i, t) in enumerate(TEXTS)], KINDS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (None, None), (2, "")], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_pii(docs):
    out = rows(pii.sanitise(docs))
    assert sorted(map(str, out)) == sorted(str((i, t, 0, 0)) for i, t in TEXTS)
    assert rows(pii.sanitise(docs.limit(0))) == []


def test_decontamination(spark, docs, folder):
    tests = spark.read.parquet(f"{folder}/benchmark.parquet")
    assert rows(decontamination.find(docs, tests)) == [(1, 1, 11, 11, 1.0)] * 2
    assert rows(decontamination.find(docs.limit(0), tests)) == rows(decontamination.find(docs, tests.limit(0))) == []


def test_simhash(docs):
    again = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10))
    got = dict(rows(simhash.near_duplicates(again)))
    assert got == {11: 1, 14: 4}
    assert rows(simhash.near_duplicates(docs.limit(0))) == []


def test_substring_dedup(docs):
    assert rows(substring_dedup.repeated(docs)) == []
    again = docs.union(docs.withColumn("doc_id", F.col("doc_id") + 10))
    n = len(LONG.split())
    assert sorted(rows(substring_dedup.repeated(again))) == [(4, 0, n, n), (14, 0, n, n)]
    assert rows(substring_dedup.repeated(docs.limit(0))) == []


def test_language_id(docs):
    out = rows(language_id.identify(docs, language_id.train(docs)))
    assert len(out) == len(TEXTS)
    assert sorted(str(i) for i, lang, p, keep in out if lang is None and p == 0 and not keep) == ["2", "3", "None"]
    none = language_id.train(docs.limit(0))
    assert none.labels == [] and rows(language_id.identify(docs.limit(0), none)) == []
    assert {r[1:] for r in rows(language_id.identify(docs, none))} == {(None, 0.0, False)}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, 1, 1), (6, None, None), (5, 0, 1), (1, 1, None)], "doc_id bigint, quality int, toxic int")
    for own in (labels, labels.limit(0)):
        out = rows(quality.rank(docs, quality.train(docs, own)))
        assert len(out) == len(TEXTS) and sorted(str(r[0]) for r in out if r[1] is None and not r[2]) == ["2", "3", "None"]
    assert rows(quality.rank(docs.limit(0), quality.train(docs.limit(0), labels))) == []


def test_html(spark):
    pages = [(1, "http://a.org/x", "<p>one two three four five six seven"), (2, "http://a.org/y", "<p>one two three four five six eight"), (2, None, "<p>some words here"), (None, "no url", None), (3, "http://b.org", ""), (4, "http://c.org", "<b" * 50_000), (5, "http://d.org", "<i>x</i> " * 200_000)]
    df = spark.createDataFrame([(*p, "a", 1) for p in pages], "page_id bigint, url string, html string, text string, host int")
    out = rows(html.extract(df))
    assert len(out) == len(pages)
    assert {(1, "a.org", "seven"), (2, "a.org", "eight"), (2, "", "some words here"), (None, "", ""), (3, "b.org", "")} <= set(out)
    assert rows(html.extract(df.limit(0))) == []


def test_ann(spark):
    own = [(1, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0]), (3, [1.0, 0.1, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [])]
    df = spark.createDataFrame([(*x, 1, 2) for x in own], "vec_id bigint, embedding array<float>, label int, cell int")
    out = {(q, n, r) for q, n, r, _ in rows(ann.neighbours(df))}
    assert out == {(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 1, 2), (3, 2, 1), (3, 1, 2)}
    assert rows(ann.neighbours(df.limit(0))) == []


def test_line_dedup(docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    got = [(r["doc_id"], r["text"], r["n_removed"], r["gone"], r["_id"], r["_th"]) for r in out.collect()]
    assert sorted(str(r[:2]) for r in got if r[0] != 4) == sorted(str(x) for x in TEXTS if x[0] != 4) and {r[2:] for r in got if r[0] != 4} == {(0, 1, 2, 3)}
    assert rows(line_dedup.dedup_lines(docs.limit(0))) == []


def test_packing(docs):
    out = rows(packing.pack(docs, capacity=1000))
    assert {r[0] for r in out} == {None, 1, 4, 5, 6} and len([r for r in out if r[0] == 1]) == 3
    assert all(0 < r[3] <= 1000 for r in out)
    assert rows(packing.pack(docs.limit(0))) == []


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, folder, name, stage):
    for own in (docs, docs.limit(0)):
        out = stage(spark, own, folder)
        assert name == "pack" or out.columns == docs.columns
        assert out.count() <= (10_000 if name == "pack" else own.count())
    if name == "benchmark":
        assert 1 not in [r["doc_id"] for r in stage(spark, docs, folder).collect()]


def test_stages_carry_a_column_that_an_operator_adds(spark, folder):
    """n_removed is the user's, whatever is removed, and other odd names come along."""
    text = "\n".join(f"shared line {k}" for k in range(30))
    df = spark.createDataFrame([(k, f"{text}\nown {k}", "en", "s", 1, 99, "a", "b") for k in range(2)], "doc_id bigint, text string, lang string, source string, n_chars bigint, n_removed int, key string, c0 string")
    out = corpus_pipeline.lines(spark, df, folder)
    assert out.columns == df.columns and {(r["n_removed"], r["key"], r["c0"]) for r in out.collect()} == {(99, "a", "b")}
    assert sum(r["n_chars"] == len(r["text"]) for r in out.collect()) == 1
    assert corpus_pipeline.near_duplicates(spark, df, folder).columns == corpus_pipeline.benchmark(spark, df, folder).columns == df.columns


def test_stages_judge_rows_without_an_id(spark, folder):
    words = "the cat sat on the mat and looked at the dog"
    other = " ".join(f"word{k}" for k in range(40))
    rows = [(None, words), (3, words), (None, other), (None, other), (7, other), (-2, other), (None, None), (None, ""), (4, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(map(str, rows_of(corpus_pipeline.near_duplicates(spark, df, folder)))) == sorted(map(str, [(3, words), (-2, other), (None, None), (None, ""), (4, None)]))
    assert sorted(map(str, rows_of(corpus_pipeline.benchmark(spark, df, folder)))) == sorted(map(str, [r for r in rows if r[1] != words]))
    lone = df.where("doc_id is null")
    assert [r for r in rows_of(corpus_pipeline.near_duplicates(spark, lone, folder)) if r[1]] in ([(None, words), (None, other)], [(None, other), (None, words)])


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]
