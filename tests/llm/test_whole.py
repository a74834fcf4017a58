"""What the operators must do over whole tables, beyond the brute-force comparisons."""

import random

from test_brute_force import brute_groups

from sedimenta.llm import language_id, quality, simhash


def _prose(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_quality_threshold_covers_all_and_drops_toxic(spark):
    rng = random.Random(4)
    insults = ["vrgx", "bqzk", "wvvp"]
    toxic = [i % 5 == 0 for i in range(1200)]
    texts = []
    for bad in toxic:
        words = _prose(rng, rng.randrange(60, 200)).split()
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(insults)
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, t in enumerate(toxic) if i < 600], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels, quantile=0.2)
    rows = {r["doc_id"]: r for r in quality.rank(docs, model).collect()}
    scores = sorted(r["score"] for r in rows.values())
    assert model.threshold == scores[int(0.2 * (len(scores) - 1))]
    unseen = [rows[i]["keep"] for i in range(600, 1200) if toxic[i]]
    fine = [rows[i]["keep"] for i in range(600, 1200) if not toxic[i]]
    assert sum(unseen) <= 0.1 * len(unseen) and sum(fine) >= 0.95 * len(fine)


def test_simhash_finds_copies_beyond_28_bits(spark):
    folder = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_groups(texts, 45)
    beyond = set(want) - set(brute_groups(texts, 28))
    got = {i: kept for i, kept, _ in simhash.op3_simhash(spark, folder).collect() if i != kept}
    assert set(got) <= set(want) and len(beyond) >= 10
    assert len(beyond & set(got)) >= 0.9 * len(beyond)


def test_language_draw_counts_labelled_rows_alone(spark):
    rows = [(i, f"the cat and dog {i}" if i % 2 else f"der hund und katze {i}", ("en" if i % 2 else "de") if i < 60 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(docs, train_rows=60)
    assert model.labels == ["de", "en"] and model.heldout_accuracy >= 0.9
    out = language_id.identify(docs, model)
    assert out.where("keep").count() >= 0.95 * len(rows)
