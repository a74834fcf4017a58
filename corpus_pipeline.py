"""The corpus pipeline: STAGES, run in order over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import decontamination, language_id, line_dedup, packing, simhash
from sedimenta.llm._text import checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: those with a calibrated probability under 0.5.

    Null and empty texts have no language and go, with or without an id; very long texts are read whole. Rows that share an id
    or are equal get a decision each, and so do rows without an id. Equal probabilities go to the language that comes first by
    name. An empty table stays empty. The columns are those of docs, whatever their names.
    """
    model = language_id.train(docs)
    rows = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "doc_id"]).alias("row"))
    kept = language_id.identify(rows, model, carry=["row"]).where("keep")
    return kept.select(*["doc_id" if c == "doc_id" else F.col("row")[c].alias(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated multi-line chunks, and the documents of which nothing is left; n_chars follows the text.

    A null or empty text stays as it is. A null id sorts first; rows that are equal in id and text are one document, and each
    gets its result. Ties don't arise between different places. The work on a text grows with its length alone. An empty table
    stays empty. The columns are those of docs; one called n_removed is carried along as any other.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    at = docs.columns.index("text")
    out = line_dedup.dedup_lines(docs.toDF(*own), id_col=own[docs.columns.index("doc_id")], text_col=own[at])
    out = out.where((F.col("n_removed") == 0) | (F.length(F.trim(own[at])) > 0))
    size = F.length(own[at]).cast("bigint")
    return out.select(*[(F.when(F.col("n_removed") == 0, F.col(o)).otherwise(size) if c == "n_chars" else F.col(o)).alias(c) for o, c in zip(own, docs.columns)])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one of least id.

    Texts without a word, null and empty ones among them, have no copies and stay. Rows of one id are one document and stay or
    go together. Rows without an id are documents of their own: of those with the same text one stays (whichever comes first;
    they may differ in other columns), and of a group with ids it is one that has an id. Very long texts are read whole. Ties
    don't arise, as ids order the rest. An empty table stays empty. The columns are those of docs.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*own)
    bare = rows.where(doc_id.isNull())
    worded = F.coalesce(F.length(text) > 0, F.lit(False))
    rows = rows.where(doc_id.isNotNull()).unionByName(bare.where(~worded)).unionByName(bare.where(worded).dropDuplicates([own[docs.columns.index("text")]]))
    # ids in their order, then texts without one
    shifted = F.lpad((doc_id.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    key = F.when(doc_id.isNotNull(), F.concat(F.lit("a"), shifted)).when(worded, F.concat(F.lit("b"), F.sha2(text, 256)))
    rows = rows.withColumn("key", key)
    drop = simhash.near_duplicates(rows.select("key", text.alias("text")), simhash.NEAR, id_col="key").select("key")
    return rows.join(drop, "key", "left_anti").select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold half of a benchmark item or more.

    Null and empty texts hold nothing and stay. Rows of one id go if one of them is hit; rows without an id go by their text.
    Very long texts are read whole, in memory linear in them. Repeated rows go together; ties between tiles don't change what
    they cover in sum. An empty table, or an empty benchmark, leaves docs as they are. The columns are those of docs.
    """
    own = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "text"))
    key = F.coalesce(F.concat(F.lit("a"), doc_id.cast("string")), F.concat(F.lit("b"), F.sha2(text, 256)))
    rows = docs.toDF(*own).withColumn("key", key)
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontamination.find(rows.select("key", text.alias("text")), tests, id_col="key").select("key").distinct()
    return rows.join(hit, "key", "left_anti").select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assigns what is left to training sequences, a row a piece of a document.

    Null and empty texts have no tokens and no row; very long ones are cut into pieces. A null id is packed as any other, and
    rows that repeat an id or a whole document each by itself. Ties in length go by id, then by piece, null last. An empty
    table gives no rows; columns other than doc_id and text are left out.
    """
    return packing.pack(docs)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("pack", pack)]

#: Models, string tiling and greedy packing can't be put in SQL; the tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; the tables between them are written to the shared checkpoint folder."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"  # kept: the result is read from it
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
