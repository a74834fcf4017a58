"""Removal of repeated multi-line chunks whose boundaries depend on content."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTOR = 31


def line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.md5(line).digest()[:4], "big")


def chunk_ends(hashes: list[int], window: int, divisor: int) -> list[int]:
    """The line after each chunk: a chunk ends where the rolling hash of the last window lines is 0 modulo divisor."""
    h = np.array(hashes, np.int64)
    roll, factor = h.copy(), 1
    for back in range(1, min(window, len(h))):
        factor *= FACTOR
        roll[back:] += factor * h[:-back]
    ends = (np.flatnonzero(roll % divisor == 0) + 1).tolist()
    return ends if ends and ends[-1] == len(h) else [*ends, len(h)]


def dedup_lines(docs: DataFrame, window: int = 2, divisor: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each chunk of two lines or more that occurs again in the corpus, all but its first occurrence.

    A text's lines are cut into chunks behind every line where a rolling hash over the hashes of the last window lines is
    0 modulo divisor, so that an insertion moves no boundary but those next to it. Chunks that share a 128-bit hash are
    compared byte by byte; of equal ones, the one of least id, then least place, stays. Returns the table with the text
    replaced and n_removed, the count of lines removed.

    A null text stays null and an empty one empty, with 0 removed; a text of which nothing is left is empty. A null id
    sorts first. Rows that are the same in id and text are one document, and each gets its result; rows with one id and
    other texts are documents of their own. Ties don't arise between different places. The work on a text is in proportion to
    its length, however long it is. An empty table stays empty. Other columns are carried along; if one is called n_removed,
    it is replaced.
    """
    base = docs.drop("n_removed")
    key = [F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_th")]
    src = docs.select(*key, F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            first, last, a, z = [], [], [], []
            for i, text in enumerate(b.column(2).to_pylist()):
                if not text or "\n" not in text:
                    continue
                lines = text.encode().split(b"\n")
                begin = 0
                for end in chunk_ends([line_hash(x) for x in lines], window, divisor):
                    if end - begin > 1:
                        d = hashlib.md5(b"\n".join(lines[begin:end])).digest()
                        rows.append(i)
                        first.append(begin)
                        last.append(end)
                        a.append(int.from_bytes(d[:8], "big", signed=True))
                        z.append(int.from_bytes(d[8:], "big", signed=True))
                    begin = end
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["_id", "_th", "s", "e", "k1", "k2"])

    found = src.mapInArrow(chunks, f"_id {kind}, _th bigint, s int, e int, k1 bigint, k2 bigint")  # hashed twice rather than stored
    place = F.struct("_id", "_th", "s")
    # a hash that many share is counted before the shuffle, and met by one row a hash in the join
    shared = found.groupBy("k1", "k2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi").select("k1", "k2")
    wanted = found.join(shared, ["k1", "k2"], "left_semi").groupBy("_id", "_th").agg(F.collect_set(F.struct("s", "e", "k1", "k2")).alias("c"))
    same_doc = F.col("_id").eqNullSafe(F.col("r_id")) & (F.col("_th") == F.col("r_th"))
    texts = src.join(wanted.select(F.col("_id").alias("r_id"), F.col("_th").alias("r_th"), "c"), same_doc).select("_id", "_th", "_text", "c")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            for i, text in enumerate(b.column(2).to_pylist()):
                lines = text.encode().split(b"\n")
                c = lists[i].values
                own = [b"\n".join(lines[x:y]) for x, y in zip(c.field("s").to_pylist(), c.field("e").to_pylist())]
                at = pa.array(np.full(len(own), i, np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(c.field(x) for x in ("s", "e", "k1", "k2")), pa.array(own, pa.binary())], ["_id", "_th", "s", "e", "k1", "k2", "bytes"])

    bytes_of = texts.mapInArrow(fetch, f"_id {kind}, _th bigint, s int, e int, k1 bigint, k2 bigint, bytes binary")
    first = bytes_of.groupBy("k1", "k2", "bytes").agg(F.min(place).alias("lo"))
    losers = bytes_of.join(first, ["k1", "k2", "bytes"]).where(place != F.col("lo")).groupBy(F.col("_id").alias("r_id"), F.col("_th").alias("r_th")).agg(F.collect_set(F.struct("s", "e")).alias("gone"))

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A byte for each line, 1 if it goes; lines behind the last that goes have none."""
        for b in batches:
            out, n = [], []
            for c in b.column(2):
                s, e = (c.values.field(x).to_numpy() for x in ("s", "e"))
                step = np.zeros(int(e.max()) + 1, np.int8)
                step[s] += 1
                step[e] -= 1
                out.append(np.cumsum(step[:-1], dtype=np.int8).tobytes())
                n.append(int((e - s).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary()), pa.array(n, pa.int64())], ["r_id", "r_th", "mask", "n"])

    gone = losers.mapInArrow(masks, f"r_id {kind}, r_th bigint, mask binary, n bigint")
    full = base.select(F.struct(*base.columns).alias("_row"), *key).join(gone, same_doc, "left")
    own = F.col("_row")[text_col]
    kept = F.array_join(F.filter(F.split(own, "\n", -1), lambda x, i: F.substring("mask", i + 1, 1) != F.lit(b"\1")), "\n")
    text = F.when(F.col("mask").isNull(), own).otherwise(kept)
    return full.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in base.columns], F.coalesce("n", F.lit(0)).cast("bigint").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


LINE_DEDUP_CTE = """
src AS (SELECT * FROM {table} WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (SELECT *, (h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS b FROM hashed),
numbered AS (SELECT *, coalesce(sum(b::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM rolled),
chunks AS (SELECT doc_id, c, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM numbered GROUP BY doc_id, c),
ranked AS (SELECT doc_id, c, n, n > 1 AND row_number() OVER (PARTITION BY t ORDER BY doc_id, c) > 1 AS gone FROM chunks),
deduped AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed
            FROM numbered JOIN ranked USING (doc_id, c) GROUP BY doc_id)
"""
SQL = {"op9_line_dedup": "WITH " + LINE_DEDUP_CTE.format(table="documents") + "SELECT doc_id, text, n_removed FROM deduped UNION ALL SELECT doc_id, NULL, 0 FROM documents WHERE text IS NULL"}
