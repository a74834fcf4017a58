"""Cost-balanced packing of documents into training sequences."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import cut

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def encoder(path: str):
    """The byte-pair encoder of a ranks file, made once a process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def assign(tokens: np.ndarray, costs: np.ndarray, capacity: int) -> np.ndarray:
    """The sequence of each piece; pieces come in descending order.

    Each goes to the sequence of lowest cost (the first of these) that still has room; where none has, one is opened.
    """
    size = max(1, -(-int(tokens.sum()) // capacity))
    room, cost = np.full(2 * size + 1, capacity), np.zeros(2 * size + 1)
    out = np.empty(len(tokens), np.int64)
    for i, (n, c) in enumerate(zip(tokens.tolist(), costs.tolist())):
        fits = np.where(room[:size] >= n, cost[:size], np.inf)
        best = int(fits.argmin())
        if fits[best] == np.inf:
            best, size = size, size + 1
            if size > len(room):
                room, cost = np.append(room, np.full(size, capacity)), np.append(cost, np.zeros(size))
        room[best] -= n
        cost[best] += c
        out[i] = best
    return out


def pack(docs: DataFrame, capacity: int = 4096, linear: float = 1.0, quadratic: float = 1 / 6144, shard_sequences: int = 512, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Assigns documents to sequences of at most capacity tokens, with costs linear * n + quadratic * n^2 kept even.

    Documents are hashed by id and place in the table into shards of about shard_sequences sequences, as many as the tokens
    need, and each shard is packed by itself, so that no task's work grows with the corpus, whatever many rows share an id or
    have none. sequence is the shard times 2^32, plus the sequence's number in it. A document longer than capacity is cut into pieces
    of capacity tokens and a rest. Returns id, piece, start_token, n_tokens, cost, sequence, a row a piece.

    The tokenizer's file must lie at the same path on every executor (TOKENIZER_DIR names its folder).

    Null and empty texts have no tokens and no row. A null id is packed as any other; rows that repeat an id or a whole
    document are packed each by itself. Ties in length go by id, then by piece, null last. An empty table gives no rows;
    other columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_ordinary
        for b in batches:
            n = [0 if t is None else len(encode(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["id", "n"])

    counts = cut(src.mapInArrow(count, f"id {kind.simpleString()}, n bigint").where("n > 0"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // (capacity * shard_sequences)))
    shard = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards))  # stable, as it numbers checkpointed rows
    pieces = counts.withColumn("shard", shard).select("id", "shard", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    pieces = pieces.select("id", "shard", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * F.lit(capacity)).cast("bigint").alias("n"))

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([("n", "descending"), ("id", "ascending"), ("piece", "ascending")])
        n = t.column("n").to_numpy()
        cost = linear * n + quadratic * n * n
        seq = assign(n, cost, capacity) + t.column("shard").to_numpy() * (1 << 32)
        return pa.table({id_col: t.column("id"), "piece": t.column("piece"), "start_token": t.column("start"), "n_tokens": t.column("n"), "cost": pa.array(cost), "sequence": pa.array(seq)})

    return pieces.groupBy("shard").applyInArrow(one, f"`{id_col}` {kind.simpleString()}, piece int, start_token bigint, n_tokens bigint, cost double, sequence bigint")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
