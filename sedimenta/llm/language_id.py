"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import mix, slices
from .sketch import frequencies

BITS = 14
BUCKETS = 1 << BITS
ORDERS = (1, 2, 3)
#: Cells of a block of documents by buckets that is handled at once.
BLOCK = 32


def counts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, last + 1, counts by bucket) of blocks of texts; n-grams of characters, blanks run together, in no two texts."""
    char = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(char)])
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    bounds = at[off]
    code[code < 33] = 32
    for lo in range(0, len(off) - 1, BLOCK):
        hi = min(len(off) - 1, lo + BLOCK)
        x = code[bounds[lo] : bounds[hi]]
        doc = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
        out = np.zeros((hi - lo) * BUCKETS, np.float32)
        for n in ORDERS:
            if len(x) < n:
                continue
            key = np.zeros(len(x) - n + 1, np.uint64)
            for k in range(n):
                key = key * np.uint64(0x110003) + x[k : k + len(key)]
            key = (mix(key + np.uint64(n << 60)) >> np.uint64(64 - BITS)).astype(np.int64) + doc[: len(key)] * BUCKETS
            if n > 1:
                key = key[doc[: len(key)] == doc[n - 1 :]]
            out += np.bincount(key, minlength=len(out))
        yield lo, hi, out.reshape(hi - lo, BUCKETS)


def features(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log(1 + count) * idf, of length 1 (0 where there is no text)."""
    x = np.log1p(tf, out=tf) * idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None]


def _present(texts: pa.Array, sums: np.ndarray) -> int:
    n = 0
    for _, _, data, off in slices(texts):
        for _, _, tf in counts(data, off):
            sums += np.count_nonzero(tf, axis=0)
            n += int(np.count_nonzero(tf.any(axis=1)))
    return n


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Rows:
    """Rows of features, of which only what isn't 0 is held."""

    def __init__(self, blocks: Iterator[np.ndarray]):
        self.at: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        for block in blocks:
            for row in block:
                self.at.append(np.flatnonzero(row).astype(np.int32))
                self.value.append(row[self.at[-1]].astype(np.float32))

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows.tolist()):
            out[k, self.at[r]] = self.value[r]
        return out


def ftrl(x: Rows, y: np.ndarray, rows: np.ndarray, classes: int, epochs: int = 4, batch: int = 16, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, seed: int = 7) -> np.ndarray:
    """Weights by follow-the-regularised-leader with adaptive rates for each weight and the elastic net l1, l2."""
    z, n, w = (np.zeros((BUCKETS, classes), np.float32) for _ in range(3))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(rows)
        for lo in range(0, len(order), batch):
            at = order[lo : lo + batch]
            some = x[at]
            p = softmax(some @ w)
            p[np.arange(len(at)), y[at]] -= 1
            g = some.T @ p.astype(np.float32)
            square = g * g
            z += g - (np.sqrt(n + square) - np.sqrt(n)) / alpha * w
            n += square
            w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)
    return w


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search."""

    def loss(log_t: float) -> float:
        p = softmax(logits / np.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    heldout_accuracy: float

    def probabilities(self, tf: np.ndarray) -> np.ndarray:
        return softmax(features(tf, self.idf) @ self.weights / self.temperature)


def train(docs: DataFrame, train_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """A model of the labels in docs. Document frequencies are counted over every document; the weights are fitted on about
    train_rows of the rows that have a label and text, however many have none, drawn by a hash of the id and the text; a fifth
    of them is kept back for the temperature.

    Rows with a null or empty text count for nothing, and those with a null label only for frequencies; a null id is drawn as
    any other. Very long texts are read whole. Equal rows are drawn together, each with its weight, and ties in the hash go by
    label. Of an empty table, or one without labels, comes a model that knows no language. Other columns are ignored.
    """
    src = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.lower(text_col).alias("t"), F.col(label_col).alias("y"))
    n, df = frequencies(src.select("t"), BUCKETS, _present)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    labelled = src.where(F.col("y").isNotNull() & (F.length("t") > 0))
    share = min(1.0, train_rows / max(1, labelled.count()))
    drawn = labelled.where(F.pmod(F.col("h"), F.lit(1 << 30)) < int(share * (1 << 30))).toArrow()
    drawn = drawn.sort_by([("h", "ascending"), ("y", "ascending")])
    of = drawn.column("y").to_pylist()
    labels = sorted(set(of))
    if not labels:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), 1.0, float("nan"))
    y = np.array([labels.index(v) for v in of], np.int64)
    x = Rows(features(tf, idf) for _, _, data, off in slices(drawn.column("t")) for _, _, tf in counts(data, off))
    back = np.flatnonzero(np.arange(len(y)) % 5 == 4)
    w = ftrl(x, y, np.flatnonzero(np.arange(len(y)) % 5 != 4), len(labels))
    if not len(back):
        return Model(labels, idf, w, 1.0, float("nan"))
    logits = np.concatenate([x[back[k : k + BLOCK]] @ w for k in range(0, len(back), BLOCK)])
    return Model(labels, idf, w, temperature(logits, y[back]), float((logits.argmax(axis=1) == y[back]).mean()))


def identify(docs: DataFrame, model: Model, min_confidence: float = 0.5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """id, language, confidence and keep of each row; keep: the calibrated probability of the language is min_confidence or more.

    A null or empty text, and any text if the model knows no language, has no language (null), confidence 0 and isn't kept.
    Equal probabilities go to the language that comes first by name. Null ids are carried along, and repeated rows get a
    result each. An empty table gives an empty result. Columns that carry names come along under their names; others are
    ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    carry = carry or []
    src = docs.select(F.col(id_col).alias("_id"), F.lower(text_col).alias("_t"), *[F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)])
    fields = [f for f in src.schema.fields if f.name != "_t"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            best, sure = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            for lo, _, data, off in slices(b.column(1)) if m.labels else ():
                for i, j, tf in counts(data, off):
                    some = np.flatnonzero(tf.any(axis=1))
                    if len(some):
                        p = m.probabilities(tf[some])
                        best[lo + i + some], sure[lo + i + some] = p.argmax(axis=1), p.max(axis=1)
            names = pa.array(m.labels, pa.string()).take(pa.array(best, mask=best < 0))
            keep = pa.array((best >= 0) & (sure >= min_confidence))
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in range(2, b.num_columns)), names, pa.array(sure), keep], [f.name for f in fields] + ["language", "confidence", "keep"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    out = src.mapInArrow(score, f"{kinds}, language string, confidence double, keep boolean")
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)], "language", "confidence", "keep")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs))
