"""Quality scores from preference pairs: Bradley-Terry ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import NON_ALNUM, SPACES, Words, cut, slices

#: Bits of a word's bucket; measures of form, whose weights come before the buckets'.
BITS = 18
FORM = 12
_b = np.arange(256)
_CLASSES = [np.isin(_b, c) for c in ([*range(97, 123), *range(128, 256)], range(65, 91), range(48, 58), [44, 46], [10])]
_LOWER = np.where((_b >= 65) & (_b <= 90), _b + 32, _b).astype(np.uint8)
_SIGN = ~(SPACES | _CLASSES[0] | _CLASSES[1] | _CLASSES[2] | _CLASSES[3])


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Measures of each text's form, a row each; and text, bucket and value of each of its distinct words, whatever their
    case: the share of the text's words (square rooted)."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def share(what: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(what[data])])
        return np.diff(total[off]) / size

    lower, upper, digit, stop, newline = (share(c) for c in _CLASSES)
    w = Words(data, off, SPACES)
    count = np.diff(w.offsets)
    per = np.maximum(count, 1)
    key = np.sort(w.doc.astype(np.uint64) << np.uint64(44) | w.hash >> np.uint64(20))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(44)).astype(np.int64), minlength=n) / per
    line = Words(data, off, _CLASSES[4])
    lkey = np.sort(line.doc.astype(np.uint64) << np.uint64(44) | line.hash >> np.uint64(20))
    lnew = np.ones(len(lkey), bool)
    lnew[1:] = lkey[1:] != lkey[:-1]
    lines = np.maximum(np.diff(line.offsets), 1)
    fresh = np.bincount((lkey[lnew] >> np.uint64(44)).astype(np.int64), minlength=n) / lines
    form = np.stack([lower, upper, digit, stop, np.sqrt(share(_SIGN)), newline, np.log1p(count) / 8, (size / per) / 10, distinct, np.sqrt(np.maximum(0, 1 - distinct)), fresh, np.sqrt(upper)], axis=1)
    own = Words(_LOWER[data], off, NON_ALNUM)
    key, times = np.unique(own.doc << BITS | (own.hash >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    doc = key >> BITS
    return form, doc, key & ((1 << BITS) - 1), np.sqrt(times / np.diff(own.offsets)[doc])


def scores(x: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], w: np.ndarray) -> np.ndarray:
    """The score of each row of features; what a text gets doesn't depend on those beside it."""
    form, doc, bucket, value = x
    return (form * w[:FORM]).sum(axis=1) + np.bincount(doc, value * w[FORM + bucket], len(form))


@dataclass
class Ranking:
    weights: np.ndarray
    threshold: float
    heldout_accuracy: float


def _rows(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    blocks = [(lo, *features(data, off)) for lo, _, data, off in slices(texts, 1 << 19)]
    if not blocks:
        return np.zeros((0, FORM)), *(np.zeros(0, np.int64),) * 2, np.zeros(0)
    return np.concatenate([x[1] for x in blocks]), np.concatenate([x[0] + x[2] for x in blocks]), *(np.concatenate([x[k] for x in blocks]) for k in (3, 4))


def fit(x: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], better: np.ndarray, worse: np.ndarray, epochs: int = 300, rate: float = 0.05, l2: float = 1e-4) -> np.ndarray:
    """Weights of least logistic loss on the differences of scores of rows, better less worse, by Adam over all pairs."""
    form, doc, bucket, value = x
    fitted = np.isin(doc, np.concatenate([better, worse]))
    doc, value = doc[fitted], value[fitted]
    used, at = np.unique(bucket[fitted], return_inverse=True)
    own = (form, doc, at, value)
    w, m, v = (np.zeros(FORM + len(used)) for _ in range(3))
    for t in range(1, epochs + 1):
        s = scores(own, w)
        p = 1 / (1 + np.exp(np.clip(s[better] - s[worse], -30, 30)))
        c = (np.bincount(better, p, len(s)) - np.bincount(worse, p, len(s))) / max(1, len(better))
        g = l2 * w - np.concatenate([c @ form, np.bincount(at, value * c[doc], len(used))])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    out = np.zeros(FORM + (1 << BITS))
    out[:FORM], out[FORM + used] = w[:FORM], w[FORM:]
    return out


def _scored(b: pa.Array, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of each text in single precision, and whether it has none."""
    s, none = np.zeros(len(b), np.float32), np.ones(len(b), bool)
    for lo, hi, data, off in slices(b, 1 << 19):
        s[lo:hi], none[lo:hi] = scores(features(data, off), weights), np.diff(off) == 0
    return s, none


def score_quantile(docs: DataFrame, weights: np.ndarray, quantile: float, text_col: str = "text") -> float:
    """The score at quantile among the scores of all texts, exactly: the one of rank floor(quantile * (n - 1)) from below.

    Scores are put in order as whole numbers of 32 bits; the driver gets the counts by the upper 16 bits, then those by
    the lower ones within the upper ones that hold the rank.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, none = _scored(b.column(0), held.value)
            bits = s[~none].view(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(bits < 0, bits ^ 0x7FFFFFFF, bits))], ["k"])

    k = cut(docs.select(F.col(text_col).alias("t")).where("t is not null").mapInArrow(ordered, "k int"))

    def counts(part: DataFrame, by: str) -> tuple[np.ndarray, np.ndarray]:
        t = part.groupBy(F.expr(by).alias("p")).agg(F.count("*").alias("n")).toArrow().sort_by("p")
        return t.column("p").to_numpy(), t.column("n").to_numpy()

    high, n = counts(k, "shiftright(k, 16)")
    if not len(high):
        return float("-inf")
    rank = int(quantile * (n.sum() - 1))
    at = int(np.searchsorted(np.cumsum(n), rank, "right"))
    low, m = counts(k.where(F.shiftright("k", 16) == int(high[at])), "k & 65535")
    own = np.int32(int(high[at]) << 16 | int(low[np.searchsorted(np.cumsum(m), rank - (n[:at].sum()), "right")]))
    return float(np.array([own ^ 0x7FFFFFFF if own < 0 else own], np.int32).view(np.float32)[0])


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 3000, pairs: int = 12000, quantile: float = 0.2, id_col: str = "doc_id", text_col: str = "text", seed: int = 5) -> Ranking:
    """Weights fitted on about train_rows labelled documents, drawn by a hash of the id, of which a fifth is kept back.

    A document of quality 1 that isn't toxic is preferred to any of quality 0 or that is toxic; pairs such pairs are drawn,
    half of them with toxic documents, where there are both kinds. The threshold is the score at quantile among the scores
    of all documents with text: about this share of the corpus isn't kept, so set it to the share of bad documents. Without
    such pairs every score is 0 and all are kept.

    Labels with a null id or quality are left out; a null toxic reads as 0. Labels that share an id are one: bad if one of
    them is, toxic if one of them is. Documents that share an id are drawn each; null texts and null ids aren't drawn, and very
    long texts are read whole. Ties in the order of drawn rows go by text. An empty table on either side gives no pairs.
    Other columns are ignored.
    """
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    own = labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 1) & ~toxic).alias("good"), toxic.alias("toxic")).where("id is not null and good is not null").groupBy("id").agg(F.min("good").alias("good"), F.max("toxic").alias("toxic"))
    n = own.count()
    drawn = own.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, train_rows / max(1, n)) * (1 << 30)))
    t = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(drawn, "id").select("id", "t", "good", "toxic").toArrow().sort_by([("id", "ascending"), ("t", "ascending")])
    good, toxic = (np.array(t.column(c).to_pylist(), bool) for c in ("good", "toxic"))
    x = _rows(t.column("t"))
    back = np.arange(len(good)) % 5 == 4
    rng = np.random.default_rng(seed)

    def some(of: np.ndarray, kinds: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        a, bad = np.flatnonzero(of & good), [b for b in (np.flatnonzero(of & k) for k in kinds) if len(b)]
        if not len(a) or not bad:
            return a[:0], a[:0]
        b = np.concatenate([rng.choice(b, pairs // len(bad)) for b in bad])
        return rng.choice(a, len(b)), b

    a, b = some(~back, (toxic, ~good & ~toxic))
    if not len(a):
        return Ranking(np.zeros(FORM + (1 << BITS)), float("-inf"), float("nan"))
    w = fit(x, a, b)
    s = scores(x, w)
    a, b = some(back, (~good,))
    return Ranking(w, score_quantile(docs, w, quantile, text_col), float((s[a] > s[b]).mean()) if len(a) else float("nan"))


def rank(docs: DataFrame, model: Ranking, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and keep of each row; keep: the score reaches the model's threshold.

    Null and empty texts have no score (null) and aren't kept. Null ids are carried along, repeated rows get a result each,
    ties with the threshold are kept. An empty table gives no rows; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    kind = src.schema["_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            s, none = _scored(b.column(1), m.weights)
            keep = ~none & (s >= m.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s.astype(np.float64), mask=none), pa.array(keep)], ["_id", "score", "keep"])

    return src.mapInArrow(score, f"_id {kind}, score double, keep boolean").withColumnRenamed("_id", id_col)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rank(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
