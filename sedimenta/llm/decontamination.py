"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import NON_ALNUM, Words, slices, spans_hash

#: Bytes of benchmark text that one broadcast holds; a larger benchmark is handled in several passes.
BROADCAST_BYTES = 64 << 20
#: Pairs of equal seeds that are held for two texts; where there are more, tiles are looked for in memory linear in the texts.
SEED_PAIRS = 1 << 18


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in pattern, place in text, length) of each tile, by running Karp-Rabin matching.

    Again and again the longest matches of unmarked tokens, of at least least tokens, are marked on both sides, in order
    of place; matches that an earlier mark cut into are looked for anew.
    """
    out: list[tuple[int, int, int]] = []
    if min(len(pattern), len(text)) < least:
        return out
    hashes = []
    for side in (pattern, text):
        at = np.arange(len(side) - least + 1)
        hashes.append(spans_hash(side, at, at + least))
    order = np.argsort(hashes[0], kind="stable")
    lo, hi = np.searchsorted(hashes[0][order], hashes[1], "left"), np.searchsorted(hashes[0][order], hashes[1], "right")
    n = hi - lo
    if int(n.sum()) > SEED_PAIRS:
        return _tiles_by_length(pattern, text, least)
    j = np.repeat(np.arange(len(n)), n)
    i = order[np.repeat(lo, n) + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)]
    free = [np.ones(len(pattern), bool), np.ones(len(text), bool)]
    while len(i):
        ok = np.ones(len(i), bool)
        for side, at in ((0, i), (1, j)):
            taken = np.concatenate([[0], np.cumsum(~free[side])])
            ok &= taken[at + least] == taken[at]
        i, j = i[ok], j[ok]
        if not len(i):
            break
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        new = np.ones(len(i), bool)
        new[1:] = ((j - i)[1:] != (j - i)[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(i))) + least - 1
        best = int(length.max())
        for a, b in sorted(zip(i[first[length == best]].tolist(), j[first[length == best]].tolist())):
            if free[0][a : a + best].all() and free[1][b : b + best].all():
                free[0][a : a + best] = free[1][b : b + best] = False
                out.append((a, b, best))
    return out


def _tiles_by_length(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """As tiles(), in memory linear in both texts, for those with repeats without end.

    The longest match of unmarked tokens is found by bisection, since whatever has a match of some length has the shorter
    ones too; each length takes one running hash over both sides. Of its matches, each place in the pattern takes the first
    free one in the text.
    """
    out: list[tuple[int, int, int]] = []
    free = [np.ones(len(pattern), bool), np.ones(len(text), bool)]
    sides = (pattern, text)

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows of n unmarked tokens, and their hashes."""
        taken = np.concatenate([[0], np.cumsum(~free[side])])
        at = np.flatnonzero(taken[n:] == taken[:-n])
        return at, spans_hash(sides[side], at, at + n)

    def meets(n: int) -> bool:
        return bool(np.isin(np.unique(windows(0, n)[1]), np.unique(windows(1, n)[1])).any())

    longest = min(len(pattern), len(text))
    while longest >= least and meets(least):
        low, high = least, longest
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if meets(middle) else (low, middle - 1)
        longest = n = low
        (at, own), (there, other) = windows(0, n), windows(1, n)
        by = np.argsort(other, kind="stable")
        there, other = there[by], other[by]
        first, last = np.searchsorted(other, own, "left"), np.searchsorted(other, own, "right")
        next_of: dict[int, int] = {}  # places only ever become marked, so none is looked at twice for one hash
        for a, lo, hi in zip(at[first < last].tolist(), first[first < last].tolist(), last[first < last].tolist()):
            if not free[0][a : a + n].all():
                continue
            k = next_of.get(lo, lo)
            while k < hi and not free[1][there[k] : there[k] + n].all():
                k += 1
            next_of[lo] = k
            if k < hi:
                b = int(there[k])
                free[0][a : a + n] = free[1][b : b + n] = False
                out.append((a, b, n))
        longest = n - 1
    return out


def find(docs: DataFrame, tests: DataFrame, least: int = 5, coverage: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The pairs of a document and a test item of which a share of coverage or more of the tokens lies in tiles.

    Tokens are runs of letters and digits of the lower-cased text. A document and an item are tiled if they share a seed of
    least tokens. Since tiles may lie in any order, passages that were cut up and put in another order are found too.
    Returns id, item_id, matched, item_tokens, coverage.

    A null or empty text has no tokens and no match, and an item of fewer than least tokens matches nothing. Null ids are
    carried along. Rows that are repeated, on either side, give rows of their own; rows that share an id are not merged.
    Ties between equally long matches go by place in the item, then in the document. Memory is linear in the longest text,
    whatever it repeats. If either table is empty, so is the result; other columns are ignored.

    The items are broadcast in parts of at most broadcast_bytes, with a pass over the documents for each part.
    """
    spark = docs.sparkSession
    items = tests.select(F.col(item_col).alias("item"), F.lower(item_text_col).alias("t")).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // broadcast_bytes))
    src = docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("t"))
    kinds = src.schema["id"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    item_type = pa.int64() if kinds[1] == "bigint" else None

    def one(part: int) -> DataFrame:
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).collect()
        held = spark.sparkContext.broadcast([(r[0], r[1]) for r in rows])
        made: list = []

        def load() -> list:
            if not made:
                texts = pa.array([t for _, t in held.value], pa.large_string())
                tokens, seeds, owner, ids = [], [], [], [i for i, _ in held.value]
                for lo, hi, data, off in slices(texts):
                    w = Words(data, off, NON_ALNUM)
                    grams, good = w.grams(least)
                    seeds.append(grams[good])
                    owner.append(w.doc[: len(grams)][good] + lo)
                    tokens += [w.hash[w.offsets[k] : w.offsets[k + 1]] for k in range(hi - lo)]
                s = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
                o = np.concatenate(owner) if owner else np.empty(0, np.int64)
                by = np.lexsort((o, s))
                s, o = s[by], o[by]
                new = np.ones(len(s), bool)
                new[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])  # a seed that an item repeats counts once
                bits = np.zeros(1 << 22, bool)
                bits[s >> np.uint64(42)] = True
                made.extend((ids, tokens, s[new], o[new], bits))
            return made

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, tokens, seeds, owner, bits = load()
            for b in batches:
                rows, found = [], []
                for lo, hi, data, off in slices(b.column(1)) if len(seeds) else ():
                    w = Words(data, off, NON_ALNUM)
                    grams, good = w.grams(least)
                    at = np.flatnonzero(bits[grams >> np.uint64(42)] & good)
                    left = np.searchsorted(seeds, grams[at], "left")
                    n = np.searchsorted(seeds, grams[at], "right") - left
                    once = np.unique(w.doc[at] * len(seeds) + left, return_index=True)[1]  # as does one that a text repeats
                    once = once[n[once] > 0]
                    at, left, n = at[once], left[once], n[once]
                    item = owner[np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                    pairs = np.unique(np.repeat(w.doc[at], n) * len(ids) + item)
                    for d, i in zip((pairs // len(ids)).tolist(), (pairs % len(ids)).tolist()):
                        got = sum(x[2] for x in tiles(tokens[i], w.hash[w.offsets[d] : w.offsets[d + 1]], least))
                        if got >= coverage * len(tokens[i]):
                            rows.append(lo + d)
                            found.append((ids[i], got, len(tokens[i])))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int32())), pa.array([x[0] for x in found], item_type), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[1] / x[2] for x in found], pa.float64())], ["id", "item", "matched", "tokens", "coverage"])

        return src.mapInArrow(match, f"id {kinds[0]}, item {kinds[1]}, matched bigint, tokens bigint, coverage double")

    out = one(0)
    for part in range(1, parts):
        out = out.unionByName(one(part))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "matched", F.col("tokens").alias("item_tokens"), "coverage")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
