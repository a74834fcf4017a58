"""Passages that recur across documents, located with sharded Aho-Corasick automata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import Words, cut, merged, segments, slices, spans_hash

#: Bytes of segments that make up one automaton.
SHARD_BYTES = 2 << 20


def locate(texts: list[bytes], low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last word + 1) of each union of recurring passages in one shard's segments.

    low and high: the least and the greatest document that has the segment. A window of k words may recur if the segments
    with its hash lie in two documents. Windows that only ever follow one another make up one passage. Each passage is read
    off one segment and compiled into the automaton, through which every segment is streamed: where a passage occurs, and
    whether it does so in two documents, is what the automaton finds, byte by byte.
    """
    import ahocorasick

    w = Words(*_joined(texts))
    grams, good = w.grams(k)
    at = np.flatnonzero(good)
    order = at[np.argsort(grams[at], kind="stable")]
    h = grams[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    first = np.flatnonzero(new)
    code = np.full(len(grams), -1)
    if len(first):
        least, most = np.minimum.reduceat(low[w.doc[order]], first), np.maximum.reduceat(high[w.doc[order]], first)
        code[order] = np.where(least != most, np.arange(len(first)), -1)[np.cumsum(new) - 1]
    hit = np.flatnonzero(code >= 0)
    if not len(hit):
        return (np.empty(0, np.int64),) * 3
    times = np.bincount(code[hit], minlength=len(first))
    # the windows right behind one another, and how often those of one hash stand before those of one other
    pair = hit[:-1][(np.diff(hit) == 1) & (w.doc[hit[1:]] == w.doc[hit[:-1]])]
    a, b = code[pair], code[pair + 1]
    follow, least, most = np.bincount(a, minlength=len(first)), np.full(len(first), len(first)), np.full(len(first), -1)
    np.minimum.at(least, a, b)
    np.maximum.at(most, a, b)
    joined = np.zeros(len(grams), bool)
    joined[pair + 1] = (least == most)[a] & (follow == times)[a] & (times[a] == times[b])
    place = np.zeros(len(first), np.int64)
    place[code[hit][::-1]] = hit[::-1]  # where each window stands first
    s = hit[~joined[hit]]
    e = np.append(np.flatnonzero(~joined[hit])[1:], len(hit)) - 1
    once = place[code[s]] == s
    s, e = s[once], hit[e[once]]
    whole = b"".join(x + b"\n" for x in texts).decode("latin-1")
    passages: dict[str, int] = {}
    for x, y in zip(w.start[s].tolist(), w.end[e + k - 1].tolist()):
        passages.setdefault(" " + whole[x:y] + " ", len(passages))
    automaton = ahocorasick.Automaton()
    for passage, n in passages.items():
        automaton.add_word(passage, (n, len(passage)))
    automaton.make_automaton()
    begin, stop, text, which = [], [], [], []
    for i in np.unique(w.doc[hit]).tolist():
        x = int(w.start[w.offsets[i]])
        line = " " + whole[x : int(w.end[w.offsets[i + 1] - 1])] + " "
        for last, (n, size) in automaton.iter(line):
            begin.append(x + last - size + 1)
            stop.append(x + last - 1)
            text.append(i)
            which.append(n)
    i, n = np.array(text), np.array(which)
    lo, hi = np.full(len(passages), np.iinfo(np.int64).max), np.full(len(passages), np.iinfo(np.int64).min)
    np.minimum.at(lo, n, low[i])
    np.maximum.at(hi, n, high[i])
    two = (lo != hi)[n]
    first, last, i = merged(np.searchsorted(w.start, begin)[two], np.searchsorted(w.end, stop)[two] + 1, i[two])
    return i, first - w.offsets[i], last - w.offsets[i]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) + 1 for x in texts])
    return np.frombuffer(b"".join(x + b"\n" for x in texts), np.uint8), np.concatenate([[0], np.cumsum(size)])


def repeated(docs: DataFrame, min_words: int = 40, seed_words: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, end_word, n_words) of each maximal run of words that windows of min_words words cover which occur in
    two documents or more. Words are what white space parts.

    Each text is cut into overlapping segments by minimisers, so that equal windows fall under the same minimiser wherever
    they lie. Segments whose minimiser is in one document only are dropped. Of the others, each distinct one (by a 64-bit hash
    of its words) is brought to its minimiser's shard, where passages are confirmed, compiled into an automaton of bounded size
    and located, byte by byte; what is found in a segment counts for every document that has it.

    Null and empty texts and those of fewer than min_words words give no row, and neither do rows without an id. Repeats
    within a document don't count, and rows that share an id count as one document; if their texts differ, the passages of
    each are returned with that id. A row that occurs twice gives each passage once. An empty table gives no rows; other
    columns are ignored. Ids are whole numbers.
    """
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t")).where("id is not null and t is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, off in slices(b.column(2)):
                w = Words(data, off)
                least, s, e = segments(w, min_words, seed_words)
                row = pa.array(w.doc[s] + lo)
                base = w.offsets[w.doc[s]]
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(least), pa.array(spans_hash(w.hash, s, e).view(np.int64)), pa.array((s - base).astype(np.int32)), pa.array((e - base).astype(np.int32))], ["id", "th", "mh", "sk", "s", "e"])

    rows = src.mapInArrow(split, "id bigint, th bigint, mh bigint, sk bigint, s int, e int")
    # a minimiser that many share is counted before the shuffle, and met by one row a minimiser in the join
    again = cut(rows.join(rows.groupBy("mh").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo != hi").select("mh"), "mh", "left_semi"))
    one = again.groupBy("mh", "sk").agg(F.min(F.struct("id", "th", "s", "e")).alias("r"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    wanted = one.groupBy(F.col("r.id").alias("id"), F.col("r.th").alias("th")).agg(F.collect_list(F.struct("mh", "sk", F.col("r.s").alias("s"), F.col("r.e").alias("e"), "lo", "hi")).alias("c"))
    texts = src.join(wanted, ["id", "th"]).select("t", "c")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            for lo, hi, data, off in slices(b.column(0)):
                w, raw = Words(data, off), data.tobytes()
                part = lists.slice(lo, hi - lo)
                c = part.flatten()
                base = np.repeat(w.offsets[:-1], part.value_lengths().to_numpy())
                first, last = w.start[base + c.field("s").to_numpy()], w.end[base + c.field("e").to_numpy() - 1]
                seg = [b" ".join(raw[x:y].split()) for x, y in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_arrays([c.field("mh"), c.field("sk"), c.field("lo"), c.field("hi"), pa.array(seg, pa.binary())], ["mh", "sk", "lo", "hi", "seg"])

    found = texts.mapInArrow(fetch, "mh bigint, sk bigint, lo bigint, hi bigint, seg binary").dropDuplicates(["mh", "sk"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            i, a, b = locate(t.column("seg").to_pylist(), t.column("lo").to_numpy(), t.column("hi").to_numpy(), min_words)
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([t.column("mh").combine_chunks().take(at), t.column("sk").combine_chunks().take(at), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["mh", "sk", "a", "b"])

    spans = found.repartition("mh").sortWithinPartitions("mh").mapInArrow(search, "mh bigint, sk bigint, a int, b int")
    own = again.join(spans, ["mh", "sk"]).groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct((F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b")))).alias("x"))

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(1).flatten()
            group = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            s, e, g = merged(c.field("a").to_numpy().astype(np.int64), c.field("b").to_numpy().astype(np.int64), group)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(g)), pa.array(s), pa.array(e), pa.array(e - s)], [id_col, "start_word", "end_word", "n_words"])

    return own.select("id", "x").mapInArrow(union, f"`{id_col}` bigint, start_word bigint, end_word bigint, n_words bigint")


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about SHARD_BYTES of segments, cut between minimisers; the rows come sorted by minimiser."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        while size >= SHARD_BYTES:
            t = pa.Table.from_batches(held).combine_chunks()
            mh = t.column("mh").to_numpy()
            bytes_to = np.cumsum([len(x) for x in t.column("seg").to_pylist()])
            upto = int(np.searchsorted(mh, mh[min(len(mh) - 1, int(np.searchsorted(bytes_to, SHARD_BYTES)))], "left"))
            if not upto:
                upto = int(np.searchsorted(mh, mh[0], "right"))
                if upto == len(mh):
                    break
            yield t.slice(0, upto)
            held = t.slice(upto).to_batches()
            size = int(bytes_to[-1] - bytes_to[upto - 1])
    if held:
        yield pa.Table.from_batches(held)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
