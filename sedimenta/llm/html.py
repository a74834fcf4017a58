"""Main text of web pages: boilerplate is what a suffix array finds repeated on a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import Words, merged, slices

_DROP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z!?](?:[^<>\"']|\"[^\"]*\"|'[^']*')*>?", re.S | re.I)
#: Suffixes that are sorted at once.
BUCKET = 1 << 20


def visible(page: str) -> str:
    """The page's text: tags, comments, scripts and styles make way for a space, and character references are resolved."""
    return html.unescape(_DROP.sub(" ", page))


def covered(tokens: np.ndarray, page: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last + 1) of each union of runs of least tokens or more that occur on two pages, from the suffix array.

    Suffixes are sorted by their first least tokens, in buckets by their first one. Deeper order isn't needed: the cover of
    all repeats of least tokens or more is that of the repeats of just least tokens, which are the intervals of the array
    whose neighbours' longest common prefixes reach least.
    """
    n = len(tokens) - least + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 2
    at = np.flatnonzero(page[:n] == page[least - 1 :])
    size = np.bincount(tokens[at]) if len(at) else np.empty(0, np.int64)
    part = (np.cumsum(size) - size) // BUCKET
    by = np.argsort(part[tokens[at]], kind="stable") if len(at) else at
    at = at[by]
    cuts = np.searchsorted(part[tokens[at]], np.arange(int(part.max()) + 2)) if len(at) else []
    hits = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        own = at[lo:hi]
        if len(own) < 2:
            continue
        own = own[np.lexsort([tokens[own + k] for k in reversed(range(least))])]
        new = np.zeros(len(own), bool)
        new[0] = True
        for k in range(least):
            t = tokens[own + k]
            new[1:] |= t[1:] != t[:-1]
        first = np.flatnonzero(new)
        apart = np.minimum.reduceat(page[own], first) != np.maximum.reduceat(page[own], first)
        hits.append(own[apart[np.cumsum(new) - 1]])
    hit = np.sort(np.concatenate(hits)) if hits else np.empty(0, np.int64)
    s, e, _ = merged(hit, hit + least, np.zeros(len(hit), np.int64))
    return s, e


def extract(pages: DataFrame, least: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host and text of each page: the runs of its words that no repeated substring of its host covers, a line a run.

    The words of a host's pages are concatenated; every substring of least words or more that occurs on two distinct pages
    of the host is boilerplate and goes, wherever it occurs. Pages of a host that have the same words are one page, so that a
    page under several addresses loses nothing to itself; each copy gets the result. Repeats within one page stay.

    A null or empty page, or one of which nothing is left, has an empty text. A null or malformed url belongs to the host
    ''. Null ids are carried along; rows that repeat an id or a whole page get a result each. Ties don't arise. An empty table gives no rows; other columns
    are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    src = pages.select(F.col(id_col).alias("id"), host.alias("host"), F.col(html_col).alias("h"))
    kind = src.schema["id"].dataType.simpleString()

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([" ".join(visible(h).split()) if h else "" for h in b.column(2).to_pylist()], pa.string())], ["id", "host", "t"])

    def one(t: pa.Table) -> pa.Table:
        texts = t.column("t").combine_chunks()
        texts = (texts if isinstance(texts, pa.Array) else texts.chunk(0)).dictionary_encode()
        which, texts = texts.indices, texts.dictionary  # each distinct page once
        hashes, pages_of, at = [], [], 0
        for lo, _, data, off in slices(texts):
            w = Words(data, off)
            hashes.append(w.hash)
            pages_of.append((w.doc + lo).astype(np.int32))
        page = np.concatenate([*pages_of, np.empty(0, np.int32)])
        tokens = np.unique(np.concatenate([*hashes, np.empty(0, np.uint64)]), return_inverse=True)[1].astype(np.int32)
        hashes.clear()
        s, e = covered(tokens, page, least)
        gone = np.zeros(len(tokens) + 1, np.int8)
        gone[s] += 1
        gone[e] -= 1
        gone = np.cumsum(gone[:-1], dtype=np.int8).astype(bool)
        out = []
        for lo, hi, data, off in slices(texts):
            w, raw = Words(data, off), data.tobytes()
            stay = ~gone[at : at + len(w.hash)]
            at += len(w.hash)
            begin, end = stay.copy(), stay.copy()
            begin[1:] &= ~stay[:-1] | (w.doc[1:] != w.doc[:-1])
            end[:-1] &= ~stay[1:] | (w.doc[1:] != w.doc[:-1])
            a, z = np.flatnonzero(begin), np.flatnonzero(end)
            runs: list[list[str]] = [[] for _ in range(hi - lo)]
            for d, x, y in zip(w.doc[a].tolist(), w.start[a].tolist(), w.end[z].tolist()):
                runs[d].append(raw[x:y].decode("utf-8", "replace"))
            out += ["\n".join(r) for r in runs]
        return pa.table({"id": t.column("id"), "host": t.column("host"), "text": pa.array(out, pa.string()).take(which)})

    done = src.mapInArrow(text, f"id {kind}, host string, t string").groupBy("host").applyInArrow(one, f"id {kind}, host string, text string")
    return done.withColumnRenamed("id", id_col)


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
