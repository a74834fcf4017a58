"""Information-theoretic sanitisation of personal data."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import NON_ALNUM, Words, cut, mix, slices

_MAIL = r"(?P<EMAIL>[\w.%+-]+@[\w-]+(?:\.[\w-]+)+)"
_OTHERS = (
    r"|(?P<SECRET>(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d)\b\s*[=:]\s*)[\"']?[^\s\"']{6,}[\"']?|\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\b(?:gh[pousr]_|sk-|xox[bp]-)[\w-]{16,}|\b[0-9a-fA-F]{32,64}\b)"
    r"|(?P<IP>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d))"
    r"|(?P<SSN>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<IBAN>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}\b)"
    r"|(?P<PHONE>(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|(?<!\d)\d{3})[ .-]?\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<CARD>(?<!\d)\d(?:[ -]?\d){12,18}(?!\d))"
)
ENTITY = re.compile(_MAIL + _OTHERS)
#: As ENTITY, for where no match has just ended: an address begins with its first character there, which spares looking
#: for it behind each character of a long word.
_BEYOND = re.compile(_MAIL.replace("[", r"(?<![\w.%+-])[", 1) + _OTHERS)


#: How secrets are named and keys begin, in lower case.
_SIGNS = ("key", "secret", "token", "passw", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxb-", "xoxp-", "\u017f")


def hinted(text: Column) -> Column:
    """Whether text has what one of ENTITY's alternatives needs; texts without it are passed by.

    An address has @; a network address and the numbers have a digit, of whatever script (some are newer than Java's tables);
    a secret is named, begins as keys do (a long s folds to s), or has digits or 32 hexadecimal letters.
    """
    low = F.lower(text)
    found = text.rlike(r"[@\p{Nd}\x{16ac0}-\x{16ac9}\x{11f50}-\x{11f59}\x{1e4f0}-\x{1e4f9}]")
    for sign in _SIGNS:
        found = found | low.contains(sign)
    return F.coalesce(found | text.rlike("[a-fA-F]{32}"), F.lit(False))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, 44 bits of the hash of each in lower case, and the line of each, counted over all the texts."""
    w = Words(_LOWER[data], off, NON_ALNUM)
    edges = np.unique(np.concatenate([np.flatnonzero(data == 10), off[1:] - 1]))
    return w, w.hash >> np.uint64(20), np.searchsorted(edges, w.start)


def _checks(number: str) -> bool:
    """Whether a card number's last digit is the check digit of the others (Luhn)."""
    d = [int(c) for c in reversed(number) if c.isdecimal()]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def entities(text: str) -> list[tuple[int, int, str, int]]:
    """(start byte, end byte, kind, hash) of each protected entity."""
    out = []
    ascii_only, at, counted, size = text.isascii(), 0, 0, 0
    while m := ENTITY.match(text, at) or _BEYOND.search(text, at):
        if m.lastgroup == "CARD" and not _checks(m.group()):
            at = m.start() + 1
            continue
        a, b = m.span()
        at = b
        if not ascii_only:
            size += len(text[counted:a].encode())
            counted, a, b = a, size, size + len(m.group().encode())
        own = np.frombuffer(re.sub(r"[\s()\"'.-]", "", m.group().lower()).encode() or b"-", np.uint8)
        h = int(mix(Words(own, np.array([0, len(own)]), np.zeros(256, bool)).hash)[0].astype(np.int64))
        out.append((a, b, m.lastgroup, h))
    return out


def general(term: bytes) -> bytes:
    """What stands for a term that is generalised: its kind, by its form."""
    digits = sum(48 <= c <= 57 for c in term)
    return b"<NUMBER>" if digits == len(term) else b"<CODE>" if digits else b"<NAME>" if term[:1].isupper() else b"<TERM>"


def _marked(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, list, Words, np.ndarray, np.ndarray]]:
    """(text, entities, words, term hashes, line of each word within the text) of each text that has entities."""
    for i in range(len(off) - 1):
        own = data[off[i] : off[i + 1]]
        found = entities(own.tobytes().decode("utf-8", "replace"))
        if found:
            w, term, line = _words(own, np.array([0, len(own)]))
            yield i, found, w, term, line


def _term_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many lines each term occurs; -1 stands for all lines."""
    hs, ns, size, lines = [], [], 0, 0

    def flush() -> pa.RecordBatch:
        h, n = np.concatenate([*hs, np.empty(0, np.uint64)]), np.concatenate([*ns, np.empty(0, np.int64)])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.empty(0, np.int64)
        total = np.add.reduceat(n, first) if len(h) else n
        hs.clear(), ns.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.append(h[first].astype(np.int64), -1)), pa.array(np.append(total, lines))], ["term", "n"])

    for b in batches:
        for _, _, data, off in slices(b.column(0)):
            w, term, line = _words(data, off)
            for part in np.split(np.arange(len(line)), np.searchsorted(line, np.arange(1 << 20, int(line[-1]) + 1, 1 << 20))) if len(line) else ():
                # 2^20 lines at a time, whose numbers fit beside the term's 44 bits
                key = np.sort((line[part] & ((1 << 20) - 1)).astype(np.uint64) << np.uint64(44) | term[part])
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                h, n = np.unique(key[new] & np.uint64((1 << 44) - 1), return_counts=True)
                hs.append(h)
                ns.append(n)
                size += len(h)
            lines += int(np.count_nonzero(data == 10)) + len(off) - 1
            if size > 1 << 22:
                yield flush()
                size, lines = 0, 0
    yield flush()


def sanitise(docs: DataFrame, generalise: float = 0.75, remove: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the sanitised text, n_entities and n_terms (how many entities and terms were replaced or removed), a row a row.

    Protected entities (mail and network addresses, phone, card and account numbers, secrets) are replaced by their kind;
    a number without a card's check digit is none.
    A term (a word without regard to ASCII case) reveals an entity as far as its pointwise mutual information with it,
    counted over the lines of all documents, makes up the entity's information, log2(lines / lines with the entity). Where
    that share is generalise or more, the term gives way to its kind (<NUMBER>, <CODE>, <NAME> if it begins with a capital,
    else <TERM>) in the lines with the entity; where it is remove or more, it
    is taken out of them. Only terms that occur with the entity in two different lines are judged: one line tells nothing
    of a term's company.

    Null stays null and empty stays empty, with counts 0, as do texts without entities stay as they are. Null ids are
    carried along. Each row gets its own result; repeated rows count in the statistics as often as they occur, and rows
    that share an id and differ in text are told apart. Where two entities in a line disagree on a term, removal wins. An
    empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = src.schema["id"].dataType.simpleString()
    some = src.where(hinted(F.col("t"))).withColumn("th", F.xxhash64("t"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cols = [], [[], [], [], []]
            for lo, _, data, off in slices(b.column(1)):
                for i, found, w, term, line in _marked(data, off):
                    own = data[off[i] : off[i + 1]]
                    edges = np.flatnonzero(own == 10)
                    taken = np.zeros(len(own) + 1, bool)
                    for a, z, _, _ in found:
                        taken[a:z] = True
                    free = ~taken[w.start]
                    whole = np.concatenate([[-1], edges, [len(own)]])
                    for at, e in {(int(np.searchsorted(edges, a)), h) for a, _, _, h in found}:
                        own_line = slice(*np.searchsorted(line, (at, at + 1)))
                        terms = np.unique(term[own_line][free[own_line]]).astype(np.int64)
                        text = own[whole[at] + 1 : whole[at + 1]]
                        context = int(Words(text, np.array([0, len(text)]), np.zeros(256, bool)).hash[0].astype(np.int64))
                        n = len(terms) + 1
                        rows += [lo + i] * n
                        for c, v in zip(cols, (np.full(n, at), np.full(n, e), np.append(terms, -1), np.full(n, context))):
                            c.append(v)
            arrays = [pa.array(np.concatenate([*c, np.empty(0, np.int64)]).astype(np.int64)) for c in cols]
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), *arrays], ["id", "th", "line", "entity", "term", "context"])

    seen = cut(some.mapInArrow(contexts, f"id {kind}, th bigint, line bigint, entity bigint, term bigint, context bigint"))
    pairs = seen.groupBy("entity", "term").agg(F.count("*").alias("nte"), (F.min("context") != F.max("context")).alias("support"))
    terms = src.where("t is not null").select("t").mapInArrow(_term_lines, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("nt"))
    lines = terms.where("term = -1").select(F.col("nt").alias("lines"))
    ne = pairs.where("term = -1").select("entity", F.col("nte").alias("ne"))
    share = 1 - F.log2(F.col("nt") / F.col("nte")) / F.log2(F.col("lines") / F.col("ne"))
    judged = pairs.where("support and term <> -1").join(ne, "entity").join(terms, "term").crossJoin(F.broadcast(lines)).where("lines > ne")
    judged = judged.select("entity", "term", (share >= remove).alias("gone"), share.alias("share")).where(F.col("share") >= generalise)
    lists = seen.join(judged, ["entity", "term"]).groupBy("id", "th", "line", "term").agg(F.max("gone").alias("gone"))
    lists = lists.groupBy(F.col("id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_list(F.struct("line", "term", "gone")).alias("c"))
    both = some.join(lists, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("th") == F.col("r_th")), "left").select("id", "t", "c")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counted = b.column(1).to_pylist(), np.zeros((b.num_rows, 2), np.int64)
            lists = b.column(2)
            for lo, _, data, off in slices(b.column(1)):
                for i, found, w, term, line in _marked(data, off):
                    own = data[off[i] : off[i + 1]].tobytes()
                    edits = [(a, z, f"<{what}>".encode()) for a, z, what, _ in found]
                    if lists[lo + i].is_valid:
                        taken = np.zeros(len(own) + 1, bool)
                        for a, z, _ in edits:
                            taken[a:z] = True
                        act = {(x["line"], x["term"]): x["gone"] for x in lists[lo + i].as_py()}
                        where = {x[0] for x in act}
                        for k in np.flatnonzero(np.isin(line, list(where)) & ~taken[w.start]).tolist():
                            gone = act.get((int(line[k]), int(term[k])))
                            if gone is not None:
                                a, z = int(w.start[k]), int(w.end[k])
                                edits.append((a - (gone and own[a - 1 : a] == b" "), z, b"" if gone else general(own[a:z])))
                                counted[lo + i, 1] += 1
                    counted[lo + i, 0] = len(found)
                    out, at = [], 0
                    for a, z, new in sorted(edits):
                        out += [own[at:a], new]
                        at = z
                    texts[lo + i] = b"".join([*out, own[at:]]).decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counted[:, 0]), pa.array(counted[:, 1])], ["id", "t", "n_entities", "n_terms"])

    done = both.mapInArrow(clean, f"id {kind}, t string, n_entities bigint, n_terms bigint")
    rest = src.where(~hinted(F.col("t"))).select("id", "t", F.lit(0).cast("bigint").alias("n_entities"), F.lit(0).cast("bigint").alias("n_terms"))
    return rest.union(done).select(F.col("id").alias(id_col), F.col("t").alias(text_col), "n_entities", "n_terms")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
