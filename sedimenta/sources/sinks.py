"""Results as YAML, JSON, sparse rows, protocol-like arrays and vectors for a projector; and readers of what is written."""

from __future__ import annotations

import re
from json import dumps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranges import carried, ranged
from . import wire


def csr(cells: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """(row, indices, data, indptr) of each row: columns in order, their values, and how many values end with this row.

    The counts are summed up over ranges of rows, so that no task gets all of them.
    """

    packed = cells.groupBy(row).agg(F.sort_array(F.collect_list(F.struct(F.col(col).alias("c"), F.col(value).alias("v")))).alias("x"))
    rows = packed.select(F.col(row).alias("row"), F.transform("x", lambda s: s["c"]).alias("indices"), F.transform("x", lambda s: s["v"]).alias("data"), F.size("x").cast("bigint").alias("_n"))
    held = carried(ranged(rows, F.col("row")), F.sum("_n"), F.sum)
    own = F.sum("_n").over(Window.partitionBy("_part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("indptr", own + F.coalesce("_before", F.lit(0))).drop("_part", "_n", "_before")


def coo(rows: DataFrame) -> DataFrame:
    """(row, col, value) back from csr."""
    return rows.select("row", F.explode(F.arrays_zip("indices", "data")).alias("x")).select("row", F.col("x.indices").alias("col"), F.col("x.data").alias("value"))


def truncated_rows(cells: DataFrame) -> DataFrame:
    """(sample, columns) from (sample, band, lines): negatives read 0, zeros at the end are left out."""
    full = cells.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("band", F.greatest(F.lit(0), "lines").cast("bigint")))).alias("m"))
    last = F.array_max(F.map_keys(F.map_filter("m", lambda k, v: v > 0)))
    zero = F.lit(0).cast("bigint")
    columns = F.when(last.isNull(), F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(zero, F.coalesce(last, zero)), lambda k: F.coalesce(F.try_element_at("m", k), zero)))
    return full.select("sample", columns.alias("columns"))


def json(df: DataFrame, path: str, kind: str) -> None:
    """df as JSON lines that carry their type, written by the executors."""
    df.withColumn("type", F.lit(kind)).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of that type, as json() wrote them."""
    return spark.read.json(path).where(F.col("type") == kind).drop("type")


def projector(vectors: DataFrame, meta: DataFrame, path: str) -> None:
    """vectors (id, vector) and meta (id, others) as tab-separated values, both in order of id, and the projector's settings."""
    first = vectors.select(F.size("vector")).first()
    shape = [vectors.count(), first[0] if first else 0]
    settings = {"embeddings": [{"tensorName": "co-occurrence", "tensorShape": shape, "tensorPath": "vectors", "metadataPath": "meta"}]}
    vectors.sparkSession.createDataFrame([(dumps(settings),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
    vectors.orderBy("id").select(F.array_join(F.transform("vector", lambda x: x.cast("string")), "\t").alias("v")).write.mode("overwrite").text(f"{path}/vectors")
    meta.orderBy("id").write.mode("overwrite").option("sep", "\t").option("header", True).csv(f"{path}/meta")


def yaml(sections: dict[str, DataFrame], header: dict[str, object]) -> str:
    """A report in YAML: the header, then a list of rows for each section. For reports that fit a driver."""

    def cell(v: object) -> str:
        if v is None:
            return "-1"
        if isinstance(v, str):
            return '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(cell, v)) + "]"
        return str(v).lower() if isinstance(v, bool) else str(v)

    out = ["header:"] + [f"  {k}: {cell(v)}" for k, v in header.items()]
    for name, df in sections.items():
        out.append(f"{name}:")
        out += ["  - {" + ", ".join(f"{k}: {cell(v)}" for k, v in r.asDict(recursive=False).items()) + "}" for r in df.orderBy(*[c for c, t in df.dtypes if not t.startswith("map")]).toLocalIterator()]
    return "\n".join(out) + "\n"


def read_yaml(text: str) -> tuple[dict[str, object], dict[str, list[dict[str, object]]]]:
    """The header and the rows of each section of a report that yaml() made; -1 stays a number, as null was written so."""

    def cells(raw: str) -> list[str]:
        out, depth, quoted, begin, at = [], 0, False, 0, 0
        while at < len(raw):
            c = raw[at]
            if quoted:
                at += c == "\\"
                quoted = c != '"'
            elif c == '"':
                quoted = True
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
            elif raw.startswith(", ", at) and not depth:
                out.append(raw[begin:at])
                begin = at + 2
            at += 1
        return [*out, raw[begin:]] if raw else []

    def value(raw: str) -> object:
        if raw.startswith("["):
            return [value(x) for x in cells(raw[1:-1])]
        if raw.startswith('"'):
            return re.sub(r"\\(.)", r"\1", raw[1:-1], flags=re.S)
        if raw in ("true", "false"):
            return raw == "true"
        for kind in (int, float):
            try:
                return kind(raw)
            except ValueError:
                pass
        return raw

    header: dict[str, object] = {}
    sections: dict[str, list[dict[str, object]]] = {}
    own = None
    for line in text.split("\n"):
        if line.startswith("  - {"):
            sections[own].append({k: value(v) for k, _, v in (x.partition(": ") for x in cells(line[5:-1]))})
        elif line.startswith("  "):
            k, _, v = line[2:].partition(": ")
            header[k] = value(v)
        elif line.endswith(":") and line != "header:":
            own = line[:-1]
            sections[own] = []
    return header, sections


def protobuf(contents: dict[str, dict], header: dict[str, object]) -> bytes:
    """A report in the protocol-buffer format: header and, by name, results as wire.MESSAGES describes them. For reports that
    fit a driver."""
    return wire.encode("Results", {"header": header, "contents": {k: wire.encode(k, v) for k, v in contents.items()}})


def read_protobuf(raw: bytes) -> tuple[dict[str, object], dict[str, dict]]:
    """header and contents of what protobuf() made; contents of other kinds stay bytes."""
    found = wire.decode("Results", raw)
    if not found["header"]:
        raise ValueError("the message has no header")
    return found["header"], {k: wire.decode(k, v) if k in wire.MESSAGES else v for k, v in found["contents"].items()}


def couples_message(pairs: DataFrame, people: DataFrame, sizes: DataFrame) -> dict:
    """wire's Couples from (file1, file2, n), (author1, author2, n) and (path, lines), indexed in order of name."""

    def sparse(df: DataFrame, a: str, b: str) -> dict:
        rows = {(str(r[a]), str(r[b])): int(r["n"]) for r in df.toLocalIterator()}
        index = sorted({x for pair in rows for x in pair})
        place = {x: k for k, x in enumerate(index)}
        cells = sorted((place[x], place[y], n) for (x, y), n in rows.items())
        ends = [0] * (len(index) + 1)
        for x, _, _ in cells:
            ends[x + 1] += 1
        for k in range(len(index)):
            ends[k + 1] += ends[k]
        return {"index": index, "matrix": {"rows_count": len(index), "columns_count": len(index), "data": [n for *_, n in cells], "indices": [y for _, y, _ in cells], "indptr": ends}}

    files = sparse(pairs, "file1", "file2")
    lines = {str(r["path"]): int(r["lines"]) for r in sizes.toLocalIterator()}
    return {"files": files, "people": sparse(people, "author1", "author2"), "files_lines": [lines.get(x, 0) for x in files["index"]]}


def devs_message(devs: DataFrame, languages: DataFrame, tick_size: int = 86400) -> dict:
    """wire's Devs from (tick, author, commits, added, removed, changed) and (tick, author, lang, added, removed, changed)."""
    ticks: dict[int, dict] = {}
    names: dict[str, int] = {}

    def entry(r) -> dict:
        who = names.setdefault(str(r["author"]), len(names))
        return ticks.setdefault(int(r["tick"]), {"devs": {}})["devs"].setdefault(who, {"commits": 0, "languages": {}})

    def lines(r) -> dict:
        return {c: int(r[c]) for c in ("added", "removed", "changed")}

    for r in devs.orderBy("author", "tick").toLocalIterator():
        entry(r).update(commits=int(r["commits"]), stats=lines(r))
    for r in languages.orderBy("author", "tick", "lang").toLocalIterator():
        entry(r)["languages"][r["lang"]] = lines(r)
    return {"ticks": ticks, "people": list(names), "tick_size": tick_size}


def read_commit_list(spark: SparkSession, path: str) -> DataFrame:
    """(at, commit) of a file with one commit a line, root first."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "commit"))
    return lines.select(F.col("at").cast("bigint"), F.trim("commit").alias("commit")).where("commit <> ''")
