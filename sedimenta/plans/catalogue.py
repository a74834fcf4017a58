"""Every query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..operators import burndown, combine, couples, effort, graphs, identity, lines, nodes, renames, series, ticks
from ..operators.ranges import parts
from ..sources import sinks, tables
from ..streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

LOG = """WITH commits AS (SELECT o_orderkey AS commit, o_custkey AS author, o_orderdate AS ts,
    date_diff('day', (SELECT min(o_orderdate) FROM orders)::DATE, o_orderdate::DATE)::BIGINT AS tick FROM orders),
files AS (SELECT l_orderkey AS commit, l_partkey AS path, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)::BIGINT AS added,
    sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::BIGINT AS changed,
    CASE WHEN bool_or(l_returnflag = 'A') THEN 'I' WHEN bool_or(l_returnflag = 'N') THEN 'M' ELSE 'D' END AS action FROM lineitem GROUP BY ALL),
log AS (SELECT files.*, author, ts, tick, p_type AS lang, p_brand AS import, p_name AS name FROM files JOIN commits USING (commit) JOIN part ON p_partkey = path)
"""
LIVES = """WITH start AS (SELECT min(o_orderdate)::DATE AS d FROM orders),
lives AS (SELECT l_partkey AS path, o_custkey AS author, l_suppkey AS remover, l_quantity::BIGINT AS lines,
    date_diff('day', d, least(o_orderdate::DATE, l_shipdate::DATE))::BIGINT AS birth, date_diff('day', d, greatest(o_orderdate::DATE, l_shipdate::DATE))::BIGINT AS death
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey, start),
horizon AS (SELECT date_diff('day', (SELECT d FROM start), max(o_orderdate)::DATE)::BIGINT AS h FROM orders),
deltas AS (SELECT path, author, author AS actor, birth AS cur, birth AS prev, lines AS delta FROM lives
    UNION ALL SELECT path, author, remover, death, birth, -lines FROM lives)
"""
SUMS = "sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed, sum(changed)::BIGINT AS changed"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


# --- effort -----------------------------------------------------------------------------------------------------------


@query("devs_by_tick", LOG + f"SELECT tick, author, count(DISTINCT commit) AS commits, {SUMS} FROM log GROUP BY tick, author")
def devs_by_tick(spark, d):
    return effort.devs(tables.log(spark, d))


@query("devs_with_empty_commits", LOG + f"SELECT c.tick, c.author, count(DISTINCT c.commit) AS commits, {', '.join(f'coalesce(sum({x}), 0)::BIGINT AS {x}' for x in effort.STATS)} FROM commits c LEFT JOIN log USING (commit) GROUP BY c.tick, c.author")
def devs_with_empty_commits(spark, d):
    return effort.devs(tables.log(spark, d), tables.commits(spark, d))


@query("devs_languages", LOG + f"SELECT tick, author, lang, {SUMS} FROM log GROUP BY tick, author, lang")
def devs_languages(spark, d):
    return effort.by_language(tables.log(spark, d))


@query("devs_totals_topk", LOG + "SELECT author, count(DISTINCT commit) AS commits, sum(added + removed + changed)::BIGINT AS lines FROM log GROUP BY author ORDER BY commits DESC, author LIMIT 20")
def devs_totals_topk(spark, d):
    return effort.top(effort.totals(tables.log(spark, d)), "commits", 20, "author")


@query("devs_efforts_cum", LOG + """, daily AS (SELECT author, tick, sum(added + removed + changed)::BIGINT AS effort FROM log GROUP BY ALL),
best AS (SELECT author FROM daily GROUP BY author ORDER BY sum(effort) DESC, author LIMIT 20),
per AS (SELECT coalesce(best.author::VARCHAR, 'others') AS who, tick, sum(effort)::BIGINT AS effort FROM daily LEFT JOIN best USING (author) GROUP BY ALL)
SELECT who, tick, effort, (sum(effort) OVER (PARTITION BY who ORDER BY tick))::BIGINT AS total FROM per""")
def devs_efforts_cum(spark, d):
    return effort.cumulative_efforts(tables.log(spark, d))


@query("devs_efforts_smooth", LOG + """, daily AS (SELECT lang, tick, sum(added + removed + changed)::BIGINT AS effort FROM log GROUP BY ALL)
SELECT lang, tick, effort, round(avg(effort) OVER (PARTITION BY lang ORDER BY tick ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING), 6) AS smooth FROM daily""")
def devs_efforts_smooth(spark, d):
    daily = tables.log(spark, d).groupBy("lang", "tick").agg(F.sum(effort.effort()).cast("bigint").alias("effort"))
    return effort.moving_average(daily, "lang", "tick", "effort", 16).withColumn("smooth", F.round("smooth", 6))


@query("old_vs_new", LOG + "SELECT tick, sum(added)::BIGINT AS new_lines, sum(removed + changed)::BIGINT AS old_lines FROM log GROUP BY tick")
def old_vs_new(spark, d):
    return effort.old_vs_new(tables.log(spark, d))


@query("languages_by_dev", LOG + """, per AS (SELECT author, lang, sum(added + removed + changed)::BIGINT AS lines FROM log WHERE lang <> '' GROUP BY ALL)
SELECT author, lang, lines, row_number() OVER (PARTITION BY author ORDER BY lines DESC, lang) AS rank FROM per""")
def languages_by_dev(spark, d):
    return effort.languages(tables.log(spark, d))


@query("commits_stat", LOG + "SELECT commit, tick, author, count(*) AS n_files, string_agg(path || ':' || lang || ':' || added || ':' || removed || ':' || changed, ',' ORDER BY path) AS files FROM log GROUP BY ALL")
def commits_stat(spark, d):
    stat = effort.commits_stat(tables.log(spark, d))
    each = F.transform("files", lambda x: F.concat_ws(":", *[x[c].cast("string") for c in ("path", "lang", *effort.STATS)]))
    return stat.select("commit", "tick", "author", F.size("files").cast("bigint").alias("n_files"), F.array_join(each, ",").alias("files"))


@query("file_history_people", LOG + f"SELECT path, author, {SUMS} FROM log GROUP BY path, author")
def file_history_people(spark, d):
    return effort.file_people(tables.log(spark, d))


@query("file_history_commits", LOG + """, seen AS (SELECT path, commit, ts, action, max(CASE WHEN action = 'I' THEN (ts, commit) END) OVER (PARTITION BY path) AS begin,
    row_number() OVER (PARTITION BY path ORDER BY ts DESC, commit DESC) AS back FROM log)
SELECT path, string_agg(commit::VARCHAR, ',' ORDER BY ts, commit) FILTER (begin IS NULL OR (ts, commit) >= begin) AS commits FROM seen GROUP BY path HAVING bool_or(back = 1 AND action <> 'D')""")
def file_history_commits(spark, d):
    return effort.file_commits(tables.log(spark, d)).select("path", _joined("commits").alias("commits"))


@query("live_file_people", LOG + f""", last AS (SELECT path, arg_max(action, (ts, commit)) AS action FROM log GROUP BY path)
SELECT path, author, {SUMS} FROM log WHERE path IN (SELECT path FROM last WHERE action <> 'D') GROUP BY path, author""")
def live_file_people(spark, d):
    log = tables.log(spark, d)
    return effort.file_people(log.join(effort.live(log), "path", "left_semi"))


@query("commits_by_tick", LOG + "SELECT tick, string_agg(commit::VARCHAR, ',' ORDER BY commit) AS commits FROM commits GROUP BY tick")
def commits_by_tick(spark, d):
    return ticks.commits_by_tick(tables.commits(spark, d)).select("tick", _joined("commits").alias("commits"))


@query("imports_per_dev", LOG + "SELECT author, lang, import, tick, count(*) AS n FROM log GROUP BY ALL")
def imports_per_dev(spark, d):
    return effort.imports(tables.log(spark, d))


@query("churn_by_tick", LOG + "SELECT tick, sum(added + changed)::BIGINT AS added, sum(removed + changed)::BIGINT AS removed FROM log GROUP BY tick")
def churn_by_tick(spark, d):
    return effort.churn(tables.log(spark, d))


@query("churn_by_dev", LOG + "SELECT tick, author, sum(added + changed)::BIGINT AS added, sum(removed + changed)::BIGINT AS removed FROM log GROUP BY tick, author")
def churn_by_dev(spark, d):
    return effort.churn(tables.log(spark, d), True)


@query("rollup_tick_dev_lang", LOG + f"SELECT tick, author, lang, {SUMS}, grouping(tick, author, lang)::BIGINT AS level FROM log GROUP BY ROLLUP (tick, author, lang)")
def rollup_tick_dev_lang(spark, d):
    return effort.rollup(tables.log(spark, d), "tick", "author", "lang")


@query("rollup_project_file", LOG + f"SELECT lang, path, {SUMS}, grouping(lang, path)::BIGINT AS level FROM log GROUP BY ROLLUP (lang, path)")
def rollup_project_file(spark, d):
    return effort.rollup(tables.log(spark, d), "lang", "path")


@query("parallel_ranks", LOG + """, per AS (SELECT author, count(DISTINCT commit) AS commits, sum(added + removed + changed)::BIGINT AS lines FROM log GROUP BY author)
SELECT author, commits, lines, row_number() OVER (ORDER BY commits DESC, author DESC) AS commits_rank, row_number() OVER (ORDER BY lines DESC, author DESC) AS lines_rank FROM per""")
def parallel_ranks(spark, d):
    per = effort.totals(tables.log(spark, d))
    return effort.global_rank(effort.global_rank(per, "commits", "author", "commits_rank"), "lines", "author", "lines_rank")


# --- co-occurrence ----------------------------------------------------------------------------------------------------

_PAIRS = "SELECT a.path AS file1, b.path AS file2, count(*) AS n FROM log a JOIN log b USING (commit) GROUP BY ALL"


@query("couples_files", LOG + _PAIRS)
def couples_files(spark, d):
    return couples.files(tables.log(spark, d))


@query("couples_context_cap", LOG + ", small AS (SELECT commit FROM log GROUP BY commit HAVING count(*) <= 4) SELECT a.path AS file1, b.path AS file2, count(*) AS n FROM log a JOIN log b USING (commit) WHERE commit IN (FROM small) GROUP BY ALL")
def couples_context_cap(spark, d):
    return couples.files(tables.log(spark, d), max_files=4)


@query("couples_people", LOG + ", pf AS (SELECT author, path, count(*) AS n FROM log GROUP BY ALL) SELECT a.author AS author1, b.author AS author2, sum(least(a.n, b.n))::BIGINT AS n FROM pf a JOIN pf b USING (path) GROUP BY ALL")
def couples_people(spark, d):
    return couples.people(tables.log(spark, d))


@query("people_files", LOG + "SELECT author, string_agg(path::VARCHAR, ',' ORDER BY path) AS paths, count(*) AS n FROM (SELECT DISTINCT author, path FROM log) GROUP BY author")
def people_files(spark, d):
    return couples.author_files(tables.log(spark, d)).select("author", _joined("paths").alias("paths"), F.size("paths").cast("bigint").alias("n"))


@query("couples_clip_p99", LOG + f", p AS ({_PAIRS}) SELECT file1, file2, least(n::DOUBLE, (SELECT quantile_cont(n::DOUBLE, 0.99) FROM p)) AS n FROM p")
def couples_clip_p99(spark, d):
    return couples.clipped(couples.files(tables.log(spark, d)))


@query("couples_topk", LOG + """, best AS (SELECT path FROM log GROUP BY path ORDER BY count(*) DESC, path LIMIT 100)
SELECT a.path AS file1, b.path AS file2, count(*) AS n FROM log a JOIN log b USING (commit) WHERE a.path IN (FROM best) AND b.path IN (FROM best) GROUP BY ALL""")
def couples_topk(spark, d):
    log = tables.log(spark, d)
    best = effort.top(log.groupBy("path").agg(F.count("*").alias("n")), "n", 100, "path").select("path")
    return couples.files(log.join(F.broadcast(best), "path", "left_semi"))  # 100 rows


# --- burndown ---------------------------------------------------------------------------------------------------------


def _horizon(spark: SparkSession, d: str) -> Column:
    return F.lit(tables.commits(spark, d).agg(F.max("tick")).first()[0])


def _cells(keys: str, granularity: int, sampling: int) -> str:
    k = f"{keys}, " if keys else ""
    on = f"AND d.{keys} = b.{keys}" if keys else ""
    return f"""per AS (SELECT {k}cur // {sampling} AS s, prev // {granularity} AS band, sum(delta) AS delta FROM deltas GROUP BY ALL),
bands AS (SELECT DISTINCT {k}band FROM per),
cells AS (SELECT {'b.' + k if k else ''}sample, b.band, sum(delta)::BIGINT AS lines FROM bands b, (SELECT unnest(range(0, (SELECT max(s) + 1 FROM per))) AS sample) t
    JOIN per d ON d.band = b.band {on} AND d.s <= sample GROUP BY ALL)"""


@query("burndown_project", LIVES + "," + _cells("", 30, 30) + ", size AS (SELECT max(sample) AS s, max(band) AS b FROM cells WHERE lines <> 0) SELECT g.sample, g.band, coalesce(lines, 0)::BIGINT AS lines FROM (SELECT s.sample, b.band FROM (SELECT unnest(range(0, s + 1)) AS sample FROM size) s, (SELECT unnest(range(0, b + 1)) AS band FROM size) b) g LEFT JOIN cells c ON c.sample = g.sample AND c.band = g.band")
def burndown_project(spark, d):
    return burndown.dense(burndown.sampled(burndown.deltas(tables.lives(spark, d)), 30, 30))


@query("burndown_files", LIVES + "," + _cells("path", 180, 180) + " SELECT * FROM cells WHERE lines <> 0")
def burndown_files(spark, d):
    return burndown.sampled(burndown.deltas(tables.lives(spark, d)), 180, 180, ("path",))


@query("burndown_people", LIVES + "," + _cells("author", 180, 180) + " SELECT * FROM cells WHERE lines <> 0")
def burndown_people(spark, d):
    return burndown.sampled(burndown.deltas(tables.lives(spark, d)), 180, 180, ("author",))


_MATRIX = """matrix AS (SELECT author, CASE WHEN delta > 0 AND author = actor THEN 'self' WHEN actor IS NULL THEN 'unknown' ELSE 'by' END AS kind,
    CASE WHEN NOT (delta > 0 AND author = actor) THEN actor END AS other, sum(delta)::BIGINT AS lines FROM deltas WHERE author IS NOT NULL GROUP BY ALL)"""


@query("overwrites_matrix", LIVES + "," + _MATRIX + " FROM matrix")
def overwrites_matrix(spark, d):
    return burndown.overwrites(burndown.deltas(tables.lives(spark, d)), 2 * tables.partitions(spark, d))  # two changes a line


@query("overwrites_topk_norm", LIVES + "," + _MATRIX + """, best AS (SELECT author FROM matrix WHERE kind = 'self' ORDER BY lines DESC, author LIMIT 20), own AS (SELECT author, lines AS own FROM matrix WHERE kind = 'self')
SELECT author, other, CASE WHEN coalesce(own, 0) = 0 THEN 0 ELSE round(-lines / own, 9) END AS share FROM matrix LEFT JOIN own USING (author) WHERE kind <> 'self' AND author IN (FROM best)""")
def overwrites_topk_norm(spark, d):
    return burndown.normalised(burndown.overwrites_of_best(burndown.deltas(tables.lives(spark, d)), 20)[0]).withColumn("share", F.round("share", 9))


@query("ownership_files", LIVES + "SELECT path, coalesce(author, -1) AS author, sum(lines)::BIGINT AS lines FROM lives, horizon WHERE birth <= h AND death > h GROUP BY ALL")
def ownership_files(spark, d):
    return burndown.ownership(tables.lives(spark, d), _horizon(spark, d))


@query("ownership_people_topk", LIVES + "," + _cells("author", 180, 180) + """, best AS (SELECT author FROM cells GROUP BY author ORDER BY sum(lines) DESC, author LIMIT 20)
SELECT coalesce(best.author::VARCHAR, 'others') AS who, sample, sum(lines)::BIGINT AS lines FROM cells LEFT JOIN best USING (author) WHERE lines <> 0 GROUP BY ALL""")
def ownership_people_topk(spark, d):
    cells = burndown.sampled(burndown.deltas(tables.lives(spark, d)), 180, 180, ("author",))
    return effort.top_with_others(cells, "author", "lines", 20).groupBy("who", "sample").agg(F.sum("lines").alias("lines"))


@query("first_appearance", LIVES + "," + _cells("author", 180, 180) + " SELECT author, min(sample) AS sample FROM cells WHERE lines > 0 GROUP BY author")
def first_appearance(spark, d):
    return burndown.first_appearance(burndown.sampled(burndown.deltas(tables.lives(spark, d)), 180, 180, ("author",)), "author")


@query("survival_kaplan_meier", LIVES + """, per AS (SELECT least(death, h) - birth AS age, sum(CASE WHEN death <= h THEN lines ELSE 0 END)::BIGINT AS deaths, sum(lines)::BIGINT AS ended FROM lives, horizon WHERE birth <= h GROUP BY ALL),
risk AS (SELECT age, deaths, (sum(ended) OVER (ORDER BY age ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS at_risk FROM per)
SELECT age, at_risk, deaths, round(exp(sum(CASE WHEN deaths = at_risk THEN '-infinity'::DOUBLE ELSE ln(1 - deaths / at_risk) END) OVER (ORDER BY age)), 6) AS survival FROM risk""")
def survival_kaplan_meier(spark, d):
    return burndown.survival(tables.lives(spark, d), _horizon(spark, d)).withColumn("survival", F.round("survival", 6))


# --- time -------------------------------------------------------------------------------------------------------------


@query("ticks_clamped", """WITH first AS (SELECT epoch(arg_min(o_orderdate, o_orderkey))::BIGINT // 86400 * 86400 AS s FROM orders)
SELECT o_orderkey AS commit, max(greatest(0, (epoch(o_orderdate)::BIGINT - s) // 86400)) OVER (ORDER BY o_orderkey) AS tick FROM orders, first""")
def ticks_clamped(spark, d):
    orders = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), F.col("o_orderdate").alias("ts"))
    return ticks.clamped(orders, "ts", "commit").select("commit", "tick")


@query("is_merge_adjacency", "SELECT event_id, coalesce(lag(event_type) OVER w = event_type, false) OR coalesce(lead(event_type) OVER w = event_type, false) AS is_merge FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def is_merge_adjacency(spark, d):
    return ticks.is_merge(tables.table(spark, d, "events"), "user_id", "event_id", "event_type").select("event_id", "is_merge")


@query("floor_tick_hourly", "SELECT floor(epoch(ts))::BIGINT // 3600 * 3600 AS hour, count(*) AS n FROM events GROUP BY ALL")
def floor_tick_hourly(spark, d):
    return tables.table(spark, d, "events").groupBy(ticks.floor_time("ts", 3600).alias("hour")).agg(F.count("*").alias("n"))


@query("commits_once", "SELECT DISTINCT l_orderkey AS commit FROM lineitem")
def commits_once(spark, d):
    return ticks.once(tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit")))


# --- blobs and renames ------------------------------------------------------------------------------------------------


@query("line_counts", r"SELECT doc_id, (CASE WHEN instr(left(text, 8000), chr(0)) > 0 THEN NULL WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END)::BIGINT AS lines FROM documents")
def line_counts(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", text.line_count("text").alias("lines"))


@query("binary_sniff", "SELECT page_id, instr(left(html, 8000), chr(0)) > 0 AS is_binary FROM pages")
def binary_sniff(spark, d):
    return tables.table(spark, d, "pages").select("page_id", text.is_binary(F.col("html")).alias("is_binary"))


_PATH = r"regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query("blacklist_filter", f"SELECT page_id, {_PATH} AS path FROM pages WHERE NOT ({_PATH} LIKE 'en/1%' OR {_PATH} LIKE 'fr/%')")
def blacklist_filter(spark, d):
    pages = tables.table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return pages.where(~text.blacklisted("path", prefixes=("en/1", "fr/")))


@query("whitelist_filter", f"SELECT page_id, {_PATH} AS path FROM pages WHERE regexp_matches({_PATH}, '[0-9]+\\.html$')")
def whitelist_filter(spark, d):
    pages = tables.table(spark, d, "pages").select("page_id", F.expr(_PATH).alias("path"))
    return pages.where(text.whitelisted("path", pattern=r"[0-9]+\.html$"))


@query("language_filter", "SELECT doc_id, lower(lang) AS lang FROM documents WHERE lower(lang) IN ('fr', 'de')")
def language_filter(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.lower("lang").alias("lang")).where(F.col("lang").isin("fr", "de"))


@query("small_blob_filter", "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents WHERE strlen(text) BETWEEN 32 AND 1048576")
def small_blob_filter(spark, d):
    return tables.table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("bigint").alias("size")).where(F.col("size").between(32, 1 << 20))


_EXACT = """, d AS (SELECT commit, removed AS blob, path AS from_path, row_number() OVER (PARTITION BY commit, removed ORDER BY path) AS k FROM log WHERE action = 'D'),
i AS (SELECT commit, added AS blob, path AS to_path, row_number() OVER (PARTITION BY commit, added ORDER BY path) AS k FROM log WHERE action = 'I'),
pairs AS (SELECT coalesce(d.commit, i.commit) AS commit, coalesce(d.blob, i.blob) AS blob, from_path, to_path FROM d FULL JOIN i ON d.commit = i.commit AND d.blob = i.blob AND d.k = i.k)
"""


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Deleted and inserted items of orders; how many there are stands for their content."""
    log = tables.log(spark, d)
    return log.where("action <> 'M'").select("commit", "path", "name", "action", F.when(F.col("action") == "D", F.col("removed")).otherwise(F.col("added")).alias("blob"))


@query("exact_renames", LOG + _EXACT + "FROM pairs")
def exact_renames(spark, d):
    return renames.exact(_changes(spark, d))


_BAND = _EXACT + """, gone AS (SELECT commit, from_path, blob AS from_size, p_name AS from_name FROM pairs JOIN part ON p_partkey = from_path WHERE to_path IS NULL),
new AS (SELECT commit, to_path, blob AS to_size, p_name AS to_name FROM pairs JOIN part ON p_partkey = to_path WHERE from_path IS NULL),
near AS (SELECT * FROM gone JOIN new USING (commit) WHERE abs(from_size - to_size) * 10000 <= greatest(1, from_size, to_size) * 2000)
"""


def _near(spark: SparkSession, d: str) -> DataFrame:
    pairs, names = renames.exact(_changes(spark, d)), tables.table(spark, d, "part").select("p_partkey", "p_name")
    gone = pairs.where("to_path is null").join(names, F.col("from_path") == F.col("p_partkey")).select("commit", "from_path", F.col("blob").alias("from_size"), F.col("p_name").alias("from_name"))
    new = pairs.where("from_path is null").join(names, F.col("to_path") == F.col("p_partkey")).select("commit", "to_path", F.col("blob").alias("to_size"), F.col("p_name").alias("to_name"))
    return renames.size_band(gone, new)


@query("size_band_pairs", LOG + _BAND + "SELECT commit, from_path, to_path, from_size, to_size FROM near")
def size_band_pairs(spark, d):
    return _near(spark, d).select("commit", "from_path", "to_path", "from_size", "to_size")


@query("name_similarity_rank", LOG + _BAND + "SELECT commit, from_path, to_path, levenshtein(from_name, to_name) AS distance, row_number() OVER (PARTITION BY commit, from_path ORDER BY levenshtein(from_name, to_name), to_path) AS rank FROM near QUALIFY rank <= 50")
def name_similarity_rank(spark, d):
    return renames.by_name(_near(spark, d), "from_name", "to_name").select("commit", "from_path", "to_path", "distance", "rank")


@query("rename_left_anti", LOG + _EXACT + ", found AS (SELECT * FROM pairs WHERE from_path IS NOT NULL AND to_path IS NOT NULL) SELECT commit, path, action FROM log l WHERE action <> 'M' AND NOT EXISTS (SELECT 1 FROM found f WHERE f.commit = l.commit AND ((action = 'D' AND path = from_path) OR (action = 'I' AND path = to_path)))")
def rename_left_anti(spark, d):
    changes = _changes(spark, d)
    return renames.leftover(changes, renames.exact(changes).where("from_path is not null and to_path is not null")).select("commit", "path", "action")


@query("tree_diff", """WITH a AS (SELECT o_custkey AS path, min(o_orderkey) AS blob FROM orders WHERE o_orderdate < '1998-01-01' GROUP BY 1), b AS (SELECT o_custkey AS path, min(o_orderkey) AS blob FROM orders WHERE o_orderdate >= '1996-01-01' GROUP BY 1)
SELECT coalesce(a.path, b.path) AS path, a.blob AS from_blob, b.blob AS to_blob, CASE WHEN a.blob IS NULL THEN 'I' WHEN b.blob IS NULL THEN 'D' ELSE 'M' END AS action FROM a FULL JOIN b ON a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob""")
def tree_diff(spark, d):
    orders = tables.table(spark, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    before, after = (orders.where(w).groupBy(F.col("o_custkey").alias("path")).agg(F.min("o_orderkey").alias("blob")) for w in ("day < '1998-01-01'", "day >= '1996-01-01'"))
    return renames.tree_diff(before, after)


@query("rename_greedy")
def rename_greedy(spark, d):
    """In each conversation, what users wrote was deleted and what the assistant wrote inserted."""
    turns = tables.table(spark, d, "conversations").where("role in ('user', 'assistant')")
    action = F.when(F.col("role") == "user", "D").otherwise("I")
    return renames.detect(turns.select(F.col("conv_id").alias("commit"), F.concat_ws("/", "role", F.col("turn").cast("string")).alias("path"), action.alias("action"), "text"), percent=40)


# --- text -------------------------------------------------------------------------------------------------------------

_LINES = "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT AS line, trim(unnest(string_split(text, chr(10))), ' ') AS t FROM documents)"


def _comments(spark: SparkSession, d: str) -> DataFrame:
    found = tables.table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return found.select("doc_id", (F.col("line") + 1).cast("bigint").alias("line"), F.trim("t").alias("t"))


@query("comment_clean", _LINES + r""", c AS (SELECT doc_id, line, t, trim(regexp_replace(regexp_replace(regexp_replace(t, '\s*[a-zA-Z_][a-zA-Z_0-9]*\(\)', ' ', 'g'), '[^\p{L}\p{N}.,:;!?\-''\s]', '', 'g'), '\s+', ' ', 'g'), ' ') AS one FROM l)
SELECT doc_id, line, one AS comment FROM c WHERE regexp_matches(t, '^[\p{L}\p{N}]') AND length(one) >= 20 AND length(regexp_replace(one, '[^\p{L}]', '', 'g')) * 10 >= length(one) * 6 AND NOT regexp_matches(lower(one), 'license|copyright|©')""")
def comment_clean(spark, d):
    return _comments(spark, d).select("doc_id", "line", text.clean_comment("t").alias("comment")).where("comment is not null")


@query("license_filter", _LINES + " SELECT doc_id, line FROM l WHERE regexp_matches(lower(t), 'license|copyright|©')")
def license_filter(spark, d):
    return _comments(spark, d).where(text.is_license("t")).select("doc_id", "line")


_GOOD, _BAD = ("the", "la", "le", "die", "und"), ("of", "de", "nicht", "not", "no")


@query("sentiment_by_tick", rf"""WITH w AS (SELECT turn AS tick, regexp_split_to_array(lower(text), '[^\p{{L}}]+') AS w FROM conversations),
c AS (SELECT tick, len(list_filter(w, lambda x: x IN {_GOOD})) AS p, len(list_filter(w, lambda x: x IN {_BAD})) AS n FROM w),
s AS (SELECT tick, 0.5::DOUBLE + (n - p) / (2.0::DOUBLE * (n + p + 1)) AS score FROM c)
SELECT tick, round(avg(score), 6) AS value, count(*) AS n FROM s WHERE abs(score - 0.5::DOUBLE) >= 0.25 GROUP BY tick""")
def sentiment_by_tick(spark, d):
    turns = tables.table(spark, d, "conversations")
    return nodes.mood(turns.select(F.col("turn").alias("tick"), nodes.lexicon_score("text", _GOOD, _BAD))).withColumn("value", F.round("value", 6))


@query("typo_pairs", "WITH n AS (SELECT DISTINCT p_brand, p_name FROM part) SELECT a.p_brand AS brand, a.p_name AS wrong, b.p_name AS correct, levenshtein(a.p_name, b.p_name) AS distance FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) BETWEEN 1 AND 4")
def typo_pairs(spark, d):
    names = tables.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("wrong")).distinct()
    pairs = names.join(names.withColumnRenamed("wrong", "correct"), "brand").where("wrong < correct")
    return lines.typos(pairs, "wrong", "correct")


@query("text_scalars", r"""SELECT doc_id, '"' || replace(replace(source, '\', '\\'), '"', '\"') || '"' AS quoted, regexp_extract(source || '/' || doc_id, '[^/]+$') AS base,
    CASE WHEN n_chars >= 1000000 THEN (n_chars // 1000000) || 'M' WHEN n_chars >= 1000 THEN (n_chars // 1000) || 'K' ELSE n_chars::VARCHAR END AS size FROM documents""")
def text_scalars(spark, d):
    docs = tables.table(spark, d, "documents").withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return docs.select("doc_id", text.yaml_quoted("source").alias("quoted"), text.basename("path").alias("base"), text.short_number("n_chars").alias("size"))


# --- syntax nodes -----------------------------------------------------------------------------------------------------

TAGS = r"""WITH tags AS (SELECT DISTINCT page_id AS commit, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1) AS path, lower(unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1))) AS node FROM pages)
"""


@query("web_node_counts", TAGS + "SELECT path, node, count(*) AS n FROM tags GROUP BY ALL")
def web_node_counts(spark, d):
    return nodes.hotness(nodes.tags(tables.table(spark, d, "pages")))


@query("web_node_couples", TAGS + "SELECT a.path, a.node AS node1, b.node AS node2, count(*) AS n FROM tags a JOIN tags b ON a.commit = b.commit AND a.path = b.path AND a.node <> b.node GROUP BY ALL")
def web_node_couples(spark, d):
    return nodes.couples(nodes.tags(tables.table(spark, d, "pages")))


@query("web_nodes_added_removed", TAGS + """, v AS (SELECT path, commit, list(node) AS now FROM tags GROUP BY ALL), w AS (SELECT *, coalesce(lag(now) OVER (PARTITION BY path ORDER BY commit), []) AS before FROM v)
SELECT path, commit, array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(before, x))), ',') AS added, array_to_string(list_sort(list_filter(before, lambda x: NOT list_contains(now, x))), ',') AS removed FROM w""")
def web_nodes_added_removed(spark, d):
    found = nodes.added_removed(nodes.tags(tables.table(spark, d, "pages")))
    return found.select("path", "commit", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


# --- vectors and identities -------------------------------------------------------------------------------------------


@query("label_angles", """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM c GROUP BY label), p AS (SELECT a.label AS label1, b.label AS label2, sum(a.x * b.x) / any_value(na.n * nb.n) AS cosine FROM c a JOIN c b ON a.i = b.i AND a.label < b.label JOIN n na ON na.label = a.label JOIN n nb ON nb.label = b.label GROUP BY ALL)
SELECT label1, label2, round(cosine, 6) AS cosine, round(acos(greatest(-1, least(1, cosine))), 6) AS angle FROM p""")
def label_angles(spark, d):
    found = series.angles(series.centroids(tables.table(spark, d, "embeddings"), "label", "embedding"))
    return found.select("label1", "label2", F.round("cosine", 6).alias("cosine"), F.round("angle", 6).alias("angle"))


def _signatures(spark: SparkSession, d: str) -> DataFrame:
    """Names and mail addresses made of customers: those of one nation and segment share an address."""
    return tables.table(spark, d, "customer").select(F.col("c_custkey").alias("commit"), F.col("c_name").alias("name"), F.concat_ws("@", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("email"))


_SIG = "WITH sig AS (SELECT c_custkey AS commit, c_name AS name, lower(c_mktsegment) || '@' || c_nationkey AS email FROM customer)"


@query("identity_lookup", _SIG + """, keys AS (SELECT email AS key, min(commit) AS author FROM sig WHERE email NOT LIKE 'household%' GROUP BY ALL UNION ALL SELECT lower(name), commit FROM sig WHERE email LIKE 'household%')
SELECT sig.commit, coalesce(e.author, n.author) AS author FROM sig LEFT JOIN keys e ON e.key = email LEFT JOIN keys n ON n.key = lower(name)""")
def identity_lookup(spark, d):
    sig = _signatures(spark, d)
    home = F.col("email").like("household%")
    keys = sig.where(~home).groupBy(F.col("email").alias("key")).agg(F.min("commit").alias("author")).union(sig.where(home).select(F.lower("name"), "commit"))
    return identity.lookup(sig, keys).select("commit", "author")


@query("identity_components", _SIG + """, g AS (SELECT email, string_agg(DISTINCT lower(name), '|' ORDER BY lower(name)) || '|' || email AS label FROM sig GROUP BY email)
SELECT lower(name) AS key, label FROM sig JOIN g USING (email) UNION SELECT email, label FROM g""")
def identity_components(spark, d):
    return identity.people(_signatures(spark, d))


@query("dict_union_literal", "WITH a AS (SELECT c_mktsegment || c_nationkey AS label, min(c_custkey) AS at FROM customer WHERE c_acctbal > 0 GROUP BY 1), b AS (SELECT c_mktsegment || c_nationkey AS label, min(c_custkey) AS at FROM customer WHERE c_acctbal < 2000 GROUP BY 1) SELECT coalesce(a.label, b.label) AS label, coalesce(a.at, -1) AS at1, coalesce(b.at, -1) AS at2 FROM a FULL JOIN b ON a.label = b.label")
def dict_union_literal(spark, d):
    people = tables.table(spark, d, "customer").select(F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("label"), F.col("c_custkey").alias("at"), "c_acctbal")
    return identity.union_literal(people.where("c_acctbal > 0"), people.where("c_acctbal < 2000"))


# --- combination ------------------------------------------------------------------------------------------------------

_REGIONS = ", regions AS (SELECT c_custkey AS author, r_name AS repo FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), own AS (SELECT * FROM log JOIN regions USING (author))"


def _regional(spark: SparkSession, d: str) -> DataFrame:
    return tables.log(spark, d).join(tables.regions(spark, d), "author")


@query("combine_devs", LOG + _REGIONS + f", starts AS (SELECT repo, min(tick) AS s FROM own GROUP BY repo) SELECT tick, author, lang, count(DISTINCT commit)::BIGINT AS commits, {SUMS} FROM own GROUP BY ALL")
def combine_devs(spark, d):
    """Each region's ticks count from its own first commit; combining moves them back."""
    own = _regional(spark, d)
    starts = own.groupBy("repo").agg(F.min("tick").alias("start"))
    sums = [F.sum(c).cast("bigint").alias(c) for c in effort.STATS]
    per = own.repartition(tables.partitions(spark, d), "author").groupBy("repo", "tick", "author", "lang", "commit").agg(*sums)
    moved = per.groupBy("repo", "tick", "author", "lang").agg(F.count("*").alias("commits"), *sums)
    results = moved.join(F.broadcast(starts), "repo").withColumn("tick", F.col("tick") - F.col("start")).drop("start")  # a row a region
    return combine.devs(results, starts)


@query("combine_couples", LOG + _PAIRS)
def combine_couples(spark, d):
    own = _regional(spark, d)
    return combine.couples(couples.paired(own.groupBy("repo", "commit").agg(F.collect_set("path").alias("paths")).drop("commit")))


@query("combine_header", LOG + _REGIONS + "SELECT (SELECT string_agg(repo, ' & ' ORDER BY repo) FROM (SELECT DISTINCT repo FROM own)) AS repo, epoch(min(ts))::BIGINT AS begin, epoch(max(ts))::BIGINT AS \"end\", count(DISTINCT commit) AS commits, sum(changed)::BIGINT AS run_time FROM own")
def combine_header(spark, d):
    own = _regional(spark, d)
    per = own.groupBy("repo").agg(F.min(ticks.seconds("ts")).alias("begin"), F.max(ticks.seconds("ts")).alias("end"), F.countDistinct("commit").alias("commits"), F.sum("changed").cast("bigint").alias("run_time"))
    return combine.header(per)


@query("csr_encode", LOG + ", x AS (SELECT author AS row, lang, sum(added)::BIGINT AS v FROM log GROUP BY ALL) SELECT row, string_agg(lang, ',' ORDER BY lang) AS indices, string_agg(v::VARCHAR, ',' ORDER BY lang) AS data, (sum(count(*)) OVER (ORDER BY row))::BIGINT AS indptr FROM x GROUP BY row")
def csr_encode(spark, d):
    cells = tables.log(spark, d).groupBy("author", "lang").agg(F.sum("added").cast("bigint").alias("v"))
    rows = sinks.csr(cells, "author", "lang", "v")
    return rows.select("row", F.array_join("indices", ",").alias("indices"), _joined("data").alias("data"), "indptr")


@query("combine_burndown", LIVES + "," + _cells("", 30, 30) + """, size AS (SELECT max(sample) AS s FROM cells WHERE lines <> 0), line AS (SELECT unnest(range(0, s + 1)) AS k FROM size)
SELECT a.k AS sample, b.k AS band, coalesce(lines, 0)::BIGINT AS lines FROM line a CROSS JOIN line b LEFT JOIN cells ON sample = a.k AND band = b.k""")
def combine_burndown(spark, d):
    """The project matrices of the regions, sampled on their own, as one."""
    lives = tables.lives(spark, d).join(tables.regions(spark, d), "author")
    cells = None
    moves = burndown.deltas(lives.withColumn("path", F.col("repo")))
    cells = burndown.sampled(moves, 30, 30, ("path",))
    return combine.burndown(cells.select(F.lit("project").alias("key"), F.col("path").alias("repo"), F.lit(30).alias("granularity"), F.lit(30).alias("sampling"), F.lit(0).alias("start"), "sample", "band", "lines")).drop("key")


@query("burndown_by_year")
def burndown_by_year(spark, d):
    cells = burndown.sampled(burndown.deltas(tables.lives(spark, d)), 30, 30)
    origin = str(tables.commits(spark, d).agg(F.min("ts")).first()[0].date())
    return combine.resampled(cells, 30, 30, origin)


# --- folds over versions ----------------------------------------------------------------------------------------------


@query("line_diff")
def line_diff(spark, d):
    script = F.array_join(F.transform("script", lambda e: F.concat(e["op"], e["n"].cast("string"))), " ")
    return renames.scripts(lines.versions(tables.dialogue(spark, d))).select("path", "tick", script.alias("script"))


@query("line_stats")
def line_stats(spark, d):
    return lines.line_stats(tables.dialogue(spark, d))


@query("dialogue_burndown")
def dialogue_burndown(spark, d):
    moves = lines.fold(tables.dialogue(spark, d)).where("kind = 'delta'")
    return burndown.sampled(moves, 1, 1, ("path",))


_VERSIONS = """WITH v AS (SELECT conv_id AS path, turn AS tick, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + (text NOT LIKE '%' || chr(10))::INT END AS n FROM conversations)
"""


@query("dialogue_lines", _VERSIONS + "SELECT path, tick, n::BIGINT AS lines FROM v WHERE n > 0")
def dialogue_lines(spark, d):
    """The lines of each version, as the changes that the fold tells add up to."""
    moves = lines.fold(tables.dialogue(spark, d)).where("kind = 'delta'").groupBy("path", F.col("cur_tick").alias("tick")).agg(F.sum("delta").alias("delta"))
    every = tables.dialogue(spark, d).select("path", "tick").join(moves, ["path", "tick"], "left")
    total = F.sum(F.coalesce("delta", F.lit(0))).over(Window.partitionBy("path").orderBy("tick"))
    return every.select("path", "tick", total.cast("bigint").alias("lines")).where("lines > 0")


@query("line_stats_net", _VERSIONS + "SELECT path, tick, (n - coalesce(lag(n) OVER (PARTITION BY path ORDER BY tick), 0))::BIGINT AS net FROM v")
def line_stats_net(spark, d):
    return lines.line_stats(tables.dialogue(spark, d)).select("path", "tick", (F.col("added") - F.col("removed")).alias("net"))


@query("dialogue_ownership_lines", _VERSIONS + "SELECT path, arg_max(n, tick)::BIGINT AS lines FROM v GROUP BY path HAVING arg_max(n, tick) > 0")
def dialogue_ownership_lines(spark, d):
    return lines.ownership(lines.fold(tables.dialogue(spark, d))).groupBy("path").agg(F.sum("lines").cast("bigint").alias("lines"))


@query("dialogue_ownership")
def dialogue_ownership(spark, d):
    return lines.ownership(lines.fold(tables.dialogue(spark, d)))


@query("typo_fixes", r"""WITH f AS (SELECT p_partkey AS commit, p_brand AS path, replace(p_name, ' ', '_') AS correct FROM part),
w AS (SELECT commit, path, replace(correct, 'a', 'aa') AS wrong, correct FROM f), t AS (SELECT *, levenshtein(wrong, correct) AS distance FROM w WHERE regexp_full_match(correct, '[A-Za-z_]\w*'))
SELECT wrong, correct, min(commit) AS commit, arg_min(path, commit) AS path, 2::BIGINT AS line FROM t WHERE distance BETWEEN 1 AND 4 GROUP BY wrong, correct""")
def typo_fixes(spark, d):
    """Names of parts as identifiers in a line of source, mended in the next version."""
    right = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    text = [F.concat(F.lit("begin\nuse("), x, F.lit(")\nend\n")) for x in (F.replace(right, F.lit("a"), F.lit("aa")), right)]
    return lines.typo_fixes(tables.table(spark, d, "part").select(F.col("p_partkey").alias("commit"), F.col("p_brand").alias("path"), text[0].alias("old"), text[1].alias("new")))


@query("dtw_distance")
def dtw_distance(spark, d):
    """Between languages: how much the series of monthly effort differ in shape."""
    monthly = tables.log(spark, d).groupBy(F.col("lang").alias("author"), F.floor(F.col("tick") / 30).alias("month")).agg(F.sum(effort.effort()).cast("double").alias("v"))
    rows = monthly.groupBy("author").agg(F.transform(F.sort_array(F.collect_list(F.struct("month", "v"))), lambda x: x["v"]).alias("values"))
    return series.warped(rows).withColumn("distance", F.round("distance", 9))


# --- merges and renames in the leaves ---------------------------------------------------------------------------------

MERGES = LOG + ", m AS (SELECT o_orderkey AS commit, o_orderpriority = '1-URGENT' AS is_merge FROM orders), merged AS (SELECT * FROM log JOIN m USING (commit))"
CONTEXTS = MERGES + """, touched AS (SELECT *, count(*) OVER (PARTITION BY commit) <= 1000 AS small FROM merged WHERE action <> 'D'),
contexts AS (SELECT * EXCLUDE (before) FROM (SELECT *, coalesce(max(small) OVER (PARTITION BY path ORDER BY commit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM touched) WHERE NOT is_merge OR NOT before)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    """The log in order of its commits, of which urgent ones stand for merges."""
    merge = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"), (F.col("o_orderpriority") == "1-URGENT").alias("is_merge"))
    return tables.log(spark, d).join(merge, "commit").withColumn("seq", F.col("commit"))


@query("devs_merges", MERGES + f"SELECT tick, author, count(DISTINCT commit) AS commits, {', '.join(f'sum(CASE WHEN is_merge THEN 0 ELSE {x} END)::BIGINT AS {x}' for x in effort.STATS)} FROM merged GROUP BY ALL")
def devs_merges(spark, d):
    return effort.devs(_merged(spark, d))


@query("devs_languages_merges", MERGES + f"SELECT tick, author, lang, {SUMS} FROM merged WHERE NOT is_merge GROUP BY ALL")
def devs_languages_merges(spark, d):
    return effort.by_language(_merged(spark, d))


@query("commits_no_merges", MERGES + "SELECT commit, tick, author, count(*) AS n_files, string_agg(path || ':' || added, ',' ORDER BY path) AS files FROM merged WHERE NOT is_merge GROUP BY ALL")
def commits_no_merges(spark, d):
    stat = effort.commits_stat(_merged(spark, d))
    each = F.transform("files", lambda x: F.concat_ws(":", x["path"].cast("string"), x["added"].cast("string")))
    return stat.select("commit", "tick", "author", F.size("files").cast("bigint").alias("n_files"), F.array_join(each, ",").alias("files"))


@query("file_history_merges", MERGES + f"SELECT path, author, {SUMS} FROM merged WHERE NOT is_merge GROUP BY ALL")
def file_history_merges(spark, d):
    return effort.file_people(_merged(spark, d))


@query("couples_merges", CONTEXTS + "SELECT a.path AS file1, b.path AS file2, count(*) AS n FROM contexts a JOIN contexts b USING (commit) GROUP BY ALL")
def couples_merges(spark, d):
    return couples.files(couples.contexts(_merged(spark, d)))


_COUNTS = """, contributions AS (SELECT commit, coalesce(CASE WHEN author % 7 <> 0 THEN author END, -1) AS author, path FROM (SELECT commit, author, path FROM contexts UNION ALL SELECT commit, author, path FROM merged WHERE action = 'D' AND NOT is_merge)),
pf AS (SELECT author, path, count(*) AS n FROM contributions GROUP BY ALL)"""


def _anonymous(spark: SparkSession, d: str) -> DataFrame:
    """The log with merges, of which every seventh author isn't known."""
    return _merged(spark, d).withColumn("author", F.when(F.col("author") % 7 != 0, F.col("author")))


@query("couples_missing_author", CONTEXTS + _COUNTS + " SELECT a.author AS author1, b.author AS author2, sum(least(a.n, b.n))::BIGINT AS n FROM pf a JOIN pf b USING (path) GROUP BY ALL")
def couples_missing_author(spark, d):
    return couples.people(couples.contributions(_anonymous(spark, d)))


_KEPT = f""", p AS ({_PAIRS}), kept AS (SELECT * FROM p WHERE file1 % 10 <> 0 AND file2 % 10 <> 0), names AS (SELECT DISTINCT file1 AS live FROM kept), alias AS (SELECT live - 1 AS path, live FROM names WHERE live % 10 = 1)"""


def _tenth(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every tenth part was renamed to the next one: the aliases, and the live paths."""
    parts = tables.table(spark, d, "part").select(F.col("p_partkey").alias("path"))
    return parts.where("path % 10 = 0").withColumn("live", F.col("path") + 1), parts.where("path % 10 <> 0")


@query("couples_renamed", LOG + _KEPT + """, old AS (SELECT x.live AS file1, coalesce(y.live, file2) AS file2, sum(n) AS more FROM p JOIN alias x ON x.path = file1 LEFT JOIN alias y ON y.path = file2 GROUP BY ALL),
known AS (SELECT old.* FROM old JOIN kept USING (file1, file2)), both_ways AS (SELECT * FROM known UNION ALL SELECT file2, file1, more FROM known WHERE file1 <> file2), more AS (SELECT file1, file2, sum(more) AS more FROM both_ways GROUP BY ALL)
SELECT file1, file2, (n + coalesce(more, 0))::BIGINT AS n FROM kept LEFT JOIN more USING (file1, file2)""")
def couples_renamed(spark, d):
    return couples.propagated(couples.files(tables.log(spark, d)), *_tenth(spark, d))


@query("people_files_renamed", LOG + _KEPT + " SELECT author, coalesce(live, path) AS path, count(*) AS n FROM log LEFT JOIN alias USING (path) GROUP BY ALL")
def people_files_renamed(spark, d):
    log, (alias, live) = tables.log(spark, d), _tenth(spark, d)
    kept = couples.files(log).where("file1 % 10 <> 0 and file2 % 10 <> 0")
    return couples.propagated_people(couples.people_files(log), kept, alias, live)


@query("file_history_renamed", LOG + """, moved AS (SELECT commit, ts, CASE WHEN path % 10 = 0 THEN path + 1 ELSE path END AS path, action FROM log),
seen AS (SELECT *, max(CASE WHEN action = 'I' THEN (ts, commit) END) OVER (PARTITION BY path) AS begin FROM moved)
SELECT path, string_agg(commit::VARCHAR, ',' ORDER BY ts, commit) FILTER (begin IS NULL OR (ts, commit) >= begin) AS commits FROM (SELECT DISTINCT path, commit, ts, begin FROM seen) WHERE path NOT IN (SELECT path FROM moved GROUP BY path HAVING arg_max(action, (ts, commit, action)) = 'D') GROUP BY path""")
def file_history_renamed(spark, d):
    """A file's list holds what it was under its former name; a commit that touched both names counts once."""
    moved = couples.renamed(tables.log(spark, d), _tenth(spark, d)[0])
    once = moved.groupBy("path", "commit", "ts").agg(F.max("action").alias("last"), F.max(F.col("action") == "I").alias("inserted"))
    return effort.file_commits_once(once).select("path", _joined("commits").alias("commits"))


@query("overwrites_topk_square", LIVES + "," + _MATRIX + """, best AS (SELECT author FROM matrix WHERE kind = 'self' ORDER BY lines DESC, author LIMIT 20)
SELECT author, other, lines FROM matrix WHERE kind = 'by' AND author IN (FROM best) AND other IN (FROM best)""")
def overwrites_topk_square(spark, d):
    matrix, best = burndown.overwrites_of_best(burndown.deltas(tables.lives(spark, d)), 20)
    return matrix.where("kind = 'by'").join(F.broadcast(best.withColumnRenamed("author", "other")), "other", "left_semi").select("author", "other", "lines")


@query("couples_symmetric", LOG + f", p AS ({_PAIRS}), half AS (SELECT * FROM p WHERE file1 <= file2) SELECT file1, file2, sum(n)::BIGINT AS n FROM (SELECT * FROM half UNION ALL SELECT file2, file1, n FROM half WHERE file1 <> file2) GROUP BY ALL")
def couples_symmetric(spark, d):
    return couples.symmetric(couples.files(tables.log(spark, d)).where("file1 <= file2"), "file1", "file2")


# --- graphs and names -------------------------------------------------------------------------------------------------


@query("ancestors", "WITH RECURSIVE e AS (SELECT DISTINCT o_orderkey AS commit, o_orderkey // k AS parent FROM orders, (SELECT unnest([2, 3]) AS k) WHERE o_orderkey // k > 0), seen AS (SELECT commit FROM (SELECT DISTINCT commit FROM e ORDER BY commit DESC LIMIT 5) UNION SELECT parent FROM seen JOIN e USING (commit)) SELECT commit FROM seen")
def ancestors(spark, d):
    """Each commit's parents are half and a third of its number; heads are the five greatest."""
    orders = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("commit"))
    keys = orders.repartition(parts(spark, orders.count(), tables.LINES), "commit").distinct()
    edges = keys.select("commit", F.explode(F.array(F.floor(F.col("commit") / 2), F.floor(F.col("commit") / 3))).alias("parent")).where("parent > 0").distinct()
    heads = edges.select("commit").distinct().orderBy(F.desc("commit")).limit(5)
    return graphs.ancestors(edges, heads)


@query("rename_chain", "SELECT c_custkey AS path, (c_custkey + 4) // 5 * 5 AS live FROM customer WHERE c_custkey % 5 <> 0")
def rename_chain(spark, d):
    steps = tables.table(spark, d, "customer").where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("from_path"), (F.col("c_custkey") + 1).alias("to_path"))
    return graphs.chain(steps)


@query("largest_component", "WITH e AS (SELECT c_custkey AS a, c_custkey - c_custkey % 7 AS b FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT b AS root, a AS node FROM e UNION SELECT b, b FROM e), best AS (SELECT root FROM n GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT node FROM n WHERE root IN (FROM best)")
def largest_component(spark, d):
    even = tables.table(spark, d, "customer").where("c_custkey % 2 = 0")
    return graphs.largest_component(even.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - F.col("c_custkey") % 7).alias("b")))


@query("mailmap", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, lower(c_mktsegment) || '@x' AS email, CASE WHEN c_custkey % 2 = 0 THEN 'Old ' || c_custkey END AS old_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey || '@old' END AS old_email FROM customer")
def mailmap(spark, d):
    c = tables.table(spark, d, "customer")
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.when(F.col("c_custkey") % 3 != 0, F.concat("c_name", F.lit(" "))).otherwise(F.lit("")), F.lit("<"), F.lower("c_mktsegment"), F.lit("@x>"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" Old "), key, F.lit(" <"), key, F.lit("@old>"))).otherwise(F.lit("")))
    return c.select("c_custkey", line.alias("line")).select("c_custkey", text.mailmap("line").alias("m")).select("c_custkey", "m.*")


@query("merged_comments", """WITH c AS (SELECT l_orderkey AS path, l_linenumber * 3 AS s, l_linenumber * 3 + l_quantity::BIGINT % 3 AS e, any_value(l_returnflag) AS t FROM lineitem GROUP BY ALL),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, coalesce(s > max(e) OVER (PARTITION BY path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true)::INT AS fresh FROM c))
SELECT path, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*) AS n FROM i GROUP BY path, island""")
def merged_comments(spark, d):
    rows = tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("path"), (F.col("l_linenumber") * 3).cast("bigint").alias("start"), (F.col("l_linenumber") * 3 + F.col("l_quantity").cast("bigint") % 3).alias("end")).distinct()
    found = nodes.merged_comments(rows.withColumn("text", F.lit("x")))
    return found.select("path", "start", "end", F.size(F.split("text", "\n")).cast("bigint").alias("n"))


_SPANS = "WITH n AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS node, l_linenumber * 4 AS s, l_linenumber * 4 + 3 + l_linenumber % 3 AS e FROM lineitem), c AS (SELECT DISTINCT l_suppkey AS commit, l_orderkey AS path, l_quantity::BIGINT AS line FROM lineitem), touched AS (SELECT DISTINCT commit, path, node FROM c JOIN n USING (path) WHERE line BETWEEN s AND e)"


def _touched(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order fall into spans of lines, which stand for syntax nodes and overlap."""
    rows = tables.table(spark, d, "lineitem")
    number = F.col("l_linenumber")
    spans = rows.select(F.col("l_orderkey").alias("path"), number.alias("node"), (number * 4).alias("start"), (number * 4 + 3 + number % 3).alias("end")).distinct()
    edits = rows.select(F.col("l_suppkey").alias("commit"), F.col("l_orderkey").alias("path"), F.col("l_quantity").cast("bigint").alias("line")).distinct()
    return nodes.touched(spans, edits)


@query("interval_join", _SPANS + " SELECT commit, path, node FROM touched")
def interval_join(spark, d):
    return _touched(spark, d)


@query("shotness", _SPANS + " SELECT path, node, count(*) AS n FROM touched GROUP BY ALL")
def shotness(spark, d):
    return nodes.hotness(_touched(spark, d))


@query("shotness_ranking", _SPANS + ", h AS (SELECT path, node, count(*) AS n FROM touched GROUP BY ALL) SELECT path, node, n, row_number() OVER (ORDER BY n DESC, path DESC, node DESC) AS rank FROM h QUALIFY rank <= 50")
def shotness_ranking(spark, d):
    best = nodes.ranked(nodes.hotness(_touched(spark, d))).limit(50)  # the report's 50 rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("path"), F.desc("node"))).cast("bigint"))


@query("mood_totals", "WITH m AS (SELECT turn AS tick, (avg(length(text)) % 100) / 100 AS value FROM conversations GROUP BY turn) SELECT round(sum(greatest((0.5 - value) * 2, 0)), 6) AS positive, round(sum(greatest((value - 0.5) * 2, 0)), 6) AS negative, round(sum((0.5 - value) * 2), 6) AS delta FROM m")
def mood_totals(spark, d):
    mood = tables.table(spark, d, "conversations").groupBy(F.col("turn").alias("tick")).agg(((F.avg(F.length("text")) % 100) / 100).alias("value"), F.count("*").alias("n"))
    return nodes.mood_totals(mood).select(*[F.round(c, 6).alias(c) for c in ("positive", "negative", "delta")])


@query("imports_of_sources", LOG + """, src AS (SELECT author, tick, unnest(CASE WHEN commit % 2 = 0 THEN ['os', lower(p_brand)] ELSE ['java.' || p_size, 'x.Y'] END) AS import, CASE WHEN commit % 2 = 0 THEN 'Python' ELSE 'Java' END AS lang FROM (SELECT DISTINCT commit, author, tick, path FROM log) JOIN (SELECT p_partkey AS path, replace(p_brand, '#', '_') AS p_brand, p_size FROM part) USING (path))
SELECT author, lang, import, tick, count(*) AS n FROM src GROUP BY ALL""")
def imports_of_sources(spark, d):
    """Imports read off source text, in two languages, that parts make up."""
    part = tables.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("_"))).alias("brand"), F.col("p_size").cast("string").alias("size"))
    rows = tables.log(spark, d).select("commit", "author", "tick", "path").join(part, "path")
    even = F.col("commit") % 2 == 0
    code = F.when(even, F.concat(F.lit("import os\nfrom "), "brand", F.lit(" import thing\nx = 1\n"))).otherwise(F.concat(F.lit("import java."), "size", F.lit(";\nimport static x.Y;\nclass A {}\n")))
    rows = rows.select("commit", "author", "tick", F.when(even, "Python").otherwise("Java").alias("lang"), code.alias("data"))
    return effort.imports(rows.select("author", "tick", "lang", F.explode(text.imports("lang", "data")).alias("import")))


# --- more of names, trees and reports ---------------------------------------------------------------------------------


@query("vendored_filter", r"SELECT page_id, path FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'vendor/a.go' WHEN 1 THEN 'src/x.min.js' WHEN 2 THEN 'lib/node_modules/y.js' ELSE 'src/' || page_id || '.py' END AS path FROM pages) WHERE page_id % 5 > 2")
def vendored_filter(spark, d):
    kinds = F.when(F.col("page_id") % 5 == 0, "vendor/a.go").when(F.col("page_id") % 5 == 1, "src/x.min.js").when(F.col("page_id") % 5 == 2, "lib/node_modules/y.js")
    pages = tables.table(spark, d, "pages").select("page_id", F.coalesce(kinds, F.concat(F.lit("src/"), F.col("page_id").cast("string"), F.lit(".py"))).alias("path"))
    return pages.where(~text.vendored("path"))


@query("language_detection", "SELECT p_partkey, (['Python', 'Makefile', 'Shell', ''])[p_partkey % 4 + 1] AS language FROM part")
def language_detection(spark, d):
    """By ending, by whole name, by interpreter, and of what isn't known."""
    part = tables.table(spark, d, "part").withColumn("k", F.col("p_partkey") % 4)
    path = F.when(F.col("k") == 0, "a/b.PY").when(F.col("k") == 1, "src/Makefile").otherwise("bin/tool")
    code = F.when(F.col("k") == 2, "#!/usr/bin/env bash\necho").otherwise("text")
    return part.withColumns({"path": path, "data": code}).select("p_partkey", text.language("path", "data").alias("language"))


@query("tree_xpath", "SELECT c_custkey AS path, c_mktsegment || ',n' || c_nationkey AS found FROM customer")
def tree_xpath(spark, d):
    """Trees made of customers: an XPath expression takes the names of what lies under calls."""
    c = tables.table(spark, d, "customer")
    xml = F.concat(F.lit("<file><call><id name='"), "c_mktsegment", F.lit("'/><id name='n"), F.col("c_nationkey").cast("string"), F.lit("'/></call><id name='outside'/></file>"))
    found = nodes.selected(c.select(F.col("c_custkey").alias("path"), xml.alias("xml")), "//call/id/@name")
    return found.select("path", F.array_join("values", ",").alias("found"))


@query("node_hash_groups", "SELECT count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY c_mktsegment, c_nationkey")
def node_hash_groups(spark, d):
    """Nodes of the same properties have one hash, whatever the order in which these are told."""
    c = tables.table(spark, d, "customer")
    a, b = (F.lit("segment"), F.col("c_mktsegment")), (F.lit("nation"), F.col("c_nationkey").cast("string"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.create_map(*a, *b)).otherwise(F.create_map(*b, *a))
    return c.select("c_custkey", nodes.node_hash(own).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first")).drop("hash")


@query("ownership_ranked", LIVES + ", o AS (SELECT path, coalesce(author, -1) AS author, sum(lines)::BIGINT AS lines FROM lives, horizon WHERE birth <= h AND death > h GROUP BY ALL) SELECT path, author, lines, row_number() OVER (PARTITION BY path ORDER BY lines DESC, author) AS rank FROM o")
def ownership_ranked(spark, d):
    return burndown.ranked_owners(burndown.ownership(tables.lives(spark, d), _horizon(spark, d)))


@query("burndown_labels", LIVES + "," + _cells("", 90, 90) + " SELECT sample, band, lines, ((SELECT d FROM start) + ((sample + 1) * 90)::INT)::VARCHAR AS day, ((SELECT d FROM start) + (band * 90)::INT)::VARCHAR || ' - ' || ((SELECT d FROM start) + (band * 90 + 90)::INT)::VARCHAR AS label FROM cells WHERE lines <> 0")
def burndown_labels(spark, d):
    origin = str(tables.commits(spark, d).agg(F.min("ts")).first()[0].date())
    return burndown.labelled(burndown.sampled(burndown.deltas(tables.lives(spark, d)), 90, 90), 90, 90, origin)


@query("unique_parents", "SELECT o_orderkey AS commit, CASE WHEN o_orderkey // 2 = o_orderkey // 3 THEN (o_orderkey // 2)::VARCHAR ELSE (o_orderkey // 2) || ',' || (o_orderkey // 3) END AS parents FROM orders WHERE o_orderkey > 0")
def unique_parents(spark, d):
    key = F.col("o_orderkey")
    half, third = F.floor(key / 2), F.floor(key / 3)
    rows = tables.table(spark, d, "orders").where(key > 0).select(key.alias("commit"), F.array(half, third, half, key).alias("parents"))
    return graphs.unique_parents(rows).select("commit", _joined("parents").alias("parents"))


@query("combine_only", LOG + _REGIONS + f"SELECT tick, author, count(DISTINCT commit)::BIGINT AS commits, {SUMS} FROM own GROUP BY ALL")
def combine_only(spark, d):
    """The results of the regions, of which just one leaf is combined."""
    own = _regional(spark, d)
    names = [r[0] for r in tables.table(spark, d, "region").select("r_name").orderBy("r_name").collect()]  # five repositories
    parts = [{"Devs": effort.devs(own.where(F.col("repo") == n)), "Churn": effort.churn(own.where(F.col("repo") == n))} for n in names]
    return combine.merged(parts, "Devs")[0]["Devs"]


# --- streams ----------------------------------------------------------------------------------------------------------

_WINDOW = "epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT"


@query("stream_tumbling", f"SELECT {_WINDOW} AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    return events.drained(events.tumbling(events.read(spark, d)))


@query("stream_sliding", f"SELECT {_WINDOW} - s * 86400 AS start, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events, (SELECT unnest([0, 1]) AS s) GROUP BY ALL")
def stream_sliding(spark, d):
    return events.drained(events.sliding(events.read(spark, d)))


@query("stream_session", """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 HOUR, true)::INT AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT floor(epoch(min(ts)))::BIGINT AS start, floor(epoch(max(ts) + INTERVAL 1 HOUR))::BIGINT AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_session(spark, d):
    return events.drained(events.sessions(events.read(spark, d)))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type, floor(epoch(ts))::BIGINT AS second FROM events")
def stream_dedup(spark, d):
    return events.drained(events.deduplicated(events.read(spark, d)), "append")


@query("stream_clamp", "SELECT user_id, event_id, max(floor(epoch(ts) / 86400)::BIGINT) OVER (PARTITION BY user_id ORDER BY event_id) AS tick FROM events")
def stream_clamp(spark, d):
    return events.drained(events.clamp(events.read(spark, d)), "append")


@query("stream_joined", "SELECT a.user_id, a.event_id AS first_id, b.event_id AS then_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 2 DAY WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def stream_joined(spark, d):
    return events.drained(events.followed(events.read(spark, d), "click", "purchase", "2 days"), "append")
