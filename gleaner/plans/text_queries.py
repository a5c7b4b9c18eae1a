"""Queries over lines, shapes, logs, content types and facts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import invariants as I
from gleaner.functions import templates as T
from gleaner.functions import text as X
from gleaner.operators import detect, logs, shell
from gleaner.sources.tables import applog, exploded_lines, failures, greplog, read

from . import sql_views as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {S.LINES}, t AS (SELECT source, doc_id, ln, line, {S.template('line')} AS tpl, {S.tokens('line')} AS tok
    FROM lines WHERE trim(line) <> '')
  SELECT source, tpl, count(DISTINCT doc_id) AS runs, count(*) AS lines, sum(tok)::BIGINT AS tokens,
    min_by(line, {{'a': doc_id, 'b': ln}}) AS example FROM t GROUP BY source, tpl HAVING count(DISTINCT doc_id) >= 2""")
def recurring_shapes(spark, sf_dir):  # noqa: ANN001, ANN201
    """Flagship: line shapes that recur over the documents of a source."""
    rows = exploded_lines(read(spark, sf_dir, "documents"), ("doc_id", "source"))
    return logs.recurring_shapes(rows, "source", "doc_id")


@query(f"SELECT source, sum({S.tokens('text')})::BIGINT AS tokens, count(*) AS docs FROM documents GROUP BY source")
def token_estimate_by_source(spark, sf_dir):  # noqa: ANN001, ANN201
    d = read(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.count("*").alias("docs"))


@query(f"WITH {S.LINES} SELECT doc_id, ln::INTEGER AS ln, line FROM lines")
def lines_explode(spark, sf_dir):  # noqa: ANN001, ANN201
    return exploded_lines(read(spark, sf_dir, "documents"))


@query(f"""WITH {S.APPLOG}, c AS (SELECT *, max(ln) OVER (PARTITION BY doc_id) AS total FROM applog)
  SELECT doc_id, ln::INTEGER AS ln, line, CASE WHEN total > 40 THEN total - 20 ELSE 0 END::BIGINT AS omitted FROM c
  WHERE total <= 40 OR ln <= 12 OR ln > total - 8""")
def head_tail(spark, sf_dir):  # noqa: ANN001, ANN201
    return shell.head_tail(applog(spark, sf_dir).select("doc_id", "ln", "line"), limit=40, head=12, tail=8)


@query(f"WITH {S.LINES} SELECT doc_id, ln::INTEGER AS ln, concat(ln::VARCHAR, ': ', line) AS shown FROM lines WHERE ln BETWEEN 2 AND 4")
def line_slice(spark, sf_dir):  # noqa: ANN001, ANN201
    return shell.line_slice(exploded_lines(read(spark, sf_dir, "documents")), 2, 4)


@query(f"""WITH {S.LINES}, f AS (SELECT doc_id, ln, line, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS new
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY ln)), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS grp FROM f)
  SELECT doc_id, min(ln)::INTEGER AS ln, count(*) AS n,
    CASE WHEN count(*) > 1 THEN concat(min(line), ' (x', count(*)::VARCHAR, ')') ELSE min(line) END AS shown FROM g GROUP BY doc_id, grp""")
def adjacent_duplicate_collapse(spark, sf_dir):  # noqa: ANN001, ANN201
    return shell.collapse_repeats(exploded_lines(read(spark, sf_dir, "documents")))


_STAMP = r"^\s*[\[(]*([0-9]{4}[-/].{5}|[0-9]{2}:[0-9]{2}:.{2})"
_LEVEL_WORD = r"(?i)\b(trace|debug|info|notice|warn|warning|error|err|fatal|critical|panic)\b"
_FRAME = r"^\s*(at |File \"|Traceback \(most recent call last\)|Caused by:|stack backtrace:|thread ''.*panicked)"


def _detect_sql(source: str) -> str:
    commas = "list_transform(filled, lambda x: length(x) - length(replace(x, ',', '')))"
    tabs = "list_transform(filled, lambda x: length(x) - length(replace(x, chr(9), '')))"
    even = lambda c: f"len(filled) >= 2 AND list_min({c}) = list_max({c}) AND list_min({c}) > 0"
    return f"""WITH src AS ({source}), h AS (SELECT id, text, ltrim(substr(text, 1, 65536)) AS head, string_split(substr(text, 1, 65536), chr(10)) AS ls FROM src),
  v AS (SELECT *, ls[1:200] AS top, list_filter(ls, lambda x: trim(x) <> '')[1:50] AS filled, list_filter(ls[1:200], lambda x: trim(x) <> '') AS tf FROM h),
  k AS (SELECT id, CASE WHEN head = '' THEN 'plain_text/high'
    WHEN head[1] IN ('{{', '[') AND json_valid(text) THEN 'json/high' WHEN head[1] IN ('{{', '[') THEN 'unknown/low'
    WHEN starts_with(head, '<?xml') OR (head[1] = '<' AND contains(head, '</')) THEN 'xml/medium'
    WHEN len(list_filter(top, lambda x: regexp_matches(x, '{_FRAME}'))) >= 2 THEN 'stack_trace/high'
    WHEN len(tf) >= 3 AND len(list_filter(tf, lambda x: regexp_matches(x, '{_LEVEL_WORD}') OR regexp_matches(x, '{_STAMP}'))) * 2 >= len(tf) THEN 'application_log/medium'
    WHEN {even(commas)} THEN 'csv/medium' WHEN {even(tabs)} THEN 'tabular_data/medium'
    WHEN len(filled) >= 2 AND starts_with(filled[1], '|') AND regexp_matches(filled[2], '^[-|: ]*$') THEN 'tabular_data/high'
    WHEN list_sum(list_transform(top, lambda x: CASE WHEN regexp_matches(x, '^(#{{1,3}} |```)') THEN 2 WHEN regexp_matches(x, '^[-*] ') THEN 1 ELSE 0 END)) >= 3 THEN 'markdown/medium'
    ELSE 'plain_text/low' END AS verdict FROM v)
  SELECT id, split_part(verdict, '/', 1) AS content_type, split_part(verdict, '/', 2) AS confidence FROM k"""


@query(_detect_sql("SELECT doc_id AS id, text FROM documents"))
def content_type_detect(spark, sf_dir):  # noqa: ANN001, ANN201
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), detect.detect(F.col("text")).alias("d")).select("id", "d.content_type", "d.confidence")


@query(_detect_sql("SELECT page_id AS id, html AS text FROM pages UNION ALL SELECT -1 - event_id, props FROM events"))
def content_type_pages_props(spark, sf_dir):  # noqa: ANN001, ANN201
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    e = read(spark, sf_dir, "events").select((-1 - F.col("event_id")).alias("id"), F.col("props").alias("text"))
    return p.unionByName(e).select("id", detect.detect(F.col("text")).alias("d")).select("id", "d.content_type", "d.confidence")


@query(f"""WITH {S.APPLOG}, src AS (SELECT doc_id AS id, string_agg(line, chr(10) ORDER BY ln) AS text FROM applog GROUP BY doc_id)
  SELECT content_type, confidence, count(*) AS docs FROM ({_detect_sql('SELECT * FROM src').replace('WITH src AS (SELECT * FROM src), ', 'WITH ')}) GROUP BY ALL""")
def content_type_logs(spark, sf_dir):  # noqa: ANN001, ANN201
    d = applog(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x.line), "\n")
    out = d.select(detect.detect(text).alias("d")).select("d.content_type", "d.confidence")
    return out.groupBy("content_type", "confidence").agg(F.count("*").alias("docs"))


@query("""WITH n AS (SELECT page_id, concat('site/', page_id::VARCHAR, CASE page_id % 5 WHEN 0 THEN '.html' WHEN 1 THEN '.PY' WHEN 2 THEN '.log' WHEN 3 THEN '' ELSE '.bin' END) AS name FROM pages),
  e AS (SELECT page_id, lower(regexp_extract(name, '([^.]*)$', 1)) AS ext FROM n)
  SELECT page_id, CASE WHEN ext IN ('html', 'xml', 'htm', 'svg') THEN 'xml' WHEN ext = 'py' THEN 'source_code' WHEN ext = 'log' THEN 'application_log' END AS content_type FROM e""")
def extension_detect(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("page_id") % 5
    tail = F.when(k == 0, ".html").when(k == 1, ".PY").when(k == 2, ".log").when(k == 3, "").otherwise(".bin")
    name = F.concat(F.lit("site/"), F.col("page_id").cast("string"), tail)
    return read(spark, sf_dir, "pages").select("page_id", detect.by_extension(name).alias("content_type"))


@query(f"WITH {S.APPLOG} SELECT doc_id, count(*) AS critical FROM applog WHERE {S.critical('line')} GROUP BY doc_id")
def critical_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = applog(spark, sf_dir).filter(X.is_critical(F.col("line")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("critical"))


@query(f"""WITH {S.APPLOG}, e AS (SELECT doc_id, string_agg(line || chr(10), '' ORDER BY ln) FILTER ({S.critical('line')}) AS region FROM applog GROUP BY doc_id)
  SELECT doc_id, coalesce(region, '') AS region FROM e""")
def critical_region(spark, sf_dir):  # noqa: ANN001, ANN201
    d = applog(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    return d.select("doc_id", X.critical_region(F.array_join(F.transform("l", lambda x: x.line), "\n")).alias("region"))


def _invariant(kind: str, view: str, text: str, useful: str = "v <> ''") -> None:
    pattern = I.PATTERNS[kind].replace("'", "''")
    key = {"applog": "doc_id", "failures": "event_id"}.get(view, "page_id")
    cte = {"applog": f"{S.APPLOG}, ", "failures": f"{S.FAILURES}, "}.get(view, "")
    sql = f"""WITH {cte}x AS (SELECT {key} AS id, unnest(regexp_extract_all({text}, '{pattern}')) AS v FROM {view})
  SELECT id, v AS value, count(*) AS n FROM x WHERE {useful} GROUP BY id, v"""

    def run(spark, sf_dir):  # noqa: ANN001, ANN202
        rows = {"applog": applog, "failures": failures}.get(view, lambda s, d: read(s, d, view))(spark, sf_dir)
        out = rows.select(F.col(key).alias("id"), F.explode(I.find(F.col(text), kind, 1 << 20)).alias("value"))
        return out.groupBy("id", "value").agg(F.count("*").alias("n"))

    QUERIES[f"invariants_{kind}"], ORACLE_SQL[f"invariants_{kind}"] = run, sql


for _kind, _view, _text, _useful in (
    ("url", "pages", "url", "v <> ''"),
    ("path", "pages", "url", "v <> ''"),
    ("line_ref", "applog", "line", "v <> ''"),
    ("hash", "failures", "line", "regexp_matches(v, '[A-Za-z]')"),
    ("version", "failures", "line", "v <> ''"),
    ("exit_code", "failures", "line", "v <> ''"),
    ("error_type", "failures", "line", "v <> ''"),
    ("comparison", "applog", "line", "v <> ''"),
    ("negation", "failures", "line", "v <> ''"),
    ("security", "failures", "line", "v <> ''"),
    ("number", "applog", "line", "strlen(v) <= 24"),
):
    _invariant(_kind, _view, _text, _useful)


@query(f"""WITH {S.APPLOG}, x AS (SELECT doc_id, ln, line, substr(line, 1, 80) AS cut, list_distinct(regexp_extract_all(line, '{I.PATTERNS['line_ref']}')) AS refs FROM applog)
  SELECT doc_id, ln::INTEGER AS ln, len(list_filter(refs, lambda r: NOT contains(cut, r)))::INTEGER AS lost FROM x WHERE len(refs) > 0""")
def invariant_violations(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = applog(spark, sf_dir).withColumn("refs", I.extract(F.col("line"), ("line_ref",))).filter(F.size("refs") > 0)
    return rows.select("doc_id", "ln", F.size(I.violations(F.col("refs"), F.substring("line", 1, 80))).alias("lost"))


_CLUSTERS = f"""WITH {S.APPLOG}, t AS (SELECT doc_id, ln, line, {S.template('line')} AS template, {S.level('line')} AS level FROM applog),
  c AS (SELECT doc_id, template, count(*) AS n, min(ln)::INTEGER AS first_line, max(ln)::INTEGER AS last_line, min_by(line, ln) AS example, min_by(level, ln) AS level
    FROM t GROUP BY doc_id, template)"""


@query(f"{_CLUSTERS} SELECT * FROM c")
def log_cluster(spark, sf_dir):  # noqa: ANN001, ANN201
    return logs.clusters(applog(spark, sf_dir).select("doc_id", "ln", "line"))


@query(f"""{_CLUSTERS}, s AS (SELECT *, CASE WHEN level IN ('FATAL', 'CRITICAL', 'PANIC') THEN 3 WHEN level = 'ERROR' THEN 2 WHEN level IN ('WARN', 'WARNING') THEN 1 ELSE 0 END AS severity FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY severity DESC, n DESC, first_line) AS rank FROM s)
  SELECT doc_id, template, n, rank::INTEGER AS rank, count(*) FILTER (rank > 4) OVER (PARTITION BY doc_id) AS templates_not_shown,
    coalesce(sum(n) FILTER (rank > 4) OVER (PARTITION BY doc_id), 0)::BIGINT AS lines_not_shown FROM r QUALIFY rank <= 4""")
def log_cluster_top(spark, sf_dir):  # noqa: ANN001, ANN201
    out = logs.shown(logs.clusters(applog(spark, sf_dir).select("doc_id", "ln", "line")), limit=4)
    return out.select("doc_id", "template", "n", "rank", "templates_not_shown", "lines_not_shown")


@query(f"WITH {S.APPLOG} SELECT {S.level('line')} AS level, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM applog GROUP BY 1")
def log_levels(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = applog(spark, sf_dir).groupBy(X.log_level(F.col("line")).alias("level"), "doc_id").agg(F.count("*").alias("n"))
    return rows.groupBy("level").agg(F.sum("n").alias("lines"), F.count("*").alias("docs"))


def log_cluster_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """The clusters as text of the intermediate form."""
    return logs.render(logs.clusters(applog(spark, sf_dir).select("doc_id", "ln", "line")))


QUERIES["log_cluster_text"] = log_cluster_text


@query(f"""WITH {S.GREPLOG}, g AS (SELECT regexp_extract(line, '^([^:]+):([0-9]+):(.*)$', 1) AS path FROM greplog)
  SELECT path, count(*) AS total, least(count(*), 20)::BIGINT AS shown, greatest(count(*) - 20, 0)::BIGINT AS dropped FROM g GROUP BY path""")
def grep_group(spark, sf_dir):  # noqa: ANN001, ANN201
    return shell.grep_by_file(shell.grep_rows(greplog(spark, sf_dir)), order="at").select("path", "total", F.col("shown").cast("bigint").alias("shown"), F.col("dropped").cast("bigint").alias("dropped"))


@query(f"""WITH {S.APPLOG}, w AS (SELECT unnest(list_filter(string_split(line, ' '), lambda w: w <> '')) AS w FROM applog),
  s AS (SELECT regexp_replace(w, '{S.TRAILING}', '') AS t FROM w)
  SELECT coalesce({S.token_class('t')}, '') AS class, count(*) AS n FROM s GROUP BY 1""")
def token_class_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    w = applog(spark, sf_dir).select(F.explode(T.tokens(F.col("line"))).alias("w"))
    return w.groupBy(F.coalesce(T.token_class(F.col("w")), F.lit("")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {S.LINES}, w AS (SELECT unnest(string_split_regex(line, '[ ]+')) AS w FROM lines), s AS (SELECT regexp_replace(w, '{S.TRAILING}', '') AS t FROM w WHERE w <> '')
  SELECT coalesce({S.token_class('t')}, '') AS class, count(*) AS n FROM s GROUP BY 1""")
def token_class_documents(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = exploded_lines(read(spark, sf_dir, "documents"))
    w = rows.select(F.explode(T.tokens(F.col("line"))).alias("w"))
    return w.groupBy(F.coalesce(T.token_class(F.col("w")), F.lit("")).alias("class")).agg(F.count("*").alias("n"))


@query(f"""WITH {S.APPLOG}, s AS (SELECT array_to_string({S.segments('line')}, ' ') AS canonical FROM applog)
  SELECT canonical, count(*) AS n FROM s GROUP BY canonical""")
def line_template(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = applog(spark, sf_dir).select(T.canonical(T.segments(F.col("line"))).alias("canonical"))
    return rows.groupBy("canonical").agg(F.count("*").alias("n"))


@query(f"""WITH {S.APPLOG}, s AS (SELECT {S.segments('line')} AS segs FROM applog), l AS (SELECT segs, list_filter(segs, lambda x: NOT regexp_matches(x, '^\\{{[a-z]+\\}}$')) AS lits FROM s)
  SELECT len(segs)::INTEGER AS tokens, len(lits)::INTEGER AS literals, coalesce(list_sum(list_transform(lits, lambda x: length(x))), 0)::INTEGER AS chars, count(*) AS n FROM l GROUP BY ALL""")
def template_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = applog(spark, sf_dir).select(T.segments(F.col("line")).alias("s"))
    rows = rows.select(F.size("s").alias("tokens"), T.literal_tokens(F.col("s")).alias("literals"), T.literal_chars(F.col("s")).alias("chars"))
    return rows.groupBy("tokens", "literals", "chars").agg(F.count("*").alias("n"))


@query(f"""WITH {S.LINES}, h AS (SELECT doc_id, ln, line, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS r FROM lines WHERE contains(lower(line), 'license'))
  SELECT doc_id, ln::INTEGER AS ln, line FROM h WHERE r <= 20""")
def search_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return shell.search(exploded_lines(read(spark, sf_dir, "documents")), "License")


@query("""SELECT event_id, CASE WHEN json_valid(props) THEN replace(props, ' ', '') ELSE props END AS small FROM events""")
def json_minify(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "events").select("event_id", X.json_minify(F.col("props")).alias("small"))


@query("""SELECT event_type, CASE json_type(props) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' END AS kind, count(*) AS n FROM events GROUP BY ALL""")
def json_schema(spark, sf_dir):  # noqa: ANN001, ANN201
    e = read(spark, sf_dir, "events")
    return e.groupBy("event_type", X.json_type(F.col("props")).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT n_chars * 37 AS ms, doc_id FROM documents)
  SELECT doc_id, CASE WHEN ms < 1000 THEN ms::VARCHAR || 'ms' WHEN ms < 60000 THEN (round(ms / 100.0)::BIGINT // 10)::VARCHAR || '.' || (round(ms / 100.0)::BIGINT % 10)::VARCHAR || 's' ELSE (ms // 60000)::VARCHAR || 'm' || (ms % 60000 // 1000)::VARCHAR || 's' END AS duration,
    CASE WHEN ms // 1000 <= 30 THEN 'just now' WHEN ms // 1000 <= 90 THEN 'a minute ago' WHEN ms // 1000 < 3600 THEN (ms // 60000)::VARCHAR || 'm ago' ELSE (ms // 3600000)::VARCHAR || 'h ago' END AS age,
    CASE WHEN ms // 1000 < 60 THEN (ms // 1000)::VARCHAR || 's' WHEN ms // 1000 < 3600 THEN (ms // 60000)::VARCHAR || 'm' WHEN ms // 1000 < 86400 THEN (ms // 3600000)::VARCHAR || 'h' ELSE (ms // 86400000)::VARCHAR || 'd' END AS span,
    (ms // 86400000)::BIGINT AS day FROM x""")
def scalar_texts(spark, sf_dir):  # noqa: ANN001, ANN201
    ms = F.col("n_chars") * 37
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", X.duration_text(ms).alias("duration"), X.age_text(ms).alias("age"), X.span_text(F.floor(ms / 1000)).alias("span"), X.day_number(ms).alias("day"))


@query("""SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS clipped, 'sha256:' || sha256(text) AS hash, substr(sha256(text), 1, 8) AS short,
    substr(sha256(lower(source)), 1, 12) AS project_id FROM documents""")
def hashes_and_clips(spark, sf_dir):  # noqa: ANN001, ANN201
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.clip(t, 40).alias("clipped"), X.content_hash(t).alias("hash"), X.short_hash(t).alias("short"), X.project_id(F.col("source")).alias("project_id"))


@query("""WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '"/usr/My Bin/Git.exe" status -s' WHEN 1 THEN 'cargo  test --lib' WHEN 2 THEN '' ELSE '/opt/NPM install left-pad' END AS command FROM orders)
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'git' WHEN 1 THEN 'cargo' WHEN 2 THEN '(unknown)' ELSE 'npm' END AS program, CASE o_orderkey % 4 WHEN 0 THEN 'Bin/Git.exe"' WHEN 1 THEN 'test' WHEN 3 THEN 'install' END AS subcommand FROM c""")
def command_scope(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey") % 4
    c = F.when(k == 0, '"/usr/My Bin/Git.exe" status -s').when(k == 1, "cargo  test --lib").when(k == 2, "").otherwise("/opt/NPM install left-pad")
    return read(spark, sf_dir, "orders").select("o_orderkey", X.program_of(c).alias("program"), X.subcommand_of(c).alias("subcommand"))
