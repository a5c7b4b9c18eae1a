"""Queries over ledgers, runs, stores, verdicts and rules, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import invariants as I
from gleaner.functions import text as X
from gleaner.operators import filtering, firewall, history, ledger, redact, rules, store, suggest
from gleaner.sources.tables import applog, exploded_lines, read, usage

from . import sql_views as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1_706_745_600_000  # 2024-02-01
TODAY = NOW // 86_400_000


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


_RANK = "CASE method WHEN 'provider' THEN 3 WHEN 'tokenizer' THEN 2 WHEN 'estimated' THEN 1 ELSE 0 END"
_SUMS = """count(*) AS runs, sum(tokens_before)::BIGINT AS tokens_before, sum(tokens_after)::BIGINT AS tokens_after,
    greatest(sum(tokens_before) - sum(tokens_after), 0)::BIGINT AS saved"""


@query(f"WITH {S.USAGE} SELECT project, {_SUMS}, min_by(method, {_RANK}) AS method, min(at_millis) AS first_millis, max(at_millis) AS last_millis FROM usage GROUP BY project")
def usage_by_project(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.by_project(usage(spark, sf_dir))


@query(f"WITH {S.USAGE} SELECT program, {_SUMS} FROM usage GROUP BY program")
def usage_by_program(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.by_program(usage(spark, sf_dir))


@query(f"""WITH {S.USAGE} SELECT coalesce(project, '*') AS project, coalesce(program, '*') AS program, grouping(project, program)::BIGINT AS level, {_SUMS}
  FROM usage GROUP BY ROLLUP(project, program)""")
def usage_rollup_sets(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.rollup_sets(usage(spark, sf_dir))


@query(f"WITH {S.USAGE} SELECT ((at_millis // 1000 + 3600) // 86400)::BIGINT AS day, {_SUMS} FROM usage GROUP BY 1")
def usage_daily(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.daily(usage(spark, sf_dir), offset_seconds=3600)


@query(f"""WITH {S.USAGE}, d AS (SELECT at_millis // 86400000 AS day, {_SUMS} FROM usage GROUP BY 1)
  SELECT {', '.join(f"coalesce(sum(saved) FILTER (day BETWEEN {TODAY - 5 - n + 1} AND {TODAY - 5}), 0)::BIGINT AS saved_{n}d" for n in (1, 7, 30))} FROM d""")
def usage_trailing_windows(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.trailing(usage(spark, sf_dir), TODAY - 5)


@query(f"""WITH {S.USAGE}, d AS (SELECT at_millis // 86400000 AS day, {_SUMS} FROM usage GROUP BY 1), s AS (SELECT unnest(range({TODAY - 40 + 1}, {TODAY + 1})) AS day)
  SELECT s.day, coalesce(d.runs, 0) AS runs, coalesce(d.saved, 0) AS saved FROM s LEFT JOIN d USING (day)""")
def usage_dense_days(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.dense_days(usage(spark, sf_dir), TODAY, 40)


_CUTOFF = NOW - 10 * 86_400_000


@query(f"""WITH {S.USAGE} SELECT t, at_millis, project, program, 1::BIGINT AS runs, tokens_before::BIGINT AS tokens_before, tokens_after::BIGINT AS tokens_after, method FROM usage WHERE at_millis >= {_CUTOFF}
  UNION ALL SELECT 'rollup', max(at_millis), project, NULL, count(*), sum(tokens_before)::BIGINT, sum(tokens_after)::BIGINT, min_by(method, {_RANK}) FROM usage WHERE at_millis < {_CUTOFF} GROUP BY project""")
def usage_compact(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.compact(usage(spark, sf_dir), _CUTOFF)


@query(f"WITH {S.USAGE} SELECT project, {_SUMS} FROM usage WHERE at_millis > 0 GROUP BY project")
def usage_compact_twice(spark, sf_dir):  # noqa: ANN001, ANN201
    """Totals after two compactions are those of the ledger before."""
    rows = ledger.compact(ledger.compact(usage(spark, sf_dir), _CUTOFF), NOW)
    return rows.groupBy("project").agg(*ledger.totals())


@query(f"WITH {S.USAGE} SELECT project, count(*) AS runs FROM usage WHERE project <> 'p7' GROUP BY project")
def usage_forget(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.forget(usage(spark, sf_dir), "p7").groupBy("project").agg(F.count("*").alias("runs"))


@query(f"""WITH {S.USAGE} SELECT program AS session_id, {_SUMS}, count(*) FILTER (tokens_after < tokens_before) AS transformed, sum(tokens_after % 2)::BIGINT AS secrets, min_by(method, {_RANK}) AS method
  FROM usage GROUP BY program""")
def session_gain(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = usage(spark, sf_dir).withColumn("session_id", F.col("program")).withColumn("transformed", F.col("tokens_after") < F.col("tokens_before"))
    return ledger.session_gain(rows.withColumn("secrets", F.col("tokens_after") % 2))


@query(f"""WITH {S.USAGE}, r AS (SELECT program AS transformer, CASE WHEN tokens_after < tokens_before * 0.95 THEN 'accepted' ELSE 'rejected' END AS validation, tokens_before, tokens_after FROM usage)
  SELECT transformer, count(*) FILTER (validation = 'accepted') AS accepted, count(*) FILTER (validation <> 'accepted') AS rejected, sum(tokens_before)::BIGINT AS tokens_before,
    sum(CASE WHEN validation = 'accepted' THEN tokens_after ELSE tokens_before END)::BIGINT AS tokens_after FROM r GROUP BY transformer""")
def transformer_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    ok = F.when(F.col("tokens_after") < F.col("tokens_before") * 0.95, "accepted").otherwise("rejected")
    return ledger.transformer_stats(usage(spark, sf_dir).withColumn("transformer", F.col("program")).withColumn("validation", ok))


def _runs(spark, sf_dir):  # noqa: ANN001, ANN202
    e = read(spark, sf_dir, "events")
    command = F.concat_ws("/", F.col("user_id").cast("string"), "event_type")
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("run_id"), command.alias("command"), millis.alias("ts_millis"), F.md5((F.col("event_id") % 3).cast("string")).alias("hash"))


_RUNS = "runs AS (SELECT event_id AS run_id, concat(user_id::VARCHAR, '/', event_type) AS command, epoch_us(ts) // 1000 AS ts_millis, md5((event_id % 3)::VARCHAR) AS hash FROM events)"


@query(f"""WITH {_RUNS}, p AS (SELECT *, lag(run_id) OVER w AS previous_id, lag(hash) OVER w AS previous_hash, ts_millis - lag(ts_millis) OVER w AS age_millis FROM runs
    WINDOW w AS (PARTITION BY command ORDER BY ts_millis, run_id))
  SELECT *, hash = previous_hash AS is_repeat FROM p WHERE age_millis <= 21600000""")
def repeat_previous(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.previous_run(_runs(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT command, hash, count(*) AS runs, min(run_id) AS first_id, max(run_id) AS last_id FROM runs GROUP BY ALL")
def repeat_count(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.repeat_counts(_runs(spark, sf_dir))


@query("""WITH l AS (SELECT conv_id AS pair, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), o AS (SELECT pair, rtrim(line) AS line, count(*) AS n FROM l WHERE turn % 2 = 0 GROUP BY ALL),
    w AS (SELECT pair, rtrim(line) AS line, count(*) AS n FROM l WHERE turn % 2 = 1 GROUP BY ALL), b AS (SELECT pair, o.n AS a, w.n AS b FROM o FULL JOIN w USING (pair, line)),
    s AS (SELECT pair, coalesce(sum(b) FILTER (a IS NOT NULL), 0)::BIGINT AS unchanged, coalesce(sum(b) FILTER (a IS NULL), 0)::BIGINT AS added, coalesce(sum(a) FILTER (b IS NULL), 0)::BIGINT AS removed FROM b GROUP BY pair)
  SELECT *, unchanged > 0 AND added < unchanged AS worth FROM s""")
def delta_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    c = exploded_lines(read(spark, sf_dir, "conversations"), ("conv_id", "turn")).select(F.col("conv_id").alias("pair"), "turn", "line")
    return history.delta_worth(history.delta_lines(c.filter("turn % 2 = 0"), c.filter("turn % 2 = 1")))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*) AS refs, max(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.dedup(read(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256)))


@query("""WITH h AS (SELECT DISTINCT md5(l_orderkey::VARCHAR) AS hash FROM lineitem), c AS (SELECT hash, count(*) OVER (PARTITION BY substr(hash, 1, 5)) AS a, count(*) OVER (PARTITION BY substr(hash, 1, 7)) AS b,
    count(*) OVER (PARTITION BY substr(hash, 1, 9)) AS c, count(*) OVER (PARTITION BY substr(hash, 1, 11)) AS d FROM h)
  SELECT hash, CASE WHEN a = 1 THEN substr(hash, 1, 5) WHEN b = 1 THEN substr(hash, 1, 7) WHEN c = 1 THEN substr(hash, 1, 9) WHEN d = 1 THEN substr(hash, 1, 11) ELSE '' END AS handle FROM c""")
def short_handles(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.short_handles(read(spark, sf_dir, "lineitem").select(F.md5(F.col("l_orderkey").cast("string")).alias("hash")))


@query("""WITH b AS (SELECT DISTINCT sha256(text) AS hash FROM documents), c AS (SELECT sha256(text) AS hash FROM documents WHERE lang <> 'fr') SELECT hash FROM b WHERE hash NOT IN (SELECT hash FROM c)""")
def blob_refs(spark, sf_dir):  # noqa: ANN001, ANN201
    d = read(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    return store.unreferenced(d.select("hash").distinct(), d.filter("lang <> 'fr'"))


@query("""WITH h AS (SELECT DISTINCT sha256(text) AS hash FROM documents), w AS (SELECT DISTINCT substr(sha256(text), 1, 2 + (doc_id % 3)::INTEGER) AS prefix FROM documents), j AS (SELECT prefix, count(hash) AS matches, min(hash) AS hash FROM w JOIN h ON starts_with(hash, prefix) GROUP BY prefix)
  SELECT prefix, matches, CASE WHEN matches = 1 THEN hash END AS found FROM j""")
def prefix_lookup(spark, sf_dir):  # noqa: ANN001, ANN201
    d = read(spark, sf_dir, "documents").withColumn("hash", F.sha2("text", 256))
    wanted = d.select(F.expr("substring(hash, 1, 2 + cast(doc_id % 3 as int))").alias("prefix")).distinct()
    return store.resolve(d.select("hash").distinct(), wanted)


@query("SELECT doc_id FROM documents WHERE n_chars * 1000 <= 2000000")
def gc_expired(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.expired(read(spark, sf_dir, "documents").withColumn("expires_millis", F.col("n_chars") * 1000), 2_000_000).select("doc_id")


@query("""WITH c AS (SELECT doc_id AS id, doc_id * 13 % 9973 AS created, n_chars AS bytes FROM documents), t AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(bytes) OVER () AS total FROM c)
  SELECT id, created, bytes FROM t WHERE total - gone > 500000""")
def gc_size_evict(spark, sf_dir):  # noqa: ANN001, ANN201
    d = read(spark, sf_dir, "documents")
    return store.evict(d.select(F.col("doc_id").alias("id"), (F.col("doc_id") * 13 % 9973).alias("created"), F.col("n_chars").alias("bytes")), 500_000)


_TEXTS = f"{S.APPLOG}, t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) AS text FROM applog GROUP BY doc_id)"


def _log_texts(spark, sf_dir):  # noqa: ANN001, ANN202
    d = applog(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    return d.select("doc_id", F.array_join(F.transform("l", lambda x: x.line), "\n").alias("text"))


_BEFORE, _AFTER = S.tokens("text"), S.tokens("output")


@query(f"""WITH {_TEXTS}, o AS (SELECT *, substr(text, 1, (length(text) * (50 + doc_id % 51) // 100)::INTEGER) AS output FROM t), k AS (SELECT doc_id, {_BEFORE}::BIGINT AS tokens_before, {_AFTER}::BIGINT AS tokens_after FROM o)
  SELECT *, tokens_before > 0 AND tokens_after > floor(tokens_before * (1 - 0.05)) AS too_little FROM k""")
def firewall_gain(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _log_texts(spark, sf_dir).withColumn("output", F.expr("substring(text, 1, cast(char_length(text) * (50 + doc_id % 51) div 100 as int))"))
    rows = rows.select("doc_id", X.token_estimate(F.col("text")).alias("tokens_before"), X.token_estimate(F.col("output")).alias("tokens_after"))
    return rows.withColumn("too_little", firewall.too_little(F.col("tokens_before"), F.col("tokens_after")))


_P = {k: I.PATTERNS[k] for k in I.MANDATORY_KINDS}
_MISSING = " OR ".join(f"len(list_filter(regexp_extract_all(region, '{p}')[1:128], lambda v: NOT contains(output, v))) > 0" for p in (_P[k].replace("'", "''") for k in I.MANDATORY_KINDS))


@query(f"""WITH {_TEXTS}, r AS (SELECT doc_id, coalesce(string_agg(line || chr(10), '' ORDER BY ln) FILTER ({S.critical('line')}), '') AS region FROM applog GROUP BY doc_id),
    o AS (SELECT t.doc_id, text, region, CASE doc_id % 3 WHEN 0 THEN substr(text, 1, 400) WHEN 1 THEN region ELSE text END AS output, doc_id % 5 = 0 AS lossy FROM t JOIN r USING (doc_id)),
    k AS (SELECT *, {_BEFORE} AS b, {_AFTER} AS a FROM o)
  SELECT doc_id, CASE WHEN lossy THEN 'policy_disabled' WHEN {_MISSING} THEN 'invariant_lost' WHEN b > 0 AND a > floor(b * (1 - 0.05)) THEN 'insufficient_gain' ELSE 'accepted' END AS verdict FROM k""")
def firewall_review(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _log_texts(spark, sf_dir)
    k = F.col("doc_id") % 3
    out = F.when(k == 0, F.substring("text", 1, 400)).when(k == 1, X.critical_region(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("output", out).withColumn("lossy", F.col("doc_id") % 5 == 0).withColumn("reparse", F.lit("none"))
    return firewall.review(rows).select("doc_id", "verdict")


@query("""WITH c AS (SELECT doc_id, text, 0 AS ord, substr(text, 1, 300) AS output FROM documents UNION ALL SELECT doc_id, text, 1, substr(text, 1, 200 + (doc_id % 2)::INTEGER * 200) FROM documents), k AS (SELECT *, """ + _BEFORE + " AS b, " + _AFTER + """ AS a FROM c), v AS (SELECT * FROM k WHERE NOT (b > 0 AND a > floor(b * (1 - 0.05))))
  SELECT doc_id, min_by(ord, struct_pack(n := strlen(output), o := ord))::INTEGER AS ord, min_by(output, struct_pack(n := strlen(output), o := ord)) AS output FROM v GROUP BY doc_id""")
def smallest_candidate(spark, sf_dir):  # noqa: ANN001, ANN201
    d = firewall.facts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    forms = F.array(F.substring("text", 1, 300), F.expr("substring(text, 1, 200 + cast(doc_id % 2 as int) * 200)"))
    both = d.select("*", F.posexplode(forms).alias("ord", "output")).withColumn("lossy", F.lit(True)).withColumn("reparse", F.lit("none"))
    return firewall.smallest(firewall.review(both, mode="balanced"))


_T = "2024-01-01 00:00:00"


def _rules(spark, actions=("drop", "fold", "keep")):  # noqa: ANN001, ANN202
    rows = [
        ("r1", None, None, f"{_T} INFO {{*}} event=click {{*}}", "drop", ""),
        ("r2", None, None, f"{_T} WARN {{*}} event=purchase {{*}}", "fold", "purchases"),
        ("r3", None, None, f"{_T} ERROR {{*}} event=error {{*}} failed: expected {{*}} got {{*}} at src/app.py:1", "drop", ""),
        ("r4", None, None, f"{_T} INFO {{*}} event=signup {{*}}", "keep", ""),
    ]
    return rules.rule_table(spark, [r for r in rows if r[4] in actions])


_STATE = f"""WITH {S.APPLOG}, m AS (SELECT doc_id, ln, line, event_type, {S.critical('line')} AS critical FROM applog)"""


@query(f"""{_STATE} SELECT doc_id, ln::INTEGER AS ln, CASE event_type WHEN 'click' THEN 'r1' WHEN 'purchase' THEN 'r2' WHEN 'error' THEN 'r3' WHEN 'signup' THEN 'r4' END AS rule_id, critical FROM m""")
def rule_match_wildcard(spark, sf_dir):  # noqa: ANN001, ANN201
    return rules.matched(applog(spark, sf_dir).select("doc_id", "ln", "line"), _rules(spark)).select("doc_id", "ln", "rule_id", "critical")


@query(f"""WITH {S.LINES}, k AS (SELECT *, regexp_matches(line, '^Licensed under the (MIT License|Apache License, Version [0-9.]+)[.]$') AS hit FROM lines)
  SELECT doc_id, ln::INTEGER AS ln, line, CASE WHEN contains(line, 'MIT') THEN 'mit' ELSE 'apache' END AS rule_id FROM k WHERE hit""")
def rule_match_equi(spark, sf_dir):  # noqa: ANN001, ANN201
    table = rules.rule_table(
        spark,
        [("mit", None, None, "Licensed under the MIT License.", "drop", ""), ("apache", None, None, "Licensed under the Apache License, Version 2.0.", "drop", "")],
    )
    hits = rules.matched(exploded_lines(read(spark, sf_dir, "documents")), table)
    return hits.filter(F.col("rule_id").isNotNull()).select("doc_id", "ln", "line", "rule_id")


@query("""WITH r AS (SELECT * FROM (VALUES ('a', NULL, NULL), ('b', 'GIT', NULL), ('c', 'git', 'log'), ('d', 'npm', NULL)) AS t(id, p, s)), d AS (SELECT o_orderkey, [NULL, 'git', 'Npm', 'git'][o_orderkey % 4 + 1] AS program, [NULL, 'log', 'ci', 'diff'][o_orderkey % 4 + 1] AS subcommand FROM orders)
  SELECT o_orderkey, count(*) AS rules FROM d JOIN r ON (p IS NULL OR lower(p) = lower(program)) AND (s IS NULL OR lower(s) = lower(subcommand)) GROUP BY 1""")
def scope_applicability(spark, sf_dir):  # noqa: ANN001, ANN201
    table = spark.createDataFrame([("a", None, None), ("b", "GIT", None), ("c", "git", "log"), ("d", "npm", None)], "id string, r_program string, r_subcommand string")
    k = F.col("o_orderkey") % 4
    d = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 1, "git").when(k == 2, "Npm").when(k == 3, "git").alias("program"), F.when(k == 1, "log").when(k == 2, "ci").when(k == 3, "diff").alias("subcommand"))
    return d.join(F.broadcast(table), rules.applies(F.col("program"), F.col("subcommand"))).groupBy("o_orderkey").agg(F.count("*").alias("rules"))


@query(f"{_STATE} SELECT doc_id, ln::INTEGER AS ln, line FROM m WHERE event_type <> 'click' OR critical")
def filter_drop(spark, sf_dir):  # noqa: ANN001, ANN201
    return filtering.filtered(applog(spark, sf_dir).select("doc_id", "ln", "line"), _rules(spark, ("drop",)))


@query(f"""{_STATE}, f AS (SELECT *, event_type = 'purchase' AND NOT critical AS fold FROM m), g AS (SELECT *, CASE WHEN fold AND lag(fold) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY ln)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ln) AS run FROM g)
  SELECT doc_id, min(ln)::INTEGER AS ln, CASE WHEN fold THEN concat('[folded] purchases (', count(*)::VARCHAR, ' line(s))') ELSE min(line) END AS line FROM r GROUP BY doc_id, run, fold""")
def filter_fold(spark, sf_dir):  # noqa: ANN001, ANN201
    return filtering.filtered(applog(spark, sf_dir).select("doc_id", "ln", "line"), _rules(spark, ("fold",)))


@query(f"{_STATE} SELECT doc_id, ln::INTEGER AS ln, line FROM m WHERE event_type = 'signup' OR critical")
def filter_keep(spark, sf_dir):  # noqa: ANN001, ANN201
    """A whitelist without a scope holds for every text, also for one of which it names no line."""
    return filtering.filtered(applog(spark, sf_dir).select("doc_id", "ln", "line"), _rules(spark, ("keep",)))


@query(f"""{_STATE}, b AS (SELECT doc_id, ln * 2 AS ln, line, event_type, critical FROM m UNION ALL SELECT doc_id, ln * 2 + 1, '', NULL, false FROM m)
  SELECT doc_id, ln::INTEGER AS ln, line FROM (SELECT *, last_value(event_type IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln) AS before FROM b) WHERE before <> 'click'""")
def blank_collapse(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = applog(spark, sf_dir).select("doc_id", "ln", "line")
    both = rows.withColumn("ln", F.col("ln") * 2).unionByName(rows.select("doc_id", (F.col("ln") * 2 + 1).alias("ln"), F.lit("").alias("line")))
    return filtering.filtered(both, _rules(spark, ("drop",)))


_TAKEN = f"""{_STATE}, u AS (SELECT *, CASE event_type WHEN 'click' THEN 'r1' WHEN 'purchase' THEN 'r2' WHEN 'error' THEN 'r3' WHEN 'signup' THEN 'r4' END AS id FROM m),
    t AS (SELECT *, CASE WHEN id IN ('r1', 'r2', 'r3') AND NOT critical THEN id END AS rule FROM u), n AS (SELECT *, rule IS DISTINCT FROM lag(rule) OVER (PARTITION BY doc_id ORDER BY ln) AS new FROM t),
    a AS (SELECT rule AS rule_id, count(DISTINCT doc_id) AS docs, count(*) AS lines, sum({S.tokens('line')})::BIGINT AS tokens, count(*) FILTER (new) AS runs, 0 AS protected FROM n WHERE rule IS NOT NULL GROUP BY rule
      UNION ALL SELECT 'r4', count(DISTINCT doc_id), 0, 0, count(*), 0 FROM n WHERE id = 'r4' HAVING count(*) > 0
      UNION ALL SELECT id, 0, 0, 0, 0, count(*) FROM u WHERE critical AND id <> 'r4' GROUP BY id),
    g AS (SELECT rule_id, sum(docs)::BIGINT AS docs, sum(lines)::BIGINT AS lines, sum(tokens)::BIGINT AS tokens, sum(runs)::BIGINT AS runs, sum(protected)::BIGINT AS protected FROM a GROUP BY rule_id)"""


@query(f"{_TAKEN} SELECT * FROM g")
def rule_accounting(spark, sf_dir):  # noqa: ANN001, ANN201
    return filtering.accounting(*filtering.decided(applog(spark, sf_dir).select("doc_id", "ln", "line"), _rules(spark)))


@query("""WITH r AS (SELECT concat('f', (o_custkey % 50)::VARCHAR) AS id, o_orderkey % 7 AS hits, o_orderkey % 11 AS lines_removed, o_orderkey * 1000 AS created_millis, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS last_hit_millis, o_orderkey % 97 <> 0 AS enabled, o_orderkey % 101 = 0 AS forced FROM orders)
  SELECT id, sum(hits)::BIGINT AS hits, sum(lines_removed)::BIGINT AS lines_removed, min(created_millis) AS created_millis, max(last_hit_millis) AS last_hit_millis, bool_and(enabled) AS enabled, bool_or(forced) AS forced FROM r GROUP BY id""")
def rule_set_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("f"), (F.col("o_custkey") % 50).cast("string")).alias("id"), (k % 7).alias("hits"), (k % 11).alias("lines_removed"), (k * 1000).alias("created_millis"),
        F.when(k % 3 == 0, k).alias("last_hit_millis"), (k % 97 != 0).alias("enabled"), (k % 101 == 0).alias("forced"), k.alias("_k"),
    )
    return rules.merge_sets(r.filter("_k % 2 = 0").drop("_k"), r.filter("_k % 2 = 1").drop("_k"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 > 0 OR o_orderkey * 1000000 >= 20000000000 - 8640000000")
def rule_prune(spark, sf_dir):  # noqa: ANN001, ANN201
    r = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 5).alias("hits"), (F.col("o_orderkey") * 1_000_000).alias("created_millis"))
    return rules.prune(r, 20_000_000_000, 100).select("o_orderkey")


_EMAIL, _IPV4 = (dict((k, p) for k, p, _ in redact.PII_RULES)[k] for k in ("email", "ipv4"))


@query(f"""SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '{_IPV4}'), lambda v: v <> ''))) AS ipv4 FROM documents WHERE regexp_matches(text, '{_IPV4}')""")
def redact_ipv4(spark, sf_dir):  # noqa: ANN001, ANN201
    """Distinct addresses of each text, by the native form of one kind of rule."""
    found = F.array_distinct(F.regexp_extract_all("text", F.lit(_IPV4), F.lit(1)))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("ipv4")).filter("ipv4 > 0")


def redact_text(spark, sf_dir):  # noqa: ANN001, ANN201
    """Texts without secrets and personal data, and how many hits of which kinds."""
    out = redact.redacted(read(spark, sf_dir, "documents").select("doc_id", "text"), pii=True)
    return out.select("doc_id", "redaction.text", F.transform("redaction.hits", lambda h: h.kind).alias("kinds"))


QUERIES["redact_text"] = redact_text


@query("SELECT doc_id, text FROM documents")
def redact_restore(spark, sf_dir):  # noqa: ANN001, ANN201
    """Restoring gives the original back, for every text."""
    out = redact.redacted(read(spark, sf_dir, "documents").select("doc_id", "text"), pii=True)
    return out.select("doc_id", redact.restored(F.col("redaction.text"), F.col("redaction.mapping")).alias("text"))


@query(f"""WITH {S.USAGE} SELECT coalesce(program, '*') AS program, coalesce(method, '*') AS method, grouping(program, method)::BIGINT AS level, {_SUMS}, min(at_millis) AS first_millis, max(at_millis) AS last_millis
  FROM usage GROUP BY GROUPING SETS ((), (program), (method))""")
def usage_lifetime_sets(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.lifetime(usage(spark, sf_dir))


AGO = "CASE WHEN {0} // 1000 <= 30 THEN 'just now' WHEN {0} // 1000 <= 90 THEN 'a minute ago' WHEN {0} // 1000 < 3600 THEN concat(({0} // 60000)::VARCHAR, 'm ago') ELSE concat(({0} // 3600000)::VARCHAR, 'h ago') END"


@query(f"""WITH {_RUNS}, p AS (SELECT *, lag(run_id) OVER w AS previous_id, lag(hash) OVER w AS previous_hash, ts_millis - lag(ts_millis) OVER w AS age FROM runs WINDOW w AS (PARTITION BY command ORDER BY ts_millis, run_id))
  SELECT run_id, concat('[repeat] identical to cap://', previous_id::VARCHAR, ' (', {AGO.format('age')}, ')', chr(10)) AS output FROM p WHERE age <= 21600000 AND hash = previous_hash""")
def repeat_candidates(spark, sf_dir):  # noqa: ANN001, ANN201
    return history.repeat_candidates(history.previous_run(_runs(spark, sf_dir)))


_SHAPES = f"""WITH {S.LINES}, s AS (SELECT source AS scope, doc_id AS run, ln, line, array_to_string({S.segments('line')}, ' ') AS shape, {S.tokens('line')} AS tok, len({S.segments('line')}) AS n FROM lines WHERE trim(line) <> '' AND NOT {S.critical('line')}),
    o AS (SELECT source AS scope, count(*) AS of_runs FROM documents GROUP BY source),
    g AS (SELECT scope, shape, count(DISTINCT run) AS runs, count(*) AS lines, sum(tok)::BIGINT AS tokens, min_by(line, {{'a': run, 'b': ln}}) AS example FROM s WHERE n BETWEEN 1 AND 64 GROUP BY scope, shape)"""


@query(f"""{_SHAPES}
  SELECT scope, shape, runs, lines, tokens, example, of_runs FROM g JOIN o USING (scope) WHERE runs >= 2""")
def suggest_shapes(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("run"), "text")
    return suggest.suggestions(exploded_lines(docs, ("run", "scope")), runs=docs.select("scope"))


@query(f"""{_SHAPES}, r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY tokens DESC, encode(shape)) AS k FROM g WHERE runs >= 2)
  SELECT scope, concat('<filter-trash>', chr(10), string_agg(example, chr(10) ORDER BY k), chr(10), '</filter-trash>', chr(10)) AS lesson FROM r WHERE k <= 20 GROUP BY scope""")
def suggest_drafts(spark, sf_dir):  # noqa: ANN001, ANN201
    """A draft lesson for each source."""
    return suggest.draft(suggest_shapes(spark, sf_dir))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN NULL WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) ELSE text END AS content, doc_id % 5 = 0 AND doc_id % 3 <> 0 AS withheld FROM documents""")
def capsule_retrieve(spark, sf_dir):  # noqa: ANN001, ANN201
    d = read(spark, sf_dir, "documents")
    levels = F.when(F.col("doc_id") % 3 == 0, F.create_map(F.lit(1), F.substring("text", 1, 20))).otherwise(F.create_map().cast("map<int,string>"))
    capsules = d.select("doc_id", F.col("text").alias("raw"), levels.alias("levels"), F.when(F.col("doc_id") % 5 == 0, "secret").otherwise("public").alias("sensitivity"))
    return store.retrieve(capsules, 2).select("doc_id", "content", "withheld")
