"""Queries over runs of commands: repeats within sessions, history in the reduction, replay."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import filtering, history, redact, reduce, reports, rules
from gleaner.sources import logs as files
from gleaner.sources.scratch import scratch_path
from gleaner.sources.tables import applog, exploded_lines, read

from .relational_queries import _TAKEN, AGO, _rules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _runs(spark, sf_dir):  # noqa: ANN001, ANN202
    """The events as runs: a session for each quarter of a day, a few commands, texts of twelve lines of which one or two change."""
    e = read(spark, sf_dir, "events")
    k, word = F.col("event_id"), lambda c: F.translate(c.cast("string"), "0123456789", "abcdefghij")
    session = F.concat(F.date_format("ts", "yyyy-MM-dd "), F.floor(F.hour("ts") / 6).cast("string"))
    same = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("checked part "), word(i), F.lit(" of all\n"))), "")
    failed = F.when(F.col("event_type") == "error", "error: expected 200 got 500 at src/app.py:7\n").otherwise("")
    text = F.concat(same, failed, F.lit("state "), word(k % 3), F.lit("\n"), F.when(k % 2 == 0, "the even one\n").otherwise(""))
    command = F.concat_ws("/", (F.col("user_id") % 10).cast("string"), "event_type")
    return e.select(k.alias("run_id"), session.alias("session_id"), command.alias("command"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_millis"), text.alias("text"))


_WORD = "translate(({})::VARCHAR, '0123456789', 'abcdefghij')"
_SAME = f"array_to_string(list_transform(range(10), lambda i: concat('checked part ', {_WORD.format('i')}, ' of all', chr(10))), '')"
_FAILED = "CASE WHEN event_type = 'error' THEN concat('error: expected 200 got 500 at src/app.py:7', chr(10)) ELSE '' END"
_RUNS = f"""e AS (SELECT event_id AS run_id, strftime(ts, '%Y-%m-%d ') || (hour(ts) // 6)::VARCHAR AS session_id, concat((user_id % 10)::VARCHAR, '/', event_type) AS command, epoch_us(ts) // 1000 AS ts_millis,
    event_type, event_id % 6 AS hash, {_FAILED} AS failed, concat('state ', {_WORD.format('event_id % 3')}, chr(10)) AS state, CASE WHEN event_id % 2 = 0 THEN concat('the even one', chr(10)) ELSE '' END AS even FROM events),
  s AS (SELECT session_id, row_number() OVER (ORDER BY session_id) AS number FROM (SELECT DISTINCT session_id FROM e)),
  r AS (SELECT e.*, number, concat({_SAME}, failed, state, even) AS text FROM e JOIN s USING (session_id)),
  l AS (SELECT *, lag(run_id) OVER w AS previous_id, lag(hash) OVER w AS previous_hash, lag(number) OVER w AS previous_number, lag(state) OVER w AS old_state, lag(even) OVER w AS old_even, ts_millis - lag(ts_millis) OVER w AS age FROM r
    WINDOW w AS (PARTITION BY command ORDER BY number, ts_millis, run_id)),
  p AS (SELECT *, (SELECT count(*) FROM r x JOIN r y ON y.run_id = l.previous_id WHERE x.command = l.command AND x.number = l.previous_number AND x.hash = l.previous_hash
      AND (x.ts_millis, x.run_id) < (y.ts_millis, y.run_id) AND x.ts_millis >= l.ts_millis - 21600000) AS repeats FROM l WHERE number - previous_number < 3 AND age <= 21600000)"""


@query(f"WITH {_RUNS} SELECT run_id, previous_id, age AS age_millis, hash = previous_hash AS is_repeat, repeats FROM p")
def repeat_walk(spark, sf_dir):  # noqa: ANN001, ANN201
    """The previous run of a command in the last three sessions, and how often its output had come before in its session."""
    runs = _runs(spark, sf_dir).withColumn("hash", F.sha2("text", 256))
    return history.previous_run(runs).select("run_id", "previous_id", "age_millis", "is_repeat", "repeats")


@query(f"""WITH {_RUNS}, c AS (SELECT run_id, CASE WHEN hash = previous_hash THEN 'repeat.suppress' ELSE 'delta.lines' END AS transformer, CASE WHEN hash = previous_hash
      THEN concat('[repeat] identical to cap://', previous_id::VARCHAR, ' (', {AGO.format('age')}, CASE WHEN repeats > 0 THEN concat(', ', repeats::VARCHAR, ' identical run(s) before that') ELSE '' END, ')', chr(10), failed)
      ELSE concat('[delta] vs cap://', previous_id::VARCHAR, ' (', {AGO.format('age')}, ')', chr(10),
        'unchanged=', (10 + (failed <> '')::INTEGER + (state = old_state)::INTEGER + (even <> '' AND even = old_even)::INTEGER)::VARCHAR, ' added=', ((state <> old_state)::INTEGER + (even <> '' AND old_even = '')::INTEGER)::VARCHAR,
        ' removed=', ((state <> old_state)::INTEGER + (even = '' AND old_even <> '')::INTEGER)::VARCHAR, chr(10), CASE WHEN state <> old_state THEN state ELSE '' END, CASE WHEN old_even = '' THEN even ELSE '' END, failed) END AS output FROM p)
  SELECT r.run_id, c.transformer, coalesce(c.output, r.text) AS output FROM r LEFT JOIN c USING (run_id)""")
def reduce_history(spark, sf_dir):  # noqa: ANN001, ANN201
    """The reduction of runs against their past alone: pointers to equal runs, deltas to similar ones, first runs as they are."""
    return reduce.reduce_runs(_runs(spark, sf_dir), compilers=()).select("run_id", "transformer", "output")


def reduce_runs(spark, sf_dir):  # noqa: ANN001, ANN201
    """The reduction of runs by all compilers and against their past."""
    return reduce.reduce_runs(_runs(spark, sf_dir), mode="balanced")


QUERIES["reduce_runs"] = reduce_runs


def _texts(spark, sf_dir, *parts):  # noqa: ANN001, ANN002, ANN202
    text = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return exploded_lines(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


@query("""SELECT p_partkey AS doc_id, p_partkey % 90 AS passed, p_partkey % 4 AS failed, (p_partkey % 3)::BIGINT AS warnings, CASE WHEN p_partkey % 4 > 0 THEN 'fail' ELSE 'pass' END AS status, concat((p_partkey % 60)::VARCHAR, '.25s') AS duration FROM part""")
def test_report_pytest(spark, sf_dir):  # noqa: ANN001, ANN201
    """Totals of test sessions: the last summary line counts, whatever earlier ones say."""
    k = F.col("p_partkey")
    rows = _texts(spark, sf_dir, "==== test session starts ====\n==== 9 failed, 9 passed in 1.00s ====\n==== ", k % 4, " failed, ", k % 90, " passed, ", k % 3, " warnings in ", k % 60, ".25s ====\n")
    return reports.pytest_totals(rows).select("doc_id", "passed", "failed", "warnings", "status", "duration")


@query("""SELECT p_partkey AS doc_id, p_partkey % 90 AS passed, p_partkey % 4 AS failed, CASE WHEN p_partkey % 4 > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN p_partkey % 2 = 0 THEN 'vitest' ELSE 'jest' END AS framework FROM part""")
def test_report_jest(spark, sf_dir):  # noqa: ANN001, ANN201
    """Totals of script tests, and which of two tools printed them."""
    k = F.col("p_partkey")
    rows = _texts(spark, sf_dir, "PASS src/a.test.ts\n", F.when(k % 2 == 0, " Test Files  1 passed\n").otherwise("Test Suites: 1 passed\n"), "Tests:       ", k % 4, " failed, ", k % 90, " passed, 100 total\n")
    return reports.jest_totals(rows).select("doc_id", "passed", "failed", "status", "framework")


@query("""SELECT p_partkey AS doc_id, concat('E', (1000 + p_partkey % 9000)::VARCHAR) AS code, concat('cannot find value `', p_brand, '`') AS message, concat('src/main.rs:', p_partkey::VARCHAR, ':5') AS location FROM part""")
def test_report_build(spark, sf_dir):  # noqa: ANN001, ANN201
    """Errors of builds: their code, message and place."""
    k = F.col("p_partkey")
    rows = _texts(spark, sf_dir, "   Compiling a v0.1.0\nerror[E", 1000 + k % 9000, "]: cannot find value `", F.col("p_brand"), "`\n  --> src/main.rs:", k, ":5\n   |\nerror: aborting due to 1 previous error\n")
    return reports.build_errors(rows).filter("location is not null").select("doc_id", "code", "message", "location")


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 OR event_id % 3 = 2 THEN 'unavailable' WHEN event_id % 4 < 2 AND event_id % 3 = 0 THEN 'tokenizer' ELSE 'estimated' END AS method, greatest(event_id % 50 - event_id % 70, 0) AS saved FROM events""")
def saved_tokens(spark, sf_dir):  # noqa: ANN001, ANN201
    """What was saved, and by which method that is known."""
    k = F.col("event_id")
    methods = F.array(*[F.lit(m) for m in ("provider", "tokenizer", "estimated", "unavailable")])
    before, after = F.get(methods, (k % 4).cast("int")), F.get(F.array(F.lit("tokenizer"), F.lit("estimated"), F.lit("unavailable")), (k % 3).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", X.saved_method(before, after).alias("method"), X.saved(k % 50, k % 70).alias("saved"))


@query("""SELECT p_partkey, concat('tool --name ', CASE WHEN contains(p_name, ' ') THEN concat('"', p_name, '"') ELSE p_name END, ' ', p_brand) AS line FROM part""")
def command_lines(spark, sf_dir):  # noqa: ANN001, ANN201
    return read(spark, sf_dir, "part").select("p_partkey", X.command_line(F.array(F.lit("tool"), F.lit("--name"), "p_name", "p_brand")).alias("line"))


@query("""SELECT event_id, event_id % 5 IN (0, 2) AS secret FROM events""")
def secrets_found(spark, sf_dir):  # noqa: ANN001, ANN201
    """Texts that hold a secret; known placeholders and code are none."""
    k = F.col("event_id")
    text = F.when(k % 5 == 0, F.concat(F.lit("password=hunter"), F.md5(k.cast("string")))).when(k % 5 == 1, "password=changeme-example").when(k % 5 == 2, F.concat(F.lit("https://me:"), F.md5(k.cast("string")), F.lit("@host/x")))
    text = text.when(k % 5 == 3, "token = make_token(ttl=-1)").otherwise("no such thing")
    return read(spark, sf_dir, "events").select("event_id", redact.has_secret(text).alias("secret"))


@query(f"{_TAKEN} SELECT rule_id, tokens FROM g WHERE lines > 0 ORDER BY tokens DESC, rule_id LIMIT 30")
def rule_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    """The rules that took lines, those that saved most first."""
    used = filtering.accounting(*filtering.decided(applog(spark, sf_dir).select("doc_id", "ln", "line"), _rules(spark)))
    return rules.hit_order(used.filter("lines > 0")).select("rule_id", "tokens")


@query("""WITH s AS (SELECT strftime(ts, '%Y%m%d') AS session_id, concat('e', (event_id % 1000)::VARCHAR, 'x', event_id::VARCHAR) AS id, epoch_us(ts) // 1000 AS ms FROM events),
    f AS (SELECT * FROM s WHERE starts_with(id, 'e7') ORDER BY session_id DESC, ms, id LIMIT 1)
  SELECT session_id, count(*) AS events, (SELECT id FROM f) AS found FROM s GROUP BY session_id""")
def event_log(spark, sf_dir):  # noqa: ANN001, ANN201
    """Events written by session and read again, and the one that a prefix finds in the newest session."""
    e = read(spark, sf_dir, "events")
    ident = F.concat(F.lit("e"), (F.col("event_id") % 1000).cast("string"), F.lit("x"), F.col("event_id").cast("string"))
    rows = e.select(ident.alias("id"), F.date_format("ts", "yyyyMMdd").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_millis"))
    path = scratch_path(spark, "events")
    files.write_events(rows, path)
    back = files.read_events(spark, path)
    found = files.find_event(back, "e7").select(F.col("id").alias("found"))
    named = files.sessions(back).join(back.groupBy("session_id").agg(F.count("*").alias("events")), "session_id")
    return named.join(found, how="left").select(F.col("session_id").cast("string").alias("session_id"), "events", "found")  # one row is found
