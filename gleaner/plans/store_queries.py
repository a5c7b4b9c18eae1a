"""Queries over the sinks, the stateful stream, lookups, ids and rule files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import learning, ledger, lesson_sources, reduce, store
from gleaner.sources import rule_files
from gleaner.sources.blobs import BlobStore
from gleaner.sources.ledger_sink import LedgerSink
from gleaner.sources.scratch import materialize, scratch_path
from gleaner.sources.tables import read, usage
from gleaner.streaming import events as E

from . import sql_views as S
from .relational_queries import _RUNS, _SUMS, NOW

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query("""WITH d AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL), f AS (SELECT DISTINCT text FROM documents WHERE lang <> 'fr')
  SELECT (SELECT count(*) FROM f) AS first_written, (SELECT count(*) FROM d) - (SELECT count(*) FROM f) AS then_written, 0::BIGINT AS last_written, (SELECT count(*) FROM d) AS blobs, (SELECT sum(strlen(text)) FROM d)::BIGINT AS bytes""")
def store_put(spark, sf_dir):  # noqa: ANN001, ANN201
    """Originals put into a store on disk in three goes: each content is written once."""
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.col("text").alias("content"), "lang")
    place = BlobStore(spark, scratch_path(spark, "store"))
    wrote = [place.put(rows).agg(F.count("*").alias(name)) for name, rows in (("first_written", d.filter("lang <> 'fr'")), ("then_written", d), ("last_written", d))]
    return wrote[0].join(wrote[1]).join(wrote[2]).join(place.stats().drop("stored_bytes"))  # a row each


_CAPSULES = """c AS (SELECT sha256(text) AS hash, min(doc_id) AS id, min(doc_id * 13 % 9973) AS created, any_value(strlen(text)) AS bytes, min(doc_id) % 4 = 0 AS expired FROM documents WHERE text IS NOT NULL GROUP BY 1),
  t AS (SELECT *, coalesce(sum(bytes) OVER (ORDER BY created, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone, sum(bytes) OVER () AS total FROM c WHERE NOT expired),
  e AS (SELECT * FROM t WHERE total - gone > 200000)"""


@query(f"""WITH {_CAPSULES} SELECT count(*) FILTER (expired) AS expired, (SELECT count(*) FROM e) AS evicted, (coalesce(sum(bytes) FILTER (expired), 0) + (SELECT coalesce(sum(bytes), 0) FROM e))::BIGINT AS bytes,
    count(*) FILTER (expired) + (SELECT count(*) FROM e) AS blobs, (coalesce(sum(bytes) FILTER (expired), 0) + (SELECT coalesce(sum(bytes), 0) FROM e))::BIGINT AS blob_bytes,
    count(*) FILTER (NOT expired) - (SELECT count(*) FROM e) AS blobs_left FROM c""")
def store_gc(spark, sf_dir):  # noqa: ANN001, ANN201
    """A sweep of a store on disk: expired capsules, then the oldest beyond a budget, and the blobs that only these had."""
    d = read(spark, sf_dir, "documents").filter("text is not null").withColumn("hash", F.sha2("text", 256))
    place = BlobStore(spark, scratch_path(spark, "store"))
    place.put(d.select("hash", F.col("text").alias("content")))
    c = d.groupBy("hash").agg(F.min("doc_id").alias("id"), F.min(F.col("doc_id") * 13 % 9973).alias("created"), F.max(F.octet_length("text")).cast("bigint").alias("bytes"))
    c = c.withColumn("expires_millis", F.when(F.col("id") % 4 == 0, 1).otherwise(9).cast("bigint"))
    _, counters = place.gc(c, now_millis=5, max_bytes=200_000)
    return counters.join(place.stats().select(F.col("blobs").alias("blobs_left")))


@query(f"WITH {S.USAGE} SELECT project, {_SUMS} FROM usage WHERE project <> 'p3' GROUP BY project")
def ledger_sink(spark, sf_dir):  # noqa: ANN001, ANN201
    """Totals of a ledger that took its rows in batches, one of them twice, folded as it grew, and forgot a project."""
    rows = usage(spark, sf_dir).withColumn("part", F.col("at_millis") % 3)
    sink = LedgerSink(spark, scratch_path(spark, "ledger"), max_bytes=20_000, retain_days=10)
    for batch in (0, 1, 1, 2):
        sink.append(rows.filter(F.col("part") == batch), batch)
    sink.forget("p3")
    return sink.read()[0].groupBy("project").agg(*ledger.totals())


@query(f"""WITH {_RUNS}, p AS (SELECT *, lag(run_id) OVER w AS previous_id, lag(hash) OVER w AS previous_hash, ts_millis - lag(ts_millis) OVER w AS age_millis FROM runs WINDOW w AS (PARTITION BY command ORDER BY ts_millis, run_id))
  SELECT run_id, command, ts_millis, hash, previous_id, previous_hash, age_millis, hash = previous_hash AS is_repeat FROM p WHERE age_millis <= 21600000 AND ts_millis < (SELECT max(ts_millis) FROM runs) - 3600000""")
def stream_previous(spark, sf_dir):  # noqa: ANN001, ANN201
    """Previous runs by a stream with keyed state: those of all runs that no late one can follow any more."""
    import uuid

    e = E.event_stream(spark, sf_dir)
    runs = e.select("ts", F.col("event_id").alias("run_id"), F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("command"), F.md5((F.col("event_id") % 3).cast("string")).alias("hash"))
    return E.run_once(E.previous_runs(runs), f"gleaner_{uuid.uuid4().hex}", scratch_path(spark, "stream"))


_DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _base32(number, digits):  # noqa: ANN001, ANN202
    return f"array_to_string(list_transform(range({digits}), lambda i: substr('{_DIGITS}', ((({number}) >> (5 * ({digits} - 1 - i))) & 31)::INTEGER + 1, 1)), '')"


@query(f"""WITH e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, sha256(event_id::VARCHAR) AS h FROM events)
  SELECT event_id, concat('evt_', {_base32('ms', 10)}, {_base32("('0x' || substr(h, 1, 10))::BIGINT", 8)}, {_base32("('0x' || substr(h, 11, 10))::BIGINT", 8)}) AS id, ms AS millis FROM e""")
def sortable_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    """Ids that sort by time, and the time read back from them."""
    e = read(spark, sf_dir, "events")
    ident = X.sortable_id("evt_", F.unix_millis(F.col("ts").cast("timestamp")), F.col("event_id").cast("string"))
    return e.select("event_id", ident.alias("id")).withColumn("millis", X.id_millis(F.col("id"), "evt_"))


@query("""WITH c AS (SELECT concat('k', doc_id::VARCHAR) AS id, sha256(text) AS hash FROM documents), h AS (SELECT DISTINCT hash FROM c),
    n AS (SELECT hash, count(*) OVER (PARTITION BY substr(hash, 1, 5)) AS a, count(*) OVER (PARTITION BY substr(hash, 1, 7)) AS b FROM h),
    s AS (SELECT CASE WHEN a = 1 THEN substr(hash, 1, 5) ELSE substr(hash, 1, 7) END AS handle, min(id) AS id FROM n JOIN c USING (hash) WHERE a = 1 OR b = 1 GROUP BY ALL),
    w AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN concat('cap://k', (o_orderkey // 4)::VARCHAR) WHEN 1 THEN concat('k', (o_orderkey % 100)::VARCHAR, '9') WHEN 2 THEN 'k1' ELSE concat('x', o_orderkey::VARCHAR) END AS name FROM orders
      UNION SELECT handle FROM s),
    p AS (SELECT name, regexp_replace(name, '^cap://', '') AS key FROM w), m AS (SELECT name, count(c.id) AS matches, min(c.id) AS id FROM p LEFT JOIN c ON starts_with(c.id, p.key) GROUP BY name)
  SELECT name, coalesce(c.id, s.id, CASE WHEN matches = 1 THEN m.id END) AS id, CASE WHEN c.id IS NOT NULL THEN 'id' WHEN s.id IS NOT NULL THEN 'short' WHEN matches = 1 THEN 'prefix' WHEN matches > 1 THEN 'ambiguous' ELSE 'missing' END AS how
  FROM p JOIN m USING (name) LEFT JOIN c ON c.id = p.key LEFT JOIN s ON s.handle = p.key""")
def capsule_lookup(spark, sf_dir):  # noqa: ANN001, ANN201
    """Originals by what a text names: their id, their short handle, a prefix."""
    c = read(spark, sf_dir, "documents").select(F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("hash"))
    k, text = F.col("o_orderkey"), lambda x: x.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("cap://k"), text(F.floor(k / 4)))).when(k % 4 == 1, F.concat(F.lit("k"), text(k % 100), F.lit("9"))).when(k % 4 == 2, "k1").otherwise(F.concat(F.lit("x"), text(k)))
    names = read(spark, sf_dir, "orders").select(name.alias("name")).unionByName(store.short_handles(c).filter("char_length(handle) between 5 and 7").select(F.col("handle").alias("name")))
    return store.lookup(c, names)


_FILES = """r AS (SELECT concat('flt_', (p_partkey % 40)::VARCHAR) AS id, p_partkey % 3 AS file, p_partkey AS k FROM part WHERE p_partkey % 40 < 30),
  o AS (SELECT *, CASE file WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END AS rank FROM r)"""


@query(f"""WITH {_FILES} SELECT id, CASE min(rank) WHEN 0 THEN 'main' WHEN 1 THEN 'a' ELSE 'b' END AS caption, sum(k % 7)::BIGINT AS hits, min(k)::BIGINT AS created_millis, bool_and(k % 11 > 0) AS enabled FROM o GROUP BY id HAVING id <> 'flt_3'""")
def rule_folder(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rules of three files in their order, merged by id, one forgotten, saved and read again."""
    k = F.col("p_partkey")
    p = read(spark, sf_dir, "part").filter(k % 40 < 30)
    r = p.select(F.concat(F.lit("flt_"), (k % 40).cast("string")).alias("id"), (k % 3).alias("file"), (k % 7).alias("hits"), k.alias("created_millis"), (k % 11 > 0).alias("enabled"), F.lit(False).alias("forced"), F.lit("drop").alias("action"), F.array(F.lit("a line")).alias("lines"), F.lit(1).cast("bigint").alias("examples"))
    folder = scratch_path(spark, "rules")
    for file, name, caption in ((0, "a.json", "a"), (1, rule_files.MAIN, "main"), (2, "b.json", "b")):
        rule_files.save(r.filter(F.col("file") == file).withColumn("caption", F.lit(caption)), f"{folder}/{name}")
    both = rule_files.forget(rule_files.read_rule_set(spark, folder), spark.createDataFrame([("flt_3",)], "id string"))
    saved = scratch_path(spark, "rules")
    rule_files.save(both, saved)
    return rule_files.read_file(spark, saved).select("id", "caption", "hits", "created_millis", "enabled")


_SOURCES = """e AS (SELECT printf('%08d', event_id) AS id, strftime(ts, '%Y-%m-%d') AS session_id, epoch_us(ts) // 1000 AS ts, CASE WHEN event_id % 5 > 0 THEN concat('c', (event_id % 50)::VARCHAR, '-') END AS capsule_id,
    CASE WHEN event_id % 7 > 0 THEN concat('/usr/bin/', event_type, '.exe --quiet run now') END AS command FROM events),
  l AS (SELECT p_partkey AS lesson_id, p_partkey % 4 = 0 AS last, CASE WHEN p_partkey % 4 = 1 THEN substr(printf('%08d', p_partkey), 1, 7 + (p_partkey % 2)::INTEGER) END AS event, CASE WHEN p_partkey % 4 = 2 THEN concat('cap://c', (p_partkey % 60)::VARCHAR, '-') END AS capsule FROM part),
  x AS (SELECT * FROM e WHERE session_id = (SELECT max(session_id) FROM e) AND capsule_id IS NOT NULL ORDER BY ts DESC, id DESC LIMIT 1),
  h AS (SELECT lesson_id, e.* FROM l JOIN e ON (NOT last AND event IS NOT NULL AND starts_with(e.id, event)) OR (NOT last AND event IS NULL AND capsule IS NOT NULL AND starts_with(e.capsule_id, replace(capsule, 'cap://', ''))) QUALIFY row_number() OVER (PARTITION BY lesson_id ORDER BY session_id DESC, ts, id) = 1),
  f AS (SELECT l.*, CASE WHEN last THEN x.id ELSE h.id END AS id, CASE WHEN last THEN x.capsule_id ELSE h.capsule_id END AS cap, CASE WHEN last THEN x.command ELSE h.command END AS command FROM l LEFT JOIN h USING (lesson_id) LEFT JOIN x ON true)"""


@query(f"""WITH {_SOURCES} SELECT lesson_id, id AS event_id, cap AS capsule_id, CASE WHEN command IS NOT NULL THEN regexp_extract(command, '([a-z]+)[.]exe', 1) END AS program, CASE WHEN command IS NOT NULL THEN 'run' END AS subcommand,
    CASE WHEN last AND id IS NULL THEN 'no_session' WHEN NOT last AND event IS NULL AND capsule IS NULL THEN 'nothing_named' WHEN id IS NULL THEN 'no_event' WHEN cap IS NULL THEN 'no_original' END AS reason FROM f""")
def lesson_source(spark, sf_dir):  # noqa: ANN001, ANN201
    """The events that lessons are about, named as the last one, by an event's prefix or by an original's."""
    return lesson_sources.resolved(_asked(spark, sf_dir), _events(spark, sf_dir))


def _events(spark, sf_dir):  # noqa: ANN001, ANN202
    k = F.col("event_id")
    e = read(spark, sf_dir, "events")
    capsule = F.when(k % 5 > 0, F.concat(F.lit("c"), (k % 50).cast("string"), F.lit("-")))
    command = F.when(k % 7 > 0, F.concat(F.lit("/usr/bin/"), F.col("event_type"), F.lit(".exe --quiet run now")))
    return e.select(F.format_string("%08d", k).alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("session_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_millis"), capsule.alias("capsule_id"), command.alias("command"))


def _asked(spark, sf_dir):  # noqa: ANN001, ANN202
    k = F.col("p_partkey")
    event = F.when(k % 4 == 1, F.substr(F.format_string("%08d", k), F.lit(1), (7 + k % 2).cast("int")))
    capsule = F.when(k % 4 == 2, F.concat(F.lit("cap://c"), (k % 60).cast("string"), F.lit("-")))
    return read(spark, sf_dir, "part").select(k.alias("lesson_id"), (k % 4 == 0).alias("last"), event.alias("event"), capsule.alias("capsule"))


@query(f"""WITH {_SOURCES} SELECT lesson_id::VARCHAR AS lesson_id, CASE WHEN cap IS NOT NULL AND NOT last AND event IS NULL AND capsule IS NULL THEN 'x' WHEN cap IS NOT NULL THEN 'matches_kept' END AS reason FROM f""")
def learn_from_source(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lessons that would teach to drop a line which is critical in the original they are about."""
    asked, events = _asked(spark, sf_dir), _events(spark, sf_dir)
    about = materialize(lesson_sources.resolved(asked, events), "lesson-sources")  # read for the lessons and for their originals
    raw = F.concat(F.lit("notice of a thing\n"), F.lit("the build has failed here\n"))
    originals = events.filter("capsule_id is not null").select(F.col("capsule_id").alias("id")).distinct().withColumn("raw", raw)
    text = F.lit("<trash>the build has failed here</trash>\nother line")
    lessons = about.select("lesson_id", "program", "subcommand", F.lit(True).alias("forced"), text.alias("text"))
    none = spark.createDataFrame([], learning.RULES)
    made = learning.learn(lessons, none, NOW, lesson_sources.counter_examples(about, originals))[1]
    return made.select("lesson_id", "reason")


@query(f"""WITH t AS (SELECT user_id, concat('[', array_to_string(list_transform(list_sort(list(props)), lambda p: concat(p, '  ')), ', '), ']') AS raw, count(*) AS n FROM events GROUP BY user_id),
    m AS (SELECT user_id AS id, raw, replace(raw, ' ', '') AS small FROM t WHERE user_id % 3 > 0),
    k AS (SELECT id, {S.tokens('raw')} AS before, {S.tokens('small')} AS after FROM m), v AS (SELECT id, before, CASE WHEN before > 0 AND after > floor(before * 0.95) THEN NULL ELSE after END AS won FROM k),
    r AS (SELECT CASE WHEN won IS NOT NULL THEN 'json.structural' END AS now_transformer, before, id % 100 AS recorded, coalesce(won, before) AS recomputed FROM v)
  SELECT now_transformer, grouping(now_transformer)::BIGINT AS level, count(*) AS events, sum(before)::BIGINT AS before, sum(recorded)::BIGINT AS recorded, sum(recomputed)::BIGINT AS recomputed, (sum(recomputed) - sum(recorded))::BIGINT AS difference
  FROM r GROUP BY ROLLUP(now_transformer)""")
def replay_session(spark, sf_dir):  # noqa: ANN001, ANN201
    """Recorded runs against what the reduction makes of their originals today, by transformer; a third has no original left."""
    e = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("props")).alias("p"))
    raw = F.concat(F.lit("["), F.array_join(F.transform("p", lambda x: F.concat(x, F.lit("  "))), ", "), F.lit("]"))
    rows = e.select(F.col("user_id").alias("id"), raw.alias("raw"))
    rows = rows.withColumns({"capsule_id": F.col("id"), "session_id": F.lit("s"), "transformer": F.lit("old"), "tokens_before": X.token_estimate(F.col("raw")), "tokens_after": F.col("id") % 100})
    again = lambda docs: reduce.reduce(docs, compilers=tuple(c for c in reduce.COMPILERS if c.name == "json.structural"))
    return ledger.replay_totals(ledger.replayed(rows.drop("raw"), rows.filter("id % 3 > 0").select("id", "raw"), again))


@query("""WITH n AS (SELECT p_partkey AS k, ['npm install', '/usr/bin/Git.EXE  Log -1', ' * ', 'GLOBAL', '', 'C:\\\\bin\\\\NPM.exe', 'go /C'][p_partkey % 7 + 1] AS name, concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN '<filter-keep>' WHEN p_partkey % 3 = 1 THEN '<trash' ELSE '<keeper' END) AS text FROM part)
  SELECT k, ['npm', 'git', NULL, NULL, NULL, 'npm', 'go'][k % 7 + 1] AS program, ['install', 'log', NULL, NULL, NULL, NULL, '/c'][k % 7 + 1] AS subcommand, ['npm install', 'git log', '(any command)', '(any command)', '(any command)', 'npm', 'go /c'][k % 7 + 1] AS scope, k % 3 < 3 AS marked FROM n""")
def scopes_and_marks(spark, sf_dir):  # noqa: ANN001, ANN201
    """Scopes by name, how they are shown, and whether texts hold marks of lessons."""
    k = F.col("p_partkey")
    names = F.array(*[F.lit(x) for x in ("npm install", "/usr/bin/Git.EXE  Log -1", " * ", "GLOBAL", "", "C:\\bin\\NPM.exe", "go /C")])
    mark = F.when(k % 3 == 0, "<filter-keep>").when(k % 3 == 1, "<trash").otherwise("<keeper")
    rows = read(spark, sf_dir, "part").select(k.alias("k"), X.scope_of(F.get(names, (k % 7).cast("int"))).alias("s"), F.concat("p_name", mark).alias("text"))
    return rows.select("k", "s.program", "s.subcommand", X.scope_text(F.col("s.program"), F.col("s.subcommand")).alias("scope"), X.has_markup(F.col("text")).alias("marked"))


@query(f"""WITH {S.USAGE}, s AS (SELECT program, {_SUMS} FROM usage GROUP BY program) SELECT *, row_number() OVER (ORDER BY saved DESC, program)::INTEGER AS rank FROM s QUALIFY rank <= 3""")
def usage_ranked(spark, sf_dir):  # noqa: ANN001, ANN201
    """The three programs that saved most."""
    return ledger.ranked(ledger.by_program(usage(spark, sf_dir)), "program", limit=3)


@query(f"WITH {S.USAGE} SELECT count(*) FILTER (project = 'p3') AS dropped FROM usage")
def usage_forgotten(spark, sf_dir):  # noqa: ANN001, ANN201
    return ledger.forgotten(usage(spark, sf_dir), "p3")


@query("""SELECT p_partkey::VARCHAR AS lesson_id, CASE p_partkey % 4 WHEN 0 THEN 'too general (1 literal token(s), 3 char(s))' WHEN 1 THEN 'would also remove a line you kept: one notice of the thing' WHEN 2 THEN '60% of the pattern is placeholders'
    ELSE 'looks like an error, and errors are never filtered (use --force)' END AS explanation FROM part""")
def learn_refusals(spark, sf_dir):  # noqa: ANN001, ANN201
    """Why lessons teach nothing, in words."""
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, "abc").when(k % 4 == 1, "one notice of the thing").when(k % 4 == 2, "notices number 1 2 3").otherwise("an error in this line")
    text = F.concat(F.lit("<trash>"), line, F.lit("</trash>\nother\n"), F.when(k % 4 == 1, line).otherwise(""))
    lessons = read(spark, sf_dir, "part").select(k.alias("lesson_id"), F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("subcommand"), F.lit(False).alias("forced"), text.alias("text"))
    made = learning.learn(lessons, spark.createDataFrame([], learning.RULES), NOW)[1]
    return learning.explained(made).select("lesson_id", "explanation")
