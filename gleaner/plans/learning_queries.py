"""Queries over learning, rule counters, layers and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import filtering, learning, rules, store
from gleaner.sources import logs as files
from gleaner.sources.tables import applog, read

from . import sql_views as S
from .relational_queries import _TAKEN, NOW, _rules

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
LESSON = "lesson_id bigint, program string, subcommand string, forced boolean, text string"


def query(sql: str | None = None):  # noqa: ANN201
    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def _word(c):  # noqa: ANN001, ANN202
    return F.translate(c.cast("string"), "0123456789", "abcdefghij")


def _lessons(parts, text):  # noqa: ANN001, ANN202
    return parts.select(F.col("p_partkey").cast("bigint").alias("lesson_id"), F.lit("make").alias("program"), F.lit(None).cast("string").alias("subcommand"), F.lit(False).alias("forced"), text.alias("text"))


def _none(spark):  # noqa: ANN001, ANN202
    return spark.createDataFrame([], learning.RULES)


def _part_lesson(spark, sf_dir):  # noqa: ANN001, ANN202
    k = F.col("p_partkey")
    line = F.concat(F.when(k % 3 == 1, "fatal error: ").otherwise(""), F.lit("notice the package "), _word(k), F.lit(" was skipped"))
    text = F.concat(F.lit("<filter-trash>"), line, F.lit("</filter-trash>\nother "), F.when(k % 3 == 0, line).otherwise(F.lit("line")), F.lit("\n"), F.when(k % 3 == 0, line).otherwise(""))
    return _lessons(read(spark, sf_dir, "part"), text)


_WORD = "translate(({})::VARCHAR, '0123456789', 'abcdefghij')"
_LINE = f"concat('notice the package ', {_WORD.format('p_partkey')}, ' was skipped')"


@query(f"""SELECT p_partkey::VARCHAR AS lesson_id, 'drop' AS action, concat(CASE WHEN p_partkey % 3 = 1 THEN 'fatal error: ' ELSE '' END, {_LINE}) AS line, 1::BIGINT AS examples,
    CASE p_partkey % 3 WHEN 1 THEN 'critical' WHEN 0 THEN 'matches_kept' END AS reason FROM part""")
def learn_rules(spark, sf_dir):  # noqa: ANN001, ANN201
    """What lessons with one marked line teach: a rule, or why there is none."""
    made = learning.learn(_part_lesson(spark, sf_dir), _none(spark), NOW)[1]
    return made.select("lesson_id", "action", F.array_join("lines", "\n").alias("line"), "examples", "reason")


@query(f"""WITH w AS (SELECT p_partkey::VARCHAR AS lesson_id, {_WORD.format('p_partkey')} AS w FROM part)
  SELECT lesson_id, concat('== banner', w, ' ==') AS source, 1 AS height FROM w UNION ALL SELECT lesson_id, '==========', 3 FROM w""")
def learn_blocks(spark, sf_dir):  # noqa: ANN001, ANN201
    """A banner of three lines, of which one alone can be a rule, becomes a block as well."""
    text = F.concat(F.lit("<trash>\n==========\n== banner"), _word(F.col("p_partkey")), F.lit(" ==\n----------\n</trash>\nrest\n"))
    made = learning.learn(_lessons(read(spark, sf_dir, "part"), text), _none(spark), NOW)[1]
    return made.select("lesson_id", "source", F.size("lines").alias("height"))


@query(f"""SELECT p_partkey::VARCHAR AS lesson_id, CASE WHEN p_partkey % 2 = 0 THEN 'old packages' END AS caption, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS examples,
    CASE WHEN p_partkey % 2 = 1 THEN 'fold_without_caption' END AS reason FROM part UNION ALL SELECT p_partkey::VARCHAR, NULL, 1, NULL FROM part""")
def learn_folds(spark, sf_dir):  # noqa: ANN001, ANN201
    """A fold with a caption, one without, and a whitelist."""
    k = F.col("p_partkey")
    text = F.concat(
        F.lit("<fold"), F.when(k % 2 == 0, ' as="old packages"').otherwise(""), F.lit(">\nwarning package "), _word(k), F.lit(" 12 is old\nwarning package "), _word(k),
        F.lit(" 13 is old\n</fold>\n<only>summary of all packages</only>\n"),
    )
    made = learning.learn(_lessons(read(spark, sf_dir, "part"), text), _none(spark), NOW)[1]
    return made.select("lesson_id", "caption", F.when(F.col("reason").isNotNull(), F.lit(0)).otherwise(F.col("examples")).cast("bigint").alias("examples"), "reason")


@query(f"""WITH p AS (SELECT {_WORD.format('p_partkey % 50')} AS w, p_partkey % 4 = 0 AS old FROM part)
  SELECT concat('notice the package ', w, ' was skipped') AS line, (count(*) + count(*) FILTER (old))::BIGINT AS examples, CASE WHEN bool_or(old) THEN 'reinforced' ELSE 'created' END AS state,
    true AS enabled, CASE WHEN bool_or(old) THEN 1000 ELSE 2000 END::BIGINT AS created_millis FROM p GROUP BY w""")
def rule_reinforce(spark, sf_dir):  # noqa: ANN001, ANN201
    """Lessons that teach rules again, which had been switched off, and new ones."""
    p = read(spark, sf_dir, "part")
    text = F.concat(F.lit("<trash>notice the package "), _word(F.col("p_partkey") % 50), F.lit(" was skipped</trash>\nrest"))
    old = learning.learn(_lessons(p.filter("p_partkey % 4 = 0"), text), _none(spark), 1000)[0].withColumn("enabled", F.lit(False)).drop("state")
    out = learning.learn(_lessons(p, text), old, 2000)[0]
    return out.select(F.get("lines", 0).alias("line"), "examples", "state", "enabled", "created_millis")


@query("""SELECT t.id, t.id <> 'r1' AS enabled FROM (VALUES ('r1'), ('r2'), ('r3'), ('r4')) t(id) WHERE (SELECT count(*) FROM events WHERE event_type = 'click') > 0""")
def rule_retire(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rules with wildcards that match a line which must stay are switched off."""
    return rules.retire(_rules(spark), applog(spark, sf_dir).filter("event_type = 'click'").select("line")).select("id", "enabled")


@query(f"""{_TAKEN} SELECT rule_id AS id, (5 + greatest(runs, CASE WHEN runs > 0 THEN 1 ELSE 0 END))::BIGINT AS hits, (7 + CASE WHEN runs > 0 THEN lines ELSE 0 END)::BIGINT AS lines_removed, tokens AS tokens_saved,
    CASE WHEN runs > 0 THEN {NOW} ELSE 0 END::BIGINT AS last_hit_millis FROM g UNION ALL SELECT 'r9', 5, 7, 0, 0""")
def rule_update(spark, sf_dir):  # noqa: ANN001, ANN201
    """The counters of rules after a pass over the logs; a rule that met nothing stays as it was."""
    table = _rules(spark)
    used = filtering.accounting(*filtering.decided(applog(spark, sf_dir).select("doc_id", "ln", "line"), table))
    before = table.select("id").unionByName(spark.createDataFrame([("r9",)], "id string"))
    before = before.select("id", F.lit(5).cast("bigint").alias("hits"), F.lit(7).cast("bigint").alias("lines_removed"), F.lit(0).cast("bigint").alias("tokens_saved"), F.lit(None).cast("bigint").alias("last_hit_millis"))
    return rules.accounted(before, used, NOW).withColumn("last_hit_millis", F.coalesce("last_hit_millis", F.lit(0)))


@query("""WITH r AS (SELECT o_orderkey % 4 = 0 AS project, concat('f', (o_orderkey // 2)::VARCHAR) AS id, o_orderkey % 7 AS hits, o_orderkey * 10 AS created_millis FROM orders WHERE o_orderkey % 2 = 0),
    g AS (SELECT id, sum(hits)::BIGINT AS hits, min(created_millis)::BIGINT AS created_millis FROM (SELECT * FROM r UNION ALL SELECT true, id, 1, 5 FROM r WHERE NOT project AND created_millis % 30 = 0) GROUP BY id),
    o AS (SELECT id, bool_or(project) OR bool_or(created_millis % 30 = 0) AS project FROM r GROUP BY id)
  SELECT id, hits, created_millis, CASE WHEN project THEN 'project' ELSE 'user' END AS origin FROM g JOIN o USING (id)""")
def rules_layered(spark, sf_dir):  # noqa: ANN001, ANN201
    """Rules of a project over those of a user; an id of both is one rule."""
    k = F.col("o_orderkey")
    r = read(spark, sf_dir, "orders").filter(k % 2 == 0).select((k % 4 == 0).alias("p"), F.concat(F.lit("f"), F.floor(k / 2).cast("string")).alias("id"), (k % 7).alias("hits"), (k * 10).alias("created_millis"))
    both = r.filter(~F.col("p") & (F.col("created_millis") % 30 == 0)).select("id", F.lit(1).cast("bigint").alias("hits"), F.lit(5).cast("bigint").alias("created_millis"))
    return files.layered(r.filter("p").drop("p").unionByName(both), r.filter("not p").drop("p")).select("id", "hits", "created_millis", "origin")


@query("SELECT doc_id AS id, n_chars AS created FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def capsules_newest(spark, sf_dir):  # noqa: ANN001, ANN201
    return store.newest(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("created")))


@query("SELECT sha256(text) AS hash FROM documents WHERE doc_id % 10 = 0")
def store_verify(spark, sf_dir):  # noqa: ANN001, ANN201
    """Blobs that no longer are what their hash says: every tenth is spoilt."""
    d = read(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("hash"), F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return store.verify(d).select("hash")


_N = "replace(upper(n_name), ' ', '_')"
_TEXT = f"""n AS (SELECT n_nationkey AS k, {_N} AS w FROM nation), t AS (SELECT c_custkey AS doc_id, w, c_custkey % 4 AS warnings, c_custkey % 3 = 0 AS banner, c_custkey % 5 = 0 AS broken FROM customer JOIN n ON k = c_nationkey)"""


def _nations(spark, sf_dir):  # noqa: ANN001, ANN202
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.translate(F.upper("n_name"), " ", "_").alias("w"))


def _taught(spark, sf_dir):  # noqa: ANN001, ANN202
    """Rules from a lesson for each nation: a banner of three lines, old packages to fold, and a failure that is forced."""
    w = F.col("w")
    lesson = F.concat(
        F.lit("<filter-trash>\n==========\n== banner"), w, F.lit(" ==\n----------\n</filter-trash>\nrest\n<filter-fold as=\"old packages of "), w, F.lit("\">\nwarning package "), w,
        F.lit(" 12 is old\nwarning package "), w, F.lit(" 13 is old\n</filter-fold>\n"),
    )
    forced = F.concat(F.lit("<trash>fatal error in package "), w, F.lit("</trash>\nrest"))
    n = _nations(spark, sf_dir)
    make = lambda df, key, text, force: df.select(key.cast("bigint").alias("lesson_id"), F.lit(None).cast("string").alias("program"), F.lit(None).cast("string").alias("subcommand"), F.lit(force).alias("forced"), text.alias("text"))
    return learning.learn(make(n, F.col("k"), lesson, False).unionByName(make(n, F.col("k") + 1000, forced, True)), _none(spark), NOW)[0].drop("state")


def _nation_texts(spark, sf_dir):  # noqa: ANN001, ANN202
    """A text for each customer: a banner with a blank line in it or its middle alone, some old packages, maybe a failure."""
    c = read(spark, sf_dir, "customer").join(_nations(spark, sf_dir), F.col("c_nationkey") == F.col("k"))
    key, w = F.col("c_custkey"), F.col("w")
    middle = F.concat(F.lit("== banner"), w, F.lit(" ==\n"))
    banner = F.when(key % 3 == 0, F.concat(F.lit("==========\n"), middle, F.lit("\n----------\n"))).otherwise(F.concat(F.lit("----------\n"), middle))
    old = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i < key % 4, F.concat(F.lit("warning package "), w, F.lit(" "), i.cast("string"), F.lit(" is old\n"))).otherwise(""))
    broken = F.when(key % 5 == 0, F.concat(F.lit("fatal error in package "), w, F.lit("\n"))).otherwise("")
    text = F.concat(F.lit("start\n"), banner, F.lit("\n"), F.array_join(old, ""), F.lit("\n"), broken, F.lit("end\n"))
    return c.select(key.alias("doc_id"), text.alias("text"))


@query(f"""WITH {_TEXT} SELECT doc_id, concat('start', chr(10), CASE WHEN banner THEN '' ELSE concat('----------', chr(10)) END,
    CASE WHEN warnings > 0 THEN concat('[folded] old packages of ', w, ' (', warnings::VARCHAR, ' line(s))', chr(10)) ELSE '' END, CASE WHEN broken THEN concat('fatal error in package ', w, chr(10)) ELSE '' END, 'end', chr(10)) AS output FROM t""")
def learn_then_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    """Texts after the rules that lessons of the same tables teach: lines, blocks and folds of one rule table in one pass."""
    return filtering.filter_texts(_nation_texts(spark, sf_dir), _taught(spark, sf_dir))


@query(f"""WITH {_TEXT}, a AS (SELECT w, 'block' AS kind, count(*) FILTER (banner) AS docs, 3 * count(*) FILTER (banner) AS lines, count(*) FILTER (banner) AS runs, 0 AS protected FROM t GROUP BY w
    UNION ALL SELECT w, 'line', count(*) FILTER (NOT banner), count(*) FILTER (NOT banner), count(*) FILTER (NOT banner), 0 FROM t GROUP BY w
    UNION ALL SELECT w, 'fold', count(*) FILTER (warnings > 0), sum(warnings), count(*) FILTER (warnings > 0), 0 FROM t GROUP BY w
    UNION ALL SELECT w, 'failure', 0, 0, 0, count(*) FILTER (broken) FROM t GROUP BY w)
  SELECT w, kind, docs::BIGINT AS docs, lines::BIGINT AS lines, runs::BIGINT AS runs, protected::BIGINT AS protected FROM a WHERE docs + protected > 0""")
def learned_accounting(spark, sf_dir):  # noqa: ANN001, ANN201
    """What each learned rule took of those texts, and how often a failure was kept from one that was forced."""
    table = _taught(spark, sf_dir)
    used = filtering.accounting(*filtering.decided(filtering.dealt_lines(_nation_texts(spark, sf_dir)), table))
    kind = F.when(F.size("lines") > 1, "block").when(F.col("action") == "fold", "fold").when(F.col("source").startswith("fatal"), "failure").otherwise("line")
    word = F.regexp_extract(F.array_join("lines", " "), r"(?:banner|package )([A-Z_0-9]+)", 1)
    named = table.select(F.col("id").alias("rule_id"), kind.alias("kind"), word.alias("w"))
    return used.join(named, "rule_id").select("w", "kind", "docs", used["lines"], "runs", "protected")
