"""Learned rules: matching of lines, scopes, counters, merging, pruning. `filtering` applies them to texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import templates as T
from gleaner.functions.text import is_critical
from gleaner.sources.scratch import materialize

#: Rules up to this number are broadcast (a rule is below 10 kB); more are joined by shuffle on their key.
BROADCAST_RULES = 5_000


def rule_table(spark, rows: list[tuple[str, str | None, str | None, str, str, str]]) -> DataFrame:  # noqa: ANN001
    """Line rules from (id, program, subcommand, example, action, summary); `*` as a token of the example is a wildcard."""
    df = spark.createDataFrame(rows, "id string, program string, subcommand string, example string, action string, summary string")
    segs = F.transform(
        T.segments(F.col("example")),
        lambda s: F.when(s.lit == T.WILDCARD, F.struct(F.lit("*").alias("cls"), F.lit("").alias("lit"))).otherwise(s),
    )
    df = df.withColumn("pattern", segs)
    return df.withColumn("wild", F.exists("pattern", lambda s: s.cls == "*")).withColumn("enabled", F.lit(True))


def applies(program: Column, subcommand: Column) -> Column:
    """A scoped rule never fires on unattributed text; names compare without case."""
    one = lambda rule, value: rule.isNull() | F.coalesce(F.lower(rule) == F.lower(value), F.lit(False))
    return one(F.col("r_program"), program) & one(F.col("r_subcommand"), subcommand)


def covering(rows: DataFrame, rules: DataFrame, names: list[str], scoped: bool = False) -> DataFrame:
    """All pairs of a line (`_segs` its template, `_key` the template's key if it was made before) and a rule that matches it, as the columns `names` of both.

    Rules without wildcards meet lines by a hash join on the template's key. Those with wildcards meet them by the number
    of tokens and the place and text of their longest literal: a line is looked up once for each place that rules of its
    length use, so a common length alone brings no pair together. Blank lines match nothing.
    """
    few = rules.count() <= BROADCAST_RULES
    side = lambda df: F.broadcast(df) if few else df
    rules = rules.select(
        F.col("id").alias("rule_id"), F.col("program").alias("r_program"), F.col("subcommand").alias("r_subcommand"), "pattern", "wild", "action", "summary"
    )
    scope = applies(F.col("program"), F.col("subcommand")) if scoped else F.lit(True)
    plain = rules.filter(~F.col("wild")).withColumn("_key", T.join_key(F.col("pattern"))).drop("wild")
    keyed = rows if "_key" in rows.columns else rows.withColumn("_key", T.join_key(F.col("_segs")))
    hits = keyed.join(side(plain), "_key").filter(scope).select(*names)
    places = F.array_max(F.transform("pattern", lambda s, i: F.struct(F.when(s.cls == "", F.char_length(s.lit)).otherwise(-1).alias("n"), (-i).alias("i"))))
    wild = rules.filter("wild").withColumn("_size", F.size("pattern")).withColumn("_at", F.when(places.n >= 0, -places.i).otherwise(-1))
    literal = lambda segs: F.when(F.col("_at") >= 0, F.get(segs, F.col("_at")).getField("lit")).otherwise("")
    wild = wild.withColumn("_lit", literal(F.col("pattern"))).drop("wild")
    spots = wild.select("_size", "_at").distinct()  # lengths and places: 64 * 65 rows at most
    near = rows.withColumn("_size", F.size("_segs")).join(F.broadcast(spots), "_size").withColumn("_lit", literal(F.col("_segs")))
    more = near.join(side(wild), ["_size", "_at", "_lit"]).filter(T.matches(F.col("pattern"), F.col("_segs")) & scope).select(*names)
    return hits.unionByName(more)


def matched(lines: DataFrame, rules: DataFrame, scoped: bool = False) -> DataFrame:
    """Lines with the first rule that covers them (id order): doc_id, ln, line, rule_id, action, summary, critical.

    Lines without a rule keep nulls. Null lines and rules of a null pattern match nothing.
    """
    rows = materialize(lines.withColumn("_segs", T.segments(F.col("line"))), "rule-lines")  # read by both joins
    hits = covering(rows, rules.filter("enabled"), ["doc_id", "ln", "rule_id", "action", "summary"], scoped)
    first = hits.groupBy("doc_id", "ln").agg(F.min(F.struct("rule_id", "action", "summary")).alias("r"))
    out = rows.drop("_segs").join(first, ["doc_id", "ln"], "left")
    return out.select(*lines.columns, "r.rule_id", "r.action", "r.summary", is_critical(F.col("line")).alias("critical"))


def accounted(rules: DataFrame, used: DataFrame, now_millis: int) -> DataFrame:
    """Rules (id, hits, lines_removed, tokens_saved, last_hit_millis, ..) with the counters of `filtering.accounting` added.

    A rule that took or named something has a hit for each run of it, which is at least one.
    """
    used = used.filter("runs > 0").select(F.col("rule_id").alias("id"), F.greatest("runs", F.lit(1)).alias("_runs"), F.col("lines").alias("_lines"), "tokens")
    out = rules.join(used, "id", "left")
    more = lambda c, by: (F.coalesce(c, F.lit(0)) + F.coalesce(by, F.lit(0))).cast("bigint").alias(c)
    hit = F.when(F.col("_runs").isNotNull(), F.lit(now_millis)).otherwise(F.col("last_hit_millis")).cast("bigint").alias("last_hit_millis")
    new = {"hits": more("hits", "_runs"), "lines_removed": more("lines_removed", "_lines"), "tokens_saved": more("tokens_saved", "tokens"), "last_hit_millis": hit}
    return out.select(*[new.get(c, F.col(c)) for c in rules.columns])


def hit_order(used: DataFrame, limit: int = 30) -> DataFrame:
    """A report of the rules of `filtering.accounting` that saved most tokens."""
    return used.orderBy(F.desc("tokens"), "rule_id").limit(limit)


def rule_id(program: Column, subcommand: Column, canonical: Column, action: Column) -> Column:
    text = F.concat_ws("\u0001", F.coalesce(program, F.lit("")), F.coalesce(subcommand, F.lit("")), canonical, action)
    return F.concat(F.lit("flt_"), F.substring(F.sha2(text, 256), 1, 10))


def guard(canonical_segs: Column, examples_critical: Column, forced: Column) -> Column:
    """Why a shape cannot be a rule, or null: unusable, critical, too general, mostly placeholders."""
    literals, size = T.literal_tokens(canonical_segs), F.size(canonical_segs)
    return (
        F.when(canonical_segs.isNull(), "unusable")
        .when(examples_critical & ~forced, "critical")
        .when((literals < 2) | (T.literal_chars(canonical_segs) < 8), "too_general")
        .when((size - literals) / size > 0.5, "mostly_placeholders")
    )


def learn_lines(trash: DataFrame, kept: DataFrame, action: str = "drop") -> DataFrame:
    """Line rules from lines marked as trash (program, subcommand, line) that no kept line (line) matches.

    One rule per shape and scope with the number of examples; the reason if the shape is refused, else null.
    """
    rows = trash.withColumn("pattern", T.segments(F.col("line"))).withColumn("canonical", T.canonical(F.col("pattern")))
    shapes = rows.groupBy("program", "subcommand", "canonical").agg(
        F.count("*").alias("examples"), F.min("line").alias("example"), F.first("pattern").alias("pattern"), F.max(is_critical(F.col("line"))).alias("_critical")
    )
    clash = kept.select(T.join_key(T.segments(F.col("line"))).alias("_key")).distinct().withColumn("_kept", F.lit(True))
    out = shapes.withColumn("_key", T.join_key(F.col("pattern"))).join(clash, "_key", "left")
    reason = F.coalesce(guard(F.col("pattern"), F.col("_critical"), F.lit(False)), F.when(F.col("_kept"), "matches_kept"))
    ident = rule_id(F.col("program"), F.col("subcommand"), F.col("canonical"), F.lit(action))
    return out.select(ident.alias("id"), "program", "subcommand", "canonical", "pattern", "examples", "example", F.lit(action).alias("action"), reason.alias("reason"))


def merge_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of rule sets by id: counters add up, creation is the earliest, the last hit the latest, enabled only if all are."""
    return a.unionByName(b).groupBy("id").agg(
        F.sum("hits").cast("bigint").alias("hits"),
        F.sum("lines_removed").cast("bigint").alias("lines_removed"),
        F.min("created_millis").alias("created_millis"),
        F.max("last_hit_millis").alias("last_hit_millis"),
        F.bool_and("enabled").alias("enabled"),
        F.bool_or("forced").alias("forced"),
    )


def prune(rules: DataFrame, now_millis: int, days: int) -> DataFrame:
    """The rules that stay: those with hits and those younger than so many days."""
    return rules.filter((F.col("hits") > 0) | (F.col("created_millis") >= now_millis - days * 86_400_000))


def set_enabled(rules: DataFrame, ids: list[str], enabled: bool) -> DataFrame:
    return rules.withColumn("enabled", F.when(F.col("id").isin(*ids), F.lit(enabled)).otherwise(F.col("enabled")))


def resolve(rules: DataFrame, prefix: str) -> DataFrame:
    """The rule whose id is the prefix, or the only one that begins with it; else nothing."""
    hits = rules.filter(F.col("id").startswith(prefix))
    n = hits.agg(F.count("*").alias("_n"), F.count_if(F.col("id") == prefix).alias("_exact"))  # one row
    some = hits.crossJoin(F.broadcast(n)).filter((F.col("id") == prefix) | ((F.col("_exact") == 0) & (F.col("_n") == 1)))
    return some.select(*rules.columns)


def retire(rules: DataFrame, kept: DataFrame) -> DataFrame:
    """Rules, with wildcards or without, that match a line which must stay (line) are switched off."""
    hit = covering(kept.select("line", T.segments(F.col("line")).alias("_segs")), rules, ["rule_id"]).distinct()
    out = rules.join(hit.select(F.col("rule_id").alias("id"), F.lit(True).alias("_hit")), "id", "left")
    return out.withColumn("enabled", F.col("enabled") & F.col("_hit").isNull()).select(*rules.columns)


def top(rules: DataFrame, limit: int = 30) -> DataFrame:
    """A report of the rules that saved most."""
    return rules.orderBy(F.desc("tokens_saved"), "id").limit(limit)
