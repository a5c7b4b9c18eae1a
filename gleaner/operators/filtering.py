"""The filter of learned rules: lines, blocks, folds and whitelists of one rule table in one pass over all texts.

Lines meet the different shapes of all template lines once, however many rules share a shape. A block is looked for where the
line stands that fewest rules have in common, and is where all its templates meet successive filled lines, so blank lines
inside it do not count. At each line the tallest rule wins, then the smaller id. Whether a run is taken does not depend on
other rules, so only runs that overlap have to be read in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import templates as T
from gleaner.functions.text import is_blank, is_critical, token_estimate
from gleaner.operators import learning
from gleaner.operators import rules as R
from gleaner.sources.scratch import materialize
from gleaner.sources.tables import exploded_lines

REMOVES = ("drop", "fold")


def templates(rules: DataFrame) -> DataFrame:
    """The template lines of enabled rules: id (rule, at, height), program, subcommand, pattern, wild, action, summary.

    Takes learned rules (`learning.RULES`: `lines`, `caption`) and line rules (`rules.rule_table`: `pattern`, `summary`).
    A rule without lines, or with a null one, matches nothing.
    """
    rules = rules.filter("enabled")
    if "pattern" in rules.columns:
        each = rules.select("*", F.lit(0).alias("_at"), F.lit(1).alias("_height"))
    else:
        each = rules.select("*", F.posexplode("lines").alias("_at", "_line"), F.size("lines").alias("_height"))
        each = each.withColumn("pattern", learning.pattern_of(F.col("_line"))).withColumn("summary", F.col("caption"))
    ident = F.struct(F.col("id").alias("rule"), F.col("_at").alias("at"), F.col("_height").alias("height"))
    wild = F.exists("pattern", lambda s: s.cls == "*")
    return each.select(ident.alias("id"), "program", "subcommand", "pattern", wild.alias("wild"), "action", F.coalesce("summary", F.lit("")).alias("summary"))


def dealt_lines(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The lines of texts that are dealt by text before they are split: few large input files make no few large tasks, and lines do not move again."""
    return exploded_lines(docs.select(*keep, "text").repartition("doc_id"), keep)


def numbered(lines: DataFrame, sizes: list[int] | None = None) -> DataFrame:
    """Lines with what all rules need: their template, whether they are critical or blank, and the count of filled lines so far.

    With `sizes`, only lines of so many tokens have a template: rules of these sizes can match no others.
    """
    so_far = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_blank", is_blank(F.coalesce("line", F.lit(""))))
    rows = rows.withColumn("_k", F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(so_far))
    return rows.withColumns({"_segs": T.segments(F.col("line"), sizes), "critical": is_critical(F.coalesce("line", F.lit("")))})  # once lines are dealt


def runs(marks: DataFrame, each: DataFrame, scoped: bool = False) -> DataFrame:
    """All places where a whole rule matches: doc_id, start, end (line numbers), rule, height, action, summary, critical.

    `marks` are lines with a shape that they have (doc_id, ln, _k, critical, shape), `each` template lines with their shape.
    """
    few = each.count() <= R.BROADCAST_RULES
    side = lambda df: F.broadcast(df) if few else df
    scope = R.applies(F.col("program"), F.col("subcommand")) if scoped else F.lit(True)
    rules = each.select("id.*", F.col("program").alias("r_program"), F.col("subcommand").alias("r_subcommand"), "shape", "action", "summary")
    one = marks.join(side(rules.filter("height = 1")), "shape").filter(scope)
    one = one.select("doc_id", F.col("ln").alias("start"), F.col("ln").alias("end"), "rule", "height", "action", "summary", "critical")
    whole = Window.partitionBy("rule", "height")
    tall = rules.filter("height > 1").withColumn("_shared", F.count("*").over(Window.partitionBy("shape")))
    tall = tall.withColumn("_rarest", F.min(F.struct("_shared", "at")).over(whole)).withColumn("_all", F.collect_list(F.struct("at", "shape")).over(whole))
    rarest = tall.filter("at = _rarest.at").select("rule", "height", "r_program", "r_subcommand", "shape", "at", "_all")
    begun = marks.join(side(rarest), "shape").filter(scope).select("doc_id", (F.col("_k") - F.col("at")).alias("_from"), "rule", "height", "r_program", "r_subcommand", F.explode("_all").alias("_each"))
    begun = begun.withColumns({"_k": F.col("_from") + F.col("_each.at"), "shape": F.col("_each.shape")}).drop("_each")
    met = begun.join(marks, ["doc_id", "_k", "shape"]).filter(scope).groupBy("doc_id", "_from", "rule", "height").agg(
        F.count("*").alias("_n"), F.min("ln").alias("start"), F.max("ln").alias("end"), F.bool_or("critical").alias("critical")
    )
    heads = rules.filter("height > 1 and at = 0").select("rule", "height", "action", "summary")
    return one.unionByName(met.filter("_n = height").join(side(heads), ["rule", "height"]).select(*one.columns))


def _in_order(candidates: DataFrame) -> DataFrame:
    """Of runs that overlap those that a reading from the first line to the last takes (doc_id, _g, start, end, ..)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, until = None, -1
        for batch in batches:
            names = batch.schema.names
            keys = zip(*[batch.column(names.index(c)).to_pylist() for c in ("doc_id", "_g", "start", "end")], strict=True)
            taken = []
            for doc, g, start, end in keys:
                if group != (doc, g):
                    group, until = (doc, g), -1
                taken.append(start > until)
                until = end if start > until else until
            yield batch.filter(pa.array(taken, pa.bool_()))

    return candidates.repartition("doc_id", "_g").sortWithinPartitions("doc_id", "_g", "start").mapInArrow(read, candidates.schema)


def chosen(places: DataFrame, protect_errors: bool = True) -> DataFrame:
    """The runs that are taken: doc_id, start, end, rule, height, action, summary; no two of them share a line.

    Runs that no other one touches are taken as they are; groups of overlapping runs are read in order, a group a unit of
    work, so a text with many of them is no unit. A run with a critical line is not taken while errors are protected.
    """
    free = (places.filter(~F.col("critical")) if protect_errors else places).repartition("doc_id")  # once for all that follows
    first = F.min(F.struct((-F.col("height")).alias("h"), "rule", "end", "action", "summary")).alias("r")
    best = free.groupBy("doc_id", "start").agg(first).select("doc_id", "start", "r.end", "r.rule", (-F.col("r.h")).alias("height"), "r.action", "r.summary")
    line = Window.partitionBy("doc_id").orderBy("start")
    reached = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_g", F.sum(F.when(reached >= F.col("start"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    alone = F.coalesce(F.lag("_g").over(line) != F.col("_g"), F.lit(True)) & F.coalesce(F.lead("_g").over(line) != F.col("_g"), F.lit(True))
    best = materialize(best.withColumn("_alone", alone), "filter-runs")
    return best.filter("_alone").unionByName(_in_order(best.filter("not _alone"))).drop("_g", "_alone")


def decided(lines: DataFrame, rules: DataFrame, scoped: bool = False, protect_errors: bool = True) -> tuple[DataFrame, DataFrame]:
    """(lines with their fate, all places where a rule matches).

    Fates: `rule` names the rule that takes the line (a blank inside a block goes with it); `keep` the first whitelist rule
    that names it; `state` is cut, away (no whitelist rule names it), gone (a blank behind a removed line) or stay.
    A whitelist holds for every text in its scope, whether it names a line there or not. Lines are numbered within a text;
    a null line is blank. With `scoped`, lines have program and subcommand.
    """
    each = templates(rules).withColumns({"_key": T.join_key(F.col("pattern")), "_n": F.monotonically_increasing_id()})
    each = materialize(each.withColumn("shape", F.min("_n").over(Window.partitionBy("_key"))), "filter-rules")
    sizes = each.filter("size(pattern) > 0").select(F.size("pattern"), "wild").distinct().collect()  # at most MAX_TOKENS, twice
    rows = numbered(lines, sorted({r[0] for r in sizes})).withColumn("_key", T.join_key(F.col("_segs")))
    rows = rows.withColumn("_segs", F.when(F.lit(any(r[1] for r in sizes)), F.col("_segs")))  # keys do where no rule has a wildcard
    rows = materialize(rows, "filter-lines")
    shapes = each.filter("_n = shape").withColumn("id", F.col("shape"))
    names = ["doc_id", "ln", "_k", "critical", *(("program", "subcommand") if scoped else ())]
    marks = R.covering(rows.filter("doc_id is not null"), shapes, [*names, "rule_id"]).withColumnRenamed("rule_id", "shape")
    marks = materialize(marks, "filter-marks")
    places = materialize(runs(marks, each.filter(F.col("action").isin(*REMOVES)), scoped), "filter-places")
    took = chosen(places, protect_errors).select("doc_id", F.col("start").alias("ln"), F.struct("end", "rule", "height", "action", "summary").alias("_run"))
    naming = each.filter("action = 'keep' and id.height = 1")
    scope = R.applies(F.col("program"), F.col("subcommand")) if scoped else F.lit(True)
    named = naming.select("shape", "id.rule", F.col("program").alias("r_program"), F.col("subcommand").alias("r_subcommand"))
    kept = marks.join(named, "shape").filter(scope).groupBy("doc_id", "ln").agg(F.min("rule").alias("_named"))
    rows = rows.drop("_segs", "_key")
    # what is known of a line comes before it in one order, so lines move once and meet it without a join
    out = rows.withColumn("_is", F.lit(1))
    for known in (took, kept):
        out = out.unionByName(known.withColumn("_is", F.lit(0)), allowMissingColumns=True)
    so_far = Window.partitionBy("doc_id").orderBy("ln", "_is").rowsBetween(Window.unboundedPreceding, 0)
    named = F.last(F.when(F.col("_named").isNotNull(), F.struct("ln", "_named")), ignorenulls=True).over(so_far)
    out = out.withColumns({"_run": F.last("_run", ignorenulls=True).over(so_far), "_named": named}).filter("_is = 1")
    out = out.withColumn("keep", F.when(F.col("_named.ln") == F.col("ln"), F.col("_named._named")))
    doc = Window.partitionBy("doc_id").orderBy("ln")
    inside = F.col("_run").isNotNull() & (F.col("ln") <= F.col("_run.end"))
    part = lambda c: F.when(inside, F.col(f"_run.{c}")).alias(c)
    out = out.select(*rows.columns, "keep", *[part(c) for c in ("rule", "height", "action", "summary")], _whitelisted(out, naming, scoped).alias("_listed"))
    safe = F.col("critical") if protect_errors else F.lit(False)
    state = F.when(F.col("rule").isNotNull(), "cut").when(F.col("_blank"), None).when(F.col("_listed") & F.col("keep").isNull() & ~safe, "away").otherwise("stay")
    out = out.withColumn("state", state)
    before = F.last("state", ignorenulls=True).over(doc.rowsBetween(Window.unboundedPreceding, 0))  # of filled and taken lines
    fate = F.when(F.col("state").isNotNull(), F.col("state")).when(before.isin("cut", "away"), "gone").otherwise("stay")
    return out.withColumn("state", fate).drop("_listed"), places


def _whitelisted(rows: DataFrame, naming: DataFrame, scoped: bool) -> Column:
    """Whether a whitelist rule holds for a text: one look at the scopes of such rules, which are few."""
    scopes = naming.select("program", "subcommand").distinct().limit(R.BROADCAST_RULES + 1).collect()
    if len(scopes) > R.BROADCAST_RULES:
        raise ValueError("too many scopes of whitelist rules")
    out = F.lit(False)
    for program, subcommand in scopes:
        one = F.lit(True)
        for value, name in ((program, "program"), (subcommand, "subcommand")):
            if scoped and value is not None:
                one = one & F.coalesce(F.lower(F.col(name)) == value.lower(), F.lit(False))
        out = out | one
    return out


def remaining(fates: DataFrame) -> DataFrame:
    """doc_id, ln, line of what stays: lines as they are, and `[folded] summary (n line(s))` for each run of a fold rule."""
    doc = Window.partitionBy("doc_id").orderBy("ln")
    fold = F.when(F.col("action") == "fold", F.col("rule"))
    rows = fates.withColumn("_fold", fold)
    new = F.when(F.col("_fold").isNotNull() & ~F.col("_fold").eqNullSafe(F.lag("_fold").over(doc)), 1).otherwise(0)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    folds = rows.filter("_fold is not null").groupBy("doc_id", "_run").agg(F.min("ln").alias("ln"), F.count_if(~F.col("_blank")).alias("n"), F.first("summary").alias("summary"))
    text = F.concat(F.lit("[folded] "), F.col("summary"), F.lit(" ("), F.col("n").cast("string"), F.lit(" line(s))"))
    return fates.filter("state = 'stay'").select("doc_id", "ln", "line").unionByName(folds.select("doc_id", "ln", text.alias("line")))


def accounting(fates: DataFrame, places: DataFrame) -> DataFrame:
    """By rule: rule_id, docs, lines and tokens it took, runs, and how often errors kept it from a run (`protected`).

    Lines of whitelist rules count as runs, with no tokens. A protected run counts where it was tried: not inside a run that
    was taken before it, nor behind a rule of higher order that took the line.
    """
    doc = Window.partitionBy("doc_id").orderBy("ln")
    shown = fates.filter("state <> 'gone'").withColumn("_new", ~F.col("rule").eqNullSafe(F.lag("rule").over(doc)))
    cuts = F.col("rule").isNotNull()
    tokens = F.when(cuts & ~F.col("_blank"), token_estimate(F.col("line")))
    ident = F.when(cuts, F.col("rule")).when(F.col("state") == "stay", F.col("keep"))
    taken = shown.select("doc_id", "ln", ident.alias("rule_id"), cuts.alias("_cut"), F.col("height").alias("_h"), "_blank", tokens.alias("tokens"), "_new")
    taken = materialize(taken.filter("rule_id is not null"), "filter-taken")
    cut = taken.filter("_cut").groupBy("rule_id").agg(
        F.count_distinct("doc_id").alias("docs"), F.count_if(~F.col("_blank")).alias("lines"), F.sum(F.coalesce("tokens", F.lit(0))).cast("bigint").alias("tokens"), F.count_if("_new").alias("runs")
    )
    named = taken.filter("not _cut").groupBy("rule_id").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("runs"))
    named = named.select("rule_id", "docs", F.lit(0).cast("bigint").alias("lines"), F.lit(0).cast("bigint").alias("tokens"), "runs")
    at = taken.filter("_cut").select("doc_id", F.col("ln").alias("start"), F.col("rule_id").alias("_r"), "_h")
    tried = places.filter("critical").join(at, ["doc_id", "start"], "left")
    order = lambda h, r: F.struct((-F.col(h)).alias("h"), F.col(r).alias("r"))
    tried = tried.filter(F.col("_r").isNull() | (order("height", "rule") < order("_h", "_r")))
    kept = tried.groupBy(F.col("rule").alias("rule_id")).agg(F.count("*").alias("protected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return cut.unionByName(named).join(kept, "rule_id", "full").select("rule_id", *[zero(c) for c in ("docs", "lines", "tokens", "runs", "protected")])


def filtered(lines: DataFrame, rules: DataFrame, scoped: bool = False, protect_errors: bool = True) -> DataFrame:
    """doc_id, ln, line of what the rules leave of texts given by line (doc_id, ln, line)."""
    return remaining(decided(lines, rules, scoped, protect_errors)[0])


def filter_texts(docs: DataFrame, rules: DataFrame, scoped: bool = False, protect_errors: bool = True) -> DataFrame:
    """doc_id, output of texts (doc_id, text, with `scoped` also program, subcommand): a final line break stays.

    A null or empty text, and one of which nothing is left, gives an empty output.
    """
    keep = ("doc_id", "program", "subcommand") if scoped else ("doc_id",)
    left = filtered(dealt_lines(docs, keep), rules, scoped, protect_errors)
    left = left.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", "line"))).alias("l"))
    ends = docs.select("doc_id", F.coalesce(F.endswith("text", F.lit("\n")), F.lit(False)).alias("_ends"))
    text = F.array_join(F.transform("l", lambda x: x.line), "\n")
    out = F.concat(text, F.when(F.col("_ends") & (F.size("l") > 0), "\n").otherwise(""))
    return ends.join(left, "doc_id", "left").select("doc_id", F.coalesce(out, F.lit("")).alias("output"))
