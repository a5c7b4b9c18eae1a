"""Log clustering: lines grouped by template, worst and most frequent first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import clip, is_blank, log_level, log_template, severity

MAX_CLUSTERS, MIN_LINES = 40, 12


def clusters(lines: DataFrame) -> DataFrame:
    """Per document and template: count, first and last line, the first line as example, its level.

    One aggregation with map-side partials; the first line comes from the least line number, never from row order.
    """
    rows = lines.filter(~is_blank(F.col("line"))).withColumn("template", log_template(F.col("line")))
    first = F.min(F.struct("ln", "line"))
    out = rows.groupBy("doc_id", "template").agg(F.count("*").alias("n"), F.max("ln").alias("last_line"), first.alias("f"))
    return out.select(
        "doc_id", "template", "n", F.col("f.ln").alias("first_line"), "last_line", clip(F.trim("f.line"), 400).alias("example"), log_level(F.col("f.line")).alias("level")
    )


def shown(found: DataFrame, limit: int = MAX_CLUSTERS) -> DataFrame:
    """Clusters with their rank in the document: severity, count, first line. Ranks beyond `limit` are left out and counted."""
    order = [F.desc("severity"), F.desc("n"), F.asc("first_line")]
    w = Window.partitionBy("doc_id")
    ranked = found.withColumn("severity", severity(F.col("level"))).withColumn("rank", F.row_number().over(w.orderBy(*order)))
    hidden = F.col("rank") > limit
    ranked = ranked.withColumn("templates_not_shown", F.count_if(hidden).over(w)).withColumn(
        "lines_not_shown", F.coalesce(F.sum(F.when(hidden, F.col("n"))).over(w), F.lit(0)).cast("bigint")
    )
    return ranked.filter(~hidden)


def pays(lines: str, templates: str) -> Column:
    """Whether clustering pays: enough lines, and at most half as many templates."""
    return (F.col(lines) >= MIN_LINES) & (F.col(templates) * 2 <= F.col(lines))


def compilable(found: DataFrame) -> DataFrame:
    """Documents for which clustering pays."""
    d = found.groupBy("doc_id").agg(F.sum("n").alias("lines"), F.count("*").alias("templates"))
    return d.filter(pays("lines", "templates"))


def render(found: DataFrame) -> DataFrame:
    """One text in the intermediate form per document that clustering pays for. The clusters are made once."""
    doc = Window.partitionBy("doc_id")
    found = found.withColumns({"_lines": F.sum("n").over(doc), "_templates": F.count("*").over(doc)}).filter(pays("_lines", "_templates"))
    head = F.col("rank") <= MAX_CLUSTERS
    body = F.concat(
        F.lit("@section t"), F.col("first_line").cast("string"), F.lit(" count="), F.col("n").cast("string"), F.lit(" lines="),
        F.concat_ws("-", F.col("first_line").cast("string"), F.col("last_line").cast("string")),
        F.when(F.col("level").isNotNull(), F.concat(F.lit(" level="), F.col("level"))).otherwise(""),
        F.lit("\n  "), F.col("example"),
        F.when((F.col("n") > 1) & (F.col("template") != F.col("example")), F.concat(F.lit("\n  template: "), clip(F.col("template"), 300))).otherwise(""),
        F.lit("\n"),
    )
    rows = shown(found).filter(head).select("doc_id", F.struct("rank", body.alias("body")).alias("s"), "templates_not_shown", "lines_not_shown", "_lines", "_templates")
    # at most MAX_CLUSTERS sections a document are gathered
    docs = rows.groupBy("doc_id").agg(
        F.array_sort(F.collect_list("s")).alias("s"), F.max("templates_not_shown").alias("tn"), F.max("lines_not_shown").alias("lnn"), F.max("_lines").alias("lines"), F.max("_templates").alias("templates"),
    )
    more = F.when(F.col("tn") > 0, F.concat(F.lit("templates_not_shown: "), F.col("tn").cast("string"), F.lit("\nlines_not_shown: "), F.col("lnn").cast("string"), F.lit("\n"))).otherwise("")
    text = F.concat(
        F.lit("@log cluster lines="), F.col("lines").cast("string"), F.lit("\ntemplates: "), F.col("templates").cast("string"), F.lit("\n"), more,
        F.array_join(F.transform("s", lambda x: x.body), ""),
    )
    return docs.select("doc_id", text.alias("output"))


def recurring_shapes(lines: DataFrame, scope: str, run: str, min_runs: int = 2) -> DataFrame:
    """Line shapes that several runs of a scope share: runs, lines, tokens, the first example.

    First by run, then by shape: both aggregations have partials, so a shape that is everywhere is no hot key.
    """
    from gleaner.functions.text import token_estimate

    rows = lines.filter(~is_blank(F.col("line"))).withColumn("tpl", log_template(F.col("line")))
    by_run = rows.groupBy(scope, "tpl", run).agg(
        F.count("*").alias("n"), F.sum(token_estimate(F.col("line"))).alias("tok"), F.min(F.struct("ln", "line")).alias("first")
    )
    out = by_run.groupBy(scope, "tpl").agg(
        F.count("*").alias("runs"),
        F.sum("n").alias("lines"),
        F.sum("tok").alias("tokens"),
        F.min(F.struct(F.col(run), F.col("first"))).getField("first").getField("line").alias("example"),
    )
    return out.filter(F.col("runs") >= min_runs)
