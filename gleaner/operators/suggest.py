"""Suggestions: line shapes that recur over runs and that no rule covers yet, and drafts of lessons from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import templates as T
from gleaner.functions.text import is_blank, is_critical, token_estimate
from gleaner.operators.rules import covering


def suggestions(lines: DataFrame, min_runs: int = 2, rules: DataFrame | None = None, runs: DataFrame | None = None) -> DataFrame:
    """Shapes of uncritical lines (scope, run, ln, line) that at least `min_runs` runs of a scope share.

    Adds how many runs the scope has (`of_runs`), lines, tokens and the first example. Shapes that a line rule
    matches, wildcards or not, are left out, whatever its scope. First by run, then by shape, so no key is hot.
    `runs` (scope, a row for each run) counts runs without lines as well; without it, runs are those that `lines` has.
    """
    rows = lines.filter(~is_blank(F.col("line")) & ~is_critical(F.col("line")))
    rows = rows.select("scope", "run", "ln", "line", T.segments(F.col("line")).alias("segs")).filter("segs is not null")
    rows = rows.withColumn("shape", T.canonical(F.col("segs")))
    if rules is not None:
        shapes = rows.groupBy("shape").agg(F.first("segs").alias("_segs"))
        rows = rows.join(covering(shapes, rules, ["shape"]).distinct(), "shape", "left_anti")
    by_run = rows.groupBy("scope", "shape", "run").agg(
        F.count("*").alias("n"), F.sum(token_estimate(F.col("line"))).alias("tok"), F.min(F.struct("ln", "line")).alias("first")
    )
    found = by_run.groupBy("scope", "shape").agg(
        F.count("*").alias("runs"), F.sum("n").alias("lines"), F.sum("tok").alias("tokens"), F.min(F.struct("run", "first")).getField("first").getField("line").alias("example")
    )
    runs = lines.groupBy("scope", "run").agg(F.lit(1).alias("_one")) if runs is None else runs
    scopes = runs.groupBy("scope").agg(F.count("*").alias("of_runs"))
    return found.filter(F.col("runs") >= min_runs).join(scopes, "scope")


def draft(found: DataFrame, limit: int = 20) -> DataFrame:
    """One lesson text per scope from its `limit` most expensive suggestions (a report's feature)."""
    best = Window.partitionBy("scope").orderBy(F.desc("tokens"), "shape")
    top = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "example"))), lambda x: x.example), "\n")
    return top.groupBy("scope").agg(F.concat(F.lit("<filter-trash>\n"), body, F.lit("\n</filter-trash>\n")).alias("lesson"))
