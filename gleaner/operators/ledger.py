"""The usage ledger: totals by project, program and day, compaction into rollups, trailing windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import day_number, method_rank


def totals() -> list[Column]:
    """Sums of a group; what was saved is cut at zero after summing, the method is the weakest."""
    return [
        F.sum("runs").cast("bigint").alias("runs"),
        F.sum("tokens_before").cast("bigint").alias("tokens_before"),
        F.sum("tokens_after").cast("bigint").alias("tokens_after"),
        F.greatest(F.sum("tokens_before") - F.sum("tokens_after"), F.lit(0)).cast("bigint").alias("saved"),
    ]


def weakest() -> Column:
    return F.min_by("method", F.struct(method_rank(F.col("method")), F.col("method"))).alias("method")


def with_runs(rows: DataFrame) -> DataFrame:
    return rows if "runs" in rows.columns else rows.withColumn("runs", F.lit(1).cast("bigint"))


def by_project(rows: DataFrame) -> DataFrame:
    return with_runs(rows).groupBy("project").agg(*totals(), weakest(), F.min("at_millis").alias("first_millis"), F.max("at_millis").alias("last_millis"))


def by_program(rows: DataFrame) -> DataFrame:
    return with_runs(rows).filter(F.col("program").isNotNull()).groupBy("program").agg(*totals())


def rollup_sets(rows: DataFrame) -> DataFrame:
    """Grand total, projects, and programs of projects in one pass; `level` tells which."""
    out = with_runs(rows).rollup("project", "program").agg(*totals(), F.grouping_id().cast("bigint").alias("level"))
    return out.select(F.coalesce("project", F.lit("*")).alias("project"), F.coalesce("program", F.lit("*")).alias("program"), "level", "runs", "tokens_before", "tokens_after", "saved")


def daily(rows: DataFrame, offset_seconds: int = 0, project: str | None = None) -> DataFrame:
    """Totals by day at a fixed offset from UTC; rollups have no day and are left out."""
    rows = rows.filter(F.col("t") == "run")
    if project is not None:
        rows = rows.filter(F.col("project") == project)
    return with_runs(rows).groupBy(day_number(F.col("at_millis"), offset_seconds).alias("day")).agg(*totals())


def trailing(rows: DataFrame, today: int, spans: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """One row: what the days up to today saved, for each span."""
    days = daily(rows)
    within = lambda n: F.col("day").between(today - n + 1, today)
    return days.agg(*[F.coalesce(F.sum(F.when(within(n), F.col("saved"))), F.lit(0)).cast("bigint").alias(f"saved_{n}d") for n in spans])


def dense_days(rows: DataFrame, today: int, days: int) -> DataFrame:
    """The last days with zeros where nothing ran."""
    spark = rows.sparkSession
    series = spark.range(today - days + 1, today + 1).withColumnRenamed("id", "day")
    return series.join(daily(rows), "day", "left").select("day", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("saved", F.lit(0)).alias("saved"))


def compact(rows: DataFrame, cutoff_millis: int) -> DataFrame:
    """Runs before the cutoff and old rollups become one rollup a project; later runs stay. Totals do not change."""
    rows = with_runs(rows)
    old = (F.col("t") == "rollup") | (F.col("at_millis") < cutoff_millis)
    programs = rows.filter(old).groupBy("project", "program").agg(*totals(), weakest(), F.max("at_millis").alias("at_millis"))
    rolled = programs.groupBy("project").agg(
        F.sum("runs").alias("runs"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"),
        weakest(), F.max("at_millis").alias("at_millis"),
    )
    rolled = rolled.withColumn("t", F.lit("rollup")).withColumn("program", F.lit(None).cast("string"))
    names = ["t", "at_millis", "project", "program", "runs", "tokens_before", "tokens_after", "method"]
    return rows.filter(~old).select(*names).unionByName(rolled.select(*names))


def forget(rows: DataFrame, project: str) -> DataFrame:
    return rows.filter(~F.col("project").eqNullSafe(F.lit(project)))


def session_gain(events: DataFrame) -> DataFrame:
    """Totals of each session: events, transformed ones, tokens, saving, secrets, the weakest method.

    With a capsule_id, how many originals were stored as well.
    """
    stored = [F.count("capsule_id").alias("capsules")] if "capsule_id" in events.columns else []
    return with_runs(events).groupBy("session_id").agg(
        *stored, *totals(), F.count_if(F.col("transformed")).alias("transformed"), F.coalesce(F.sum("secrets"), F.lit(0)).cast("bigint").alias("secrets"), weakest()
    )


def ranked(sums: DataFrame, name: str, limit: int | None = None, by: str = "saved") -> DataFrame:
    """A report of sums (a row for each name): the most first, ties by name, with their rank from 1; a limit of 0 is none."""
    rows = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), F.col(name).asc_nulls_first())))  # a row for each name
    return rows.filter(F.col("rank") <= limit) if limit else rows


def forgotten(rows: DataFrame, project: str | None = None) -> DataFrame:
    """One row: how many rows `forget` drops, of a project or, without one, of all."""
    return rows.agg((F.count("*") if project is None else F.count_if(F.col("project").eqNullSafe(F.lit(project)))).alias("dropped"))


def transformer_stats(records: DataFrame) -> DataFrame:
    """By transformer: accepted, rejected, tokens; a rejected one counts its input on both sides, so it saves nothing."""
    after = F.when(F.col("validation") == "accepted", F.col("tokens_after")).otherwise(F.col("tokens_before"))
    return records.groupBy("transformer").agg(
        F.count_if(F.col("validation") == "accepted").alias("accepted"),
        F.count_if(F.col("validation") != "accepted").alias("rejected"),
        F.sum("tokens_before").cast("bigint").alias("tokens_before"),
        F.sum(after).cast("bigint").alias("tokens_after"),
    )


def lifetime(rows: DataFrame) -> DataFrame:
    """Totals over everything, by program and by method in one pass; `level` tells which grouping a row is."""
    g = with_runs(rows).groupingSets([[], ["program"], ["method"]], "program", "method")
    out = g.agg(*totals(), F.min("at_millis").alias("first_millis"), F.max("at_millis").alias("last_millis"), F.grouping_id().cast("bigint").alias("level"))
    return out.select(F.coalesce("program", F.lit("*")).alias("program"), F.coalesce("method", F.lit("*")).alias("method"), "level", "runs", "tokens_before", "tokens_after", "saved", "first_millis", "last_millis")


def replayed(events: DataFrame, capsules: DataFrame, reduced: Callable[[DataFrame], DataFrame], session: str | None = None) -> DataFrame:
    """Recorded runs put through today's reduction again: event_id, transformer, now_transformer, before, recorded, recomputed.

    Events (id, session_id, capsule_id, transformer, tokens_before, tokens_after) meet their stored originals (id, raw); one
    without an original, as after expiry, is left out. `reduced` is the reduction, of doc_id and text. Nothing is written.
    """
    rows = events if session is None else events.filter(F.col("session_id") == session)
    rows = rows.filter("capsule_id is not null").join(capsules.select(F.col("id").alias("capsule_id"), "raw"), "capsule_id")
    now = reduced(rows.select(F.col("id").alias("doc_id"), F.col("raw").alias("text")))
    now = now.select(F.col("doc_id").alias("id"), F.col("transformer").alias("now_transformer"), F.col("tokens_after").alias("recomputed"))
    return rows.drop("raw").join(now, "id").select(
        F.col("id").alias("event_id"), "transformer", "now_transformer", F.col("tokens_before").alias("before"), F.col("tokens_after").alias("recorded"), "recomputed"
    )


def replay_totals(rows: DataFrame) -> DataFrame:
    """By today's transformer (null: none) and in all (`level` 1): events, before, recorded, recomputed, difference."""
    out = rows.rollup("now_transformer").agg(
        F.grouping_id().alias("level"), F.count("*").alias("events"), *[F.sum(c).cast("bigint").alias(c) for c in ("before", "recorded", "recomputed")]
    )
    return out.withColumn("difference", F.col("recomputed") - F.col("recorded"))


def replay(recorded: DataFrame, recomputed: DataFrame) -> DataFrame:
    """What was recorded against what the reduction makes of the originals today (doc_id, tokens_before, tokens_after)."""
    now = recomputed.select("doc_id", F.col("tokens_after").alias("_now"))
    both = recorded.join(now, "doc_id")
    return both.agg(F.count("*").alias("events"), F.sum("tokens_before").alias("before"), F.sum("tokens_after").alias("recorded"), F.sum("_now").alias("recomputed"))
