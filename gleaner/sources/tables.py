"""Readers of the base tables, and views that render them as logs, search results and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.text import lines


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exploded_lines(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """One row per line: the kept columns, ln from 1, line."""
    out = df.select(*keep, F.posexplode(lines(F.col(text_col))).alias("_pos", "line"))
    return out.select(*keep, (F.col("_pos") + 1).alias("ln"), "line")


def applog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as log lines: a document per user, numbered in the order of time."""
    e = read(spark, sf_dir, "events")
    text = lambda c: F.col(c).cast("string")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    failure = F.concat(
        F.lit(" failed: expected 200 got "), (400 + F.col("event_id") % 5).cast("string"),
        F.lit(" at src/app.py:"), (1 + F.col("event_id") % 90).cast("string"),
    )
    line = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" user="), text("user_id"), F.lit(" event="), F.col("event_type"),
        F.lit(" id="), text("event_id"), F.when(F.col("event_type") == "error", failure).otherwise(""),
    )
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("doc_id"), F.row_number().over(order).alias("ln"), line.alias("line"), "event_type", "event_id", "ts")


def greplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as search results `path:line:text`."""
    li = read(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("orders/"), F.col("l_returnflag"), F.lit(".tbl:"), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_orderkey").cast("string"))
    return li.select(line.alias("line"))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as runs of a ledger."""
    e = read(spark, sf_dir, "events")
    method = F.element_at(F.array(*[F.lit(m) for m in ("provider", "tokenizer", "estimated", "unavailable")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select(
        F.lit("run").alias("t"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("at_millis"),
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project"),
        F.col("event_type").alias("program"),
        (1000 + F.col("event_id") % 977).alias("tokens_before"),
        (F.col("event_id") % 1013).alias("tokens_after"),
        method.alias("method"),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as failure reports that hold facts of many kinds."""
    e = read(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    i = F.col("event_id")
    line = F.concat(
        F.lit("build v"), text(i % 4), F.lit("."), text(i % 11), F.lit("."), text(i % 7), F.lit("-rc1 of commit "), F.substring(F.md5(text(i)), 1, 12),
        F.lit(" exited with status "), text(i % 5), F.lit(": TypeError E"), text(100 + i % 900), F.lit(", must not pass, CVE-2024-"),
        text(1000 + i % 77), F.lit(", exit code: "), text(i % 3),
    )
    return e.select("event_id", line.alias("line"))
