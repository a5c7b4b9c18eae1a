"""Sources and sinks: text files, JSON-lines event logs and ledgers, rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = (
    "id string, session_id string, ts_millis bigint, source string, direction string, content_type string, source_hash string, command string, "
    "tokens_before struct<value:bigint,method:string>, tokens_after struct<value:bigint,method:string>, secrets_redacted bigint"
)
USAGE_SCHEMA = (
    "t string, at_millis bigint, project string, program string, runs bigint, tokens_before bigint, tokens_after bigint, method string"
)
RULE_SCHEMA = "version int, id string, program string, subcommand string, example string, action string, summary string, enabled boolean"
RULES_VERSION = 1


def read_texts(spark: SparkSession, path: str, empty: str = "skip") -> DataFrame:
    """One document per file: name, text. The command is made up, so reading again repeats.

    Empty files are left out, or with `empty="error"` end the reading, as there is nothing in them to reduce.
    """
    df = spark.read.text(path, wholetext=True).withColumn("name", F.input_file_name())
    if empty == "error":
        message = F.concat(F.lit("nothing to reduce (empty input): "), "name")
        df = df.withColumn("value", F.when(F.length("value") > 0, F.col("value")).otherwise(F.raise_error(message).cast("string")))
    return df.filter(F.length("value") > 0).select("name", F.col("value").alias("text"), F.concat(F.lit("read "), "name").alias("command"))


def write_events(events: DataFrame, path: str) -> None:
    """Append events, a folder for each session."""
    events.write.mode("append").partitionBy("session_id").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their corrupt rows in `_corrupt`; folder names like `session_id=x` are columns."""
    rows = spark.read.text(path).filter(F.trim("value") != "")
    folders = [c for c in rows.columns if c != "value"]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = rows.select(*folders, F.from_json("value", f"{schema}, _corrupt string", options).alias("_r"))
    inner = [f.name for f in parsed.schema["_r"].dataType.fields if f.name not in folders]
    return parsed.select(*folders, *[F.col(f"_r.{c}") for c in inner])


def read_events(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Events without corrupt lines; of one session: only its folder is read."""
    df = read_lines(spark, path, EVENT_SCHEMA)
    if session is not None:
        df = df.filter(F.col("session_id") == session)
    return df.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def corrupt_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("_corrupt").isNull()).alias("records"), F.count_if(F.col("_corrupt").isNotNull()).alias("skipped"))


def sessions(events: DataFrame) -> DataFrame:
    """Sessions, newest first: their ids sort by time."""
    return events.select("session_id").distinct().orderBy(F.desc("session_id"))


def find_event(events: DataFrame, prefix: str) -> DataFrame:
    """The event whose id begins with a prefix, of the newest session that has one."""
    hits = events.filter(F.col("id").startswith(prefix))
    return hits.orderBy(F.desc("session_id"), "ts_millis", "id").limit(1)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of one or more files; a version newer than ours is an error."""
    df = spark.read.schema(RULE_SCHEMA).json(path)
    known = F.when(F.coalesce("version", F.lit(1)) > RULES_VERSION, F.raise_error(F.lit("rules of a newer version"))).otherwise(F.col("id"))
    return df.withColumn("id", known)


def layered(project: DataFrame, user: DataFrame) -> DataFrame:
    """The rules of both: an id of both layers is the project's rule, which takes in the user's counters.

    Numbers named hits, examples, lines_removed or tokens_saved add up, created_millis is the earliest, last_hit_millis
    the latest; all else is the project's. `origin` tells whose rule it is.
    """
    both = project.withColumn("_l", F.lit(0)).unionByName(user.withColumn("_l", F.lit(1)), allowMissingColumns=True)
    first = lambda c: F.min_by(c, "_l")
    how = {"hits": F.sum, "examples": F.sum, "lines_removed": F.sum, "tokens_saved": F.sum, "created_millis": F.min, "last_hit_millis": F.max}
    named = [how.get(c, first)(c).alias(c) for c in both.columns if c not in ("id", "_l")]
    return both.groupBy("id").agg(*named, F.when(F.min("_l") == 0, "project").otherwise("user").alias("origin"))


def as_json(df: DataFrame) -> DataFrame:
    """Any report as JSON lines."""
    return df.select(F.to_json(F.struct("*")).alias("json"))
