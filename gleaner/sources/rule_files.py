"""Rule sets in files: read in a fixed order, merged by id, saved whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import learning
from gleaner.sources.files import children, move
from gleaner.sources.logs import RULES_VERSION
from gleaner.sources.scratch import materialize, remove

#: A rule set is a folder of JSON lines; this one comes first, the others by name.
MAIN = "learned-filters.json"
COUNTERS = "hits bigint, lines_removed bigint, tokens_saved bigint, last_hit_millis bigint"
SCHEMA = f"{learning.RULES}, {COUNTERS}"
_SUMMED = ("examples", "hits", "lines_removed", "tokens_saved")


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """The rules of one file or folder of JSON lines. Missing and blank ones are empty; a newer version is an error."""
    if not children(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.text(path).filter(F.trim("value") != "")
    r = rows.select(F.from_json("value", f"version int, {SCHEMA}").alias("r")).select("r.*")
    newer = F.coalesce("version", F.lit(1)) > RULES_VERSION
    return r.withColumn("id", F.when(newer, F.raise_error(F.lit("rules of a newer version"))).otherwise(F.col("id"))).drop("version")


def merged(rows: DataFrame) -> DataFrame:
    """One rule for each id of rows with a column `rank`: what it says is that of the lowest rank, its counters add up.

    It was created at the earliest, hit last at the latest, is on only if all are, and is forced if any is.
    """
    first = lambda c: F.min_by(c, "rank").alias(c)
    how = {c: F.sum(c).cast("bigint").alias(c) for c in _SUMMED}
    how |= {"created_millis": F.min("created_millis").alias("created_millis"), "last_hit_millis": F.max("last_hit_millis").alias("last_hit_millis")}
    how |= {"enabled": F.bool_and("enabled").alias("enabled"), "forced": F.bool_or("forced").alias("forced")}
    names = [c for c in rows.columns if c not in ("id", "rank")]
    return rows.groupBy("id").agg(*[how.get(c, first(c)) for c in names]).select([c for c in rows.columns if c != "rank"])


def read_rule_set(spark: SparkSession, folder: str) -> DataFrame:
    """The rules of all `*.json` in a folder: the main one first, then by name; the same id of two files is one rule."""
    names = [n for n in children(spark, folder) if n.lower().endswith(".json")]
    names = [MAIN] * (MAIN in names) + [n for n in names if n != MAIN]
    out = spark.createDataFrame([], SCHEMA).withColumn("rank", F.lit(0))
    for rank, name in enumerate(names):  # files that people keep by hand
        out = out.unionByName(read_file(spark, f"{folder}/{name}").withColumn("rank", F.lit(rank)))
    return merged(out)


def save(rules: DataFrame, path: str) -> None:
    """Replace a rule set whole: it is written beside its place and moved there, so a crash leaves one of the two.

    A reader that finds nothing at the path after a crash between the moves finds the former set at `<path>.old`.
    """
    spark = rules.sparkSession
    rules = rules.select([F.col(c.split()[0]) if c.split()[0] in rules.columns else F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in SCHEMA.split(", ")])
    stage = f"{path}.tmp-{uuid.uuid4().hex}"
    rules.select(F.lit(RULES_VERSION).alias("version"), "*").write.option("ignoreNullFields", "false").json(stage)
    if children(spark, path):
        remove(spark, f"{path}.old")
        move(spark, path, f"{path}.old")
    move(spark, stage, path)
    remove(spark, f"{path}.old")


def import_rules(mine: DataFrame, theirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rules of both, one row `added` with the number of ids that are new). Rules known already take their counters in."""
    both = merged(mine.withColumn("rank", F.lit(0)).unionByName(theirs.select(mine.columns).withColumn("rank", F.lit(1))))
    both = materialize(both, "rules-import")
    return both, theirs.select("id").distinct().join(mine.select("id"), "id", "left_anti").agg(F.count("*").alias("added"))


def export_rules(rules: DataFrame, program: str | None = None) -> DataFrame:
    """What others may use: rules without their counters, of one program or all."""
    some = rules if program is None else rules.filter(F.lower("program") == program.lower())
    zero = F.lit(0).cast("bigint")
    return some.withColumns({"hits": zero, "lines_removed": zero, "tokens_saved": zero, "last_hit_millis": F.lit(None).cast("bigint")})


def forget(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """The rules that stay when those of a table (id) go."""
    return rules.join(ids.select("id").distinct(), "id", "left_anti").select(rules.columns)
