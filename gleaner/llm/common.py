"""Shared pieces of the corpus operators: word patterns, tables, and the scratch tables of the core library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import let
from gleaner.sources.scratch import materialize, materialize_by, remove, scratch_path, shared_dir, temporary

__all__ = ["SPACE", "WORD", "free_names", "let", "materialize", "materialize_by", "partitions", "remove", "scratch_path", "shared_dir", "table", "temporary", "words_of"]

#: White space of the word contract: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

def words_of(text: Column) -> Column:
    """The words of a text (null: none), in order, as an array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores in front as it takes that the table has none of them, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
