"""Operator 3: contiguous byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, table


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents, in the order of their id, into shards whose byte sizes are near equal.

    Rows are range-partitioned by id; each partition sums its bytes, the totals of the partitions (one row each)
    give every partition its global offset, and the shard is where a row's middle byte falls among equal targets.
    So shards are contiguous in id order, and a shard misses its target by less than one document at either end.

    A size is the UTF-8 bytes plus 1, so an empty or null text still counts. Null ids come first. Repeated rows are
    kept, next to each other. An empty table gives no rows. Only the id and the text column are read. Returns the
    id, size, text_crc32, shard and slot (the row's place in its shard, gapless from 0).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("_tie")]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    ranged = ranged.select(
        "doc_id",
        "size",
        "text_crc32",
        F.spark_partition_id().alias("_block"),
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_pos"),
    )
    ranged = materialize(ranged, "shard-order")  # the blocks must stay as they are between the two passes

    in_block = Window.partitionBy("_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = ranged.groupBy("_block").agg(F.count("*").alias("_n"), F.sum("size").alias("_bytes"))
    totals = totals.select(  # a row for each partition, however many documents there are
        "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.sum("_bytes").over(every).alias("_all"),
    )
    placed = ranged.withColumn("_end", F.sum("size").over(in_block)).join(F.broadcast(totals), "_block")
    placed = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.expr(f"cast(least({shards - 1}, (2 * (_bytes_before + _end) - size) * {shards} div (2 * _all)) as int)").alias("shard"),
        (F.col("_rows_before") + F.col("_pos")).alias("_index"),
    )
    firsts = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # at most `shards` rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law of near equal byte sizes."""
    out = shard_by_bytes(table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
