"""The store of originals: content addressing, handles, lookup, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.scratch import materialize

HANDLE_LENGTHS = (5, 7, 9, 11)


def dedup(docs: DataFrame, hash_col: str = "hash") -> DataFrame:
    """One blob for each content: its hash, bytes, how many documents share it, and the first of them."""
    return docs.groupBy(hash_col).agg(F.min("doc_id").alias("first_id"), F.count("*").alias("refs"), F.max(F.octet_length("text")).cast("bigint").alias("bytes"))


def put(blobs: DataFrame, new: DataFrame) -> DataFrame:
    """The blobs of `new` (hash, content) that are not stored yet, once each."""
    return new.dropDuplicates(["hash"]).join(blobs.select("hash"), "hash", "left_anti")


def verify(blobs: DataFrame) -> DataFrame:
    """Blobs whose content is no longer what their hash says."""
    return blobs.filter(F.sha2("content", 256) != F.col("hash"))


def short_handles(hashes: DataFrame) -> DataFrame:
    """For each distinct hash the shortest prefix of 5, 7, 9 or 11 characters that no other hash shares; else empty.

    Independent of the order in which hashes came; one window per length over the prefix.
    """
    out = hashes.select("hash").distinct()
    handle: Column = F.lit("")
    for n in reversed(HANDLE_LENGTHS):
        prefix = F.substring("hash", 1, n)
        out = out.withColumn(f"_n{n}", F.count("*").over(Window.partitionBy(prefix)))
        handle = F.when(F.col(f"_n{n}") == 1, prefix).otherwise(handle)
    return out.select("hash", handle.alias("handle"))


def prefix_ranges(keys: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each prefix (wanted: prefix) how many keys (key, distinct) begin with it, and the key if it is the only one.

    A prefix is an interval of the sorted keys. Keys and the ends of all intervals are sorted together, once, whatever
    lengths prefixes have; running counts by range partition number them, and a single key is found by its number. Every
    key begins with the empty prefix; a null prefix has none.
    """
    spark = keys.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = wanted.select("prefix").filter("prefix is not null").distinct()
    rows = keys.select(F.col("key"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("prefix"))
    for kind, end in ((0, F.col("prefix")), (2, F.concat("prefix", F.lit("\U0010ffff")))):
        rows = rows.unionByName(asked.select(end.alias("key"), F.lit(kind).alias("kind"), "prefix"))
    rows = materialize(rows.repartitionByRange(parts, "key", "kind").withColumn("_block", F.spark_partition_id()), "lookup-order")
    one = F.when(F.col("kind") == 1, 1).otherwise(0)
    sums = rows.groupBy("_block").agg(F.sum(one).alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.sum(one).over(Window.partitionBy("_block").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
    placed = materialize(rows.withColumn("_own", own).join(sums, "_block").select("key", "kind", "prefix", (F.col("_before") + F.col("_own")).alias("place")), "lookup-places")
    ends = placed.filter("kind <> 1").groupBy("prefix").agg(F.min("place").alias("first"), (F.max("place") - F.min("place")).alias("matches"))
    single = ends.filter("matches = 1").select("prefix", (F.col("first") + 1).alias("place"))
    found = single.join(placed.filter("kind = 1").select("place", "key"), "place").select("prefix", F.col("key").alias("found"))
    return ends.select("prefix", "matches").join(found, "prefix", "left")


def resolve(blobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Look prefixes up: `found` is the hash if exactly one begins with the prefix (wanted: prefix; longer than any hash: none)."""
    out = prefix_ranges(blobs.select(F.col("hash").alias("key")).distinct(), wanted)
    return wanted.select("prefix").join(out, "prefix", "left").select("prefix", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"), "found")


def reference(handle: Column, ident: Column) -> Column:
    """How a stored original is named in texts: by its short handle, or by its id where there is none."""
    return F.concat(F.lit("cap://"), F.coalesce(F.nullif(handle, F.lit("")), ident))


def lookup(capsules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Find capsules (id, hash) by what a text names (wanted: name): an id, else a short handle, else a prefix of one id only.

    `cap://` in front is ignored. Returns name, id and `how`: id, short, prefix, ambiguous or missing. Of capsules of one
    content, a handle names the one with the smallest id.
    """
    names = wanted.select("name").distinct().withColumn("prefix", F.regexp_replace(F.trim("name"), "^(cap://)+", ""))
    exact = capsules.select(F.col("id").alias("prefix"), F.col("id").alias("_exact")).distinct()
    first = capsules.groupBy("hash").agg(F.min("id").alias("_short"))
    handles = short_handles(capsules).filter("handle <> ''").join(first, "hash").select(F.col("handle").alias("prefix"), "_short")
    near = names.join(exact, "prefix", "left").join(handles, "prefix", "left")
    near = materialize(near, "lookup-names")
    open_ = near.filter("_exact is null and _short is null")
    ranges = prefix_ranges(capsules.select(F.col("id").alias("key")).distinct(), open_)
    out = near.join(ranges, "prefix", "left")
    how = (
        F.when(F.col("_exact").isNotNull(), "id").when(F.col("_short").isNotNull(), "short").when(F.col("matches") == 1, "prefix").when(F.col("matches") > 1, "ambiguous").otherwise("missing")
    )
    return out.select("name", F.coalesce("_exact", "_short", "found").alias("id"), how.alias("how"))


def unreferenced(blobs: DataFrame, capsules: DataFrame) -> DataFrame:
    return blobs.join(capsules.select("hash"), "hash", "left_anti")


def expired(capsules: DataFrame, now_millis: int) -> DataFrame:
    return capsules.filter(F.col("expires_millis") <= now_millis)


def evict(capsules: DataFrame, max_bytes: int) -> DataFrame:
    """The oldest capsules that go until the rest fits the budget (id, created, bytes; ties by id).

    A capsule goes while what is left before it goes is still above the budget. The running sum is taken by range
    partitions of the creation order: their sums first, so no task sees more than a partition.
    """
    parts = max(1, int(capsules.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = capsules.repartitionByRange(parts, "created", "id").withColumn("_block", F.spark_partition_id())
    rows = materialize(rows, "store-order")  # the blocks stay as they are between the passes
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    sums = rows.groupBy("_block").agg(F.sum("bytes").alias("_sum"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sums = sums.select("_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    own = Window.partitionBy("_block").orderBy("created", "id").rowsBetween(Window.unboundedPreceding, -1)
    gone = rows.join(F.broadcast(sums), "_block").withColumn("_gone", F.col("_before") + F.coalesce(F.sum("bytes").over(own), F.lit(0)))
    return gone.filter(F.lit(total) - F.col("_gone") > max_bytes).select(*capsules.columns)


def retrieve(capsules: DataFrame, level: int, raw_allowed: bool = False) -> DataFrame:
    """The best stored level up to `level` (levels: map of level to text), else the original.

    The original of a secret capsule is withheld unless allowed, also where it would only be the fallback.
    """
    keys = F.filter(F.map_keys("levels"), lambda k: k <= level)
    best = F.array_max(keys)
    raw = (F.lit(level) >= 4) | best.isNull()
    withheld = raw & (F.col("sensitivity") == "secret") & F.lit(not raw_allowed)
    text = F.when(withheld, None).when(raw, F.col("raw")).otherwise(F.element_at("levels", best))
    return capsules.withColumn("content", text).withColumn("withheld", withheld)


def newest(capsules: DataFrame, limit: int = 20) -> DataFrame:
    """A report of the newest capsules."""
    return capsules.orderBy(F.desc("created"), "id").limit(limit)
