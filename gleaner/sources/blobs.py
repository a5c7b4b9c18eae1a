"""A store of originals on disk: content-addressed, in buckets of the hash, append-only but for sweeps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.operators import store
from gleaner.sources.files import children, file_bytes, move
from gleaner.sources.scratch import materialize, remove

SCHEMA = "hash string, content string, bytes bigint"
BUCKET_CHARS = 2
#: Up to so many new hashes (a hash is some 100 bytes) are broadcast to the contents, so that contents that are stored do not move.
FEW = 200_000


class BlobStore:
    """Blobs (hash, content, bytes) under a path, a folder for each bucket of the hash's first characters.

    Files are written beside the store and moved into their bucket, a bucket at a time, so a reader sees whole files only and
    a writer that dies leaves the store as it was; writing again is harmless, as what is there is not written twice. A sweep
    moves a new generation of a bucket into place before the old one goes; readers take the newest. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _bucket(self) -> F.Column:
        return F.substring(F.regexp_replace("hash", "^[a-z0-9]+:", ""), 1, BUCKET_CHARS)

    def _generations(self) -> dict[str, int]:
        """The newest generation of each bucket (at most 16 to the power of BUCKET_CHARS)."""
        out = {}
        for name in children(self.spark, self.path):
            if name.startswith("bucket="):
                found = [int(g[2:]) for g in children(self.spark, f"{self.path}/{name}") if g.startswith("g=")]
                if found:
                    out[name[7:]] = max(found)
        return out

    def blobs(self, buckets: list[str] | None = None) -> DataFrame:
        """What is stored, of some buckets or all: hash, content, bytes, bucket."""
        paths = [f"{self.path}/bucket={b}/g={g}" for b, g in self._generations().items() if buckets is None or b in buckets]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA).withColumn("bucket", F.lit(""))
        rows = self.spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(*paths)
        return rows.withColumn("bucket", self._bucket())

    def _place(self, rows: DataFrame, generations: dict[str, int], part: bool) -> None:
        stage = f"{self.path}/_stage-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(stage)
        for name in children(self.spark, stage):
            if name.startswith("bucket="):
                target = f"{self.path}/{name}/g={generations.get(name[7:], 0)}"
                move(self.spark, f"{stage}/{name}", f"{target}/p={uuid.uuid4().hex}" if part else target)
        remove(self.spark, stage)

    def put(self, new: DataFrame) -> DataFrame:
        """Store contents (hash, content) that are not there yet, once each. Returns the hashes written, with their bytes.

        Only the buckets of the new hashes are looked at, and of those only the hashes. Null contents are not stored. Which
        hashes are new is found without the contents; those move once, into their buckets. `new` is read twice.
        """
        rows = new.filter("content is not null").select("hash", F.col("content").cast("string").alias("content"), self._bucket().alias("bucket"))
        asked = materialize(rows.groupBy("hash", "bucket").agg(F.min(F.octet_length("content")).cast("bigint").alias("bytes")), "blobs-asked")
        touched = [r[0] for r in asked.select("bucket").distinct().collect()]  # bounded by the number of buckets
        fresh = materialize(asked.join(self.blobs(touched).select("hash"), "hash", "left_anti"), "blobs-fresh")
        n = fresh.count()
        if n:
            if n <= FEW:
                rows = rows.join(F.broadcast(fresh.select("hash")), "hash", "left_semi").select(*rows.columns)
            dealt = rows.withColumn("_new", F.lit(False)).unionByName(fresh.select("hash", F.lit(None).cast("string").alias("content"), "bucket", F.lit(True).alias("_new")))
            once = dealt.repartition("bucket").groupBy("bucket", "hash").agg(F.min_by("content", F.octet_length("content")).alias("content"), F.bool_or("_new").alias("_new"))
            once = once.filter("_new and content is not null").select("hash", "content", F.octet_length("content").cast("bigint").alias("bytes"), "bucket")
            self._place(once, self._generations(), part=True)
        return fresh.select("hash", "bytes")

    def remove(self, hashes: DataFrame) -> DataFrame:
        """Remove blobs by hash; returns those that were there, with their bytes. Only their buckets are written again."""
        wanted = hashes.select("hash").distinct().withColumn("bucket", self._bucket())
        wanted = materialize(wanted, "blobs-gone")
        touched = [r[0] for r in wanted.select("bucket").distinct().collect()]
        held = self.blobs(touched)
        gone = materialize(held.join(wanted.select("hash"), "hash", "left_semi").select("hash", "bytes", "bucket"), "blobs-removed")
        emptied = [r[0] for r in gone.select("bucket").distinct().collect()]
        if emptied:
            old = self._generations()
            left = self.blobs(emptied).join(gone.select("hash"), "hash", "left_anti")
            self._place(left.repartition("bucket"), {b: old[b] + 1 for b in emptied}, part=False)
            for b in emptied:
                remove(self.spark, f"{self.path}/bucket={b}/g={old[b]}")
        return gone.select("hash", "bytes")

    def get(self, hashes: DataFrame) -> DataFrame:
        """Contents by hash (hash, content, intact): not intact if the content is no longer what its hash says."""
        found = self.blobs().join(hashes.select("hash").distinct(), "hash", "left_semi")
        return found.select("hash", "content", (F.sha2("content", 256) == F.regexp_replace("hash", "^[a-z0-9]+:", "")).alias("intact"))

    def hashes(self) -> DataFrame:
        """All hashes, sorted."""
        return self.blobs().select("hash").orderBy("hash")

    def stats(self) -> DataFrame:
        """One row: blobs, their original bytes, and the bytes of the files."""
        stored = sum(file_bytes(self.spark, f"{self.path}/bucket={b}/g={g}") for b, g in self._generations().items())
        return self.blobs().agg(F.count("*").alias("blobs"), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes"), F.lit(stored).cast("bigint").alias("stored_bytes"))

    def clean(self) -> int:
        """Remove what writers that died have left; returns how many such folders there were."""
        left = [n for n in children(self.spark, self.path) if n.startswith("_stage-")]
        for name in left:
            remove(self.spark, f"{self.path}/{name}")
        return len(left)

    def gc(self, capsules: DataFrame, now_millis: int, max_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
        """(the capsules that stay, one row of counters) after expiry and eviction; blobs without a capsule are swept.

        Capsules: id, hash, created, expires_millis, bytes. Expired ones go first; then, with a budget, the oldest until the
        rest fits. Counters: expired, evicted, bytes (of the capsules that went), blobs and blob_bytes (that were swept).
        """
        old = materialize(store.expired(capsules, now_millis).select("id", "bytes"), "gc-expired")
        young = materialize(capsules.join(old.select("id"), "id", "left_anti").select(capsules.columns), "gc-young")
        evicted = materialize(store.evict(young, max_bytes).select("id", "bytes") if max_bytes > 0 else young.select("id", "bytes").limit(0), "gc-evicted")
        left = materialize(young.join(evicted.select("id"), "id", "left_anti").select(capsules.columns), "gc-left")
        swept = self.remove(store.unreferenced(self.blobs().select("hash"), left))
        total = lambda df, name: df.agg(F.count("*").alias(name), F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias(f"{name}_bytes"))
        counts = total(old, "expired").join(total(evicted, "evicted")).join(total(swept, "blobs"))  # a row each
        freed = (F.col("expired_bytes") + F.col("evicted_bytes")).alias("bytes")
        return left, counts.select("expired", "evicted", freed, "blobs", F.col("blobs_bytes").alias("blob_bytes"))
