"""A ledger that grows by batches: repeated batches count once, and old runs are folded together as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleaner.operators import ledger
from gleaner.sources.files import children, file_bytes, move
from gleaner.sources.logs import USAGE_SCHEMA
from gleaner.sources.scratch import remove

MAX_BYTES = 2 << 20
RETAIN_DAYS = 400
COLUMNS = [c.split()[0] for c in USAGE_SCHEMA.split(", ")]


class LedgerSink:
    """Rows of usage as JSON lines under a path: `batch=<n>` holds a batch, `upto=<n>-<k>` all batches up to n, folded.

    A batch is written beside its place and moved there, replacing nothing: a batch that is there already, or that a fold
    has taken in, is not written again, so replays of a stream do not count twice. A fold is moved into place before what it
    replaces goes, and readers take the newest fold and the batches after it, so a crash anywhere loses or doubles nothing.
    """

    def __init__(self, spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, retain_days: int = RETAIN_DAYS) -> None:
        self.spark, self.path, self.max_bytes, self.retain_days = spark, path.rstrip("/"), max_bytes, retain_days

    def _state(self) -> tuple[tuple[int, int], list[int]]:
        """The newest fold (its last batch and number; -1: none) and the batches after it."""
        names = children(self.spark, self.path)
        folds = [tuple(map(int, n[5:].split("-"))) for n in names if n.startswith("upto=")]
        fold = max(folds, default=(-1, -1))
        return fold, sorted(int(n[6:]) for n in names if n.startswith("batch=") and int(n[6:]) > fold[0])

    def _live(self) -> list[str]:
        fold, batches = self._state()
        return [f"upto={fold[0]}-{fold[1]}"] * (fold[0] >= 0) + [f"batch={n}" for n in batches]

    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch once; returns whether it was new. The ledger is folded first if it has grown beyond its size."""
        fold, batches = self._state()
        if batch <= fold[0] or batch in batches:
            return False
        if sum(file_bytes(self.spark, f"{self.path}/{n}") for n in self._live()) > self.max_bytes:
            self.fold()
        stage = f"{self.path}/_stage-{batch}"
        have = ledger.with_runs(rows)
        have.select([F.col(c) if c in have.columns else F.lit(None).alias(c) for c in COLUMNS]).write.mode("overwrite").json(stage)
        move(self.spark, stage, f"{self.path}/batch={batch}")
        return True

    def write(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Append what a stream brings; run to the end with the query's awaitTermination."""
        how = stream.writeStream.foreachBatch(lambda rows, batch: self.append(rows, batch) and None)
        return how.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(rows, one row with records and skipped): lines torn by a crash of another writer are skipped and counted."""
        live = self._live()
        if not live:
            rows = self.spark.createDataFrame([], f"{USAGE_SCHEMA}, _corrupt string")
        else:
            rows = _parsed(self.spark.read.text([f"{self.path}/{n}" for n in live]))
        counts = rows.agg(F.count_if(F.col("_corrupt").isNull()).alias("records"), F.count_if(F.col("_corrupt").isNotNull()).alias("skipped"))
        return rows.filter("_corrupt is null").drop("_corrupt"), counts

    def _replace(self, rows: DataFrame) -> None:
        """Put rows in the place of all that counts now."""
        (last, number), batches = self._state()
        upto, number = (batches[-1], 0) if batches else (last, number + 1)
        stage = f"{self.path}/_stage-upto"
        rows.write.mode("overwrite").json(stage)
        move(self.spark, stage, f"{self.path}/upto={upto}-{number}")
        kept = self._live()
        for name in children(self.spark, self.path):
            if name.startswith(("batch=", "upto=")) and name not in kept:
                remove(self.spark, f"{self.path}/{name}")

    def fold(self, now_millis: int | None = None) -> None:
        """Fold runs older than the days that are kept into one row a project; the newest run is now if no time is given."""
        if self._live():
            rows, _ = self.read()
            now = now_millis if now_millis is not None else rows.agg(F.max("at_millis")).first()[0] or 0
            self._replace(ledger.compact(rows, now - self.retain_days * 86_400_000))

    def forget(self, project: str | None = None) -> int:
        """Remove the rows of a project, or all; returns how many there were."""
        if not self._live():
            return 0
        rows, _ = self.read()
        gone = rows.count() if project is None else rows.filter(F.col("project").eqNullSafe(F.lit(project))).count()
        self._replace(rows.limit(0) if project is None else ledger.forget(rows, project))
        return gone


def _parsed(lines: DataFrame) -> DataFrame:
    rows = lines.select("value").filter(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", f"{USAGE_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("_r"))
    return parsed.select("_r.*")
