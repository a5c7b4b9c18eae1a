"""Streaming forms of the event log: daily totals with late data, repeats within a time, previous runs by command."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from gleaner.operators.history import WITHIN_MILLIS
from gleaner.sources.scratch import scratch_path

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, pattern: str = "events.parquet") -> DataFrame:
    """New files of an append-only event log."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).parquet(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and value by day and type; a day is emitted once its late data can no longer come."""
    days = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type")
    out = days.agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("day"), "event_type", "events", "value")


def without_repeats(events: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), within: str = "6 hours") -> DataFrame:
    """Events of a key that come again within the time are left out; state older than that is dropped."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(list(keys))


PAIRS = "run_id long, command string, ts_millis long, hash string, previous_id long, previous_hash string, age_millis long, is_repeat boolean"
_WAITING = "commands array<string>, times array<long>, ids array<long>, hashes array<string>, last_commands array<string>, last_times array<long>, last_ids array<long>, last_hashes array<string>"
#: Commands share so many states by hash: a call for a state costs milliseconds, however few its runs are. It decides on no result.
BUCKETS = 1024


def previous_runs(runs: DataFrame, late: str = "1 hour", within_millis: int = WITHIN_MILLIS, buckets: int = BUCKETS) -> DataFrame:
    """The stream form of `history.previous_run`: each run (ts, run_id, command, hash) with the newest earlier one of its command.

    A command's runs wait until the watermark has passed them, so late ones take their place in the order of (ts, run_id);
    runs later than `late` are dropped. State is what waits, and the last run that was paired, for as long as it may still
    be the previous one of another: a timer ends it. Commands are kept in `buckets` states, each read whole when a run of it
    comes; a stream with very many runs within its lateness takes more of them. A run without a previous one within the
    time gives no row.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([],) * 8
        waiting = list(zip(*held[:4], strict=True))
        last = {c: r for c, *r in zip(*held[4:], strict=True)}
        for rows in batches:
            millis = rows["ts"].astype("datetime64[ms]").astype("int64")
            waiting += zip(rows["command"].tolist(), millis.tolist(), rows["run_id"].tolist(), rows["hash"].tolist(), strict=True)
        now, out = state.getCurrentWatermarkMs(), []
        done = sorted((r for r in waiting if r[1] < now), key=lambda r: r[:3])
        waiting = [r for r in waiting if r[1] >= now]
        for command, time, ident, digest in done:
            if (before := last.get(command)) is not None and before[1] is not None and 0 <= time - before[0] <= within_millis:
                out.append((ident, command, time, digest, before[1], before[2], time - before[0], digest == before[2]))
            last[command] = (time, ident, digest)
        last = {c: r for c, r in last.items() if r[1] is not None and r[0] + within_millis >= now}  # others can be no previous run of one to come
        if waiting or last:
            ends = [r[1] for r in waiting] or [r[0] + within_millis for r in last.values()]
            columns = lambda rows, n: tuple(map(list, zip(*rows, strict=True))) or ([],) * n
            state.update((*columns(waiting, 4), *columns([(c, *r) for c, r in last.items()], 4)))
            state.setTimeoutTimestamp(max(now + 1, min(ends)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    some = runs.select("ts", "run_id", "command", "hash").filter("command is not null").withWatermark("ts", late)
    some = some.withColumn("_bucket", F.pmod(F.xxhash64("command"), F.lit(buckets)))
    return some.groupBy("_bucket").applyInPandasWithState(step, PAIRS, _WAITING, "append", "EventTimeTimeout")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there into a table in the shared folder and return it (for tests and backfills)."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    q = df.writeStream.outputMode(mode).format("parquet").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path)
