"""Repeats and deltas against the previous run of the same command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import age_text, critical_region, is_critical, lines
from gleaner.sources.scratch import materialize

WITHIN_MILLIS = 6 * 3600 * 1000
#: The sessions that are looked at: the run's own and those before it.
SESSIONS = 3


def session_numbers(runs: DataFrame) -> DataFrame:
    """session_id, number: the distinct sessions in the order of their ids, which sort by time, from 0.

    Range partitions are counted first, so no task sees more than a partition.
    """
    parts = max(1, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = runs.select("session_id").distinct().repartitionByRange(parts, "session_id").withColumn("_block", F.spark_partition_id())
    ids = materialize(ids, "history-sessions")
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = ids.groupBy("_block").agg(F.count("*").alias("_n"))
    before = sizes.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("session_id"))
    return ids.join(before, "_block").select("session_id", (F.col("_before") + own - 1).alias("number"))


def previous_run(runs: DataFrame, within: int = WITHIN_MILLIS, sessions: int = SESSIONS) -> DataFrame:
    """Each run (run_id, command, ts_millis, hash) with the newest earlier one of its command, at most `within` old.

    With a session_id, runs of the own session come first, only the last `sessions` sessions are looked at, and `repeats` is
    added: how many runs before the previous one, in its session and within the time, gave its output. Adds previous_id,
    previous_hash, age_millis and is_repeat; a run without such a previous one is left out. Runs of one time
    are in the order of run_id. A command that holds many runs is split by session; a run without one has its own.
    """
    if "session_id" not in runs.columns:
        w = Window.partitionBy("command").orderBy("ts_millis", "run_id")
        rows = runs.withColumns({"previous_id": F.lag("run_id").over(w), "previous_hash": F.lag("hash").over(w), "age_millis": F.col("ts_millis") - F.lag("ts_millis").over(w)})
        return rows.filter(F.col("previous_id").isNotNull() & (F.col("age_millis") <= within)).withColumn("is_repeat", F.col("hash") == F.col("previous_hash"))
    numbered = runs.join(session_numbers(runs), "session_id", "left")
    numbered = numbered.withColumn("_number", F.coalesce("number", F.lit(-1))).drop("number")
    key = ["command", "_number"]
    w = Window.partitionBy(*key).orderBy("ts_millis", "run_id")
    facts = F.struct(F.col("run_id").alias("id"), F.col("hash").alias("hash"), F.col("ts_millis").alias("ts"), F.col("_number").alias("n"))
    own = numbered.withColumn("_own", F.lag(facts).over(w))
    last = numbered.groupBy(*key).agg(F.max_by(facts, F.struct("ts_millis", "run_id")).alias("_l"))
    before = last.select(*key, F.lag("_l").over(Window.partitionBy("command").orderBy("_number")).alias("_old"))  # a row for each session of a command
    found = own.join(before.filter("_old is not null"), key, "left").withColumn("_p", F.coalesce("_own", "_old"))
    near = F.col("_number") - F.col("_p.n") < sessions
    out = found.filter(F.col("_p").isNotNull() & near).withColumns(
        {"previous_id": F.col("_p.id"), "previous_hash": F.col("_p.hash"), "age_millis": F.col("ts_millis") - F.col("_p.ts"), "_session": F.col("_p.n")}
    )
    out = out.filter(F.col("age_millis") <= within).withColumn("is_repeat", F.col("hash") == F.col("previous_hash"))
    out = out.drop("_own", "_old", "_p")
    return _repeated(out, numbered, within).drop("_number", "_session")


def _repeated(pairs: DataFrame, runs: DataFrame, within: int) -> DataFrame:
    """Add `repeats`: how many runs before the previous one, in its session and within the time, gave its output.

    Runs and questions are put in one order by (command, session, output): a question asks how many runs came before the
    time of interest, a previous run how many came before itself; the difference is the answer, without pairs of runs.
    """
    key = ["command", "_number", "hash"]
    events = runs.select(*key, "ts_millis", F.lit(1).alias("_kind"), "run_id", F.lit(None).cast("string").alias("_q"))
    asked = pairs.select(
        "command", F.col("_session").alias("_number"), F.col("previous_hash").alias("hash"), (F.col("ts_millis") - within).alias("ts_millis"), F.lit(0).alias("_kind"),
        F.lit(None).cast(dict(runs.dtypes)["run_id"]).alias("run_id"), F.col("run_id").cast("string").alias("_q"),
    )
    so_far = Window.partitionBy(*key).orderBy("ts_millis", "_kind", "run_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = events.unionByName(asked).withColumn("_n", F.coalesce(F.sum("_kind").over(so_far), F.lit(0)))
    counted = materialize(counted.select("_kind", "run_id", "_q", "_n"), "history-counts")
    place = counted.filter("_kind = 1").select(F.col("run_id").alias("previous_id"), F.col("_n").alias("_place"))
    old = counted.filter("_kind = 0").select("_q", F.col("_n").alias("_older"))
    out = pairs.withColumn("_q", F.col("run_id").cast("string")).join(place, "previous_id").join(old, "_q")
    return out.withColumn("repeats", (F.col("_place") - F.col("_older")).cast("bigint")).drop("_q", "_place", "_older")


def repeat_counts(runs: DataFrame) -> DataFrame:
    """How many runs of a command gave one content, and when first and last."""
    return runs.groupBy("command", "hash").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_id"), F.max("run_id").alias("last_id"))


def delta_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines by pair: unchanged, added, removed, compared without trailing blanks (pair, line).

    The side that is searched is a set, the other keeps its repeats: both sides are counted by (pair, line) first, so the
    one shuffle moves a row for each different line.
    """
    counted = lambda df, name: df.groupBy("pair", F.rtrim("line").alias("line")).agg(F.count("*").alias(name))
    both = counted(old, "n_old").join(counted(new, "n_new"), ["pair", "line"], "full")
    n_old, n_new = F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))
    return both.groupBy("pair").agg(
        F.sum(F.when(n_old > 0, n_new).otherwise(0)).cast("bigint").alias("unchanged"),
        F.sum(F.when(n_old == 0, n_new).otherwise(0)).cast("bigint").alias("added"),
        F.sum(F.when(n_new == 0, n_old).otherwise(0)).cast("bigint").alias("removed"),
    )


def delta_worth(deltas: DataFrame) -> DataFrame:
    """A delta is shown only if something stayed and less was added than stayed."""
    return deltas.withColumn("worth", (F.col("unchanged") > 0) & (F.col("added") < F.col("unchanged")))


def reference() -> Column:
    """How a text names the stored original of the previous run."""
    return F.concat(F.lit("cap://"), F.col("previous_id").cast("string"))


def repeat_candidates(pairs: DataFrame) -> DataFrame:
    """run_id, output: the text that replaces a repeated output, a pointer to the run before (rows of `previous_run`).

    With `repeats` it says how many runs before that were the same; with `text` it carries the critical lines, which a column
    `critical` may hold already.
    """
    more = F.lit("")
    if "repeats" in pairs.columns:
        more = F.when(F.col("repeats") > 0, F.concat(F.lit(", "), F.col("repeats").cast("string"), F.lit(" identical run(s) before that"))).otherwise("")
    kept = F.col("critical") if "critical" in pairs.columns else critical_region(F.col("text")) if "text" in pairs.columns else F.lit("")
    text = F.concat(F.lit("[repeat] identical to "), reference(), F.lit(" ("), age_text(F.col("age_millis")), more, F.lit(")\n"), kept)
    return pairs.filter("is_repeat").select("run_id", text.alias("output"))


def delta_candidates(changed: DataFrame) -> DataFrame:
    """run_id, output: what is new in a run against its previous one (run_id, previous_id, age_millis, text, old).

    Lines are compared without trailing blanks; the counts are those of `delta_lines`. A delta is made only if something
    stayed and less was added than stayed. Critical lines that are not new come behind the new ones. Lines of both sides
    meet by (pair, line), so a long text is spread; what is gathered for a pair is what its output shows.
    """
    pairs = changed.withColumn("pair", F.col("run_id"))
    return delta_texts(pairs.filter(F.col("text") != F.col("old")), delta_bodies(pairs))


def delta_texts(changed: DataFrame, bodies: DataFrame) -> DataFrame:
    """run_id, output: the deltas of runs (run_id, previous_id, age_millis, pair) whose pair of texts has one in `delta_bodies`."""
    head = F.concat(F.lit("[delta] vs "), reference(), F.lit(" ("), age_text(F.col("age_millis")), F.lit(")\n"))
    return changed.select("run_id", "previous_id", "age_millis", "pair").join(bodies, "pair").select("run_id", F.concat(head, F.col("body")).alias("output"))


def delta_bodies(pairs: DataFrame) -> DataFrame:
    """pair, body: the counts and the lines that a delta shows, for each pair of texts (pair, text, old) that is worth one."""
    side = lambda c, new: pairs.select("pair", F.lit(new).alias("new"), F.posexplode(lines(F.col(c))).alias("at", "line"))
    rows = side("text", True).unionByName(side("old", False)).withColumn("_key", F.rtrim("line"))
    has = lambda new: F.max(F.col("new") == F.lit(new)).over(Window.partitionBy("pair", "_key"))
    rows = rows.withColumn("_both", has(True) & has(False))
    added = F.col("new") & ~F.col("_both")
    kept = F.col("new") & F.col("_both") & is_critical(F.col("line"))
    some = rows.filter(added | kept).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct(kept.alias("kept"), "at", "line"))).alias("l"))
    counts = rows.groupBy("pair").agg(
        F.count_if(F.col("new") & F.col("_both")).alias("unchanged"), F.count_if(added).alias("added"), F.count_if(~F.col("new") & ~F.col("_both")).alias("removed")
    )
    worth = delta_worth(counts).filter("worth").join(some, "pair", "left")
    count = lambda c: F.concat(F.lit(f"{c}="), F.col(c).cast("string"))
    body = F.coalesce(F.array_join(F.transform("l", lambda x: F.concat(x.line, F.lit("\n"))), ""), F.lit(""))
    return worth.select("pair", F.concat(count("unchanged"), F.lit(" "), count("added"), F.lit(" "), count("removed"), F.lit("\n"), body).alias("body"))
