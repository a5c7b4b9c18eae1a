"""Sinks, streams with state, lookups, ids, rule files and lesson sources in small cases."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as X
from gleaner.operators import learning, ledger, lesson_sources, store
from gleaner.sources import rule_files
from gleaner.sources.blobs import BlobStore
from gleaner.sources.ledger_sink import LedgerSink
from gleaner.streaming import events as E

HOUR = 3_600_000


def contents(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "content string").select(F.sha2("content", 256).alias("hash"), "content")


def test_a_store_writes_once_sweeps_and_survives_a_dead_writer(spark, tmp_path):
    place = BlobStore(spark, f"file://{tmp_path}/store")
    assert place.stats().first()["blobs"] == 0 and place.hashes().count() == 0
    assert place.put(contents(spark, "a", "b", "b", None, "")).count() == 3
    assert place.put(contents(spark, "b", "c")).select("bytes").collect()[0][0] == 1
    (tmp_path / "store" / "_stage-dead").mkdir()
    assert place.clean() == 1
    got = {r["content"]: r["intact"] for r in place.get(contents(spark, "a", "c", "zz")).collect()}
    assert got == {"a": True, "c": True}
    assert [r["hash"] for r in place.hashes().collect()] == sorted(r["hash"] for r in contents(spark, "a", "b", "c", "").collect())
    assert place.remove(contents(spark, "b", "zz")).count() == 1 and place.remove(contents(spark, "b")).count() == 0
    assert place.put(contents(spark, "b")).count() == 1
    row = place.stats().first()
    assert (row["blobs"], row["bytes"]) == (4, 3) and row["stored_bytes"] > 0


def test_a_sweep_counts_what_went(spark, tmp_path):
    place = BlobStore(spark, f"file://{tmp_path}/store")
    blobs = contents(spark, "aa", "bbb", "cccc", "lost")
    place.put(blobs)
    h = {r["content"]: r["hash"] for r in blobs.collect()}
    rows = [(1, h["aa"], 10, 1, 2), (2, h["bbb"], 20, 99, 3), (3, h["cccc"], 30, 99, 4), (4, h["bbb"], 40, 99, 3)]
    capsules = spark.createDataFrame(rows, "id bigint, hash string, created bigint, expires_millis bigint, bytes bigint")
    left, counters = place.gc(capsules, now_millis=5, max_bytes=7)
    assert sorted(r["id"] for r in left.collect()) == [3, 4]
    c = counters.first()
    assert (c["expired"], c["evicted"], c["bytes"], c["blobs"], c["blob_bytes"]) == (1, 1, 5, 2, 6)  # the text of 2 is still that of 4
    assert place.stats().first()["blobs"] == 2


def test_a_ledger_counts_batches_once_and_folds(spark, tmp_path):
    sink = LedgerSink(spark, f"file://{tmp_path}/ledger", max_bytes=150, retain_days=1)
    row = lambda k, p, at: spark.createDataFrame([("run", at, p, "x", k, 1, "estimated")], "t string, at_millis bigint, project string, program string, tokens_before bigint, tokens_after bigint, method string")
    day = 86_400_000
    assert sink.read()[0].count() == 0 and sink.forget() == 0
    for batch in range(6):
        assert sink.append(row(10 + batch, "p" if batch % 2 else "q", batch * day), batch)
        assert not sink.append(row(99, "p", 0), batch)  # a replay
    sums = lambda: {r["project"]: (r["runs"], r["tokens_before"]) for r in sink.read()[0].groupBy("project").agg(*ledger.totals()).collect()}
    assert sums() == {"p": (3, 39), "q": (3, 36)} and any(n.startswith("upto=") for n in map(lambda p: p.name, (tmp_path / "ledger").iterdir()))
    sink.fold(now_millis=100 * day)
    assert sums() == {"p": (3, 39), "q": (3, 36)} and not sink.append(row(1, "p", 0), 3)
    sink.append(row(5, "r", 7 * day), 9)
    with next((tmp_path / "ledger" / "batch=9").glob("part-*.json")).open("a") as f:
        f.write('{"t":"run","at_mill')  # torn
    for crc in (tmp_path / "ledger" / "batch=9").glob(".*.crc"):
        crc.unlink()
    rows, counts = sink.read()
    assert tuple(counts.first()) == (rows.count(), 1)
    assert sink.forget("q") == 1 and sums() == {"p": (3, 39), "r": (1, 5)}
    assert sink.forget() > 0 and sums() == {}


def test_a_stream_feeds_the_ledger(spark, tmp_path):
    schema = "t string, at_millis bigint, project string, program string, tokens_before bigint, tokens_after bigint, method string"
    rows = spark.createDataFrame([("run", k, "p", "x", k, 0, "estimated") for k in range(20)], schema)
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    sink = LedgerSink(spark, f"file://{tmp_path}/ledger")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sink.write(stream(), str(tmp_path / "c1")).awaitTermination()
    assert sink.read()[0].agg(F.sum("tokens_before")).first()[0] == 190
    sink.write(stream(), str(tmp_path / "c2")).awaitTermination()  # all of it again, from the start
    assert sink.read()[0].agg(F.sum("tokens_before")).first()[0] == 190


def test_previous_runs_of_a_stream_with_late_rows(spark, tmp_path):
    minute = 60_000
    batches = [[(1, "a", 0), (2, "a", 30), (9, "b", 5)], [(3, "a", 20), (4, "a", 50)], [(5, "a", 700), (6, "b", 700)], [(7, "a", 702), (8, "b", 2000)]]
    for k, rows in enumerate(batches):
        df = spark.createDataFrame([(i, c, 1_700_000_000_000 + t * minute, f"h{i % 2}") for i, c, t in rows], "run_id long, command string, ms long, hash string")
        df.select("run_id", "command", F.timestamp_millis("ms").alias("ts"), "hash").coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"x{k}").glob("part-*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        (tmp_path / "in" / f"{k}.parquet").touch()
    stream = spark.readStream.schema("run_id long, command string, ts timestamp, hash string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = E.run_once(E.previous_runs(stream), "gleaner_late", str(tmp_path / "c")).collect()
    # 3 came late and is between 1 and 2; 5 is more than six hours after 4, and 8 after 6
    assert {(r["run_id"], r["previous_id"], r["age_millis"] // minute, r["is_repeat"]) for r in got} == {(3, 1, 20, True), (2, 3, 10, False), (4, 2, 20, True), (7, 5, 2, True)}


def test_ids_sort_by_time_and_give_it_back(spark):
    df = spark.createDataFrame([(1_700_000_000_000, "x"), (1_700_000_000_001, "a"), (0, "z"), ((1 << 48) - 1, "b")], "ms bigint, key string")
    rows = df.select("ms", X.sortable_id("evt_", F.col("ms"), F.col("key")).alias("id")).withColumn("back", X.id_millis(F.col("id"), "evt_")).collect()
    assert all(r["ms"] == r["back"] and len(r["id"]) == 30 for r in rows)
    assert [r["id"] for r in sorted(rows, key=lambda r: r["ms"])] == sorted(r["id"] for r in rows)
    bad = spark.createDataFrame([("evt_short",), ("other" + "0" * 26,), ("evt_" + "U" * 26,), (None,)], "id string")
    assert [r[0] for r in bad.select(X.id_millis(F.col("id"), "evt_")).collect()] == [None] * 4


def test_lookups_take_an_id_before_a_handle_before_a_prefix(spark):
    h = lambda x: x * 64
    capsules = spark.createDataFrame([("aaaaa", h("b")), ("abcde", h("a")), ("abcdf", h("a")), ("k1", h("c"))], "id string, hash string")
    names = spark.createDataFrame([("cap://aaaaa",), ("bbbbb",), ("abc",), (" k",), ("",), ("zz",), (None,), ("aaaaaa",)], "name string")
    got = {r["name"]: (r["id"], r["how"]) for r in store.lookup(capsules, names).collect()}
    assert got["cap://aaaaa"] == ("aaaaa", "id") and got["bbbbb"] == ("aaaaa", "short") and got["abc"] == (None, "ambiguous") and got[" k"] == ("k1", "prefix")
    assert got[""][1] == "ambiguous" and got["zz"] == got[None] == got["aaaaaa"] == (None, "missing")
    assert store.lookup(capsules.limit(0), names).filter("how <> 'missing'").count() == 0


def test_rule_files(spark, tmp_path):
    rules = spark.createDataFrame([("x", "git", None, "drop", None, ["a line"], 1, "", False, True, 5)], learning.RULES)
    folder = f"file://{tmp_path}"
    assert rule_files.read_rule_set(spark, folder).count() == 0
    rule_files.save(rules, f"{folder}/b.json")
    rule_files.save(rules.withColumns({"caption": F.lit("main"), "hits": F.lit(3).cast("bigint"), "created_millis": F.lit(9).cast("bigint")}), f"{folder}/{rule_files.MAIN}")
    rule_files.save(rules.withColumn("id", F.lit("y")), f"{folder}/B2.JSON")
    got = {r["id"]: r for r in rule_files.read_rule_set(spark, folder).collect()}
    assert set(got) == {"x", "y"} and (got["x"]["caption"], got["x"]["hits"], got["x"]["created_millis"], got["x"]["examples"]) == ("main", 3, 5, 2)
    both, added = rule_files.import_rules(rule_files.read_file(spark, f"{folder}/b.json"), rule_files.read_rule_set(spark, folder))
    assert added.first()["added"] == 1 and both.count() == 2
    assert rule_files.export_rules(both, "GIT").first()["hits"] == 0 and rule_files.export_rules(both, "npm").count() == 0
    (tmp_path / "new.json").mkdir()
    (tmp_path / "new.json" / "part-0.json").write_text('{"version": 99, "id": "z"}\n')
    with pytest.raises(Exception, match="newer version"):
        rule_files.read_rule_set(spark, folder).collect()


def test_lesson_sources(spark):
    events = spark.createDataFrame(
        [("e1", "s1", 1, "c1", "git log"), ("e2", "s1", 2, "c2", None), ("f1", "s2", 3, None, "npm ci"), ("e1x", "s2", 4, "c1y", "/bin/Make -j all"), ("f9", "s2", 5, None, "")],
        "id string, session_id string, ts_millis bigint, capsule_id string, command string",
    )
    asked = spark.createDataFrame(
        [(1, True, "e1", None), (2, False, "e1", "c2"), (3, None, None, "cap://c2"), (4, False, "f1", None), (5, False, None, None), (6, False, "q", None), (7, False, None, "c1")],
        "lesson_id bigint, last boolean, event string, capsule string",
    )
    got = {r["lesson_id"]: (r["event_id"], r["program"], r["subcommand"], r["reason"]) for r in lesson_sources.resolved(asked, events).collect()}
    assert got[1] == got[2] == got[7] == ("e1x", "make", "all", None)
    assert got[3] == ("e2", None, None, None) and got[4] == ("f1", "npm", "ci", "no_original")
    assert got[5][3] == "nothing_named" and got[6][3] == "no_event"
    assert {r["reason"] for r in lesson_sources.resolved(asked.filter("last"), events.limit(0)).collect()} == {"no_session"}
    capsules = spark.createDataFrame([("c1y", "fine\nfatal: bad\n"), ("c2", None)], "id string, raw string")
    lines = {(r["lesson_id"], r["ln"], r["line"]) for r in lesson_sources.counter_examples(lesson_sources.resolved(asked, events), capsules).collect()}
    assert lines == {(1, 2, "fatal: bad"), (2, 2, "fatal: bad"), (7, 2, "fatal: bad")}


def test_a_prefix_that_many_lessons_name_is_looked_up_once(spark):
    """Lessons and events of one prefix do not meet in pairs: 4,000 of each would be 16 million rows."""
    k = F.col("id")
    events = spark.range(4000).select(F.format_string("e%06d", k).alias("id"), F.lit("s").alias("session_id"), (k * 7 % 4000).alias("ts_millis"), F.lit("c1-x").alias("capsule_id"), F.lit("git log").alias("command"))
    asked = spark.range(4000).select(k.alias("lesson_id"), F.lit(False).alias("last"), F.lit(None).cast("string").alias("event"), F.lit("cap://c1-").alias("capsule"))
    wanted = asked.select("lesson_id", F.lit("c1-").alias("needle"))
    rows = events.withColumns({"_session": F.lit(0), "_at": F.struct("ts_millis", "id")})
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    watched = rows.mapInArrow(count, rows.schema)
    found = lesson_sources._by_prefix(watched, "capsule_id", wanted)
    joined = [n for n in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in n or "Join" in n]
    assert "Join" in joined[0]  # the lessons meet what was aggregated by prefix
    assert {r["event"]["id"] for r in found.collect()} == {"e000000"} and seen.value == 4000
    got = lesson_sources.resolved(asked, events)
    assert got.filter("event_id = 'e000000' and program = 'git'").count() == 4000


@pytest.mark.parametrize("buckets", [1, 3])
def test_commands_share_states_of_a_stream(spark, tmp_path, buckets):
    runs = [(k, f"c{k * 7 % 23}", 1_700_000_000_000 + k * 400_000, f"h{k % 3}") for k in range(300)]
    df = spark.createDataFrame(runs, "run_id long, command string, ms long, hash string")
    df.select("run_id", "command", F.timestamp_millis("ms").alias("ts"), "hash").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id long, command string, ts timestamp, hash string").parquet(str(tmp_path / "in"))
    got = {(r["run_id"], r["previous_id"], r["age_millis"]) for r in E.run_once(E.previous_runs(stream, buckets=buckets), f"gleaner_shared_{buckets}", str(tmp_path / "c")).collect()}
    end = runs[-1][2] - 3_600_000
    assert got == {(k, k - 23, 23 * 400_000) for k in range(23, 300) if runs[k][2] < end}


def test_contents_are_written_into_the_store_only(spark, tmp_path):
    import os

    from gleaner.sources import scratch

    place = scratch.shared_dir(spark).removeprefix("file://") + "/gleaner"
    had = set(os.listdir(place)) if os.path.isdir(place) else set()
    docs = spark.createDataFrame([(f"{k % 30:02x}" + "0" * 62, os.urandom(20_000).hex() if k < 30 else "short") for k in range(40)], "hash string, content string")
    docs.write.parquet(str(tmp_path / "docs"))
    docs, held = spark.read.parquet(str(tmp_path / "docs")), BlobStore(spark, str(tmp_path / "store"))
    assert sorted(r["bytes"] for r in held.put(docs).collect()) == [5] * 10 + [40_000] * 20
    assert {r["hash"][:2]: r["bytes"] for r in held.blobs().filter("bytes = octet_length(content)").collect()} == {f"{k:02x}": 5 if k < 10 else 40_000 for k in range(30)}
    assert held.put(docs).count() == 0
    made = [f"{d}/{f}" for n in set(os.listdir(place)) - had for d, _, names in os.walk(f"{place}/{n}") for f in names]
    assert sum(map(os.path.getsize, made)) < 100_000
