"""Runs against their past: pairs, repeats and deltas by a plain reading; candidates that fail; reductions of runs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import CRITICAL
from gleaner.operators import firewall, history, reduce

ERROR = re.compile("(?i)" + CRITICAL)
HOUR = 3_600_000


def walk(runs):
    """run_id -> (previous_id, repeats), as a reader of the sessions would find them."""
    sessions = sorted({r[1] for r in runs})
    out = {}
    for run in runs:
        at = sessions.index(run[1])
        order = lambda r: (r[3], r[0])
        for s in sessions[max(0, at - 2) : at + 1][::-1]:
            found = [r for r in sorted(runs, key=order, reverse=True) if r[1] == s and r[2] == run[2] and (s != run[1] or order(r) < order(run))]
            if found:
                first = found[0]
                if run[3] - first[3] <= history.WITHIN_MILLIS:
                    same = [r for r in found[1:] if r[4] == first[4] and run[3] - r[3] <= history.WITHIN_MILLIS]
                    out[run[0]] = (first[0], len(same))
                break
    return out


@pytest.mark.parametrize("seed", range(2))
def test_previous_runs_and_repeats(spark, seed):
    rng = random.Random(seed)
    runs = [(k, f"s{k // 25:02}", rng.choice(["a", "a", "b", "c"]), k * HOUR // 5 + rng.randint(0, 50), rng.choice("xy")) for k in range(200)]
    df = spark.createDataFrame(runs, "run_id bigint, session_id string, command string, ts_millis bigint, hash string")
    got = {r["run_id"]: (r["previous_id"], r["repeats"]) for r in history.previous_run(df).collect()}
    assert got == walk(runs)
    assert history.previous_run(df.limit(0)).count() == 0


def delta(text, old):
    """The body of a delta, or None."""
    rows = lambda t: t.removesuffix("\n").split("\n") if t else []
    before, now = {x.rstrip(" ") for x in rows(old)}, {x.rstrip(" ") for x in rows(text)}
    added = [x for x in rows(text) if x.rstrip(" ") not in before]
    same = len(rows(text)) - len(added)
    if text == old or not same or len(added) >= same:
        return None
    gone = sum(x.rstrip(" ") not in now for x in rows(old))
    kept = [x for x in rows(text) if x.rstrip(" ") in before and ERROR.search(x)]
    return f"unchanged={same} added={len(added)} removed={gone}\n" + "".join(x + "\n" for x in added + kept)


def test_deltas(spark):
    rng = random.Random(5)
    words = ["one", "two", "two ", "", "error: bad", "three", "four", "five"]
    pairs = [(k, "\n".join(rng.choice(words) for _ in range(rng.randint(0, 9))), "\n".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for k in range(150)]
    df = spark.createDataFrame([(k, -k, 0, a, b) for k, a, b in pairs], "run_id bigint, previous_id bigint, age_millis bigint, text string, old string")
    got = {r["run_id"]: r["output"].split("\n", 1)[1] for r in history.delta_candidates(df).collect()}
    assert got == {k: d for k, a, b in pairs if (d := delta(a, b)) is not None}


def test_runs_compete_with_their_past(spark):
    text = "".join(f"line {c} of the report\n" for c in "abcdefgh")
    rows = [
        (1, "s1", "make", 0, text), (2, "s1", "make", 40_000, text), (3, "s1", "make", 3 * HOUR, text + "one more\n"), (4, "s1", "make", 10 * HOUR, text + "one more\n"),
        (5, "s1", None, 1, text), (6, "s1", None, 2, text), (7, "s2", "make", 11 * HOUR, None), (8, "s2", "make", 11 * HOUR, text),
    ]
    runs = spark.createDataFrame(rows, "run_id bigint, session_id string, command string, ts_millis bigint, text string")
    got = {r["run_id"]: (r["transformer"], r["output"]) for r in reduce.reduce_runs(runs, compilers=()).collect()}
    assert got[1] == got[5] == got[6] == (None, text) and got[7] == (None, "") and got[8] == (None, text)
    assert got[2] == ("repeat.suppress", "[repeat] identical to cap://1 (a minute ago)\n")
    assert got[3] == ("delta.lines", "[delta] vs cap://2 (2h ago)\nunchanged=8 added=1 removed=0\none more\n")
    assert got[4] == (None, text + "one more\n")  # more than six hours later
    fired = spark.createDataFrame([(2, "r1")], "run_id bigint, key string")
    other = {r["run_id"]: r["transformer"] for r in reduce.reduce_runs(runs, compilers=(), fired=fired).collect()}
    assert other[2] is None and other[3] is None  # not filtered by the same rules
    assert {r["transformer"] for r in reduce.reduce_runs(runs, mode="observe", compilers=()).collect()} == {None}


def test_a_failing_compiler_leaves_its_text_alone(spark):
    docs = spark.createDataFrame([(k, f"bad {k} " * 30 if k == 2 else f"good {k} " * 30) for k in range(4)], "doc_id bigint, text string")

    @F.pandas_udf("output string, error string")
    def risky(texts):
        import pandas as pd

        def one(text):
            if text.startswith("bad"):
                return None, "ValueError: bad"
            return text[:10], None

        return pd.DataFrame([one(t) for t in texts], columns=["output", "error"])

    some = reduce.Compiler("risky", lambda: F.col("text").isNotNull(), lambda s: s.docs.select("doc_id", risky("text").alias("r")).select("doc_id", "r.output", "r.error"))
    got = {r["doc_id"]: (r["transformer"], r["output"]) for r in reduce.reduce(docs, compilers=(some,)).collect()}
    assert got[2] == (None, "bad 2 " * 30) and got[1] == ("risky", "good 1 goo")
    seen = {r["doc_id"]: r["verdict"] for r in firewall.review(reduce.candidates(docs.withColumn("content_type", F.lit("plain_text")), (some,))).collect()}
    assert seen == {0: "accepted", 1: "accepted", 2: "transformer_error", 3: "accepted"}


def test_damaged_forms_are_refused(spark):
    rows = [(1, "word " * 90, "@test cargo status=ok\npassed: 3\n", "token_ir"), (2, "word " * 90, "@test cargo status=ok\n  stray", "token_ir"), (3, "word " * 90, "no form", "token_ir"), (4, "word " * 90, "no form", "none"), (5, "word " * 90, None, "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, output string, reparse string").withColumn("lossy", F.lit(False))
    got = {r["doc_id"]: (r["verdict"], r["final"]) for r in firewall.review(df, token_ir=True).collect()}
    assert {k: v for k, (v, _) in got.items()} == {1: "accepted", 2: "reparse_failed", 3: "reparse_failed", 4: "accepted", 5: "transformer_error"}
    assert got[2][1] == got[5][1] == "word " * 90


def test_each_pair_of_texts_is_compared_once(spark, monkeypatch):
    """Runs of few contents: what is compared grows with the pairs of contents, not with the runs."""
    seen = []
    bodies = history.delta_bodies
    monkeypatch.setattr(history, "delta_bodies", lambda pairs: seen.append(pairs.count()) or bodies(pairs))
    texts = ["".join(f"line {w}\n" for w in (*("checked part " + c for c in "abcdefghijklmnopqrst"), x)) for x in ("one", "two")]
    runs = [(k, "s", "make", k * 1000, texts[k % 2]) for k in range(200)]
    df = spark.createDataFrame(runs, "run_id long, session_id string, command string, ts_millis long, text string")
    got = {r["run_id"]: (r["transformer"], r["output"]) for r in reduce.reduce_runs(df, compilers=()).collect()}
    assert seen == [2]
    assert got[0] == (None, texts[0])
    assert all(got[k] == ("delta.lines", f"[delta] vs cap://{k - 1} (just now)\nunchanged=20 added=1 removed=1\nline {('one', 'two')[k % 2]}\n") for k in range(1, 200))
