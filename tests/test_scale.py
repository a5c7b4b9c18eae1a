"""What keeps the work of queries in proportion to their input: things that are made once, and tasks that stay small."""

from pyspark.sql import functions as F

from gleaner.functions import templates as T
from gleaner.functions import text as X
from gleaner.operators import filtering, learning, lessons, logs, redact, reduce, reports, rules
from gleaner.sources.tables import exploded_lines


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_token_estimate_counts_without_making_tokens(spark):
    texts = ["", "a", "abcde fghi_j", "1234567", "a1b22c333d4444", "  x  y ", "é😀\n\tabc", "A_b-c.d/e 12:30", "____ _____", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_count(F.coalesce("t", F.lit("")), F.lit(X.TOKEN)).cast("bigint")
    assert all(a == b for a, b in df.select(old, X.token_estimate(F.col("t"))).collect())
    assert "regexp_count" not in plan(df.select(X.token_estimate(F.col("t")))).lower()


def test_log_clusters_are_made_once(spark):
    text = "\n".join([f"step {k} done" for k in range(20)] + ["ERROR x at a.py:3"])
    short = "\n".join(["step 1 done"] * 11)
    docs = spark.createDataFrame([(1, text), (2, short)], "doc_id long, text string")
    made = logs.render(logs.clusters(exploded_lines(docs)))
    assert "Join" not in plan(made)
    assert [r["doc_id"] for r in made.collect()] == [1]
    wants = reduce.prepared(docs.withColumns({"content_type": F.lit("plain_text"), "of_command": F.lit(False)}))
    bit = [c.name for c in reduce.COMPILERS].index("log.cluster")
    assert {r["doc_id"]: bool(r["_wants"] >> bit & 1) for r in wants.collect()} == {1: True, 2: False}


def test_reduction_counts_tokens_of_a_text_once(spark):
    text = "\n".join(f"step {k} done" for k in range(40))
    docs = spark.createDataFrame([(1, text), (2, "as it is: password=hunter2hunter2"), (3, None)], "doc_id long, text string")
    out = reduce.reduce(docs, mode="balanced")
    assert "[A-Za-z_]" not in plan(out.select("tokens_before"))
    rows = {r["doc_id"]: r for r in out.withColumn("n", X.token_estimate(F.col("output"))).collect()}
    assert rows[1]["transformer"] == "log.cluster" and rows[1]["tokens_after"] == rows[1]["n"] < rows[1]["tokens_before"]
    assert rows[2]["tokens_after"] == rows[2]["tokens_before"] == rows[2]["n"] and "hunter2" not in rows[2]["output"]


def test_redaction_looks_only_at_texts_that_may_hold_something(spark):
    texts = ["plain words", "token is: abcdefgh1", "from 10.1.2.3 on", "1.2 and 3.4", "AUTHORIZATION= Bearer abcdefgh12", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = [r[0] for r in redact.redacted(df, pii=True).orderBy("doc_id").select("redaction.text").collect()]
    assert [t == g for t, g in zip(texts, got, strict=True)] == [True, True, False, True, False, True]


def test_templates_are_made_of_lines_that_rules_can_match(spark):
    docs = spark.createDataFrame([(1, "one two three\n\none two\nfour 12 kb and more\nx"), (2, None)], "doc_id long, text string")
    table = rules.rule_table(spark, [("r1", None, None, "one two", "drop", ""), ("r2", None, None, "four 1 kb {*} more", "fold", "sizes")])
    rows = filtering.numbered(exploded_lines(docs), [2, 5])
    assert [r["_segs"] is not None for r in rows.orderBy("doc_id", "ln").collect()] == [False, False, True, True, False]
    fates, _ = filtering.decided(exploded_lines(docs), table)
    assert [(r["ln"], r["rule"], r["state"]) for r in fates.orderBy("ln").collect()] == [(1, None, "stay"), (2, None, "stay"), (3, "r1", "cut"), (4, "r2", "cut"), (5, None, "stay")]
    assert "_segs" not in fates.columns


def test_a_diff_sorts_its_lines_once(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@\n+in\n-out\n-- x\n same\ndiff --git a/y b/y\n+no hunk yet\n@@ -2 +2 @@\n+in"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    made = reports.git_diff(exploded_lines(docs)).select("path", "added", "removed", "context")
    assert made._jdf.queryExecution().executedPlan().toString().count(" Sort [") == 1
    assert sorted(tuple(r) for r in made.collect()) == [("x", 1, 2, 1), ("y", 1, 0, 0)]


def test_texts_are_dealt_before_their_lines_are_made(spark):
    docs = spark.range(4).select(F.col("id").alias("doc_id"), F.lit("one two\n\nthree 4").alias("text")).coalesce(1)
    tree = filtering.numbered(filtering.dealt_lines(docs), [2])._jdf.queryExecution().executedPlan().toString()
    assert tree.count("Exchange hash") == 1
    assert tree.index("Window ") < tree.index("Generate ") < tree.index("Exchange hash")


def test_rules_that_share_lines_meet_them_once(spark, monkeypatch):
    """A line that all blocks have brings together no pair for each of them; the fate of lines is found once."""
    pairs = []
    covering = rules.covering

    def counted(*args, **kwargs):
        out = covering(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(rules, "covering", counted)
    word = lambda k: chr(97 + k) * 12
    rows = [(f"b{k}", "git", None, "drop", None, ["=====", f"the banner {word(k)}", "====="], 1, "", False, True, 0) for k in range(20)]
    rows += [(f"f{k}", None, None, "fold", "old", [f"warning package {word(k)} {{n}}"], 1, "", False, True, 0) for k in range(20)]
    rows.append(("x", None, None, "drop", None, ["fatal error in", "====="], 1, "", False, True, 0))
    text = lambda k: f"=====\n\nthe banner {word(k)}\n=====\nwarning package {word(k)} 1\nwarning package {word(k)} 2\nfatal error in\n=====\nend\n"
    docs = spark.createDataFrame([(k, "GIT" if k < 8 else "make", None, text(k % 4)) for k in range(10)], "doc_id long, program string, subcommand string, text string")
    fates, places = filtering.decided(filtering.dealt_lines(docs, ("doc_id", "program", "subcommand")), spark.createDataFrame(rows, learning.RULES), scoped=True)
    assert sum(pairs) == 10 * 7  # one for each line that some rule has
    used = filtering.accounting(fates, places)
    assert "Window" not in plan(used)
    got = {r["rule_id"]: (r["docs"], r["lines"], r["runs"], r["protected"]) for r in used.collect()}
    blocks, folds = {f"b{k}": (2, 6, 2, 0) for k in range(4)}, {f"f{k}": (n, 2 * n, n, 0) for k, n in enumerate((3, 3, 2, 2))}
    assert got == blocks | folds | {"x": (0, 0, 0, 10)}


def test_short_ways_of_templates_give_the_same_classes(spark):
    words = "1 123456 1234567 12, 12kb 1.2.3 a.b .... ---- ==== x/y c:\\d 12:30:01 2024-01-02 v1.2.3 0xabcdef1 50% 1,000 deadbee1 http://x a-b end. \u3000w 7) () ٣".split(" ")
    df = spark.createDataFrame([(w,) for w in words], "t string")
    got = {r[0]: (r[1], r[2]) for r in df.select("t", X.is_blank(F.col("t")), T.canonical(T.segments(F.col("t")))).collect()}
    assert got == {w: (not w.strip(), learning.text_of(lessons.shape(w))) for w in words}
    blank = spark.createDataFrame([("",), (" \t",), ("\u2003\u3000",), (" a",), (None,)], "t string")
    assert [tuple(r) for r in blank.select(X.is_blank(F.col("t")), F.size(T.tokens(F.col("t")))).collect()] == [(True, 0), (True, 0), (True, 0), (False, 1), (None, None)]


def test_all_shapes_of_a_scope_are_merged(spark):
    """No shape is left out, whatever their number; a scope's shapes are merged in sets that cannot meet, as if at once."""
    word = lambda k: "".join("abcdefghij"[int(d)] for d in f"{k:04}")
    line = "2024-01-02 03:04:05 INFO user={} event=view id={}".format
    rows = [("p", line(word(k % 300), word(k))) for k in range(600)] + [("p", "wholly other line"), ("p", line(word(999), word(9999)))]
    rows += [("q", f"the {'abc'[k % 3]}x {'abcde'[k % 5]}y {'abcd'[k % 4]}z was said here again {{n}}") for k in range(60)] + [("q", "the ax ay az was said here again 5")]
    df = spark.createDataFrame([(p, None, x) for p, x in rows], "program string, subcommand string, line string")
    got = lessons.generalised(df, most=None).collect()
    expected = [(p, lessons.text_of(s)) for p in "pq" for s in lessons.generalise([lessons.shape(x) for q, x in rows if p == q], most=None)]
    assert sorted((r["program"], r["canonical"]) for r in got) == sorted(expected) and len(got) > 300
    assert {r["left_out"] for r in got} == {0}
    assert sum(r["canonical"].endswith("{*}") for r in got if r["program"] == "p") == 300


def test_merged_shapes_are_those_of_trying_every_pair():
    import random

    def slowly(shapes, kept):
        found = sorted(set(shapes))
        while pair := next(((a, b, m) for k, a in enumerate(found) for b in found[k + 1 :] if len(a) == len(b) and (m := lessons.joined(a, b, kept))), None):
            found = sorted({*(s for s in found if s not in pair[:2]), pair[2]})
        return found

    deal = random.Random(7)
    words = [("", "alpha"), ("", "be"), ("", "gamma"), ("n", ""), ("hex", "")]
    for n in (2, 3, 4, 5, 6, 7) * 4:
        shapes = [tuple(deal.choice(words) for _ in range(n + deal.randrange(2))) for _ in range(100)]
        kept = shapes[: deal.randrange(3)]
        assert lessons.generalise(shapes, kept) == slowly(shapes, kept)


def test_sets_of_places_hold_what_may_meet():
    from itertools import combinations

    for n, varying, classes, most in ((6, 0b101000, 0b000011, 128), (12, 0b1111111111, 0, 128), (9, 0b111111111, 0, 128), (64, (1 << 64) - 1, 0, 128), (4, 0b1, 0b1110, 128)):
        sets = lessons.places(varying, classes, n)
        assert len(sets) <= most
        wild = min(n // 2, n - 2) - (classes & ~varying).bit_count()
        at = [1 << k for k in range(n) if varying >> k & 1]
        differ = [sum(d) for d in combinations(at, min(wild, len(at)))] if 0 < wild and len(at) < 20 else []
        assert all(any(not s & d for s in sets) for d in differ) and bool(sets) == (wild > 0)
