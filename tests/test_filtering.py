"""The filter of learned rules against a plain reading of each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import CRITICAL
from gleaner.operators import filtering, learning, lessons
from gleaner.sources.tables import exploded_lines

ERROR = re.compile("(?i)" + CRITICAL)
WORDS = ["====", "alpha beta", "note one", "note two", "12 items", "fatal error", "", "end of it"]


def plain(text, rules, protect=True):
    """A reading from the first line to the last: taken lines, whitelists, folds, stranded blanks."""
    rows = (text[:-1] if text.endswith("\n") else text).split("\n") if text else []
    shapes = [lessons.shape(r) for r in rows]
    removing = sorted((r for r in rules if r[1] != "keep"), key=lambda r: (-len(r[3]), r[0]))
    naming = [r for r in rules if r[1] == "keep"]
    by = [None] * len(rows)
    tried = {}
    at = 0
    while at < len(rows):
        step = 1
        for rule in removing if rows[at].strip() else ():
            k, used = at, []
            for want in rule[3]:
                while used and k < len(rows) and not rows[k].strip():
                    k += 1
                if k >= len(rows) or not shapes[k] or not lessons.same(want, shapes[k]):
                    break
                used.append(k)
                k += 1
            if len(used) < len(rule[3]):
                continue
            if protect and any(ERROR.search(rows[u]) for u in used):
                tried[rule[0]] = tried.get(rule[0], 0) + 1
                continue
            step = used[-1] - at + 1
            by[at : at + step] = [rule] * step
            break
        at += step
    out, gone, fold = [], False, None
    for row, rule in zip(rows, by, strict=True):
        if rule is not None:
            if fold is not None and fold[0] is not rule:
                out.append(f"[folded] {fold[0][2]} ({fold[1]} line(s))")
                fold = None
            if rule[1] == "fold":
                fold = [rule, (fold[1] if fold else 0) + bool(row.strip())]
            gone = True
            continue
        if fold is not None:
            out.append(f"[folded] {fold[0][2]} ({fold[1]} line(s))")
            fold = None
        if not row.strip():
            if not gone:
                out.append(row)
            continue
        if naming and not any(lessons.same(r[3][0], lessons.shape(row)) for r in naming) and not (protect and ERROR.search(row)):
            gone = True
            continue
        gone = False
        out.append(row)
    if fold is not None:
        out.append(f"[folded] {fold[0][2]} ({fold[1]} line(s))")
    return "\n".join(out) + ("\n" if text.endswith("\n") and out else ""), tried


def table(spark, rules):
    rows = [(i, None, None, a, c, [learning.text_of(s) for s in shapes], 1, "", False, True, 0) for i, a, c, shapes in rules]
    return spark.createDataFrame(rows, learning.RULES)


@pytest.mark.parametrize("seed", range(4))
def test_any_rules_over_any_texts(spark, seed):
    rng = random.Random(seed)
    texts = [(k, "\n".join(rng.choice(WORDS) for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n"])) for k in range(120)]
    rules = []
    for k in range(5):
        height = rng.choice([1, 1, 2, 3, 4])
        shapes = tuple(lessons.shape(rng.choice([w for w in WORDS if w])) for _ in range(height))
        if rng.random() < 0.3:
            shapes = tuple((*s[:-1], ("*", "")) for s in shapes)
        rules.append((f"r{k}", rng.choice(["drop", "drop", "fold"]), f"caption {k}", shapes))
    if seed % 2:
        rules.append(("k1", "keep", None, (lessons.shape("end of it"),)))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for protect in (True, False):
        got = {r["doc_id"]: r["output"] for r in filtering.filter_texts(docs, table(spark, rules), protect_errors=protect).collect()}
        assert got == {k: plain(t, rules, protect)[0] for k, t in texts}
    expected = {}
    for _, t in texts:
        for rule, n in plain(t, rules)[1].items():
            expected[rule] = expected.get(rule, 0) + n
    used = filtering.accounting(*filtering.decided(exploded_lines(docs), table(spark, rules))).collect()
    assert {r["rule_id"]: r["protected"] for r in used if r["protected"]} == expected


def test_edges(spark):
    rules = [("b", "drop", "", tuple(lessons.shape(x) for x in ("+-----+", "| hello you |", "+-----+")))]
    texts = [(1, "a\n+-----+\n\n| hello you |\n+-----+\n\nz\n"), (2, "+-----+\n| other |\n"), (3, None), (4, ""), (5, "+-----+\n| hello you |\n+-----+"), (6, "x " * 200_000)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r["doc_id"]: r["output"] for r in filtering.filter_texts(docs, table(spark, rules)).collect()}
    assert got == {1: "a\nz\n", 2: "+-----+\n| other |\n", 3: "", 4: "", 5: "", 6: "x " * 200_000}
    assert filtering.filter_texts(docs.limit(0), table(spark, rules)).count() == 0
    assert {r["doc_id"]: r["output"] for r in filtering.filter_texts(docs, table(spark, [])).collect()}[2] == texts[1][1]


def test_scopes(spark):
    rows = [("a", "git", None, "drop", None, ["some line here"], 1, "", False, True, 0), ("k", "git", "log", "keep", None, ["other line here"], 1, "", False, True, 0)]
    docs = spark.createDataFrame(
        [(1, "GIT", "log", "some line here\nother line here\nthird\n"), (2, "git", None, "some line here\nthird\n"), (3, None, None, "some line here\nthird\n")],
        "doc_id bigint, program string, subcommand string, text string",
    )
    got = {r["doc_id"]: r["output"] for r in filtering.filter_texts(docs, spark.createDataFrame(rows, learning.RULES), scoped=True).collect()}
    assert got == {1: "other line here\n", 2: "third\n", 3: "some line here\nthird\n"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lessons_are_read_one_behind_the_other(spark):
    """A call for each lesson would cost more than its few lines; lines that a rule removes already teach nothing in any of them."""
    text = F.concat(F.lit("<trash>notice the package "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" was skipped</trash>\nrest"))
    none = F.lit(None).cast("string")
    lessons = spark.range(300).select(F.col("id").alias("lesson_id"), none.alias("program"), none.alias("subcommand"), (F.col("id") % 2 == 0).alias("forced"), text.alias("text"))
    first, made = learning.learn(lessons, spark.createDataFrame([], learning.RULES), 1)
    assert made.filter("reason is null").count() == first.count() == 300
    assert made.filter("forced").count() == 150
    more = lessons.unionByName(lessons.withColumns({"lesson_id": F.col("lesson_id") + 300, "text": F.replace("text", F.lit("notice"), F.lit("remark"))}))
    known = first.filter("forced").drop("state")
    assert {int(r["lesson_id"]) for r in learning.learn(more, known, 2)[1].collect()} == {k for k in range(600) if k % 2 or k >= 300}
    assert "FlatMapGroupsIn" not in plan_of(learning.proposals(learning.parsed(lessons), known))


def test_templates_of_marked_lines_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("p", None, f"notice the package w{k % 3}x was skipped") for k in range(90)], "program string, subcommand string, line string")
    got = lessons.generalised(rows.mapInArrow(count, rows.schema)).collect()
    assert [(r["canonical"], r["left_out"]) for r in got] == [("notice the package {*} was skipped", 0)]
    assert seen.value == 90
