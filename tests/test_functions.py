"""Scalar functions: one table of cases each."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import invariants as I
from gleaner.functions import templates as T
from gleaner.functions import text as X
from gleaner.operators import detect


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} {'string' if v is None or isinstance(v, str) else 'bigint'}" for k, v in enumerate(values)))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,expected", [("", []), ("\n", [""]), ("a\n\n", ["a", ""]), ("a\r\nb", ["a", "b"]), ("a\r", ["a\r"]), (None, [])])
def test_lines_split_like_a_file(spark, text, expected):
    assert one(spark, X.lines(F.col("c0")), text) == expected


@pytest.mark.parametrize("text,n", [("", 0), ("abcd", 1), ("abcde", 2), ("1234", 2), ("a b", 2), ("é!", 2), ("foo_bar", 2), (None, 0)])
def test_token_estimate(spark, text, n):
    assert one(spark, X.token_estimate(F.col("c0")), text) == n


@pytest.mark.parametrize(
    "token,cls",
    [("https://x.y/z", "url"), ("123e4567-e89b-12d3-a456-426614174000", "uuid"), ("12:30:01", "t"), ("2024-01-02T03", "t"), ("9s", "size"), ("12.5kb", "size"),
     ("1.2.3", "ver"), ("left-pad@1.2.3", "ver"), ("1234567", "hex"), ("0xdeadbee1", "hex"), ("412", "n"), ("50%", "n"), ("src/a.py", "path"), ("main.rs:", "path"),
     ("hello", None), ("deadbeef", None), ("...", None)],
)
def test_token_class_in_both_forms(spark, token, cls):
    from gleaner.operators.lessons import token_class

    assert one(spark, T.token_class(F.col("c0")), token) == cls
    assert token_class(token) == (cls or "")


def test_templates_match_by_position(spark):
    df = spark.createDataFrame([("added 3 packages in 9s", "added 12 packages in 10s", "added {*} packages in 9s")], "a string, b string, w string")
    a, b = T.segments(F.col("a")), T.segments(F.col("b"))
    row = df.select(T.canonical(a).alias("c"), (T.join_key(a) == T.join_key(b)).alias("same"), T.matches(a, b).alias("m"), T.literal_tokens(a).alias("l")).first()
    assert row["c"] == "added {n} packages in {size}" and row["same"] and row["m"] and row["l"] == 3


def test_a_literal_that_looks_like_a_class_is_no_class(spark):
    df = spark.createDataFrame([("got {n} x", "got 5 x")], "a string, b string")
    row = df.select((T.join_key(T.segments(F.col("a"))) == T.join_key(T.segments(F.col("b")))).alias("x")).first()
    assert row["x"] is False


def test_merge_takes_one_new_wildcard(spark):
    df = spark.createDataFrame([("get alpha now", "get beta now", "put gamma now")], "a string, b string, c string")
    s = [T.segments(F.col(x)) for x in "abc"]
    row = df.select(F.size(T.merged(s[0], s[1])).alias("ab"), T.merged(s[0], s[2]).alias("ac")).first()
    assert row["ab"] == 3 and row["ac"] is None


@pytest.mark.parametrize(
    "line,critical", [("error: x", True), ("npm ERR! code", True), ("FAIL: x", False), ("AssertionError: x", True), ("IntegrityError", False), ("timed out", True), ("all good", False)]
)
def test_critical_lines(spark, line, critical):
    assert one(spark, X.is_critical(F.col("c0")), line) is critical


def test_log_template_masks_in_order(spark):
    line = '2024-01-02 03:04:05 id=123e4567-e89b-12d3-a456-426614174000 "q 1" 0xdeadbeef01 n=42 '
    assert one(spark, X.log_template(F.col("c0")), line) == "<ts> id=<uuid> <str> <hex> n=<n>"


def test_invariants_are_ranked_and_paths_of_references_go(spark):
    text = "src/a.py:12 failed, see src/a.py and lib/b.py at https://x.y/z (exit code 3) ValueError expected 4"
    found = [(r["kind"], r["value"]) for r in one(spark, I.extract(F.col("c0")), text)]
    assert found[0] == ("line_ref", "src/a.py:12") and ("path", "lib/b.py") in found and ("path", "src/a.py") not in found
    assert ("exit_code", "exit code 3") in found and ("error_type", "ValueError") in found


@pytest.mark.parametrize(
    "text,kind,sure",
    [("  ", "plain_text", "high"), ('{"a": 1}', "json", "high"), ("{a", "unknown", "low"), ("<?xml?>", "xml", "medium"), ("<p>x</p>", "xml", "medium"),
     ("Traceback (most recent call last)\n  File \"a\"", "stack_trace", "high"), ("INFO a\nx\nWARN b", "application_log", "medium"), ("a,b\nc,d", "csv", "medium"),
     ("a\tb\nc\td", "tabular_data", "medium"), ("|a|\n|-|", "tabular_data", "high"), ("# h\n- a\nx", "markdown", "medium"), ("plain", "plain_text", "low")],
)
def test_detection(spark, text, kind, sure):
    row = one(spark, detect.detect(F.col("c0")), text)
    assert (row["content_type"], row["confidence"]) == (kind, sure)


@pytest.mark.parametrize("name,kind", [("a.JSON", "json"), ("x.tar.rs", "source_code"), ("log", "application_log"), ("a.bin", None)])
def test_names_decide(spark, name, kind):
    assert one(spark, detect.by_extension(F.col("c0")), name) == kind


def test_json_minify_keeps_order_and_spelling(spark):
    assert one(spark, X.json_minify(F.col("c0")), '{ "b" : 1.0, "a" : [ 1, "x y" ] }') == '{"b":1.0,"a":[1,"x y"]}'
    assert one(spark, X.json_minify(F.col("c0")), "{ no json }") == "{ no json }"


def test_texts_of_numbers(spark):
    ms = F.col("c0")
    assert [one(spark, X.duration_text(ms), v) for v in (12, 1500, 125_000)] == ["12ms", "1.5s", "2m5s"]
    assert [one(spark, X.age_text(ms), v) for v in (30_999, 31_000, 90_000, 91_000, 600_000, 7_200_000)] == ["just now", "a minute ago", "a minute ago", "1m ago", "10m ago", "2h ago"]
    assert one(spark, X.day_number(ms), -1) == -1


def test_ids_sort_by_time_and_give_it_back(spark):
    ident = X.sortable_id("e_", F.col("c0"), F.lit("k"))
    a, b = one(spark, ident, 1_700_000_000_000), one(spark, ident, 1_700_000_000_001)
    assert a < b and one(spark, X.id_millis(F.col("c0"), "e_"), a) == 1_700_000_000_000


def test_streams_are_combined(spark):
    c = X.combine_streams(F.col("c0"), F.col("c1"))
    assert one(spark, c, "out  ", "err") == "out\nerr" and one(spark, c, "", "err") == "err" and one(spark, c, "out", None) == "out"


def test_words_without_marks_are_tried_for_no_class(spark):
    from gleaner.functions import templates as T

    words = ["plain", "word.", "a-b", "a.b", "x/y", "git+ssh", "12", "Zürich,", "", "...", "deadbeef", "https://a", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee", "a\\b", "v1.2.3)", "C:", "日本", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["c"] for r in df.select("w", T.token_class(F.col("w")).alias("c")).collect()}
    assert {w: c for w, c in got.items() if c} == {"12": "n", "a.b": "path", "x/y": "path", "git+ssh": "url", "https://a": "url", "aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeeee": "uuid", "a\\b": "path", "v1.2.3)": "ver"}
    assert T.MARKED == r"[0-9/\\.:+-]"
