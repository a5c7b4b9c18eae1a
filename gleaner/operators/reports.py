"""Test, build and version-control output as tables: blocks of lines by carried headings, then grouped.

Input is a table of lines (doc_id, ln, line). A heading opens a block; a block's number is the running count of headings,
so every parser is a window over the document and one aggregation. Results render to the intermediate form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import clip
from gleaner.operators import ir

MAX_FAILURES, MAX_DETAIL, MAX_CHANGED, MAX_FILES = 25, 12, 400, 200
#: The lines that the tools print.
CARGO_RESULT = r"test result: (\w+)\. ([0-9]+) passed; ([0-9]+) failed; ([0-9]+) ignored; ([0-9]+) measured; ([0-9]+) filtered out; finished in ([0-9.]+)s"
CARGO_BLOCK, CARGO_PANIC = r"^---- (.+) stdout ----\s*$", r"panicked at ([^\s:]+(?::[0-9]+){1,2}):?"
RUSTC_ERROR, RUSTC_AT = r"^error(?:\[(E[0-9]{4})\])?: (.+)$", r"^\s*--> (.+:[0-9]+:[0-9]+)\s*$"
PYTEST_BLOCK, PYTEST_AT = r"^_{3,} (.+?) _{3,}\s*$", r"^(\S+\.py:[0-9]+): (\w+)"
JEST_BLOCK, JEST_AT = r"^\s*● (.+?)\s*$", r"at .*?\(?([\w./\\-]+\.[jt]sx?:[0-9]+:[0-9]+)\)?"
JEST_DETAIL = r"^\s*(Expected|Received|expect\(|AssertionError|Error:|- Expected|\+ Received)"
GO_VERDICT, GO_AT = r"^\s*--- (FAIL|PASS|SKIP): (\S+)", r"(\S+\.go:[0-9]+)"
DIFF_HEADER = r"^diff --git a/(.+?) b/(.+)$"
COMMIT, AUTHOR, DATE = r"^commit ([0-9a-f]{7,40})", r"^Author:\s+(.+?)\s+<", r"^Date:\s+(.+)$"


def by_doc() -> Window:
    return Window.partitionBy("doc_id").orderBy("ln")



def got(pattern: str, group: int = 1) -> Column:
    """The group of a line that matches, else null."""
    return F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, group))


def blocks(lines: DataFrame, opens: Column, closes: Column | None = None) -> DataFrame:
    """Lines behind a heading with the number of their block; lines of no block are left out."""
    mark = F.when(opens, 1)
    if closes is not None:
        mark = mark.when(closes, 0)
    rows = lines.withColumn("_mark", mark).withColumn("block", F.count(F.when(opens, 1)).over(by_doc()))
    rows = rows.withColumn("_in", F.last("_mark", ignorenulls=True).over(by_doc())).filter(F.col("_in") == 1)
    return rows.drop("_mark", "_in")


def first_of(value: Column, n: int) -> Column:
    """The first n values of a group in line order (nulls do not count)."""
    found = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("ln", value.alias("v")))))
    return F.transform(F.slice(found, 1, n), lambda x: x.v)


def last_of(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("ln")))


def _failures(rows: DataFrame, name: Column, location: Column, detail: Column, error: Column | None = None) -> DataFrame:
    return rows.groupBy("doc_id", "block").agg(
        F.min_by(name, "ln").alias("name"), location.alias("location"), (error if error is not None else F.lit(None).cast("string")).alias("error_type"),
        first_of(detail, MAX_DETAIL).alias("detail"),
    )


def bare(column: str | Column = "line") -> Column:
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def trimmed(test: Column) -> Column:
    text = bare()
    return F.when(test & (text != ""), text)


def cargo_totals(lines: DataFrame) -> DataFrame:
    """Sums over all result lines of a document; it passes if all of them do."""
    rows = lines.filter(F.col("line").rlike(CARGO_RESULT))
    part = lambda k: F.regexp_extract("line", CARGO_RESULT, k)
    total = lambda k: F.sum(part(k).cast("bigint"))
    ok = F.bool_and(part(1) == "ok")
    return rows.groupBy("doc_id").agg(
        F.when(ok, "pass").otherwise("fail").alias("status"), total(2).alias("passed"), total(3).alias("failed"), total(4).alias("ignored"),
        total(5).alias("measured"), total(6).alias("filtered_out"), F.format_string("%.2fs", F.sum(part(7).cast("double"))).alias("duration"),
    )


def cargo_failures(lines: DataFrame) -> DataFrame:
    opens = F.col("line").rlike(CARGO_BLOCK)
    rows = blocks(lines, opens, F.col("line").rlike("^(failures:|test result:)"))
    at = got(CARGO_PANIC)
    return _failures(rows, got(CARGO_BLOCK), last_of(at), trimmed(~opens), F.when(F.max(at).isNotNull(), "panic"))


def build_errors(lines: DataFrame) -> DataFrame:
    """Compiler errors: code, message, the first place, up to four lines of help."""
    aborting = F.col("line").startswith("error: aborting")
    opens = F.col("line").rlike(RUSTC_ERROR) & ~aborting
    inner = bare(F.regexp_replace("line", r"^[| ^-]+", ""))
    help_ = F.when(~opens & ~aborting & got(RUSTC_AT).isNull() & inner.rlike(r"expected |found |^help:|^note:"), inner)
    rows = blocks(lines, opens)
    out = rows.groupBy("doc_id", "block").agg(
        F.min_by(F.nullif(F.regexp_extract("line", RUSTC_ERROR, 1), F.lit("")), "ln").alias("code"), F.min_by(got(RUSTC_ERROR, 2), "ln").alias("message"),
        F.min_by(got(RUSTC_AT), F.when(got(RUSTC_AT).isNotNull(), F.col("ln"))).alias("location"), first_of(help_, 4).alias("detail"),
    )
    placed = out.groupBy("doc_id").agg(F.max(F.col("location").isNotNull()).alias("_p")).filter("_p")
    return out.join(placed.drop("_p"), "doc_id", "left_semi")


def last_counts(lines: DataFrame, where: Column, words: dict[str, str]) -> DataFrame:
    """Counters `N word` of the last line that passes; words maps what is printed to the counter's name."""
    some = where & F.col("line").rlike(r"[0-9]+ (" + "|".join(words) + ")")
    last = lines.filter(some).groupBy("doc_id").agg(F.max_by("line", "ln").alias("line"))
    count = lambda names: sum(
        (F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("line", rf"([0-9]+) {w}\b", 1), F.lit("")), F.lit("999999999999")), F.lit(0)) for w in names), F.lit(0)
    ).cast("bigint")
    names = dict.fromkeys(words.values())
    out = last.select("doc_id", "line", *[count([w for w, n in words.items() if n == name]).alias(name) for name in names])
    bad = F.greatest(*[F.col(c) for c in names if c in ("failed", "errors")], F.lit(0)) > 0
    return out.withColumn("status", F.when(bad, "fail").otherwise("pass"))


def pytest_totals(lines: DataFrame) -> DataFrame:
    words = {w: w for w in ("passed", "failed", "errors", "skipped", "xfailed", "xpassed", "deselected", "warnings")} | {"error": "errors", "warning": "warnings"}
    out = last_counts(lines, F.col("line").startswith("="), words)
    return out.withColumn("duration", F.nullif(F.regexp_extract("line", r"in ([0-9.]+s)", 1), F.lit(""))).drop("line")


def pytest_failures(lines: DataFrame) -> DataFrame:
    """Failure blocks with the node id of the short summary: that of the first failure of its last name."""
    rows = blocks(lines, F.col("line").rlike(PYTEST_BLOCK), F.col("line").startswith("==="))
    detail = F.when(F.col("line").startswith("E "), F.trim(F.substring("line", 2, 1 << 20)))
    found = _failures(rows, got(PYTEST_BLOCK), last_of(got(PYTEST_AT)), detail, last_of(got(PYTEST_AT, 2)))
    ids = lines.select("doc_id", got(r"^(?:FAILED|ERROR) (\S+)").alias("node")).filter("node is not null").withColumn("name", F.substring_index("node", "::", -1))
    ids = ids.groupBy("doc_id", "name").agg(F.min("node").alias("node"))
    first = found.groupBy("doc_id", "name").agg(F.min("block").alias("block"))
    named = first.join(ids, ["doc_id", "name"]).select("doc_id", "block", "node")
    return found.join(named, ["doc_id", "block"], "left").withColumn("name", F.coalesce("node", "name")).drop("node")


def jest_totals(lines: DataFrame) -> DataFrame:
    words = {w: w for w in ("passed", "failed", "skipped", "todo", "pending")}
    named = lines.groupBy("doc_id").agg(F.when(F.max(F.col("line").contains("Test Files")), "vitest").otherwise("jest").alias("framework"))
    return last_counts(lines, F.ltrim("line").rlike("^Tests[: ]"), words).drop("line").join(named, "doc_id")


def jest_failures(lines: DataFrame) -> DataFrame:
    """Failures at their last `at` place, else in the file that was named last before them."""
    rows = lines.withColumn("_file", F.last(got(r"^\s*FAIL (.+?)\s*$"), ignorenulls=True).over(by_doc()))
    opens = F.col("line").rlike(JEST_BLOCK)
    rows = blocks(rows, opens & ~F.col("line").rlike(r"^\s*● Console"), opens)
    return _failures(
        rows, got(JEST_BLOCK), F.coalesce(last_of(got(JEST_AT)), F.min_by("_file", "ln")), trimmed(F.col("line").rlike(JEST_DETAIL)),
        F.when(F.max(F.ltrim("line").startswith("expect(")), "assertion"),
    )


def go_totals(lines: DataFrame) -> DataFrame:
    v = got(GO_VERDICT)
    out = lines.filter(v.isNotNull()).groupBy("doc_id").agg(*[F.count_if(v == k).alias(n) for k, n in (("PASS", "passed"), ("FAIL", "failed"), ("SKIP", "skipped"))])
    return out.withColumn("status", F.when(F.col("failed") > 0, "fail").otherwise("pass"))


def go_failures(lines: DataFrame) -> DataFrame:
    """Failures with the indented lines around the verdict: those after it, and those before that no failure owns."""
    verdict = got(GO_VERDICT)
    anchor = F.when(verdict.isNotNull(), verdict).when(~F.col("line").rlike(r"^[ \t]"), "-")
    rows = lines.withColumn("_a", anchor).withColumn("_n", F.sum(F.when(verdict == "FAIL", 1).otherwise(0)).over(by_doc()))
    rows = rows.withColumn("_before", F.last("_a", ignorenulls=True).over(by_doc()))
    ahead = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_after", F.first("_a", ignorenulls=True).over(ahead))
    own = F.when(F.col("_before") == "FAIL", F.col("_n")).when(F.col("_a").isNull() & (F.col("_after") == "FAIL"), F.col("_n") + 1)
    rows = rows.withColumn("block", own).filter(F.col("block").isNotNull())
    detail = trimmed(F.col("_a").isNull())
    place = F.when(F.col("_a").isNull(), F.nullif(F.regexp_extract("line", GO_AT, 1), F.lit("")))
    named = F.when(F.col("_a") == "FAIL", F.regexp_extract("line", GO_VERDICT, 2))
    return rows.groupBy("doc_id", "block").agg(
        F.max(named).alias("name"), F.min_by(place, F.when(place.isNotNull(), F.col("ln"))).alias("location"), F.lit(None).cast("string").alias("error_type"),
        first_of(detail, MAX_DETAIL).alias("detail"),
    )


def git_status(lines: DataFrame) -> DataFrame:
    """Changed files by heading: state and path; short form if there is no heading."""
    heads = {"Changes to be committed:": "staged", "Changes not staged for commit:": "unstaged", "Untracked files:": "untracked"}
    head = F.coalesce(*[F.when(F.rtrim("line") == k, v) for k, v in heads.items()])
    rows = lines.withColumn("_s", F.last(head, ignorenulls=True).over(by_doc()))
    entry = F.col("_s").isNotNull() & F.col("line").rlike(r"^(\t|        )\S")
    state = F.when(F.col("line").rlike(r"^\s*[^:]{1,12}:"), F.trim(F.regexp_extract("line", r"^\s*([^:]+):", 1))).otherwise("untracked")
    path = F.when(F.col("line").rlike(r"^\s*[^:]{1,12}:"), F.trim(F.regexp_extract("line", r"^\s*[^:]+:(.*)$", 1))).otherwise(bare())
    long = rows.filter(entry).select("doc_id", "ln", F.concat_ws("/", "_s", state).alias("state"), path.alias("path"))
    short = lines.filter(F.col("line").rlike(r"^[MADRCU?! ]{2} \S") & ~F.col("line").startswith("   "))
    short = short.join(long.select("doc_id").distinct(), "doc_id", "left_anti")
    return long.unionByName(short.select("doc_id", "ln", F.trim(F.substring("line", 1, 3)).alias("state"), F.trim(F.substring("line", 4, 1 << 20)).alias("path")))


def git_head(lines: DataFrame) -> DataFrame:
    """Branch, how far ahead or behind, and whether the tree is clean."""
    return lines.groupBy("doc_id").agg(
        F.max(got(r"^On branch (\S+)")).alias("branch"), F.max(got(r"ahead .*by ([0-9]+) commit")).cast("bigint").alias("ahead"),
        F.max(got(r"behind .*by ([0-9]+) commit")).cast("bigint").alias("behind"), F.max(F.col("line").contains("nothing to commit")).alias("clean"),
    )


def git_diff(lines: DataFrame) -> DataFrame:
    """Files of a diff: lines added, removed and of context, flags, and the changed lines with their hunk headings.

    `---` and `+++` are headers only before a file's first hunk, so a removed line `-- x` counts.
    """
    opens = F.col("line").rlike(DIFF_HEADER)
    hunk = F.when(opens, False).when(F.col("line").startswith("@@"), True)
    # What a line takes from the lines before it comes from one window, so the lines of a document are sorted once.
    carried = {"_path": F.last(got(DIFF_HEADER, 2), ignorenulls=True).over(by_doc()), "_hunk": F.coalesce(F.last(hunk, ignorenulls=True).over(by_doc()), F.lit(False))}
    rows = blocks(lines.withColumns(carried), opens)
    inside = F.col("_hunk") & ~F.col("line").startswith("@@")
    first = F.substring("line", 1, 1)
    added, removed = inside & (first == "+"), inside & (first == "-")
    kept = F.when(added | removed | F.col("line").startswith("@@"), F.col("line"))
    flag = lambda p: F.max(F.col("line").rlike(p))
    return rows.groupBy("doc_id", "block", F.col("_path").alias("path")).agg(
        F.count_if(added).alias("added"), F.count_if(removed).alias("removed"),
        F.count_if(inside & ~added & ~removed).alias("context"), flag("^(Binary files |GIT binary patch)").alias("binary"), flag("^new file mode").alias("new_file"),
        flag("^deleted file mode").alias("deleted"), F.max(got("^rename from (.+)$")).alias("renamed_from"), F.count(kept).alias("changed"),
        first_of(kept, MAX_CHANGED).alias("kept"),
    )


def git_log(lines: DataFrame) -> DataFrame:
    rows = blocks(lines, F.col("line").rlike(COMMIT))
    subject = F.when(F.col("line").startswith("    "), F.trim("line"))
    return rows.groupBy("doc_id", "block").agg(
        F.substring(F.min_by(got(COMMIT), "ln"), 1, 8).alias("hash"), last_of(got(AUTHOR)).alias("author"), F.trim(last_of(got(DATE))).alias("date"),
        F.min_by(subject, F.when(subject != "", F.col("ln"))).alias("subject"),
    )


def _kv(**pairs: Column) -> Column:
    some = F.array(*[F.struct(F.lit(k.rstrip("_")).alias("k"), v.cast("string").alias("v")) for k, v in pairs.items()])
    return F.filter(some, lambda e: e.v.isNotNull())


def _none() -> Column:
    return F.lit(None).cast("string")


def _sections(rows: DataFrame, section: Column, limit: int) -> DataFrame:
    """The first `limit` sections of each document, in block order, and how many there were."""
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("block"))
    total = F.count("*").over(Window.partitionBy("doc_id"))
    some = rows.withColumn("_r", rank).withColumn("_n", total).filter(F.col("_r") <= limit)
    out = some.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("_r"), section.alias("s")))).alias("s"), F.max("_n").alias("found"))
    return out.select("doc_id", "found", F.transform("s", lambda x: x.s).alias("sections"))


def render_tests(totals: DataFrame, failures: DataFrame, framework: str) -> DataFrame:
    """Test totals and failures as text of the intermediate form; a column `framework` of the totals goes before the name given."""
    section = F.struct(
        F.concat(F.lit("failure "), F.col("name")).alias("label"), _kv(at=F.col("location"), error=F.col("error_type")).alias("attrs"),
        F.transform("detail", lambda d: clip(d, 400)).alias("body"),
    )
    parts = totals.join(_sections(failures, section, MAX_FAILURES), "doc_id", "left")
    counts = [c for c in totals.columns if c not in ("doc_id", "status", "duration", "framework")]
    fields = _kv(**{c: F.when((F.col(c) > 0) | F.lit(c in ("passed", "failed")), F.col(c)) for c in counts}, failures_not_shown=F.when(F.col("found") > MAX_FAILURES, F.col("found") - MAX_FAILURES))
    header = _kv(status=F.col("status"), duration=F.col("duration") if "duration" in totals.columns else _none())
    named = F.col("framework") if "framework" in totals.columns else F.lit(framework)
    text = ir.render(F.lit("test"), named, header, fields, F.coalesce("sections", F.array().cast(parts.schema["sections"].dataType)), _none())
    return parts.select("doc_id", text.alias("output"))


def render_build(errors: DataFrame) -> DataFrame:
    section = F.struct(
        F.concat(F.lit("error#"), F.col("block").cast("string")).alias("label"), _kv(at=F.col("location"), code=F.col("code")).alias("attrs"),
        F.concat(F.array(clip(F.col("message"), 400)), F.transform("detail", lambda d: clip(d, 400))).alias("body"),
    )
    parts = _sections(errors, section, MAX_FAILURES)
    text = ir.render(F.lit("build"), F.lit("cargo"), _kv(status=F.lit("error")), _kv(errors=F.col("found")), F.col("sections"), _none())
    return parts.select("doc_id", text.alias("output"))


def render_diff(files: DataFrame) -> DataFrame:
    yes = lambda c: F.when(F.col(c), "true")
    section = F.struct(
        F.col("path").alias("label"),
        _kv(
            added=F.col("added"), removed=F.col("removed"), binary=yes("binary"), new=yes("new_file"), deleted=yes("deleted"), renamed_from=F.col("renamed_from"),
            context_dropped=F.when(F.col("context") > 0, F.col("context")), not_shown=F.when(F.col("changed") > MAX_CHANGED, F.col("changed") - MAX_CHANGED),
        ).alias("attrs"),
        F.transform("kept", lambda x: clip(x, 500)).alias("body"),
    )
    sums = files.groupBy("doc_id").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    parts = _sections(files, section, MAX_FILES).join(sums, "doc_id")
    more = F.when(F.col("found") > MAX_FILES, F.col("found") - MAX_FILES)
    text = ir.render(F.lit("git"), F.lit("diff"), _kv(files=F.col("found")), _kv(added=F.col("added"), removed=F.col("removed"), files_not_shown=more), F.col("sections"), _none())
    return parts.select("doc_id", text.alias("output"))


def render_log(commits: DataFrame) -> DataFrame:
    line = F.concat("hash", F.lit(" "), F.coalesce("date", F.lit("")), F.lit(" | "), F.coalesce("author", F.lit("")), F.lit(" | "), clip(F.coalesce("subject", F.lit("")), 120))
    parts = _sections(commits, line, MAX_FILES)
    section = F.array(F.struct(F.lit("commits").alias("label"), F.array().cast("array<struct<k:string,v:string>>").alias("attrs"), F.col("sections").alias("body")))
    text = ir.render(F.lit("git"), F.lit("log"), _kv(commits=F.col("found")), _kv(x=_none()), section, _none())
    return parts.select("doc_id", text.alias("output"))


def render_status(lines: DataFrame) -> DataFrame:
    entries = git_status(lines).withColumn("block", F.col("ln"))
    parts = git_head(lines).join(_sections(entries, F.concat_ws(" ", "state", "path"), MAX_FILES), "doc_id", "left")
    some = F.col("found").isNotNull()
    section = F.when(some, F.array(F.struct(F.lit("files").alias("label"), F.array().cast("array<struct<k:string,v:string>>").alias("attrs"), F.col("sections").alias("body"))))
    empty = F.array().cast("array<struct<label:string,attrs:array<struct<k:string,v:string>>,body:array<string>>>")
    header = _kv(status=F.when(F.col("clean") & ~some, "clean").otherwise("dirty"))
    fields = _kv(branch=F.col("branch"), ahead=F.col("ahead"), behind=F.col("behind"), files=F.coalesce("found", F.lit(0)))
    text = ir.render(F.lit("git"), F.lit("status"), header, fields, F.coalesce(section, empty), _none())
    return parts.filter(some | F.col("branch").isNotNull() | F.col("clean")).select("doc_id", text.alias("output"))
