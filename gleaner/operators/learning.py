"""Learning rules from lessons: retire, cover, lines, generalise, blocks, folds, whitelists, install.

A lesson is a small text with marked lines, so what depends on the order of its lines is decided in Python by lesson, in
parallel over lessons. Matching against rules, retiring and installing are joins over whole tables.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import templates as T
from gleaner.functions.text import CRITICAL
from gleaner.operators import lessons as L
from gleaner.operators import rules as R
from gleaner.sources.scratch import materialize

#: Least characters of the literals of a line and of a block, most placeholders by tokens.
LINE_CHARS, BLOCK_CHARS, MOST_PLACEHOLDERS = 8, 24, 0.5
RULES = "id string, program string, subcommand string, action string, caption string, lines array<string>, examples bigint, source string, forced boolean, enabled boolean, created_millis bigint"
#: Proposals that a task hands on at a time.
BATCH = 4096
_TEXT = ("lesson_id", "program", "subcommand", "action", "caption")
PROPOSALS = pa.schema([*((c, pa.string()) for c in _TEXT), ("lines", pa.list_(pa.string())), ("examples", pa.int64()), ("source", pa.string()), ("forced", pa.bool_()), ("reason", pa.string()), ("detail", pa.string())])
_CRITICAL = re.compile("(?i)" + CRITICAL, re.ASCII)
_CLASSES = [*dict(T.CLASS_PATTERNS), "path", "t"]


def pattern_of(canonical: Column) -> Column:
    """The template that a canonical text stands for: classes and the wildcard are in braces."""
    name = lambda t: F.regexp_extract(t, r"^\{([a-z]+|\*)\}$", 1)
    part = lambda c, w: F.struct(c.alias("cls"), w.alias("lit"))
    token = lambda t: F.when(name(t).isin("*", *_CLASSES), part(name(t), F.lit(""))).otherwise(part(F.lit(""), t))
    return F.transform(F.split(canonical, " "), token)


def compiled(rules: DataFrame, every_line: bool = False) -> DataFrame:
    """Line rules in the form that `rules.matched` reads; with `every_line`, one row for each line of a block as well."""
    rows = rules.select("*", F.explode("lines").alias("_line")) if every_line else rules.filter(F.size("lines") == 1).withColumn("_line", F.get("lines", 0))
    rows = rows.withColumn("pattern", pattern_of(F.col("_line"))).withColumn("summary", F.col("caption"))
    return rows.withColumn("wild", F.exists("pattern", lambda s: s.cls == "*"))


def parsed(lessons: DataFrame) -> DataFrame:
    """The marked and plain lines of lessons (lesson_id, program, subcommand, forced, text)."""
    return lessons.lateralJoin(L.ParseLesson(F.col("text").outer())).drop("text")


def refusal(shapes: list[tuple], sources: list[str], kept: list[tuple], forced: bool) -> str | None:
    """Why lines cannot be a rule, the first reason that holds, or None. Blocks meet every run of kept lines."""
    parts = [s for shape in shapes for s in shape]
    literal = [s for s in parts if not s[0]]
    chars = sum(len(s[1]) for s in literal)
    if not all(shapes):
        return "unusable"
    if len(shapes) > L.MAX_HEIGHT:
        return "too_tall"
    if not forced and any(_CRITICAL.search(s) for s in sources):
        return "critical"
    if len(literal) < 2 or chars < (LINE_CHARS if len(shapes) == 1 else BLOCK_CHARS):
        return "too_general"
    if (len(parts) - len(literal)) / len(parts) > MOST_PLACEHOLDERS:
        return "mostly_placeholders"
    for at in range(len(kept) - len(shapes) + 1):
        if all(map(L.same, shapes, kept[at : at + len(shapes)])):
            return "matches_kept"
    return None


def text_of(shape: tuple) -> str:
    return " ".join("{" + c + "}" if c else w for c, w in shape)


def by_shape(rows: list[str], kept: list[tuple]) -> list[tuple[tuple, str, int]]:
    """(shape, first line, examples) of lines, merged where one place differs and no kept line would match."""
    count, first = Counter(L.shape(r) for r in rows), {}
    for r in rows:
        first.setdefault(L.shape(r), r)
    most = dict(sorted(count.items(), key=lambda c: (-c[1], c[0]))[: L.MAX_SHAPES])
    out = []
    for merged in L.generalise([s for s in most if s], kept):
        mine = [s for s in most if L.same(merged, s)]
        if mine:
            out.append((merged, first[min(mine)], sum(most[s] for s in mine)))
    return [*out, *(((), first[()], n) for s, n in most.items() if not s)]


class Row(NamedTuple):
    """A line of a lesson as `parsed` gives it, with the lesson's own columns; of the kind `covered`: a line that a rule removes already."""

    lesson_id: str
    program: str | None
    subcommand: str | None
    forced: bool
    ln: int
    kind: str
    run: int
    caption: str | None
    line: str


def taught(rows: list[Row]) -> list[tuple]:
    """(action, caption, lines, examples, source, reason, detail) that one lesson teaches; a reason marks what it may not."""
    forced, found = bool(rows[0].forced), []
    first = [r.line for r in rows if r.kind in ("plain", "keep")]
    kept = [L.shape(x) for x in first]
    covered = {r.ln for r in rows if r.kind == "covered"}
    open_ = [r.line for r in rows if r.kind == "trash" and r.ln not in covered]
    new = []
    more = len({L.shape(x) for x in open_}) - L.MAX_SHAPES
    if more > 0:
        found.append(("drop", None, [], more, "", "left_out"))
    for shape, source, n in by_shape(open_, kept):
        reason = refusal([shape], [source], kept, forced)
        found.append(("drop", None, [text_of(shape)] if shape else [], n, source, reason))
        if reason is None:
            new.append(shape)
    for run in by_run(rows, "trash"):
        lines, shapes = [r.line for r in run], [L.shape(r.line) for r in run]
        left = [r.ln not in covered and not any(L.same(s, x) for s in new) for r, x in zip(run, shapes, strict=True)]
        if len(lines) < 2 or 2 * sum(left) <= len(lines):  # line rules do for most of it
            continue
        reason = refusal(shapes, lines, kept, forced)
        found.append(("drop", None, list(map(text_of, shapes)), 1, lines[0], reason))
        if reason is None:  # the block takes the lines, so they are refused no more
            found = [f for f in found if f[5] is None or f[4] not in lines]
    for run in by_run(rows, "fold"):
        caption, lines = (run[0].caption or "").strip(), [r.line for r in run]
        if not caption:
            found.append(("fold", None, [], 1, lines[0], "fold_without_caption"))
            continue
        made = [(s, x, n, refusal([s], [x], kept, forced)) for s, x, n in by_shape(lines, kept)]
        if any(r is None for *_, r in made) or len(lines) < 2:
            found += [("fold", caption, [text_of(s)] if s else [], n, x, r) for s, x, n, r in made]
        else:
            shapes = [L.shape(x) for x in lines]
            found.append(("fold", caption, list(map(text_of, shapes)), 1, lines[0], refusal(shapes, lines, kept, forced)))
    for shape, source, n in by_shape([r.line for r in rows if r.kind == "only"], []):
        found.append(("keep", None, [text_of(shape)] if shape else [], n, source, refusal([shape], [source], [], True)))
    lines = [text_of(k) for k in kept]
    return [(*f, met(f[2], lines, first) if f[5] == "matches_kept" else None) for f in found]


def by_run(rows: list[Row], kind: str) -> Iterator[list[Row]]:
    """The lines of one kind by the mark they stand in, in the order of the marks."""
    mine = sorted((r for r in rows if r.kind == kind), key=lambda r: r.run)
    return (list(run) for _, run in groupby(mine, key=lambda r: r.run))


def met(rule: list[str], kept: list[str], lines: list[str]) -> str | None:
    """The first kept line that a rule of these canonical lines would take."""
    same = lambda a, b: len(x := a.split()) == len(y := b.split()) and all(p in ("{*}", q) for p, q in zip(x, y, strict=True))
    for at in range(len(kept) - len(rule) + 1):
        if all(map(same, rule, kept[at : at + len(rule)])):
            return lines[at]
    return None


def explained(made: DataFrame) -> DataFrame:
    """Add `explanation` to proposals: what a refused one is told, null for the others."""
    segs = F.flatten(F.transform("lines", pattern_of))
    literal = F.filter(segs, lambda s: s.cls == "")
    chars = F.aggregate(literal, F.lit(0), lambda n, s: n + F.char_length(s.lit))
    share = F.when(F.size(segs) > 0, F.floor((F.size(segs) - F.size(literal)) * 100 / F.size(segs)))
    text = (
        F.when(F.col("reason") == "unusable", "nothing to match on")
        .when(F.col("reason") == "too_general", F.format_string("too general (%d literal token(s), %d char(s))", F.size(literal), chars))
        .when(F.col("reason") == "mostly_placeholders", F.format_string("%d%% of the pattern is placeholders", share))
        .when(F.col("reason") == "critical", "looks like an error, and errors are never filtered (use --force)")
        .when(F.col("reason") == "matches_kept", F.concat(F.lit("would also remove a line you kept: "), F.coalesce("detail", F.lit(""))))
        .when(F.col("reason") == "too_tall", F.format_string(f"%d lines is taller than a block rule may be ({L.MAX_HEIGHT})", F.size("lines")))
        .when(F.col("reason") == "left_out", F.format_string(f"%d shape(s) beyond the {L.MAX_SHAPES} that a lesson may teach", F.col("examples")))
        .when(F.col("reason") == "fold_without_caption", 'a fold needs a caption: <filter-fold as="what this run amounts to">')
    )
    return made.withColumn("explanation", text)


def retired(rules: DataFrame, kept: DataFrame) -> DataFrame:
    """Rules any of whose lines a line must stay for (kept: program, subcommand, line) are switched off."""
    each = compiled(rules.filter("enabled"), every_line=True)
    hit = R.covering(kept.withColumn("_segs", T.segments(F.col("line"))), each, ["rule_id"], scoped=True).distinct()
    out = rules.join(hit.withColumnRenamed("rule_id", "id").withColumn("_hit", F.lit(True)), "id", "left")
    return out.withColumn("enabled", F.col("enabled") & F.col("_hit").isNull()).drop("_hit")


def proposals(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """What the lessons teach (rows of `parsed`): lesson_id, id, program, subcommand, action, caption, lines, examples, source, forced, reason, detail.

    Lines are dealt and sorted by lesson, and a task reads one lesson behind the other: a lesson costs its lines, and no call.
    """
    trash = rows.filter("kind = 'trash'").withColumn("_segs", T.segments(F.col("line")))
    covered = R.covering(trash, compiled(rules.filter("enabled and action = 'drop'")), ["lesson_id", "ln"], scoped=True).distinct()
    covered = covered.withColumns({"kind": F.lit("covered"), "line": F.lit(""), "run": F.lit(0)})
    known = rows.withColumn("_at", F.monotonically_increasing_id()).unionByName(covered, allowMissingColumns=True)
    known = known.select(F.col("lesson_id").cast("string").alias("lesson_id"), *Row._fields[1:], "_at")

    def lessons(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        read = (Row(*r) for b in batches for r in zip(*[b.column(k).to_pylist() for k in range(len(Row._fields))], strict=True))
        for _, lesson in groupby(read, key=lambda r: r.lesson_id):
            lines = list(lesson)
            scope = next(r for r in lines if r.kind != "covered")  # covered lines are of no scope
            for action, caption, shapes, n, source, reason, detail in taught(sorted(lines, key=lambda r: r.kind == "covered")):
                yield scope.lesson_id, scope.program, scope.subcommand, action, caption, shapes, n, source, scope.forced, reason, detail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lessons(batches)
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), PROPOSALS, strict=True)], schema=PROPOSALS)

    schema = "lesson_id string, program string, subcommand string, action string, caption string, lines array<string>, examples bigint, source string, forced boolean, reason string, detail string"
    made = known.repartition("lesson_id").sortWithinPartitions("lesson_id", "ln", "_at").drop("_at").mapInArrow(run, schema)
    ident = R.rule_id(F.col("program"), F.col("subcommand"), F.array_join("lines", "\n"), F.concat_ws("\u0001", "action", "caption"))
    return made.withColumn("id", ident)


def install(rules: DataFrame, made: DataFrame, now_millis: int) -> DataFrame:
    """The rule set with what was taught and not refused: new rules, and old ones that are taught again, which are enabled."""
    new = made.filter("reason is null").groupBy("id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("program", "subcommand", "action", "caption", "lines")],
        F.sum("examples").alias("examples"), F.min("source").alias("source"), F.bool_or("forced").alias("forced"),
    )
    new = new.withColumns({"enabled": F.lit(True), "created_millis": F.lit(now_millis).cast("bigint")})
    names = [c.split()[0] for c in RULES.split(", ")]
    both = rules.select(*names).withColumn("_old", F.lit(True)).unionByName(new.select(*names).withColumn("_old", F.lit(False)))
    of_old = lambda c: F.coalesce(F.max_by(c, F.when(F.col("_old"), 1)), F.max_by(c, F.when(~F.col("_old"), 1)))
    return both.groupBy("id").agg(
        *[of_old(c).alias(c) for c in ("program", "subcommand", "action", "caption", "lines")],
        F.sum("examples").alias("examples"), of_old("source").alias("source"), F.bool_or("forced").alias("forced"),
        F.bool_or(F.col("enabled")).alias("enabled"), F.min("created_millis").alias("created_millis"),
        F.when(~F.bool_or("_old"), "created").when(F.bool_or(~F.col("_old")), "reinforced").otherwise("unchanged").alias("state"),
    )


def learn(lessons: DataFrame, rules: DataFrame, now_millis: int, counter: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rules, proposals) after the lessons (lesson_id, program, subcommand, forced, text).

    `counter` has more lines (lesson_id, ln, line) that what a lesson teaches may not match, as the critical ones of its source.

    Lines marked to stay retire the rules that match them. Lines that a rule removes already teach nothing. Of the others,
    shapes become line rules, runs that line rules do not do for become blocks, captioned runs become folds, and lines
    that alone shall stay become a whitelist. Rules get their id from scope, action and lines, so lessons that teach the
    same meet in one rule. All lessons are read against the rules as they were; a lesson without text teaches nothing.
    Lines, rules and proposals are written once, as each is read several times.
    """
    rows = parsed(lessons)
    if counter is not None:
        lesson = lessons.select("lesson_id", "program", "subcommand", "forced")
        more = counter.select("lesson_id", (-F.col("ln")).cast("int").alias("ln"), F.lit("plain").alias("kind"), F.lit(0).alias("run"), F.lit(None).cast("string").alias("caption"), "line")
        rows = rows.unionByName(lesson.join(more, "lesson_id").select(rows.columns))
    rows = materialize(rows, "learn-lines")
    active = materialize(retired(rules, rows.filter("kind = 'keep'").select("program", "subcommand", "line")), "learn-rules")
    made = materialize(proposals(rows, active), "learn-proposals")
    return install(active, made, now_millis), made
