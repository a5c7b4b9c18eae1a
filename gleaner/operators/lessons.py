"""Lessons: marked-up texts that teach rules, and generalised shapes. Ordered state, so Python per text."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain, combinations, groupby, islice
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import templates as T
from gleaner.operators.graph import components
from gleaner.sources.scratch import materialize

#: The tags of a lesson, in two spellings.
TAGS = {"trash": "trash", "filter-trash": "trash", "fold": "fold", "filter-fold": "fold", "only": "only", "filter-only": "only", "keep": "keep", "filter-keep": "keep"}
TAG = re.compile(r"<(/?)(" + "|".join(TAGS) + r")(?:\s+as=\"([^\"]*)\")?\s*>")
MAX_HEIGHT, MAX_SHAPES = 32, 256
WILD = ("*", "")
#: Most sets of places that shapes are joined by, and rows that a task hands on at a time.
MOST_SETS, BATCH = 128, 4096
_CLASSES = [(name, re.compile(p)) for name, p in T.CLASS_PATTERNS]
_TRAILING, _DATE = re.compile(T.TRAILING), re.compile(T.DATE_PREFIX)


def lesson_lines(text: str) -> Iterator[tuple[int, str, int, str | None, str]]:
    """(line, kind, run, caption, text) of every filled line; unmarked lines are `plain`, a tag may close on its line."""
    kind, run, caption = "plain", 0, None
    for number, row in enumerate(text.splitlines(), 1):
        at, pieces = 0, []
        for m in TAG.finditer(row):
            pieces.append((kind, run, caption, row[at : m.start()]))
            at = m.end()
            if m[1]:
                kind, caption = "plain", None
            else:
                kind, run, caption = TAGS[m[2]], run + 1, m[3]
        pieces.append((kind, run, caption, row[at:]))
        filled = [p for p in pieces if p[3].strip()]
        for k, r, c, piece in filled:
            yield number, k, r if k != "plain" else 0, c, piece.strip() if len(pieces) > 1 else piece


@F.udtf(returnType="ln int, kind string, run int, caption string, line string")
class ParseLesson:
    """Table function: the marked lines of a lesson."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from lesson_lines(text)


@lru_cache(1 << 16)
def token_class(token: str) -> str:
    """The Python form of `templates.token_class`, from the same patterns; '' for a literal."""
    t = _TRAILING.sub("", token)
    digits = sum(c in "0123456789" for c in t)
    for name, pattern in _CLASSES:
        if name == "t":
            if (pattern.search(t) and digits >= 3) or _DATE.search(t):
                return "t"
        elif name == "hex":
            if pattern.search(t) and re.search("[0-9]", t.removeprefix("0x")):
                return "hex"
        elif t and pattern.search(t):
            return name
    if len(t.encode()) >= 3 and ("/" in t or "\\" in t or re.search(r"^.*[A-Za-z0-9].*\.[A-Za-z0-9]{1,6}$", t)):
        return "path"
    return ""


@lru_cache(1 << 12)
def shape(line: str) -> tuple[tuple[str, str], ...]:
    words = line.split()
    return tuple((c, "" if c else w) for w in words if len(words) <= T.MAX_TOKENS for c in (token_class(w),))


def same(rule: tuple, line: tuple) -> bool:
    return len(rule) == len(line) and all(r[0] == "*" or r == x for r, x in zip(rule, line, strict=True))


def joined(a: tuple, b: tuple, kept: list[tuple] = ()) -> tuple | None:
    """Two shapes of one length as one, if one place differs at most that is not wild already and what is left is specific."""
    out, new, literals, chars = [], 0, 0, 0
    for x, y in zip(a, b, strict=True):
        if x == y:
            out.append(x)
            if not x[0]:
                literals, chars = literals + 1, chars + len(x[1])
        else:
            new += "*" not in (x[0], y[0])
            if new > 1:
                return None
            out.append(WILD)
    if literals < 2 or chars < 8 or 2 * (len(out) - literals) > len(out):
        return None
    out = tuple(out)
    return None if any(same(out, k) for k in kept) else out


class Codes:
    """The shapes of one length as rows of numbers, for what can be merged with one of them (kept shapes aside)."""

    def __init__(self, shapes: list[tuple]) -> None:
        self.code = {t: k for k, t in enumerate(sorted({WILD, *chain.from_iterable(shapes)}))}
        self.wild, self.row = self.code[WILD], {}
        self.chars = np.array([len(w) for _, w in self.code], np.int32)
        self.literal = np.array([not c for c, _ in self.code])
        self.table = np.empty((2 * len(shapes), len(shapes[0])), np.int32)  # each merge makes one shape of two
        for s in shapes:
            self.add(s)

    def add(self, shape: tuple) -> None:
        if shape not in self.row:
            self.row[shape] = len(self.row)
            self.table[self.row[shape]] = [self.code[t] for t in shape]

    def near(self, shape: tuple, others: list[tuple]) -> np.ndarray:
        """The places in `others` of what can be merged with a shape."""
        a, rows = self.table[self.row[shape]], self.table[[self.row[s] for s in others]]
        equal = rows == a
        new = (~equal & (rows != self.wild) & (a != self.wild)).sum(1)
        literal = equal & self.literal[a]
        count = literal.sum(1)
        return np.flatnonzero((new <= 1) & (count >= 2) & (literal @ self.chars[a] >= 8) & (2 * (len(a) - count) <= len(a)))


def merged(rows: list[tuple], kept: list[tuple] = ()) -> list[tuple]:
    """The sorted distinct shapes of one length, the first pair that can be merged by one shape, until there is none.

    A shape for which no later one was found is not tried again until a merge makes one that it can be merged with; these are
    among the first `known`.
    """
    alone, known, i, codes = [False] * len(rows), 0, 0, None
    while i < len(rows):
        if alone[i]:
            i += 1
            continue
        a, j, made = rows[i], i + 1, None
        if j < len(rows) and (made := joined(a, rows[j], kept)) is None and j + 1 < len(rows):
            codes = codes or Codes(rows)
            at, step = j + 1, 64
            while made is None and at < len(rows):
                for k in codes.near(a, rows[at : at + step]):
                    if (made := joined(a, rows[j := at + int(k)], kept)) is not None:
                        break
                at, step = at + step, min(2 * step, 8192)
        if made is None:
            alone[i], i = True, i + 1
            known = max(known, i)
            continue
        for k in (j, i):
            del rows[k], alone[k]
            known -= k < known
        at = bisect_left(rows, made)
        if at < len(rows) and rows[at] == made:
            continue
        old = made == a  # a shape that takes another one in meets nothing new
        if codes:
            codes.add(made)
        if known and not old:
            codes = codes or Codes([*rows, made])
            for k in codes.near(made, rows[: min(at, known)]):
                alone[k], i = False, min(i, int(k))
        rows.insert(at, made)
        alone.insert(at, False)
        known += at < known
        i = min(i, at)
    return rows


def generalise(shapes: list[tuple], kept: list[tuple] = (), most: int | None = MAX_SHAPES) -> list[tuple]:
    """Merge shapes of one length that differ in one place (or in places that are wild already), until none merge.

    A merged shape that a kept one would match is not made. The first `most` shapes take part, all of them without it.
    """
    by_length: dict[int, list[tuple]] = {}
    for s in sorted(set(shapes))[:most]:
        by_length.setdefault(len(s), []).append(s)
    return sorted(chain.from_iterable(merged(rows, kept) for rows in by_length.values()))


def text_of(shape: tuple) -> str:
    """The canonical text of a shape, as `templates.canonical` makes it."""
    return " ".join(T.WILDCARD if c == "*" else "{" + c + "}" if c else w for c, w in shape)


def shape_of(canonical: str, classes: int) -> tuple:
    """The shape of a canonical text; `classes` has a bit for each place that a class stands in."""
    return tuple((w[1:-1], "") if classes >> k & 1 else ("", w) for k, w in enumerate(canonical.split(" ")))


def places(varying: int, classes: int, n: int) -> list[int]:
    """Sets of places, as bits, so that shapes of n tokens that may end in one merged shape agree on one of the sets.

    Shapes of one merged shape differ in its wild places only, at most half of the places, less `classes` (places in which all of them
    hold one class), and the places that vary at all are given. All sets that leave out as many places are taken; where
    these are too many, one more set than wild places, none of which has a place of another one. No set: nothing can be merged.
    """
    at = [k for k in range(n) if varying >> k & 1]
    fixed = (classes & ~varying & (1 << 64) - 1).bit_count()
    wild = min(n // 2, n - 2) - fixed
    if wild <= 0 or not at:
        return []
    bits = lambda some: sum(1 << k for k in some)
    if len(at) <= wild:
        return [0]
    if comb(len(at), wild) <= MOST_SETS:
        return [bits(at) - bits(left) for left in combinations(at, wild)]
    return [bits(at[k :: wild + 1]) for k in range(wild + 1)]


def generalised(lines: DataFrame, most: int | None = MAX_SHAPES) -> DataFrame:
    """Generalised shapes of marked lines by scope: program, subcommand, canonical, left_out.

    The `most` most frequent shapes of a scope take part, and `left_out` counts those of the scope that do not; without `most` all
    shapes do. Shapes that cannot meet in a merged shape, whatever is merged before, are merged apart from each other: so a task
    holds one such set of shapes at a time, and the result is that of `generalise` on all shapes of the scope.
    """
    once = F.explode_outer(F.array(T.segments(F.col("line")))).alias("_segs")  # a plain column would be made for each use and for the filter
    made = lines.select("program", "subcommand", "line", once).filter("_segs is not null")
    classes = F.expr("aggregate(transform(_segs, (s, i) -> if(s.cls <> '', shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    shapes = made.select("program", "subcommand", T.canonical(F.col("_segs")).alias("c"), "line", classes.alias("classes"))
    counted = shapes.groupBy("program", "subcommand", "c").agg(F.count("*").alias("n"), F.min(F.struct("line", "classes")).getField("classes").alias("classes"))
    counted = materialize(counted.withColumn("id", F.monotonically_increasing_id()), "lesson-shapes")  # templates are made once
    if most is None:
        return _all_merged(counted).withColumn("left_out", F.lit(0).cast("bigint"))
    order = Window.partitionBy("program", "subcommand").orderBy(F.desc("n"), "c")
    sizes = counted.groupBy("program", "subcommand").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))
    leading = counted.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most)
    made = _all_merged(materialize(leading, "lesson-leading"))
    alike = lambda c: made[c].eqNullSafe(sizes[c])
    return made.join(sizes, alike("program") & alike("subcommand")).select(made["program"], made["subcommand"], "canonical", "left_out")


def _all_merged(shapes: DataFrame) -> DataFrame:
    """What `generalise` makes of all shapes (program, subcommand, c, classes, id) of each scope: program, subcommand, canonical."""
    scope = ["program", "subcommand", "n"]
    rows = shapes.select("program", "subcommand", "c", "classes", "id", F.split("c", " ").alias("_t")).withColumn("n", F.size("_t"))
    least = materialize(rows.groupBy(*scope).agg(F.min("id").alias("id"), F.bit_and("classes").alias("_all")), "lesson-sizes")
    one = rows.join(least.select("id", "_all"), "id").select(*[F.col(c).alias(f"_{c}") for c in scope], "_all", F.col("_t").alias("_o"), F.col("classes").alias("_classes"))
    in_scope = lambda other: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(other[f"_{c}"]) for c in scope))
    unlike = F.expr("aggregate(transform(_t, (t, i) -> if(t <> _o[i], shiftleft(1L, i), 0L)), classes ^ _classes, (a, b) -> a | b)")
    one = materialize(one, "lesson-first")
    varying = rows.join(one, in_scope(one)).groupBy("_program", "_subcommand", "_n", "_all").agg(F.bit_or(unlike).alias("_varying"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [places(v, a, n) for v, a, n in zip(*(b.column(k).to_pylist() for k in (4, 3, 2)), strict=True)]
            found = [[x - (1 << 64) if x >> 63 else x for x in some] for some in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.list_(pa.int64()))], ["_program", "_subcommand", "_n", "_sets"])

    named = materialize(varying.mapInArrow(sets, "_program string, _subcommand string, _n int, _sets array<long>"), "lesson-places")
    key = F.expr("explode(transform(_sets, m -> xxhash64(program, subcommand, n, m, classes & m, filter(_t, (t, i) -> getbit(m, i) = 1))))")
    dealt = rows.join(named, in_scope(named)).select("id", key.alias("key"))  # equal hashes of other tokens join more than they must
    first = dealt.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("_b")).filter("a < _b").drop("_b")
    edges = dealt.join(first, "key").filter("a < id").select("a", F.col("id").alias("b")).distinct()
    roots = components(edges)
    members = shapes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
    members = materialize(members.select("program", "subcommand", "c", "classes", "root"), "lesson-members")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        made = (
            (program, subcommand, text_of(s))
            for (_, program, subcommand), some in groupby(read, key=lambda r: r[:3])
            for s in generalise([shape_of(c, classes) for *_, c, classes in some], most=None)
        )
        while some := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], ["program", "subcommand", "canonical"])

    together = members.filter("root is not null").select("root", "program", "subcommand", "c", "classes").repartition("root").sortWithinPartitions("root", "program", "subcommand")
    apart = members.filter("root is null").select("program", "subcommand", F.col("c").alias("canonical"))
    return apart.unionByName(together.mapInArrow(run, "program string, subcommand string, canonical string"))
