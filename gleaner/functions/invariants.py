"""Facts that a shorter text must keep, found by kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import critical_region, is_critical, let

#: The kinds in rank order, with the pattern of each.
PATTERNS = {
    "line_ref": r"(?:[A-Za-z]:)?[\w./\\+@-]+\.[A-Za-z][A-Za-z0-9]{0,9}:[0-9]+(?::[0-9]+)?",
    "path": r"(?:[A-Za-z]:[\\/])?(?:[\w.+@-]+[\\/])+[\w.+@-]+",
    "url": r"[a-zA-Z][a-zA-Z0-9+.-]*://[^\s)\]'\"*,]+",
    "hash": r"\b[0-9a-fA-F]{7,64}\b",
    "version": r"\bv?[0-9]+\.[0-9]+(?:\.[0-9]+)?(?:-[0-9A-Za-z.-]+)?\b",
    "exit_code": r"(?i)\b(?:exit(?:ed)?[ _-]?(?:code|status)?|status)[ =:]+(-?[0-9]+)\b",
    "error_type": r"\b(?:[A-Z][a-zA-Z0-9]*(?:Error|Exception|Panic|Failure|Fault)|E[0-9]{3,4}|TS[0-9]{4}|C[0-9]{4})\b",
    "comparison": r"(?i)\b(?:expected|actual|got|want|left|right)\b\s*[:=]?\s*[^\s,;]{1,64}",
    "negation": r"(?i)\b(?:not|never|no|without|cannot|can't|don't|doesn't|must not|failed to)\b",
    "security": r"(?i)\b(?:vulnerab\w+|CVE-[0-9]{4}-[0-9]+|security|unsafe|injection|exploit|privilege|secret|credential)\b",
    "number": r"\b[0-9]+(?:\.[0-9]+)?\s?(?:ms|s|m|h|kb|mb|gb|tb|%|bytes|files|tests)?\b",
}
RANK = {kind: k for k, kind in enumerate(PATTERNS)}
DEFAULT_KINDS = ("line_ref", "path", "url", "hash", "version", "exit_code", "error_type", "comparison")
CRITICAL_KINDS = ("line_ref", "exit_code", "error_type", "comparison", "hash")
MANDATORY_KINDS = ("line_ref", "url", "exit_code", "error_type", "comparison")


def useful(kind: str, value: Column) -> Column:
    if kind == "hash":
        return value.rlike("[A-Za-z]")
    if kind == "number":
        return F.octet_length(value) <= 24
    return value != ""


def find(text: Column, kind: str, cap: int = 512) -> Column:
    """The values of one kind in text order, repeats included, at most `cap` useful ones."""
    return F.slice(F.filter(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda v: useful(kind, v)), 1, cap)


def extract(text: Column, kinds: tuple[str, ...] = DEFAULT_KINDS, cap: int = 512) -> Column:
    """Sorted distinct array of (rank, kind, value); a path that begins a line reference goes."""
    values = {k: F.array_distinct(find(text, k, cap)) for k in kinds}
    if "path" in values and "line_ref" in values:
        refs = values["line_ref"]
        values["path"] = F.filter(values["path"], lambda p: ~F.exists(refs, lambda r: r.startswith(p)))
    as_structs = lambda k: F.transform(
        values[k], lambda v: F.struct(F.lit(RANK[k]).cast("tinyint").alias("rank"), F.lit(k).alias("kind"), v.alias("value"))
    )
    return F.array_sort(F.array_distinct(F.concat(*[as_structs(k) for k in kinds])))


def mandatory(text: Column, cap: int = 128) -> Column:
    """What the critical lines of a text oblige a shorter form to keep; a text without any is looked at once."""
    none = F.array().cast("array<struct<rank:tinyint,kind:string,value:string>>")
    return F.when(is_critical(text), let(critical_region(text), lambda r: extract(r, MANDATORY_KINDS, cap))).otherwise(none)


def violations(declared: Column, text: Column) -> Column:
    return F.filter(declared, lambda i: (i.value != "") & (F.instr(text, i.value) == 0))
