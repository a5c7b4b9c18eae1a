"""Content types of texts, by name or by a look at their first lines; one CASE chain, first match wins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank, let, lines

SNIFF, TOP = 65_536, 200
#: Content type by file extension.
EXTENSIONS = {
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "xml": "xml", "html": "xml", "htm": "xml", "svg": "xml", "csv": "csv",
    "tsv": "tabular_data", "md": "markdown", "markdown": "markdown", "log": "application_log", "txt": "plain_text",
}
SOURCE_EXTENSIONS = "rs py ts tsx js jsx go java kt c h cc cpp hpp cs rb php swift scala sh bash ps1".split()
#: What a stack frame, a level and a time stamp look like.
FRAME = r"^\s*(at |File \"|Traceback \(most recent call last\)|Caused by:|stack backtrace:|thread '.*panicked)"
LEVEL_WORD = r"(?i)\b(trace|debug|info|notice|warn|warning|error|err|fatal|critical|panic)\b"
STAMP = r"^\s*[\[(]*([0-9]{4}[-/].{5}|[0-9]{2}:[0-9]{2}:.{2})"


def by_extension(name: Column) -> Column:
    """The content type that a name's extension stands for, or null. A name without a dot is its own extension."""
    ext = F.lower(F.regexp_extract(name, r"([^.]*)$", 1))
    out = F.when(ext.isin(*SOURCE_EXTENSIONS), "source_code")
    for kind in dict.fromkeys(EXTENSIONS.values()):
        out = out.when(ext.isin(*[e for e, k in EXTENSIONS.items() if k == kind]), kind)
    return out


def _count(ls: Column, test) -> Column:  # noqa: ANN001
    return F.size(F.filter(ls, test))


def _delimited(filled: Column, mark: str) -> Column:
    counts = F.transform(filled, lambda x: F.char_length(x) - F.char_length(F.translate(x, mark, "")))
    return (F.size(filled) >= 2) & F.get(filled, F.lit(0)).contains(mark) & (F.array_min(counts) == F.array_max(counts)) & (F.array_min(counts) > 0)


def detect(text: Column, name: Column | None = None) -> Column:
    """Struct of content_type and confidence."""
    head = F.substring(text, 1, SNIFF)
    trimmed = F.regexp_replace(head, r"^(?U)\s+", "")
    first = F.substring(trimmed, 1, 1)
    verdict = lambda kind, sure: F.struct(F.lit(kind).alias("content_type"), F.lit(sure).alias("confidence"))

    # A text that matches nowhere matches in no line, so most texts are looked at once and not line by line.
    anywhere = lambda pattern: head.rlike("(?m)" + pattern)

    def sniff(first_lines: Column) -> Column:
        last_whole = F.when((F.size(first_lines) <= TOP) & (F.element_at(first_lines, -1) == ""), F.size(first_lines) - 1).otherwise(F.least(F.size(first_lines), F.lit(TOP)))
        filled = lambda top: let(F.filter(top, lambda x: ~is_blank(x)), lambda top_filled: by_lines(first_lines, top, top_filled))
        return let(F.slice(first_lines, 1, last_whole), filled)

    def by_lines(first_lines: Column, top: Column, top_filled: Column) -> Column:
        return let(F.slice(F.when((F.size(top_filled) >= 50) | (F.size(first_lines) <= TOP), top_filled).otherwise(F.filter(lines(head), lambda x: ~is_blank(x))), 1, 50), lambda filled: verdicts(top, top_filled, filled))

    def verdicts(top: Column, top_filled: Column, filled: Column) -> Column:
        logged = F.when(head.rlike(LEVEL_WORD) | anywhere(STAMP), _count(top_filled, lambda x: x.rlike(LEVEL_WORD) | x.rlike(STAMP))).otherwise(0)
        mark = lambda n, x: n + F.when(x.rlike("^(#{1,3} |```)"), 2).when(x.rlike(r"^[-*] "), 1).otherwise(0)
        marks = F.when(anywhere("^(#{1,3} |```|[-*] )"), F.aggregate(top, F.lit(0), mark)).otherwise(0)
        table = (F.size(filled) >= 2) & F.get(filled, F.lit(0)).startswith("|") & F.get(filled, F.lit(1)).rlike(r"^[-|: ]*$")
        return (
            F.when(anywhere(FRAME) & (_count(top, lambda x: x.rlike(FRAME)) >= 2), verdict("stack_trace", "high"))
            .when((F.size(top_filled) >= 3) & (logged * 2 >= F.size(top_filled)), verdict("application_log", "medium"))
            .when(_delimited(filled, ","), verdict("csv", "medium"))
            .when(_delimited(filled, "\t"), verdict("tabular_data", "medium"))
            .when(table, verdict("tabular_data", "high"))
            .when(marks >= 3, verdict("markdown", "medium"))
            .otherwise(verdict("plain_text", "low"))
        )

    sniffed = let(F.split(head, "\r?\n", TOP + 1), sniff)  # once a text
    found = (
        F.when(F.coalesce(trimmed, F.lit("")) == "", verdict("plain_text", "high"))
        .when(first.isin("{", "[") & F.try_parse_json(text).isNotNull(), verdict("json", "high"))
        .when(first.isin("{", "["), verdict("unknown", "low"))
        .when(trimmed.startswith("<?xml") | ((first == "<") & trimmed.contains("</")), verdict("xml", "medium"))
        .otherwise(sniffed)
    )
    if name is None:
        return found
    named = by_extension(name)
    return F.when(named.isNotNull(), F.struct(named.alias("content_type"), F.lit("high").alias("confidence"))).otherwise(found)
