"""The intermediate form: `@kind` line, fields, sections with verbatim bodies. Rendering is native, parsing a table function.

    @kind variant key=value ...
    name: value
    @section label key=value ...
      body line
    @raw reference

Values are quoted if empty or if they hold white space, a quote or a backslash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIR = re.compile(r"\s*([A-Za-z_][\w.-]*)=(\"(?:[^\"\\]|\\.)*\"|[^\s\"\\]+)")
ESCAPES = {"n": "\n", '"': '"', "\\": "\\"}


def quoted(value: Column) -> Column:
    text = F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when((value == "") | value.rlike(r"[\s\"\\]"), F.concat(F.lit('"'), text, F.lit('"'))).otherwise(value)


def pairs(entries: Column) -> Column:
    """Ordered (k, v) pairs as ` k=v k=v`."""
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(" "), e.k, F.lit("="), quoted(e.v))), "")


def render(kind: Column, variant: Column, header: Column, fields: Column, sections: Column, raw: Column) -> Column:
    """A whole document as text."""
    body = lambda lines: F.array_join(F.transform(lines, lambda x: F.when(x == "", F.lit("\n")).otherwise(F.concat(F.lit("  "), x, F.lit("\n")))), "")
    section = lambda s: F.concat(F.lit("@section "), quoted(s.label), pairs(s.attrs), F.lit("\n"), body(s.body))
    field = lambda e: F.concat(e.k, F.lit(": "), e.v, F.lit("\n"))
    return F.concat(
        F.lit("@"), kind, F.when(variant.isNotNull(), F.concat(F.lit(" "), variant)).otherwise(""), pairs(header), F.lit("\n"),
        F.array_join(F.transform(fields, field), ""), F.array_join(F.transform(sections, section), ""),
        F.when(raw.isNotNull(), F.concat(F.lit("@raw "), raw, F.lit("\n"))).otherwise(""),
    )


def parse_pairs(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = PAIR.match(text, at)
        if m is None:
            raise ValueError(f"malformed pairs {text!r}")
        value = m[2]
        if value[0] == '"':
            value = re.sub(r"\\(.)", lambda e: ESCAPES[e[1]] if e[1] in ESCAPES else _bad(value), value[1:-1])
        out.append((m[1], value))
        at = m.end()
    return out


def _bad(value: str) -> str:
    raise ValueError(f"unknown escape in {value!r}")


def parse(text: str) -> dict:
    """A document from its text; ValueError if malformed."""
    rows = text.split("\n")
    top = re.fullmatch(r"@([a-z][\w.-]*)(?: ([\w.-]+)(?=$| ))?(.*)", rows[0]) if rows else None
    if top is None or top[1] in ("section", "raw"):
        raise ValueError("no document line")
    doc = {"kind": top[1], "variant": top[2], "header": parse_pairs(top[3]), "fields": [], "sections": [], "raw": None}
    for row in rows[1:-1] if rows[-1] == "" else rows[1:]:
        if doc["raw"] is not None:
            raise ValueError("text behind the raw reference")
        if row.startswith("@section "):
            m = re.match(r'@section ("(?:[^"\\]|\\.)*"|\S+)(.*)', row)
            if m is None:
                raise ValueError(f"malformed section {row!r}")
            doc["sections"].append({"label": parse_pairs(f"x={m[1]}")[0][1], "attrs": parse_pairs(m[2]), "body": []})
        elif row.startswith("@raw "):
            doc["raw"] = row[5:]
        elif row.startswith("@"):
            raise ValueError(f"unknown line {row!r}")
        elif doc["sections"]:
            if row and not row.startswith("  "):
                raise ValueError(f"body line without indent {row!r}")
            doc["sections"][-1]["body"].append(row[2:])
        else:
            name, colon, value = row.partition(": ")
            if not colon:
                raise ValueError(f"malformed field {row!r}")
            doc["fields"].append((name, value))
    return doc


def valid(text: str | None) -> bool:
    try:
        parse(text or "")
    except ValueError:
        return False
    return True


@F.udtf(returnType="kind string, label string, position int, body string")
class ParseSections:
    """Table function: one row per section of a document; no row for a malformed one."""

    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None and valid(text):
            doc = parse(text)
            for k, s in enumerate(doc["sections"]):
                yield doc["kind"], s["label"], k, "\n".join(s["body"])
