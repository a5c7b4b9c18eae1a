"""Outlines of source texts: the lines that declare something."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import clip, lines

#: How declarations begin, modifiers that may stand before, and marks of comments.
DECLARATIONS = (
    "fn |struct |enum |trait |impl |mod |macro_rules!|type |const |static |union |def |class |async def |function |interface |namespace |declare |"
    "export |abstract class |func |package |var |public |private |protected |internal |record |sealed |template|typedef |struct|#define |function"
).split("|")
MODIFIERS = "pub pub(crate) pub(super) export default async unsafe extern const static final abstract override virtual inline @staticmethod @classmethod @property".split()
COMMENT = r"^(//|#|/\*|\*|--)"
DECLARES = "^(?:(?:" + "|".join(map(re.escape, MODIFIERS)) + r"):*\s+){0,3}(?:" + "|".join(re.escape(d) for d in DECLARATIONS) + ")"
CALL_BLOCK = r"^[\w:* ]+\(.*\{$"


def declares(line: Column) -> Column:
    t = F.trim(line)
    return (t != "") & ~t.rlike(COMMENT) & (t.rlike(DECLARES) | t.rlike(CALL_BLOCK))


def signature(line: Column, limit: int = 120) -> Column:
    head = F.when(F.instr(line, " {") > 0, F.expr("1")).isNotNull()
    cut = F.when(head, F.substring_index(F.rtrim(line), " {", 1)).otherwise(F.rtrim(line))
    return clip(F.rtrim(F.regexp_replace(cut, "[:;{]+$", "")), limit)


def outline(docs: DataFrame) -> DataFrame:
    """doc_id, ln, signature of every declaration, and whether the outline is worth it: below a third of the lines."""
    rows = docs.select("doc_id", lines(F.col("text")).alias("_l")).withColumn("_n", F.size("_l"))
    rows = rows.withColumn("_found", F.size(F.filter("_l", declares)))
    rows = rows.select("doc_id", (F.col("_found") * 3 < F.col("_n")).alias("useful"), F.posexplode("_l").alias("_p", "line"))
    return rows.filter(declares(F.col("line"))).select("doc_id", (F.col("_p") + 1).alias("ln"), signature(F.col("line")).alias("signature"), "useful")
