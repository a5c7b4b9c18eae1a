"""Line operators: repeats, head and tail, slices, searches and search results by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import is_blank

MAX_PER_FILE, MAX_FILES = 20, 200
GREP = r"^((?:[A-Za-z]:)?[^:\n]+):([0-9]+):(?:([0-9]+):)?(.*)$"


def collapse_repeats(lines: DataFrame) -> DataFrame:
    """Runs of equal neighbours as one row: first line number, text, how many, and `line (xN)` where N is over 1."""
    w = Window.partitionBy("doc_id").orderBy("ln")
    new = F.when(F.col("line").eqNullSafe(F.lag("line").over(w)) & F.lag("ln").over(w).isNotNull(), 0).otherwise(1)
    runs = lines.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    out = runs.groupBy("doc_id", "_run").agg(F.min("ln").alias("ln"), F.min("line").alias("line"), F.count("*").alias("n"))
    text = F.when(F.col("n") > 1, F.concat(F.col("line"), F.lit(" (x"), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("line"))
    return out.select("doc_id", "ln", "n", text.alias("shown"))


def head_tail(lines: DataFrame, limit: int = 200, head: int = 60, tail: int = 40) -> DataFrame:
    """The first and last lines of documents longer than `limit`, all lines of others, with the number left out."""
    total = F.max("ln").over(Window.partitionBy("doc_id"))
    rows = lines.withColumn("_total", total)
    keep = (F.col("_total") <= limit) | (F.col("ln") <= head) | (F.col("ln") > F.col("_total") - tail)
    omitted = F.when(F.col("_total") > limit, F.col("_total") - head - tail).otherwise(0)
    return rows.filter(keep).withColumn("omitted", omitted.cast("bigint")).drop("_total")


def line_slice(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Lines start to end, both included, as `n: text`."""
    numbered = F.concat(F.col("ln").cast("string"), F.lit(": "), F.col("line"))
    return lines.filter(F.col("ln").between(start, end)).select("doc_id", "ln", numbered.alias("shown"))


def search(lines: DataFrame, needle: str, limit: int = 20) -> DataFrame:
    """Lines that hold a literal, whatever the case; the first `limit` of a document (a report's feature)."""
    hits = lines.filter(F.lower("line").contains(needle.lower()))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("ln"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("doc_id", "ln", "line")


def grep_rows(lines: DataFrame) -> DataFrame:
    """`path:line:text` and `path:line:column:text` rows (col: null without one); others are dropped."""
    part = lambda k: F.regexp_extract("line", GREP, k)
    rows = lines.filter(F.col("line").rlike(GREP))
    return rows.select(*[c for c in lines.columns if c != "line"], part(1).alias("path"), part(2).cast("bigint").alias("at"), part(3).try_cast("bigint").alias("col"), part(4).alias("text"))


def grep_by_file(rows: DataFrame, order: str = "ln", per_file: int = MAX_PER_FILE, files: int = MAX_FILES) -> DataFrame:
    """Matches of each file, files in the order of appearance: path, total, shown, dropped."""
    by = rows.groupBy("path").agg(F.count("*").alias("total"), F.min(order).alias("first"))
    kept = by.orderBy("first", "path").limit(files)  # every task keeps that many at most
    return kept.select("path", "total", F.least("total", F.lit(per_file)).alias("shown"), F.greatest(F.col("total") - per_file, F.lit(0)).alias("dropped"))


def render_grep(lines: DataFrame, per_file: int = MAX_PER_FILE, files: int = MAX_FILES) -> DataFrame:
    """Search results of each document by file: doc_id, output. Others than search results give none.

    A document is a search result if three quarters of its first 40 filled lines, five at least, name a file and a line;
    it needs three matches, and two for each file on average.
    """
    filled = lines.filter(~is_blank(F.col("line")))
    hit = F.col("line").rlike(GREP)
    top = filled.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ln"))).filter("_n <= 40")
    told = top.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(hit).alias("hits")).filter("n >= 5 and 4 * hits >= 3 * n").select("doc_id")
    rows = grep_rows(filled.select("doc_id", "ln", "line")).join(told, "doc_id", "left_semi")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("ln")))
    line = F.concat(F.col("at").cast("string"), F.lit(": "), F.trim("text"))
    by = rows.groupBy("doc_id", "path").agg(
        F.count("*").alias("total"), F.min("ln").alias("first"), F.array_sort(F.collect_list(F.when(F.col("_r") <= per_file, F.struct("_r", line.alias("line"))))).alias("shown")
    )
    order = Window.partitionBy("doc_id").orderBy("first", "path")
    by = by.withColumn("_f", F.row_number().over(order)).withColumn("more", F.greatest(F.col("total") - per_file, F.lit(0)))
    text = F.concat("path", F.lit("\n"), F.array_join(F.transform("shown", lambda x: F.concat(F.lit("  "), x.line)), "\n"))
    text = F.concat(text, F.when(F.col("more") > 0, F.concat(F.lit("\n  (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise(""))
    docs = by.groupBy("doc_id").agg(
        F.sum("total").alias("total"), F.count("*").alias("files"), F.array_sort(F.collect_list(F.when(F.col("_f") <= files, F.struct("_f", text.alias("text"))))).alias("parts")
    ).filter("total >= 3 and total >= 2 * files")
    head = F.concat(F.lit("@shell grep matches="), F.col("total").cast("string"), F.lit(" files="), F.col("files").cast("string"), F.lit("\n"))
    return docs.select("doc_id", F.concat(head, F.array_join(F.transform("parts", lambda p: p.text), "\n"), F.lit("\n")).alias("output"))
