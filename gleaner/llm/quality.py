"""Operator 9: document quality rules, compiled from a table of thresholds into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_names, let, table, words_of

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from has he in is it of on only or that the this to was were which will with "
    "aber als am auch auf aus bei das dem den der des die ein eine einen er es für im in ist mit nicht sich sie "
    "sind und von war wie zu zum "
    "au aux avec ce dans de des du elle en est et il la le les mais ne on ou par pas pour que qui se sur un une "
    "al como con de del el en entre es esta la las lo los más no para pero por que se sin su sus un una y"
).split()  # compared without case and without the marks around a word
#: Fixed value: marks that may stand around a word.
MARKS = ".,;:!?\"'()[]{}…«»“”„‘’¿¡"
#: Words from which on a text without stop words is telling; shorter ones are not held against that rule.
TELLING_WORDS = 100


@dataclass(frozen=True)
class Rule:
    """A document fails when `low <= feature <= high` does not hold. A null bound is open."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None


#: Thresholds. Ratios are taken over the words, characters or lines of the whole text.
RULES = (
    Rule("too_short", "n_words", low=10),
    Rule("mean_word_low", "mean_word_chars", low=1.5),
    Rule("mean_word_high", "mean_word_chars", high=20.0),
    Rule("symbols", "symbol_word_ratio", high=0.30),
    Rule("shouting", "exclaim_word_ratio", high=0.30),
    Rule("repeated_windows", "repeat_word_ratio", high=0.20),
    Rule("duplicate_lines", "dup_line_ratio", high=0.50),
    Rule("few_stop_words", "stop_word_ratio", low=0.01),
)


def count_of(text: Column, keep: str) -> Column:
    """How many characters of the class `keep` (the inside of brackets) a text has."""
    return F.length(F.regexp_replace(text, f"[^{keep}]+", "")).cast("long")


def repeat_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of `width` words that the text holds twice or more, the first time included.

    Windows are compared by a 64-bit hash of their words; sorted with their places, equal ones stand together.
    """
    hashes = lambda ws: F.when(
        F.size(ws) >= width,
        F.transform(F.sequence(F.lit(0), F.size(ws) - width), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(width)])),
    ).otherwise(F.array().cast("array<bigint>"))
    placed = lambda hs: F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = lambda s: F.filter(
        s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h)  # beyond the ends: null, so not kept
    )
    places = lambda r: F.sort_array(F.transform(r, lambda x: x.i))
    covered = lambda at: F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct(
            (acc.n + (i + width - F.greatest(acc.end, i)).cast("long")).alias("n"), (i + width).alias("end")
        ),
        lambda acc: acc.n,
    )
    return let(
        hashes(words),
        lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
            let(placed(hs), lambda s: let(places(repeated(s)), covered))
        ),
    )


def features(text: Column) -> Column:
    """All counts of a text as one struct."""
    is_word_line = lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0
    of_lines = lambda lines: F.struct(
        F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines")
    )
    of_words = lambda ws: F.struct(
        F.size(ws).cast("long").alias("n_words"),
        repeat_words(ws).alias("n_repeat_words"),
        F.size(F.filter(ws, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(ws, lambda w: w.endswith("!!"))).cast("long").alias("n_exclaim_words"),
    )
    return let(
        F.coalesce(text, F.lit("")),
        lambda t: F.struct(
            F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long").alias("word_chars"),
            count_of(t, "#*$%&|<>").alias("n_symbols"),
            let(F.filter(F.split(t, "\n"), is_word_line), of_lines).alias("lines"),
            let(words_of(t), of_words).alias("words"),
        ),
    )


def assess(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Add the counts, `failed_rules` and `kept` to every row; one projection without user functions, no shuffle.

    A null text counts as empty: all its counts are 0 and it fails the length rule. Repeated rows get equal results,
    an empty table stays empty. Added columns replace input columns of the same name.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed_rules", "kept")
    # One expression for all: a filter on `kept` that the optimizer moves below must not repeat the counting.
    q = free_names(docs, "_q")[0]
    out = docs.withColumn(q, let(features(F.col(text_col).cast("string")), lambda q: let(values_of(q), lambda v: verdict(q, v, rules))))
    return out.withColumns({name: F.col(f"{q}.{name}") for name in names}).drop(q)


def values_of(q: Column) -> Column:
    """The features that rules speak of, as one struct."""
    part = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    n = q["words"]["n_words"]
    return F.struct(
        n.cast("double").alias("n_words"),
        part(q["word_chars"], n).alias("mean_word_chars"),
        part(q["n_symbols"], n).alias("symbol_word_ratio"),
        part(q["words"]["n_exclaim_words"], n).alias("exclaim_word_ratio"),
        part(q["words"]["n_repeat_words"], n).alias("repeat_word_ratio"),
        part(q["lines"]["n_dup_lines"], q["lines"]["n_lines"]).alias("dup_line_ratio"),
        F.when(n >= TELLING_WORDS, part(q["words"]["n_stop_words"], n)).otherwise(F.lit(1.0)).alias("stop_word_ratio"),
    )


def verdict(q: Column, v: Column, rules: tuple[Rule, ...]) -> Column:
    def broken(r: Rule) -> Column:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (v[r.feature] < r.low)
        if r.high is not None:
            bad = bad | (v[r.feature] > r.high)
        return F.when(bad, F.lit(r.name))

    failed = F.array_compact(F.array(*[broken(r) for r in rules]))
    return let(
        failed,
        lambda f: F.struct(
            q["words"]["n_words"].alias("n_words"),
            q["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            q["lines"]["n_dup_lines"].alias("n_dup_lines"),
            q["words"]["n_repeat_words"].alias("n_repeat_words"),
            f.alias("failed_rules"),
            (F.size(f) == 0).alias("kept"),
        ),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict on every document."""
    out = assess(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & F.col("kept")).alias("kept"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
