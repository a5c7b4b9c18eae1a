"""The quality firewall: what may replace an original, and what replaces it."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.invariants import mandatory, violations
from gleaner.functions.text import token_estimate
from gleaner.operators import ir

MODES = ("observe", "safe", "balanced", "maximum", "forensic", "debug")
LOSSY_MODES = ("balanced", "maximum")
MIN_GAIN = 0.05


def same_json(a: Column, b: Column) -> Column:
    canonical = lambda x: F.to_json(F.try_parse_json(x))
    return canonical(a).eqNullSafe(canonical(b)) & F.try_parse_json(a).isNotNull()


def too_little(before: Column, after: Column, min_gain: Column | float = MIN_GAIN) -> Column:
    gain = F.lit(min_gain) if isinstance(min_gain, float) else min_gain
    return (before > 0) & (after > F.floor(before * (1 - gain)))


def facts(docs: DataFrame) -> DataFrame:
    """Add what every candidate of a text is held against: tokens_before and must_stay. Once a text, not once a candidate."""
    return docs.withColumns({"tokens_before": token_estimate(F.col("text")), "must_stay": mandatory(F.col("text"))})


def _reparsed(rows: DataFrame) -> DataFrame:
    """Add `_parses`: whether an output of kind token_ir is a document of the intermediate form.

    Only such outputs leave the JVM; for others a document line goes in their place.
    """

    @F.pandas_udf("boolean")
    def _parses(texts: pd.Series) -> pd.Series:
        return texts.map(ir.valid).astype(bool)

    form = F.when(F.col("reparse") == "token_ir", F.col("output")).otherwise(F.lit("@x"))
    return rows.withColumn("_parses", _parses(form))


def review(candidates: DataFrame, mode: str = "safe", min_gain: float = MIN_GAIN, token_ir: bool = False) -> DataFrame:
    """Verdicts on candidates (text, output, lossy, reparse in none / json_valid / json_equal / token_ir).

    Checks in this order: a candidate with an `error` never counts; observing never changes; lossy needs a lossy mode;
    mandatory facts of critical lines must stay; the output must parse as it says; it must be shorter by the least gain,
    for which a candidate may ask for less by a column `min_gain`. Adds tokens_before, tokens_after, verdict and final, which
    is the original unless the verdict is `accepted`. Columns of `facts` are used where they are there. Outputs are parsed
    as token_ir only with `token_ir`, as parsing leaves the JVM; a null output is an error of its own.
    """
    if mode not in MODES or not math.isfinite(min_gain):
        raise ValueError(f"unknown mode {mode!r}")
    rows = candidates if {"tokens_before", "must_stay"} <= set(candidates.columns) else facts(candidates)
    rows = rows.withColumn("tokens_after", token_estimate(F.col("output"))).withColumn("missing", violations(F.col("must_stay"), F.col("output")))
    rows = _reparsed(rows) if token_ir else rows.withColumn("_parses", F.lit(True))
    parses = (
        F.when(F.col("reparse") == "json_valid", F.try_parse_json("output").isNotNull())
        .when(F.col("reparse") == "json_equal", same_json(F.col("text"), F.col("output")))
        .otherwise(F.col("_parses"))
    )
    failed = F.col("output").isNull() | (F.col("error").isNotNull() if "error" in rows.columns else F.lit(False))
    gain = F.least(F.coalesce("min_gain", F.lit(min_gain)), F.lit(min_gain)) if "min_gain" in rows.columns else min_gain
    verdict = (
        F.when(F.lit(mode == "observe"), "skipped")
        .when(failed, "transformer_error")
        .when(F.col("lossy") & F.lit(mode not in LOSSY_MODES), "policy_disabled")
        .when(F.size("missing") > 0, "invariant_lost")
        .when(~parses, "reparse_failed")
        .when(too_little(F.col("tokens_before"), F.col("tokens_after"), gain), "insufficient_gain")
        .otherwise("accepted")
    )
    rows = rows.withColumn("verdict", verdict).drop("must_stay", "_parses")
    return rows.withColumn("final", F.when(F.col("verdict") == "accepted", F.col("output")).otherwise(F.col("text")))


def smallest(reviewed: DataFrame, counted: bool = False) -> DataFrame:
    """The accepted candidate with the fewest bytes, the first on ties (doc_id, ord, output, with `counted` also tokens_after)."""
    accepted = reviewed.filter(F.col("verdict") == "accepted")
    names = ("ord", "output", "tokens_after") if counted else ("ord", "output")
    best = F.min_by(F.struct(*names), F.struct(F.octet_length("output"), "ord"))
    return accepted.groupBy("doc_id").agg(best.alias("b")).select("doc_id", *[f"b.{n}" for n in names])
