"""The reduction of whole corpora: detect, redact, propose shorter forms, verify them, choose the smallest."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash, critical_region, json_minify
from gleaner.operators import detect, filtering, firewall, history, ir, json_summary, logs, redact, reports, shell
from gleaner.sources.scratch import materialize
from gleaner.sources.tables import exploded_lines


@dataclass(frozen=True)
class Source:
    """What a compiler works on: the documents it applies to (doc_id, text, content_type), and their lines (doc_id, ln, line)."""

    docs: DataFrame
    lines: DataFrame


@dataclass(frozen=True)
class Compiler:
    """A reducer: where it may try, what it makes (doc_id, output), whether it loses text, how its output is checked.

    It may also return a column `error`: a document with one keeps its text, and the others do not suffer; and a column
    `lossy`, where that depends on the document.
    """

    name: str
    applies: Callable[[], Column]
    compile: Callable[[Source], DataFrame]
    lossy: bool = False
    reparse: str = "none"
    min_gain: float | None = None


def _has(*needles: str) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.col("text").contains(n)
    return out


def _many_lines() -> Column:
    """Whether a text has line ends for as many lines as clustering needs."""
    return F.substring_index("text", "\n", logs.MIN_LINES - 1) != F.col("text")


def _tests(totals: Callable, failures: Callable, framework: str) -> Callable[[Source], DataFrame]:
    def run(source: Source) -> DataFrame:
        return reports.render_tests(totals(source.lines), failures(source.lines), framework)

    return run


def _minified(source: Source) -> DataFrame:
    return source.docs.select("doc_id", json_minify(F.col("text")).alias("output"))


def _summary(source: Source) -> DataFrame:
    s = json_summary.summarized(source.docs.select("doc_id", "text")).filter("summary.path is not null")
    body = F.concat(
        F.lit("@json summary array="), ir.quoted(F.col("summary.path")), F.lit("\nelements: "), F.col("summary.elements").cast("string"), F.lit("\n@section schema\n"),
        F.array_join(F.transform("summary.schema", lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), ""), F.lit("@section sample\n"),
        F.array_join(F.transform("summary.samples", lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), ""),
    )
    return s.select("doc_id", body.alias("output"))


def _collapsed(source: Source) -> DataFrame:
    rows = shell.collapse_repeats(source.lines)
    rows = shell.head_tail(rows.withColumn("_at", F.col("ln")).withColumn("ln", F.row_number().over(Window.partitionBy("doc_id").orderBy("_at"))).withColumnRenamed("shown", "line"))
    note = F.concat(F.col("line"), F.lit("\n["), F.col("omitted").cast("string"), F.lit(" line(s) left out]"))
    rows = rows.withColumn("shown", F.when((F.col("omitted") > 0) & (F.col("ln") == 60), note).otherwise(F.col("line")))
    out = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ln", "shown"))).alias("s"), F.max(F.col("omitted") > 0).alias("lossy"))
    return out.select("doc_id", F.array_join(F.transform("s", lambda x: x.shown), "\n").alias("output"), "lossy")


def learned(rules: DataFrame, protect_errors: bool = True) -> Compiler:
    """The filter of learned rules of all kinds as a compiler: put it behind the others to offer it too."""
    return Compiler("learn.filter", lambda: F.col("text").isNotNull(), lambda s: filtering.filter_texts(s.docs, rules, False, protect_errors), min_gain=0.0)


IR = "token_ir"
#: Specific ones first; of accepted outputs the one with the fewest bytes wins, and of equals the first.
COMPILERS = (
    Compiler("test.pytest", lambda: _has("test session starts", "short test summary info"), _tests(reports.pytest_totals, reports.pytest_failures, "pytest"), reparse=IR),
    Compiler("test.cargo", lambda: _has("test result:"), _tests(reports.cargo_totals, reports.cargo_failures, "cargo"), reparse=IR),
    Compiler("build.cargo", lambda: F.col("text").rlike(r"(?m)^error(\[E[0-9]{4}\])?: ") & ~_has("test result:"), lambda s: reports.render_build(reports.build_errors(s.lines)), reparse=IR),
    Compiler("test.jest", lambda: _has("Tests:", "Test Files", "Test Suites:"), _tests(reports.jest_totals, reports.jest_failures, "jest"), reparse=IR),
    Compiler("test.go", lambda: _has("--- FAIL:", "--- PASS:", "=== RUN"), _tests(reports.go_totals, reports.go_failures, "go"), reparse=IR),
    Compiler("git.status", lambda: F.col("text").startswith("On branch "), lambda s: reports.render_status(s.lines), reparse=IR),
    Compiler("git.diff", lambda: _has("diff --git "), lambda s: reports.render_diff(reports.git_diff(s.lines)), reparse=IR),
    Compiler("git.log", lambda: F.col("text").rlike("(?m)^commit [0-9a-f]{7,40}"), lambda s: reports.render_log(reports.git_log(s.lines)), reparse=IR),
    Compiler("json.structural", lambda: F.col("content_type") == "json", _minified, reparse="json_equal"),
    Compiler("json.summary", lambda: F.col("content_type") == "json", _summary, lossy=True, reparse=IR),
    Compiler("log.cluster", lambda: F.col("content_type").isin("application_log", "plain_text", "unknown") & _many_lines(), lambda s: logs.render(logs.clusters(s.lines)), lossy=True, reparse=IR),
    Compiler("shell.grep", lambda: F.col("text").rlike(r"(?m)^[^:\n]+:[0-9]+:"), lambda s: shell.render_grep(s.lines)),
    Compiler("shell.generic", lambda: F.expr("of_command and instr(text, '\n') between 1 and char_length(text) - 1"), _collapsed),
)


def prepared(docs: DataFrame, compilers: tuple[Compiler, ...] = COMPILERS) -> DataFrame:
    """Documents with their facts and `_wants`, a bit for each compiler that applies: what all candidates need of a text, made once."""
    wants = sum((F.when(c.applies(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in enumerate(compilers)), F.lit(0).cast("long"))
    return materialize(firewall.facts(docs).withColumn("_wants", wants), "reduce-facts")


def candidates(docs: DataFrame, compilers: tuple[Compiler, ...] = COMPILERS) -> DataFrame:
    """All proposals for documents (doc_id, text, content_type, of_command): each compiler sees only what it applies to.

    Where compilers apply is found in one pass (`prepared`, unless it was called before), and lines are made once, for all of
    them. Outputs come together before they meet the texts and their facts, so these are moved once.
    """
    docs = docs if "_wants" in docs.columns else prepared(docs, compilers)
    rows = materialize(exploded_lines(docs.filter("_wants <> 0"), ("doc_id", "_wants")), "reduce-lines")
    out = None
    for k, c in enumerate(compilers):
        mine = F.col("_wants").bitwiseAND(F.lit(1 << k).cast("long")) != 0
        made = c.compile(Source(docs.filter(mine).drop("_wants"), rows.filter(mine).drop("_wants")))
        error = F.col("error").cast("string") if "error" in made.columns else F.lit(None).cast("string")
        lossy = F.col("lossy") if "lossy" in made.columns else F.lit(c.lossy)
        made = made.select(
            "doc_id", F.lit(k).alias("ord"), F.lit(c.name).alias("transformer"), "output", lossy.alias("lossy"), F.lit(c.reparse).alias("reparse"),
            F.lit(c.min_gain).cast("double").alias("min_gain"), error.alias("error"),
        )
        out = made if out is None else out.unionByName(made)
    texts = docs.select("doc_id", "text", "tokens_before", "must_stay")
    return out.join(texts, "doc_id").filter(F.col("output").isNull() | (F.col("output") != F.col("text")))


def reduce(docs: DataFrame, mode: str = "safe", pii: bool = False, compilers: tuple[Compiler, ...] = COMPILERS) -> DataFrame:
    """doc_id, content_type, hash, transformer, output, tokens_before, tokens_after for every document.

    Texts are redacted first; proposals come from the redacted text and a document without an accepted one keeps it.
    Equal texts are reduced once and joined back, so copies cost a row each. With a column `command`, a document that has
    one is the output of a command, where repeated lines fold and the middle of long outputs may go.
    """
    of_command = F.col("command").isNotNull() if "command" in docs.columns else F.lit(False)
    own = docs.select("doc_id", F.col("text"), of_command.alias("of_command")).withColumn("hash", content_hash(F.col("text")))
    return own.select("doc_id", "hash", "of_command").join(_reduced(own, mode, pii, compilers).drop("clean"), ["hash", "of_command"]).drop("of_command")


def _reduced(own: DataFrame, mode: str, pii: bool, compilers: tuple[Compiler, ...]) -> DataFrame:
    """The reduction of each content (hash, of_command, text, doc_id): its redacted text is `clean`."""
    once = own.groupBy("hash", "of_command").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    clean = redact.redacted(once, pii).select("doc_id", "hash", "of_command", F.col("redaction.text").alias("text"), F.size("redaction.hits").alias("secrets"))
    clean = clean.withColumn("content_type", detect.detect(F.col("text")).getField("content_type"))
    clean = prepared(clean, compilers)  # every compiler reads it
    best = firewall.smallest(firewall.review(candidates(clean, compilers), mode, token_ir=True), counted=True) if compilers and mode != "observe" else None
    names = F.array(*[F.lit(c.name) for c in compilers]).cast("array<string>")
    if best is None:
        out = clean.withColumns({"ord": F.lit(None).cast("int"), "output": F.lit(None).cast("string"), "tokens_after": F.lit(None).cast("bigint")})
    else:
        out = clean.join(best, "doc_id", "left")
    return out.select(
        "hash", "of_command", "content_type", "secrets", F.when(F.col("ord").isNotNull(), F.get(names, F.col("ord"))).alias("transformer"), F.coalesce("output", "text").alias("output"),
        "tokens_before", F.coalesce("tokens_after", "tokens_before").alias("tokens_after"), F.col("text").alias("clean"),
    )


def reduce_runs(
    runs: DataFrame, mode: str = "safe", pii: bool = False, compilers: tuple[Compiler, ...] = COMPILERS, within: int = history.WITHIN_MILLIS, fired: DataFrame | None = None
) -> DataFrame:
    """The reduction of runs of commands (run_id, session_id, command, ts_millis, text): also against their past.

    A run whose last one within the time gave the same redacted text is answered by a pointer to it (`repeat.suppress`); one
    that gave mostly the same lines by the lines that are new (`delta.lines`). Both carry the critical lines, pass the
    firewall like any other candidate, and win where they are shortest; of equals they come first. Texts of past runs are
    met by their hash, and only the texts of deltas are taken apart, each pair of texts once. `fired` (run_id, key) names the learned rules that
    took part in a run: only runs with the same ones are compared.

    A null command has no past; a null text is empty. Returns run_id, hash, content_type, transformer, output,
    tokens_before, tokens_after.
    """
    own = runs.select("run_id", "session_id", "command", "ts_millis", F.coalesce("text", F.lit("")).alias("text")).withColumns({"hash": content_hash(F.col("text")), "of_command": F.col("command").isNotNull()})
    texts = materialize(_reduced(own.withColumn("doc_id", F.col("run_id")), mode, pii, compilers), "reduce-texts")
    clean = texts.select("hash", "clean").dropDuplicates(["hash"]).select(F.col("hash").alias("raw_hash"), content_hash(F.col("clean")).alias("hash"), F.col("clean").alias("text"))
    clean = materialize(clean, "reduce-contents")
    named = own.drop("text", "of_command").withColumnRenamed("hash", "raw_hash").join(clean.drop("text"), "raw_hash")
    named = materialize(named, "reduce-runs")
    out = named.select("run_id", F.col("raw_hash").alias("hash"), F.col("command").isNotNull().alias("of_command")).join(texts.drop("clean", "secrets"), ["hash", "of_command"]).drop("of_command")
    if mode == "observe":
        return out
    past = history.previous_run(named.filter("command is not null"), within)
    if fired is not None:
        key = lambda c: fired.select(F.col("run_id").alias(c), F.col("key").alias(f"_{c}"))
        past = past.join(key("run_id"), "run_id", "left").join(key("previous_id"), "previous_id", "left")
        past = past.filter(F.coalesce("_run_id", F.lit("")) == F.coalesce("_previous_id", F.lit(""))).drop("_run_id", "_previous_id")
    past = materialize(past, "reduce-past")
    # What runs with a past need of their texts is made once for each text, and each pair of texts is compared once.
    known = firewall.facts(clean.join(past.select("raw_hash").distinct(), "raw_hash", "left_semi")).withColumn("critical", critical_region(F.col("text")))
    known = materialize(known.select("raw_hash", "tokens_before", "must_stay", "critical"), "reduce-known")
    repeats = history.repeat_candidates(past.filter("is_repeat").join(known.select("raw_hash", "critical"), "raw_hash"))
    changed = past.filter("not is_repeat")
    contents = clean.dropDuplicates(["hash"]).select("hash", "text")
    pairs = changed.select("hash", "previous_hash").distinct().join(contents, "hash").join(contents.toDF("previous_hash", "old"), "previous_hash")
    pairs = pairs.withColumn("pair", F.concat("hash", "previous_hash"))
    bodies = materialize(history.delta_bodies(materialize(pairs, "reduce-deltas")), "reduce-bodies")
    deltas = history.delta_texts(changed.withColumn("pair", F.concat("hash", "previous_hash")), bodies)
    both = repeats.select("run_id", F.lit("repeat.suppress").alias("transformer"), "output").unionByName(deltas.select("run_id", F.lit("delta.lines").alias("transformer"), "output"))
    full = past.select("run_id", "raw_hash").join(known.drop("critical"), "raw_hash").drop("raw_hash").withColumn("text", F.lit(None).cast("string"))  # only its facts count here
    both = both.join(full, "run_id").withColumns({"lossy": F.lit(False), "reparse": F.lit("none"), "min_gain": F.lit(0.0)})
    won = firewall.review(both, mode).filter("verdict = 'accepted'").select("run_id", F.col("transformer").alias("_name"), F.col("output").alias("_text"), F.col("tokens_after").alias("_tokens"))
    out = out.join(won, "run_id", "left")
    better = F.col("_text").isNotNull() & (F.col("transformer").isNull() | (F.octet_length("_text") <= F.octet_length("output")))
    pick = lambda new, c: F.when(better, F.col(new)).otherwise(F.col(c)).alias(c)
    return out.select("run_id", "hash", "content_type", pick("_name", "transformer"), pick("_text", "output"), "tokens_before", pick("_tokens", "tokens_after"))
