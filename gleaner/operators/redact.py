"""Redaction of secrets and personal data, as one expression over a text: places of all rules, choice, numbers, pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.text import let

#: Kind, pattern, group of the secret. Digits are written as [0-9], so that only those of ASCII count.
SECRET_RULES = (
    ("auth_header", r"(?i)(authorization\s*[:=]\s*(?:bearer|basic|token)\s+)([A-Za-z0-9._~+/=-]{8,})", 2),
    ("aws_access_key", r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b", 1),
    ("github_token", r"\b(gh[pousr]_[A-Za-z0-9]{20,255})\b", 1),
    ("slack_token", r"\b(xox[abposr]-[A-Za-z0-9-]{10,})\b", 1),
    ("openai_key", r"\b(sk-[A-Za-z0-9_-]{16,})\b", 1),
    ("google_key", r"\b(AIza[0-9A-Za-z_-]{35})\b", 1),
    ("private_key", r"(?s)(-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)", 1),
    ("jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})\b", 1),
    ("assigned_secret", r"(?i)\b((?:api[_-]?key|secret|passwd|password|token|access[_-]?key)\w*)\s*[:=]\s*[\"']?([^\s\"'\n,;]{8,})", 2),
    ("connection_string", r"(?i)\b([a-z][a-z0-9+.-]*://[^\s:/@]+:)([^\s@]{3,})(@)", 2),
)
PII_RULES = (
    ("email", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24})\b", 1),
    ("ipv4", r"\b((?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])){3})\b", 1),
)
#: What a text must hold for a rule to match at all; a look for it costs far less than the rule. Other rules have no such part.
NEEDS = {
    "aws_access_key": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "slack_token": ("xox",), "openai_key": ("sk-",), "google_key": ("AIza",),
    "private_key": ("PRIVATE KEY-----",), "jwt": ("eyJ",), "connection_string": ("://",), "email": ("@",), "auth_header": (":", "="), "assigned_secret": (":", "="),
}
#: The same as a pattern that is found faster than the rule's.
LOOKS = {"ipv4": "[0-9][.][0-9]"}
#: Bytes of a match behind its secret; a match of any other rule ends with the secret.
BEHIND = {"connection_string": 1}
#: Words of values that are known placeholders, and characters of code.
PLACEHOLDERS = ("example", "changeme", "redacted", "xxxx")
CODE = r"[(){}\[\]<>$`]"

#: Places sort by their start, then the longest first, then the rule; `back` is the end with its sign turned.
PLACE = "struct<start:int,back:int,rule:int,kind:string,value:string>"
HITS = "array<struct<kind:string,placeholder:string,start:int,end:int>>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _harmless(kind: str, value: Column) -> Column:
    core = F.lower(F.regexp_replace(value, r"(?U)^[\W_]+|[\W_]+$", ""))
    out = value.contains("<secret:") | (core == "")
    for word in PLACEHOLDERS:
        out = out | core.contains(word)
    return out | value.rlike(CODE) if kind == "assigned_secret" else out


def _may(text: Column, kind: str, pattern: str) -> Column:
    """Whether a rule matches somewhere."""
    may = F.lit(kind not in NEEDS)
    for part in NEEDS.get(kind, ()):
        may = may | text.contains(part)
    if kind in LOOKS:
        may = may & text.rlike(LOOKS[kind])
    return may & text.rlike("(?U)" + pattern)


def _places(text: Column, number: int, kind: str, pattern: str, group: int) -> Column:
    """The places of one rule, in bytes: matches and the pieces between them alternate, so running lengths give the ends."""
    p = F.lit("(?U)" + pattern)
    matched = lambda g: F.regexp_extract_all(text, p, F.lit(g))
    both = F.struct(F.split(text, p, -1).alias("between"), matched(0).alias("whole"), matched(group).alias("value"))

    def placed(m: Column) -> Column:
        steps = F.slice(F.zip_with(m["between"], m["whole"], lambda a, b: F.octet_length(a) + F.octet_length(b)), 1, F.size(m["whole"]))
        ends = F.aggregate(steps, _none("int"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
        one = lambda v, i, e: F.struct(
            (F.get(e, i) - BEHIND.get(kind, 0) - F.octet_length(v)).alias("start"), (BEHIND.get(kind, 0) - F.get(e, i)).alias("back"), F.lit(number).alias("rule"), F.lit(kind).alias("kind"), v.alias("value"),
        )
        return let(ends, lambda e: F.transform(m["value"], lambda v, i: one(v, i, e)))

    found = let(both, placed)
    return F.when(_may(text, kind, pattern), F.filter(found, lambda s: ~_harmless(kind, s["value"]))).otherwise(_none(PLACE))


def places(text: Column, pii: bool = False) -> Column:
    """What is secret in a text, in its order and without overlaps: of places that begin first, the longest."""
    rules = SECRET_RULES + (PII_RULES if pii else ())
    every = F.concat(*[_places(text, n, *rule) for n, rule in enumerate(rules)])
    first = F.struct(F.lit(0).alias("until"), _none(PLACE).alias("kept"))
    free = lambda acc, s: s["start"] >= acc["until"]
    take = lambda acc, s: F.struct((-s["back"]).alias("until"), F.concat(acc["kept"], F.array(s)).alias("kept"))
    return F.when(
        F.size(every) > 0, F.aggregate(F.sort_array(every), first, lambda acc, s: F.when(free(acc, s), take(acc, s)).otherwise(acc), lambda acc: acc["kept"])
    ).otherwise(_none(PLACE))


def _names(kept: Column) -> Column:
    """Placeholder by value: the values of a kind are numbered by where they come first, over all kinds of a value."""
    values = F.transform(kept, lambda s: s["value"])
    firsts = F.filter(kept, lambda s, i: F.array_position(values, s["value"]) == i + 1)

    def numbered(fs: Column) -> Column:
        entry = lambda kind: lambda f, i: F.struct(f["value"].alias("key"), F.concat(F.lit(f"<secret:{kind}_"), (i + 1).cast("string"), F.lit(">")).alias("value"))
        of = lambda kind: F.transform(F.filter(fs, lambda f: f["kind"] == kind), entry(kind))
        return F.map_from_entries(F.concat(*[of(kind) for kind, *_ in SECRET_RULES + PII_RULES]))

    return let(firsts, numbered)


def _replaced(text: Column, kept: Column) -> Column:
    """The struct of the redacted text, the hits with byte offsets, and what each placeholder stands for."""
    data = text.cast("binary")
    cut = lambda start, stop: F.substring(data, start + 1, stop - start).cast("string")
    end_before = lambda i: F.when(i == 0, 0).otherwise(-F.get(kept, i - 1)["back"])

    def made(names: Column) -> Column:
        of = lambda s: F.element_at(names, s["value"])
        pieces = F.transform(kept, lambda s, i: F.concat(cut(end_before(i), s["start"]), of(s)))
        rest = cut(-F.element_at(kept, -1)["back"], F.octet_length(text))
        hits = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), of(s).alias("placeholder"), s["start"].alias("start"), (-s["back"]).alias("end")))
        mapping = F.map_from_entries(F.transform(F.map_entries(names), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))
        return F.struct(F.concat(F.array_join(pieces, ""), rest).alias("text"), hits.cast(HITS).alias("hits"), mapping.alias("mapping"))

    return let(_names(kept), made)


def redaction(text: Column, pii: bool = False) -> Column:
    """A text's redaction: text, hits and mapping. A null text stays null; one without secrets stays as it is.

    A text costs a scan for each rule; what is done with hits takes time by the square of their number in a text. The scans of
    texts without any match are compiled; places are looked for by lambdas, which Spark interprets.
    """
    some = F.lit(False)
    for kind, pattern, _ in SECRET_RULES + (PII_RULES if pii else ()):
        some = some | _may(text, kind, pattern)
    plain = lambda t: F.struct(t.alias("text"), F.array().cast(HITS).alias("hits"), F.create_map().cast("map<string,string>").alias("mapping"))
    made = let(text, lambda t: let(places(t, pii), lambda kept: F.when(F.size(kept) > 0, _replaced(t, kept)).otherwise(plain(t))))
    return F.when(some, made).otherwise(plain(text))


def redacted(docs: DataFrame, pii: bool = False, text_col: str = "text") -> DataFrame:
    """Add `redaction`: the redacted text, the hits and the mapping. Null texts stay null. Keep the mapping apart."""
    return docs.withColumn("redaction", redaction(F.col(text_col), pii))


def restored(text: Column, mapping: Column) -> Column:
    """The original text of a redacted one."""
    return F.aggregate(F.map_entries(mapping), text, lambda t, e: F.replace(t, e.key, e.value))


def has_secret(text: Column) -> Column:
    """Whether a text holds a secret, known placeholders and code aside."""
    return F.coalesce(let(text, lambda t: F.size(places(t)) > 0), F.lit(False))
