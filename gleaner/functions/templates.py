"""Token classes, line templates and their matching, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import let

MAX_TOKENS = 64
WILDCARD = "{*}"
#: The classes of a token in the order in which they are tried. Units of sizes are part of the format.
CLASS_PATTERNS = (
    ("url", r"^(https?://|file://|git\+|ssh://)"),
    ("uuid", r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
    ("t", r"^[0-9.]*:[0-9:.]*$"),
    ("size", r"(?i)^[0-9.,]*[0-9][0-9.,]*(b|kb|mb|gb|tb|kib|mib|gib|tib|ns|us|µs|ms|s|m|h|x)$"),
    ("ver", r"^(.+@)?v?[0-9]+(\.[0-9]+){2,}([-+][^@]*)?$"),
    ("hex", r"^(0x)?[0-9A-Fa-f]{7,}$"),
    ("n", r"^[-+]?[0-9.,_]*[0-9][0-9.,_]*%?$"),
)
DATE_PREFIX = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: What a token of any class holds: a digit, or a mark of an address, a path or a uuid.
MARKED = r"[0-9/\\.:+-]"
SHORT_NUMBER = r"^[0-9]{1,6}$"
TRAILING = r"[,:;)\]}.\"'!?]+$"


def token_class(token: Column) -> Column:
    """url, uuid, t, size, ver, hex, n or path; null for a literal. Trailing punctuation does not count."""
    return F.when(token.rlike(MARKED), let(F.regexp_replace(token, TRAILING, ""), _class_of))  # most words hold no mark


def _class_of(t: Column) -> Column:
    p = dict(CLASS_PATTERNS)
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    path = (F.octet_length(t) >= 3) & (t.contains("/") | t.contains("\\") | t.contains(".") & t.rlike(r"^.*[A-Za-z0-9].*\.[A-Za-z0-9]{1,6}$"))
    numeric = (  # all of these hold a digit, so most words skip them
        F.when(t.rlike(p["uuid"]), "uuid")
        .when((t.rlike(p["t"]) & (digits >= 3)) | t.rlike(DATE_PREFIX), "t")
        .when(t.rlike(p["size"]), "size")
        .when(t.rlike(p["ver"]), "ver")
        .when(t.rlike(p["hex"]) & F.regexp_replace(t, "^0x", "").rlike("[0-9]"), "hex")
        .when(t.rlike(p["n"]), "n")
    )
    plain_uuid = F.when(t.rlike(p["uuid"]), "uuid")
    return (
        F.when(~t.rlike(MARKED), None)  # a word with a mark behind it; the empty token too
        .when(t.rlike(SHORT_NUMBER), "n")  # what most marked words are, and nothing else can be
        .when(t.rlike(p["url"]), "url")
        .otherwise(F.coalesce(F.when(t.rlike("[0-9]"), numeric).otherwise(plain_uuid), F.when(path, "path")))
    )


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")


def segments(line: Column, sizes: list[int] | None = None) -> Column:
    """The template of a line: array of (cls, lit), null for blank lines and lines of more than 64 tokens.

    A literal keeps its text in `lit`; a class leaves it empty. With `sizes`, lines of other numbers of tokens have none either.
    """
    wanted = lambda n: (n > 0) & (n <= MAX_TOKENS) & (F.lit(True) if sizes is None else n.isin(*sizes))
    one = lambda c, t: F.struct(F.coalesce(c, F.lit("")).alias("cls"), F.when(c.isNull(), t).otherwise("").alias("lit"))
    literal = lambda t: F.struct(F.lit("").alias("cls"), t.alias("lit"))
    seg = lambda t: F.when(t.rlike(MARKED), let(token_class(t), lambda c: one(c, t))).otherwise(literal(t))
    made = lambda ts: F.when(wanted(F.size(ts)), F.transform(ts, seg))
    return let(tokens(line), made)


def canonical(segs: Column) -> Column:
    """The template as text: classes in braces."""
    return F.array_join(F.transform(segs, lambda s: F.when(s.cls == "", s.lit).otherwise(F.concat(F.lit("{"), s.cls, F.lit("}")))), " ")


def join_key(segs: Column) -> Column:
    """Like `canonical`, but a class can never be mistaken for a literal of the same spelling."""
    tagged = F.transform(segs, lambda s: F.when(s.cls == "", F.concat(F.lit("="), s.lit)).otherwise(F.concat(F.lit("\u0001"), s.cls)))
    return F.array_join(tagged, "\u0002")


def literal_tokens(segs: Column) -> Column:
    return F.size(F.filter(segs, lambda s: s.cls == ""))


def literal_chars(segs: Column) -> Column:
    return F.aggregate(segs, F.lit(0), lambda n, s: n + F.char_length(s.lit))


def matches(rule: Column, line: Column) -> Column:
    """Position by position: equal literals, equal classes, or a wildcard in the rule."""
    same = F.zip_with(rule, line, lambda r, s: (r.cls == "*") | ((r.cls == s.cls) & (r.lit == s.lit)))
    return (F.size(rule) == F.size(line)) & F.forall(same, lambda x: x)


def merged(a: Column, b: Column) -> Column:
    """Two templates of one length as one: at most one new wildcard; null if more positions differ."""
    star = F.struct(F.lit("*").alias("cls"), F.lit("").alias("lit"))
    equal = lambda x, y: (x.cls == y.cls) & (x.lit == y.lit)
    new = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~equal(x, y) & (x.cls != "*") & (y.cls != "*")), lambda d: d))
    joined = F.zip_with(a, b, lambda x, y: F.when(equal(x, y), x).otherwise(star))
    return F.when((F.size(a) == F.size(b)) & (new <= 1), joined)
