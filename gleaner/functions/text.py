"""Column builders over texts and lines. All of them are Catalyst expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One estimated token: up to four letters, up to three digits, or any other character but a space.
TOKEN = r"[A-Za-z_]{1,4}|[0-9]{1,3}|[^A-Za-z_0-9 ]"
#: What of a text is more or less than one character a token: where its first character goes in its place, characters are tokens.
TOKEN_REST = r"([A-Za-z_])[A-Za-z_]{1,3}|([0-9])[0-9]{1,2}| +"

#: Volatile parts of a log line, in the order in which they are masked.
LOG_MASKS = (
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "<ts>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\"[^\"]*\"|'[^']*'", "<str>"),
    (r"\b(?:0x)?[0-9a-fA-F]{8,}\b", "<hex>"),
    (r"[0-9]+", "<n>"),
)
#: Fixed value: words that name a log level.
LEVEL = r"\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL|PANIC)\b"
#: Where a word of ASCII characters ends, as `\b` in SQL; Java's own knows letters like ñ too.
WORD_END = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
#: Fixed value: what makes a line critical. The long s and the sign of the kelvin fold as in SQL.
CRITICAL = (
    r"(?<!\w)(?:(?:error|failed|failure|fail:|panic|panicked|exception|traceback|assert\w*|fatal|cannot|denied|refused|"
    r"timed?[ _-]?out|expected|actual|exit(?:ed)?[ _-]?(?:code|status))" + WORD_END + "|ERR!)"
).replace("s", "[sſ]").replace("k", "[k\u212a]")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once inside an expression; a plain reference inside a lambda would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    """The lines of a text: split at LF or CRLF, without the empty piece behind a final line end."""
    pieces = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    cut = lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    return let(pieces, cut)


def is_blank(line: Column) -> Column:
    return ~line.rlike(r"(?U)\S")


def token_estimate(text: Column) -> Column:
    """How many `TOKEN` a text has, counted without making them."""
    return F.char_length(F.regexp_replace(F.coalesce(text, F.lit("")), TOKEN_REST, "$1$2")).cast("bigint")


def saved(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0).cast("bigint"))


def saved_method(before: Column, after: Column) -> Column:
    """The method of a difference of two counts: exact only if both are, unavailable if either is."""
    exact = lambda m: m.isin("provider", "tokenizer")
    return (
        F.when((before == "unavailable") | (after == "unavailable"), "unavailable")
        .when(exact(before) & exact(after), "tokenizer")
        .otherwise("estimated")
    )


def method_rank(method: Column) -> Column:
    return F.when(method == "provider", 3).when(method == "tokenizer", 2).when(method == "estimated", 1).otherwise(0)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def log_template(line: Column) -> Column:
    for pattern, mask in LOG_MASKS:
        line = F.regexp_replace(line, pattern, mask)
    return F.trim(line)


def log_level(line: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(line, "(?i)" + LEVEL, 1)), F.lit(""))


def severity(level: Column) -> Column:
    return (
        F.when(level.isin("FATAL", "CRITICAL", "PANIC"), 3).when(level == "ERROR", 2).when(level.isin("WARN", "WARNING"), 1).otherwise(0)
    )


def is_critical(line: Column) -> Column:
    return line.rlike("(?i)" + CRITICAL)


def critical_region(text: Column) -> Column:
    """The critical lines of a text, each with a line end."""
    found = F.filter(lines(text), is_critical)
    return F.array_join(F.transform(found, lambda x: F.concat(x, F.lit("\n"))), "")


def clip(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def duration_text(ms: Column) -> Column:
    n = F.round(ms / 100.0).cast("bigint")
    tenths = F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"), F.lit("s"))
    minutes = F.concat((F.floor(ms / 60000)).cast("string"), F.lit("m"), F.floor((ms % 60000) / 1000).cast("string"), F.lit("s"))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60000, tenths).otherwise(minutes)


def age_text(ms: Column) -> Column:
    """Up to 30 s are now, up to 90 s a minute; then whole minutes, from an hour on whole hours."""
    seconds = F.floor(ms / 1000)
    return (
        F.when(seconds <= 30, "just now")
        .when(seconds <= 90, "a minute ago")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
    )


def span_text(seconds: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(seconds / n).cast("string"), F.lit(u))
    return F.when(seconds < 60, unit(1, "s")).when(seconds < 3600, unit(60, "m")).when(seconds < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(0.0))


def day_number(millis: Column, offset_seconds: int = 0) -> Column:
    return F.floor((F.floor(millis / 1000) + offset_seconds) / 86400).cast("bigint")


def day_date(day: Column) -> Column:
    return F.date_add(F.to_date(F.lit("1970-01-01")), day.cast("int"))


#: Fixed value: the digits of an id in base 32, in rising order.
DIGITS = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def base32(number: Column, digits: int) -> Column:
    """The last `digits` digits of a number of up to 60 bits."""
    digit = lambda i: F.substring(F.lit(DIGITS), (F.shiftright(number, 5 * i).bitwiseAND(31) + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in reversed(range(digits))])


def from_base32(text: Column, digits: int) -> Column:
    """The number of that many digits; null if one is none."""
    place = lambda i: F.nullif(F.instr(F.lit(DIGITS), F.substring(text, i + 1, 1)), F.lit(0)).cast("bigint") - 1
    number = sum((F.shiftleft(place(i), 5 * (digits - 1 - i)) for i in range(digits)), F.lit(0).cast("bigint"))
    return F.when(F.char_length(text) == digits, number)


def sortable_id(prefix: str, millis: Column, key: Column) -> Column:
    """An id of 128 bits in 26 digits: 48 bits of its time, so that ids sort by time, and 80 of a hash of the key, so that a
    rerun makes the same one."""
    digest = F.sha2(key, 256)
    part = lambda at: F.conv(F.substring(digest, at, 10), 16, 10).cast("bigint")
    return F.concat(F.lit(prefix), base32(millis.cast("bigint").bitwiseAND((1 << 48) - 1), 10), base32(part(1), 8), base32(part(11), 8))


def id_millis(ident: Column, prefix: str) -> Column:
    """The time of an id; null if it is not well formed."""
    body = F.substr(ident, F.lit(len(prefix) + 1))
    formed = F.startswith(ident, F.lit(prefix)) & body.rlike(f"^[{DIGITS}]{{26}}$")
    return F.when(formed, from_base32(F.substring(body, 1, 10), 10))


def program_of(command: Column) -> Column:
    """The program of a command line: its head, quotes aware, without folders and `.exe`, in lower case."""
    head = F.coalesce(
        F.nullif(F.regexp_extract(F.trim(command), r"^\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(F.trim(command), r"^(\S*)", 1)
    )
    base = F.regexp_replace(F.lower(F.regexp_extract(head, r"([^/\\]*)$", 1)), r"\.exe$", "")
    return F.coalesce(F.nullif(base, F.lit("")), F.lit("(unknown)"))


def subcommand_of(command: Column) -> Column:
    """The first later word that is no option."""
    later = F.slice(F.split(F.trim(command), r"\s+"), 2, 10_000)
    return F.get(F.filter(later, lambda a: ~a.startswith("-")), F.lit(0))


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scope_of(text: Column) -> Column:
    """The scope that `npm install` or `npm` names, as program and subcommand; nothing, `*` and `global` name none.

    A program loses its folders, `.exe` and its case, a subcommand its case only. A null text names no scope.
    """
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    none = (clean == "") | (clean == "*") | (_ascii_lower(clean) == "global")
    word = lambda n: F.when(~none, F.get(F.split(clean, " "), F.lit(n)))
    program = F.regexp_replace(_ascii_lower(F.regexp_extract(word(0), r"([^/\\]*)$", 1)), r"\.exe$", "")
    return F.struct(program.alias("program"), _ascii_lower(word(1)).alias("subcommand"))


def scope_text(program: Column, subcommand: Column) -> Column:
    """How reports name a scope."""
    return F.when(program.isNull(), "(any command)").otherwise(F.concat_ws(" ", program, subcommand))


def has_markup(text: Column) -> Column:
    """Whether a text holds any mark of a lesson."""
    return F.coalesce(text.rlike("<(filter-)?(trash|fold|only|keep)"), F.lit(False))


def command_line(argv: Column) -> Column:
    quoted = lambda a: F.when(a.contains(" "), F.concat(F.lit('"'), a, F.lit('"'))).otherwise(a)
    return F.array_join(F.transform(argv, quoted), " ")


def project_id(path: Column) -> Column:
    return F.substring(F.sha2(F.lower(path), 256), 1, 12)


def combine_streams(out: Column, err: Column) -> Column:
    out, err = F.coalesce(out, F.lit("")), F.coalesce(err, F.lit(""))
    return F.when(is_blank(err), out).when(is_blank(out), err).otherwise(F.concat(F.rtrim(out), F.lit("\n"), err))


def json_minify(text: Column) -> Column:
    """Remove white space outside strings of a text that parses as JSON; keys keep their order, numbers their spelling."""
    small = F.regexp_replace(text, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+', "$1")
    return F.when(F.try_parse_json(text).isNotNull(), small).otherwise(text)


def json_type(text: Column) -> Column:
    first = F.substring(F.ltrim(text), 1, 1)
    return (
        F.when(F.try_parse_json(text).isNull(), None)
        .when(first == "{", "object")
        .when(first == "[", "array")
        .when(first == '"', "string")
        .when(first.isin("t", "f"), "bool")
        .when(first == "n", "null")
        .otherwise("number")
    )
