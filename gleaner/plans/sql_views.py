"""The same rendered views as in `gleaner.sources.tables`, as SQL for DuckDB, and shared pieces of that SQL."""

LINES = """lines AS (
  SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)"""

APPLOG = r"""applog AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ln, event_type, event_id, ts,
    concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ',
      CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END,
      ' user=', user_id::VARCHAR, ' event=', event_type, ' id=', event_id::VARCHAR,
      CASE WHEN event_type = 'error' THEN concat(' failed: expected 200 got ', (400 + event_id % 5)::VARCHAR,
        ' at src/app.py:', (1 + event_id % 90)::VARCHAR) ELSE '' END) AS line FROM events)"""

USAGE = """usage AS (
  SELECT 'run' AS t, epoch_us(ts) // 1000 AS at_millis, concat('p', (user_id % 20)::VARCHAR) AS project, event_type AS program,
    1000 + event_id % 977 AS tokens_before, event_id % 1013 AS tokens_after,
    ['provider', 'tokenizer', 'estimated', 'unavailable'][event_id % 4 + 1] AS method FROM events)"""

GREPLOG = """greplog AS (
  SELECT concat('orders/', l_returnflag, '.tbl:', l_linenumber::VARCHAR, ':', l_orderkey::VARCHAR) AS line FROM lineitem)"""

TOKENS = "len(regexp_extract_all({0}, '[A-Za-z_]{{1,4}}|[0-9]{{1,3}}|[^A-Za-z_0-9 ]'))"


def tokens(column: str) -> str:
    return TOKENS.format(column)


def template(column: str) -> str:
    """The log template of a line."""
    out = column
    for pattern, mask in (
        (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?", "<ts>"),
        (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
        (r"\"[^\"]*\"|''[^'']*''", "<str>"),
        (r"\b(?:0x)?[0-9a-fA-F]{8,}\b", "<hex>"),
        (r"[0-9]+", "<n>"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{mask}', 'g')"
    return f"trim({out})"


CRITICAL = (
    r"(\b(error|failed|failure|fail:|panic|panicked|exception|traceback|assert\w*|fatal|cannot|denied|refused|"
    r"timed?[ _-]?out|expected|actual|exit(?:ed)?[ _-]?(?:code|status))\b|\bERR!)"
)


def critical(column: str) -> str:
    return f"regexp_matches({column}, '(?i){CRITICAL}')"


LEVEL = r"(?i)\b(TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|FATAL|CRITICAL|PANIC)\b"


def level(column: str) -> str:
    return f"nullif(upper(regexp_extract({column}, '{LEVEL}', 1)), '')"


def token_class(t: str) -> str:
    """The class of a token whose trailing punctuation is gone already."""
    digits = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))"
    return f"""CASE WHEN {t} = '' THEN NULL
      WHEN regexp_matches({t}, '^(https?://|file://|git\\+|ssh://)') THEN 'url'
      WHEN regexp_matches({t}, '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$') THEN 'uuid'
      WHEN (regexp_matches({t}, '^[0-9.]*:[0-9:.]*$') AND {digits} >= 3) OR regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 't'
      WHEN regexp_matches({t}, '(?i)^[0-9.,]*[0-9][0-9.,]*(b|kb|mb|gb|tb|kib|mib|gib|tib|ns|us|µs|ms|s|m|h|x)$') THEN 'size'
      WHEN regexp_matches({t}, '^(.+@)?v?[0-9]+(\\.[0-9]+){{2,}}([-+][^@]*)?$') THEN 'ver'
      WHEN regexp_matches({t}, '^(0x)?[0-9A-Fa-f]{{7,}}$') AND regexp_matches(regexp_replace({t}, '^0x', ''), '[0-9]') THEN 'hex'
      WHEN regexp_matches({t}, '^[-+]?[0-9.,_]*[0-9][0-9.,_]*%?$') THEN 'n'
      WHEN strlen({t}) >= 3 AND (contains({t}, '/') OR contains({t}, chr(92)) OR regexp_matches({t}, '^.*[A-Za-z0-9].*\\.[A-Za-z0-9]{{1,6}}$')) THEN 'path'
    END"""


TRAILING = r"[,:;)\]}.\"''!?]+$"


def segments(line: str) -> str:
    """Tokens of a line as text: `{class}` or the literal; a list."""
    words = f"list_filter(string_split_regex(trim(regexp_replace({line}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"
    stripped = f"regexp_replace(w, '{TRAILING}', '')"
    return f"list_transform({words}, lambda w: coalesce('{{' || ({token_class(stripped)}) || '}}', w))"


FAILURES = """failures AS (
  SELECT event_id, concat('build v', (event_id % 4)::VARCHAR, '.', (event_id % 11)::VARCHAR, '.', (event_id % 7)::VARCHAR, '-rc1 of commit ',
    substr(md5(event_id::VARCHAR), 1, 12), ' exited with status ', (event_id % 5)::VARCHAR, ': TypeError E', (100 + event_id % 900)::VARCHAR,
    ', must not pass, CVE-2024-', (1000 + event_id % 77)::VARCHAR, ', exit code: ', (event_id % 3)::VARCHAR) AS line FROM events)"""
