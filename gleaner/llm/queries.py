"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from . import ann, bestfit, chat, divergence, html, mixing, packing, quality, sharding, simhash, toxicity, trie, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_html": html.op2_html,
    "op3_sharding": sharding.op3_sharding,
    "op4_ann": ann.op4_ann,
    "op5_simhash": simhash.op5_simhash,
    "op6_mixing": mixing.op6_mixing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_quality": quality.op9_quality,
    "op10_warc": warc.op10_warc,
    "op11_divergence": divergence.op11_divergence,
    "op12_prefix_trie": trie.op12_prefix_trie,
    "op13_bestfit": bestfit.op13_bestfit,
}

_LINE_WORD = r"[^\x20\x09-\x0D]"
_MARKS = quality.MARKS.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


def _rules_sql() -> str:
    """The names of the rules that a row of features breaks."""
    tests = []
    for r in quality.RULES:
        bad = [f"{r.feature} < {r.low}"] * (r.low is not None) + [f"{r.feature} > {r.high}"] * (r.high is not None)
        tests.append(f"CASE WHEN {' OR '.join(bad)} THEN '{r.name}' END")
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


#: The other operators are beyond SQL: tokenizer ids, trained models, 64-bit shingle hashes, keyed rounding, approximate search.
ORACLE_SQL: dict[str, str] = {
    "op3_sharding": """
WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS tbl),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda p: ('0x' || p)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, size::BIGINT AS size, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bytes), lambda acc, x: xor(acc // 256, tbl[(xor(acc, x) % 256) + 1]::BIGINT)))::BIGINT AS text_crc32 FROM b, t),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM c),
g AS (SELECT *, least(15, ((2 * upto - size) * 16) // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM g""",
    "op8_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 18 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op9_quality": f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_LINE_WORD}+') AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_LINE_WORD}')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 4]) AS n FROM g) WHERE n > 1),
k AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM r, range(5) AS o(j) GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: lower(trim(x, '{_MARKS}')) IN ({_STOP}))) AS n_stop, len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_loud FROM w LEFT JOIN k USING (doc_id)),
v AS (SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_word_ratio,
  CASE WHEN n_words > 0 THEN n_loud / n_words ELSE 0 END AS exclaim_word_ratio, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_ratio,
  CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio, CASE WHEN n_words >= {quality.TELLING_WORDS} THEN n_stop / n_words ELSE 1 END AS stop_word_ratio FROM f),
d AS (SELECT *, {_rules_sql()} AS failed, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND len(failed) = 0 AS kept, array_to_string(failed, ',') AS failed_rules FROM d""",
    "op10_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT // (32 ** (3 - i % 4))::BIGINT) % 32 + 1)::INTEGER, 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM m""",
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
x AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(x.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 5) // (s.n + 5 * v.v) AS p, 1 + 1000000000::HUGEINT * (c.total + 5) // (v.n + 5 * v.v) AS q
  FROM c JOIN s ON s.lang = c.lang AND s.source = c.source JOIN v ON v.lang = c.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM u)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50""",
    "op12_prefix_trie": r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
tbl AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS x),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)),
  lambda acc, b: xor(acc // 256, x[(xor(acc, b) % 256) + 1]::BIGINT))) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), tbl),
r AS (SELECT c.conv_id, role, text, 0 AS own, n FROM c JOIN t ON t.conv_id = c.base WHERE n <= h UNION ALL SELECT c.conv_id, role, text, 1, n FROM c JOIN t ON t.conv_id = c.conv_id WHERE n > h),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, n) AS d, sha256(concat(length(role), ':', role, text)) AS turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r),
p AS (SELECT conv_id, d, words, list(turn) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM o UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, max(d) AS last FROM p GROUP BY conv_id),
n AS (SELECT path, any_value(d) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last) AS ends FROM p JOIN m USING (conv_id) GROUP BY path),
k AS (SELECT a.conv_id AS up, b.*, (SELECT count(*) FROM n x WHERE x.depth = b.depth + 1 AND x.path[:b.depth] = b.path) AS n_children FROM n b LEFT JOIN n a ON a.depth = b.depth - 1 AND a.path = b.path[:b.depth - 1])
SELECT a.conv_id, a.depth::BIGINT AS depth, a.up AS parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.words)::BIGINT AS saved_tokens, sha256(coalesce(a.ends, '')) AS ends_sha256
FROM k a JOIN k b ON b.depth >= a.depth AND b.path[:a.depth] = a.path GROUP BY a.path, a.conv_id, a.depth, a.up, a.n_convs, a.n_children, a.ends""",
}
