"""DuckDB SQL for the queries that SQL can express."""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five hex digits are twenty bits and so four letters; the bits come from the digits' places in the alphabet of hex.
_LETTERS = f"""array_to_string(list_transform(range(32), lambda i: substr('{_BASE32}', 1 + (
        ((instr('0123456789abcdef', substr(sha, 5 * (i // 4) + 1, 1)) - 1) * 65536
        + (instr('0123456789abcdef', substr(sha, 5 * (i // 4) + 2, 1)) - 1) * 4096
        + (instr('0123456789abcdef', substr(sha, 5 * (i // 4) + 3, 1)) - 1) * 256
        + (instr('0123456789abcdef', substr(sha, 5 * (i // 4) + 4, 1)) - 1) * 16
        + (instr('0123456789abcdef', substr(sha, 5 * (i // 4) + 5, 1)) - 1))
        // CAST(pow(32, 3 - i % 4) AS INTEGER) % 32)::INTEGER, 1)), '')"""

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
    g AS (SELECT sha, max(page_id) AS last FROM p GROUP BY sha)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_LETTERS} AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN g USING (sha)
"""

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"
OP10 = rf"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (
    SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
g AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
r AS (
    SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (
        SELECT doc_id, unnest([i, i + 1, i + 2]) AS k
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
    GROUP BY doc_id),
m AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        coalesce(n_lines, 0) AS n_lines,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter,
        len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]') AND strlen(x) > 1)) AS n_upper,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
    FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words
        AND 2 * n_dup_lines <= n_lines AND 10 * n_letter >= 6 * n_words AND 2 * n_upper <= n_words
        AND 10 * n_stutter <= 3 * n_words AS kept
FROM b
"""


OP6 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
p AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT p.b, r.root FROM reach r JOIN p ON p.a = r.id),
least AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id),
met AS (SELECT a AS id, count(*) AS n FROM p GROUP BY a)
SELECT l.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, l.id = component_id AS kept
FROM least l LEFT JOIN met ON met.id = l.id
"""

SQL = {"op4_warc": OP4, "op6_embedding_dedup": OP6, "op10_rules": OP10}
