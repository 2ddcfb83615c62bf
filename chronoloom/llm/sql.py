"""DuckDB SQL for the queries that SQL can express, written from the contracts and not from the code."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

# The checksum's table follows from its polynomial, one bit at a time; list_reduce then walks the bytes.
_CRC = """crc_bits AS (
  SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM crc_bits WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE step = 8)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: ('0x' || b)::BIGINT)"
    step = "lambda c, b: xor(t[(xor(c, b) & 255::BIGINT) + 1], c >> 8)"
    return f"CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295::BIGINT) AS BIGINT)"


SHARDS = f"""
WITH RECURSIVE {_CRC},
plain AS (
  SELECT doc_id, coalesce(text, '') AS text, source,
         CASE WHEN source IS NULL THEN 'null' ELSE '=' || source END AS stratum,
         ('0x' || md5('shards-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15])::BIGINT AS mix
  FROM documents),
sized AS (SELECT doc_id, source, stratum, mix, CAST(strlen(text) + 1 AS BIGINT) AS size, {_crc32("text")} AS text_crc32
          FROM plain, crc_table),
ranked AS (
  SELECT *, CAST(2 * row_number() OVER (PARTITION BY stratum ORDER BY mix, doc_id, text_crc32, size) - 1 AS DOUBLE)
            / CAST(2 * count(*) OVER (PARTITION BY stratum) AS DOUBLE) AS fraction
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, mix, doc_id, text_crc32, size) - 1 AS place,
         count(*) OVER () AS total
  FROM ranked),
cut AS (SELECT *, place * 16 // total AS shard FROM placed)
SELECT doc_id, size, text_crc32, source, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
       CAST(place - (shard * total + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut"""


def _rules() -> str:
    tests = [f"({r.numerator} >= {r.low} * {r.denominator} AND {r.numerator} <= {r.high} * {r.denominator})" for r in RULES]
    return " AND ".join(tests)


def _failed() -> str:
    named = [
        f"CASE WHEN {r.numerator} < {r.low} * {r.denominator} OR {r.numerator} > {r.high} * {r.denominator} THEN '{r.name}' END"
        for r in RULES
    ]
    return f"concat_ws(',', {', '.join(named)})"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SPACE = r"[^\x20\x09-\x0D]"

QUALITY_CTES = f"""plain AS (SELECT row_number() OVER () AS r, *, coalesce(text, '') AS body FROM {{table}}),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p
          FROM (SELECT r, regexp_extract_all(body, '{_SPACE}+') AS w FROM plain)),
windows AS (
  SELECT r, p, len(eight) AS n, array_to_string(eight, ' ') AS gram
  FROM (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS eight FROM words)),
again AS (SELECT r, p, count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM windows WHERE n = 8),
covered AS (
  SELECT r, least(8, coalesce(p - lag(p) OVER (PARTITION BY r ORDER BY p), 8)) AS k FROM again WHERE twice),
repeats AS (SELECT r, sum(k) AS n_repeat_words FROM covered GROUP BY r),
lines AS (SELECT r, unnest(string_split(body, chr(10))) AS line FROM plain),
line_counts AS (SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_kinds
                FROM lines WHERE regexp_matches(line, '{_SPACE}') GROUP BY r),
word_counts AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
                       count(*) FILTER (WHERE word IN ({_STOP})) AS n_stop_words
                FROM words GROUP BY r),
measured AS (
  SELECT plain.*, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words,
         CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines - n_kinds, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(coalesce(n_stop_words, 0) AS BIGINT) AS n_stop_words,
         CAST(length(regexp_replace(body, '[^A-Z]', '', 'g')) AS BIGINT) AS n_capitals
  FROM plain LEFT JOIN word_counts USING (r) LEFT JOIN line_counts USING (r) LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)"""

QUALITY = f"""
WITH {QUALITY_CTES.format(table="documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_capitals,
       base_failed, NOT base_failed AND {_rules()} AS kept, {_failed()} AS failed_rules
FROM judged"""

WARC = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM firsts"""

VECTORS = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
normal AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM normal a JOIN normal b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
smallest AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN smallest ON smallest.a = vec_id LEFT JOIN counted ON counted.a = vec_id"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = rf"regexp_extract_all(translate({{}}, {_UPPER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

SEARCH = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS terms FROM documents),
items AS (SELECT row_number() OVER () AS q, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT DISTINCT q, item_id, unnest({_TERMS.format("coalesce(text, '')")}) AS term FROM items),
totals AS (SELECT CAST(count(*) AS HUGEINT) AS n_docs, CAST(sum(len(terms)) AS HUGEINT) AS n_terms FROM docs WHERE len(terms) > 0),
held AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM held, totals GROUP BY term, n_docs),
lengths AS (SELECT r, doc_id, CAST(10 + (90 * len(terms) * n_docs) // n_terms AS BIGINT) AS m FROM docs, totals WHERE len(terms) > 0),
scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weights USING (term) JOIN lengths USING (r) GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

# A node is the list of digests that leads to it. The checksum of the id is that of sharding's SQL.
TRIE = f"""
WITH RECURSIVE {_CRC},
turns AS (
  SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
         md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({{'d': digest, 's': size}} ORDER BY turn ASC NULLS FIRST, digest) AS seq FROM turns GROUP BY conv_id),
cut AS (SELECT conv_id, seq, {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, crc_table),
rebuilt AS (
  SELECT cut.conv_id, list_concat(coalesce(base.seq[1:h], []), cut.seq[h + 1:]) AS seq
  FROM cut LEFT JOIN own base ON base.conv_id = cut.conv_id - cut.conv_id % 5),
steps AS (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt),
member AS (
  SELECT conv_id, depth, len(seq) AS n, list_transform(seq[1:depth], lambda x: x.d) AS path,
         list_transform(seq[1:depth - 1], lambda x: x.d) AS up, CASE WHEN depth > 0 THEN seq[depth].s ELSE 0 END AS size
  FROM steps),
node AS (
  SELECT path, any_value(CASE WHEN depth > 0 THEN up END) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id,
         count(*) AS n_convs, (count(*) - 1) * any_value(size) AS own_saved,
         sha256(coalesce(string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM member GROUP BY path),
counted AS (SELECT up AS path, count(*) AS n_children FROM node WHERE up IS NOT NULL GROUP BY up),
facts AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN counted USING (path)),
within AS (SELECT path[1:top] AS path, own_saved, n_children FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM facts)),
sums AS (SELECT path, sum(own_saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM within GROUP BY path)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums USING (path) LEFT JOIN node p ON p.path = f.up"""
