"""SQL texts, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from . import mixing, negatives, quality
from .workers import WORD

_BEFORE = "rows between unbounded preceding and 1 preceding"
_ONWARDS = "rows between current row and unbounded following"
_WEIGHTS = ", ".join(f"{float(w)}::DOUBLE" for w in mixing.WEIGHTS)

MIXING = f"""
WITH d_all AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', coalesce(doc_id::VARCHAR, ''), text)),
                         1, {mixing.DRAW_DIGITS}))::BIGINT AS draw
  FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source, draw) - 1 AS number FROM d_all),
d AS (
  SELECT doc_id, source, size,
         CASE WHEN number = 0 THEN draw
              ELSE ('0x' || substr(md5(concat_ws('|', 'copy', draw, number)), 1, {mixing.DRAW_DIGITS}))::BIGINT END AS draw
  FROM n),
t AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} AS turn
  FROM d GROUP BY source),
w AS (
  SELECT source, source_size, [{_WEIGHTS}][turn + 1] AS weight,
         source_size * {float(mixing.EPOCHS)}::DOUBLE AS cap FROM t),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {mixing.SHARE}::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST {_BEFORE}), 0::DOUBLE))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST {_ONWARDS}) AS level FROM w),
g AS (
  SELECT source, source_size, cap, weight,
         max(CASE WHEN cap > level * weight THEN level END) OVER () AS free FROM l),
p AS (
  SELECT source, source_size,
         CASE WHEN free IS NULL THEN cap ELSE least(cap, free * weight) END AS target FROM g),
e AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM p),
r AS (
  SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw) AS reached,
         sum(size) OVER (PARTITION BY d.source, draw) AS own
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN reached - own / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_ENDS = "".join("\\" + chr(b) for b in quality.LINE_ENDS) + "".join(quality.WIDE_ENDS)
_SYMBOLS = "[#*$%&|<>]"

QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
cut AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS n FROM d),
line AS (
  SELECT *, len(regexp_extract_all(line, '{WORD}')) AS words,
         len(regexp_extract_all(line, '[|>]')) AS separators,
         len(regexp_extract_all(line, '{_SYMBOLS}')) AS symbols,
         len(regexp_extract_all(line, '[A-ZÀ-Þ]')) AS capitals,
         len(regexp_extract_all(line, '[a-zß-ÿ]')) AS small
  FROM cut),
judged AS (
  SELECT *, words > 0 AND regexp_matches(line, '{_quoted(quality.BOILERPLATE)}', 'i') AS notice,
    words > 0 AND (
    (words >= {quality.LONG_LINE} AND NOT regexp_matches(line, '[{_quoted(_ENDS)}]([\x20\x09-\x0D]|$)'))
    OR (separators >= 3 AND separators > {quality.MOST_SEPARATORS}::DOUBLE * words)
    OR symbols > {quality.MOST_SYMBOLS}::DOUBLE * words
    OR (capitals + small >= {quality.CAPITALS_FROM} AND capitals > {quality.MOST_CAPITALS}::DOUBLE * (capitals + small))) AS failed
  FROM line),
lines AS (
  SELECT doc_id, coalesce(sum(words) FILTER (failed OR notice), 0)::BIGINT AS lost_words,
         coalesce(sum(words) FILTER (notice), 0)::BIGINT AS notice_words,
         (count(*) FILTER (words > 0) - count(DISTINCT line) FILTER (words > 0))::BIGINT AS n_dup_lines,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT (failed OR notice)), '') AS clean_text
  FROM judged GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + {quality.WINDOW - 1}], ' ') AS words
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {quality.WINDOW - 2})) AS i FROM w)),
twice AS (
  SELECT doc_id, unnest(range(i, i + {quality.WINDOW})) AS place
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words) AS times FROM windows) WHERE times > 1),
repeats AS (SELECT doc_id, count(DISTINCT place)::BIGINT AS n_repeat_words FROM twice GROUP BY doc_id),
f AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(array_to_string(words, ' '), '{_SYMBOLS}'))::BIGINT AS n_symbols,
         n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, lost_words, notice_words, clean_text
  FROM w JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
b AS (
  SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed
  FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, base_failed,
       NOT base_failed AND lost_words - notice_words <= {quality.MOST_LOST}::DOUBLE * (n_words - notice_words)
         AND n_words > notice_words AS kept,
       sha256(clean_text) AS clean_sha256
FROM b
"""

NEGATIVES = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
         list_transform(embedding, lambda x: floor({negatives.SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS alike,
         list_inner_product(a.v, r.v)::BIGINT AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, row_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= {negatives.POSITIVES})
SELECT p.anchor_id, positive_id, row_id AS negative_id, positive_score, score AS negative_score,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, row_id)::INTEGER AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike
  AND {negatives.LOW_PERCENT} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {negatives.NEGATIVES}
"""



def _sized(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_sized(f) for f in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# crc32 bit by bit: DuckDB has none. The table is the remainders of all bytes.
_CRC_TABLE = (
    "list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: "
    "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b))"
)

MANIFEST = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS bytes),
d AS (
  SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
           lambda c, b: xor(c >> 8, bytes[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS crc
  FROM documents, crc),
leaves AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
         CASE WHEN crc % 7 = 0 THEN {_leaf('(n_chars::HUGEINT + 1)')} ELSE {_leaf('n_chars')} END AS changed
  FROM d),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM leaves),
up(lang, level, pos, digest, n) AS (
  SELECT lang, 0, pos, leaf, n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 1) // 2)
  FROM up WHERE n > 1 GROUP BY lang, level, pos // 2),
nodes AS MATERIALIZED (SELECT * FROM up),
subroots AS MATERIALIZED (
  SELECT lang, level, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
over(level, pos, digest, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 1) // 2)
  FROM over WHERE n > 1 GROUP BY level, pos // 2),
tops AS MATERIALIZED (SELECT * FROM over),
levels AS MATERIALIZED (SELECT DISTINCT level FROM nodes UNION SELECT DISTINCT level FROM tops),
steps AS MATERIALIZED (
  SELECT p.lang, p.pos, l.level, (p.pos >> l.level) & 1 AS slot, coalesce(s.digest, '') AS sibling
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang JOIN levels l ON l.level < r.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = l.level AND s.pos = xor(p.pos >> l.level, 1)
  UNION ALL
  SELECT p.lang, p.pos, r.level + l.level, (r.pos >> l.level) & 1, coalesce(s.digest, '')
  FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang
  JOIN levels l ON l.level < (SELECT max(level) FROM tops)
  LEFT JOIN tops s ON s.level = l.level AND s.pos = xor(r.pos >> l.level, 1)),
folded(lang, pos, level, digest) AS (
  SELECT lang, pos, 0, changed FROM placed
  UNION ALL
  SELECT f.lang, f.pos, f.level + 1, sha256(CASE WHEN slot = 1 THEN sibling || digest ELSE digest || sibling END)
  FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.level = f.level),
ends AS MATERIALIZED (SELECT lang, pos, arg_max(digest, level) AS folded_root FROM folded GROUP BY lang, pos),
proofs AS MATERIALIZED (
  SELECT lang, pos, string_agg(sibling, '' ORDER BY level) AS siblings FROM steps GROUP BY lang, pos),
root AS (SELECT digest AS root FROM tops WHERE n = 1)
SELECT p.doc_id, leaf, subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN subroots r ON r.lang IS NOT DISTINCT FROM p.lang CROSS JOIN root
JOIN ends e ON e.lang IS NOT DISTINCT FROM p.lang AND e.pos = p.pos
LEFT JOIN proofs x ON x.lang IS NOT DISTINCT FROM p.lang AND x.pos = p.pos
"""

ORACLES = {"op13_manifest": MANIFEST, "op11_hard_negatives": NEGATIVES, "op2_quality": QUALITY, "op7_mixing": MIXING}
