"""DuckDB SQL for the queries that SQL can state, in another shape than the operators."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: The table is filled by a recursion with one step for each slot claimed.
OP4 = """
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range(16) t(i)
), walks AS (
  SELECT list(struct_pack(
    at := ('0x' || substr(md5('offset:' || shard), 1, 15))::BIGINT % 2039,
    step := ('0x' || substr(md5('skip:' || shard), 1, 15))::BIGINT % 2038 + 1) ORDER BY i) AS w
  FROM shards
), claims AS (
  SELECT 0::BIGINT AS turn, -1::BIGINT AS slot, []::BIGINT[] AS taken
  UNION ALL
  SELECT turn + 1, s.slot, list_append(taken, s.slot)
  FROM (
    SELECT turn, taken, list_filter(
      list_transform(range(2039), lambda j: (w[(turn % 16 + 1)::INT].at + j * w[(turn % 16 + 1)::INT].step) % 2039),
      lambda p: NOT list_contains(taken, p))[1] AS slot
    FROM claims, walks WHERE turn < 2039
  ) s
)
SELECT d.doc_id, c.slot::INTEGER AS slot, 'shard-' || lpad(((c.turn - 1) % 16)::VARCHAR, 2, '0') AS shard
FROM documents d JOIN claims c
  ON c.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % 2039
WHERE c.turn > 0
"""

#: Shares by rounds of resharing would recurse; here each number of capped
#: sources is tried.  Thresholds come from a full sort by hash.
OP5 = rf"""
WITH d AS (
  SELECT doc_id, source, len({_WORDS}) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place FROM s
), levels AS (
  SELECT a.place, ((SELECT sum(source_size) FROM s) - coalesce(sum(b.source_size * 3) FILTER (b.place < a.place), 0))::DOUBLE
    / sum(b.weight) FILTER (b.place >= a.place) AS level
  FROM ranked a, ranked b GROUP BY a.place
), fit AS (
  SELECT min_by(l.level, l.place) AS level, min(l.place) AS place
  FROM levels l JOIN ranked r USING (place) WHERE l.level * r.weight <= (3 * r.source_size)::DOUBLE
), t AS (
  SELECT source, source_size, CASE WHEN r.place >= fit.place THEN level * weight ELSE (3 * source_size)::DOUBLE END AS target
  FROM ranked r, fit
), c AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM t
), g AS (
  SELECT source, h, sum(size)::BIGINT AS words FROM d GROUP BY source, h
), run AS (
  SELECT g.*, sum(words) OVER (PARTITION BY source ORDER BY h) - words AS gone FROM g
)
SELECT d.doc_id, d.size::BIGINT AS size, c.source_size, c.target,
  (d.size * least(3, c.copies + CASE WHEN run.gone + run.words / 2 < c.target - c.copies * c.source_size
     THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source
JOIN run ON d.source IS NOT DISTINCT FROM run.source AND d.h = run.h
"""

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents
), seq AS (
  SELECT r, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM d
), win AS (
  SELECT r, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM seq WINDOW o AS (PARTITION BY r ORDER BY i)
), rep AS (
  SELECT r, i, c IS NOT NULL AND count(*) OVER (PARTITION BY r, a, b, c) > 1 AS twice FROM win
), cover AS (
  SELECT r, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS x
  FROM rep WINDOW o AS (PARTITION BY r ORDER BY i)
), repeats AS (
  SELECT r, count(*) FILTER (x) AS n FROM cover GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
    len(regexp_extract_all(text, '\p{{Lu}}')) AS upper_, len(regexp_extract_all(text, '\p{{Ll}}')) AS lower_
  FROM d LEFT JOIN dups USING (r) LEFT JOIN repeats USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 2 * n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words
    OR 2 * n_dup_lines > len(string_split(text, chr(10))) OR upper_ > lower_) AS kept
FROM b
"""

ORACLES = {"op4_sharding": OP4, "op5_mixing": OP5, "op6_quality_rules": OP6}
