"""DuckDB SQL with the rows of the queries that SQL can express. The trained models, the
mix's rounding and the tokenizer have none; tests hold them to brute force."""

from __future__ import annotations

from docweave.llm.chat import END, MIDDLE, START
from docweave.llm.license_rules import rules

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLE_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"


def _decontaminate() -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l FROM documents),
  b AS (SELECT item_id, l FROM (SELECT item_id, {_WORDS.format("text")} AS l FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL) WHERE len(l) > 0),
  v AS (SELECT DISTINCT item_id, least(13, len(l)) AS k, array_to_string(l[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(1, len(l) - 12) + 1)) AS i FROM b)),
  p AS (SELECT doc_id, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v)),
  h AS (SELECT doc_id, i, p.k, item_id FROM p JOIN v ON v.k = p.k AND v.g = array_to_string(l[i:i + p.k - 1], ' ')),
  n AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS w FROM h) GROUP BY doc_id),
  s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM h GROUP BY doc_id)
  SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
  FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""


def _near_dups() -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_SHINGLE_WORDS.format("coalesce(text, '')")} AS l FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(l[i:i + 1], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(1, len(l) - 1) + 1)) AS i FROM d WHERE len(l) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
  r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
  m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
  SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id"""


def _chat() -> str:
    escaped = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({0}, '\', '\\'), '<(\||/?s>)', '<\\\1', 'g'), '<(/?SYS>>)', '<\\\1', 'g'), '<<(\\?/?SYS>>|/SYS>>)', '<\\<\1', 'g'), '\[(/?INST\])', '[\\\1', 'g'), chr(1), '', 'g')"
    marks = len(START) + len(MIDDLE) + len(END)
    said = "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))"
    return f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + length({escaped.format('role')}) + length({escaped.format('text')}))::BIGINT AS formatted_chars FROM ({said}) GROUP BY conv_id"""


def _top_k() -> str:
    return """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
  SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 10"""


def _licenses() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({i}, {quoted(r.label)}, {quoted(r.pattern)}, {r.priority}, {r.confidence}::DOUBLE)" for i, r in enumerate(rules()))
    count = "((length({0}) - length(replace({0}, ' ', ''))) // 2)"
    return f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS l FROM documents),
  t AS (SELECT doc_id, array_to_string(list_transform(l, lambda w: ' ' || w || ' '), '') AS t FROM d),
  r(i, label, pattern, p, confidence) AS (VALUES {table}),
  m AS (SELECT doc_id, i, p, string_split_regex(t, pattern) AS g, regexp_extract_all(t, pattern) AS f FROM t JOIN r ON regexp_matches(t, pattern)),
  x AS (SELECT doc_id, i, p, array_to_string(g[1:k], '') || array_to_string(f[1:k - 1], '') AS before, f[k] AS hit FROM (SELECT *, unnest(range(1, len(f) + 1)) AS k FROM m)),
  s AS (SELECT doc_id, i, p, {count.format('before')} AS a, {count.format('before')} + {count.format('hit')} AS b FROM x),
  k AS (SELECT * FROM s WHERE p = 4 OR NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.p <> 4 AND o.p >= s.p AND o.a <= s.a AND o.b >= s.b AND (o.a, -o.b, -o.p, o.i) < (s.a, -s.b, -s.p, s.i))),
  y AS (SELECT doc_id, count(*) FILTER (k.p = 4) AS n_base, min(a) FILTER (k.p = 4) AS first_word, max(a) FILTER (k.p = 4) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (k.p = 4)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(confidence) AS score, count(*) AS n_found FROM k JOIN r USING (i) GROUP BY doc_id)
  SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_found, 0)::BIGINT AS n_found FROM d LEFT JOIN y USING (doc_id)"""


def _clusters(k: int = 16, rounds: int = 3, width: int = 64) -> str:
    kept = f"""SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({width} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
    parts = [f"e AS ({kept})", f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS j, v AS c FROM e QUALIFY j < {k})"]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT i, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM e, c{r})")
        parts.append(f"a{r} AS (SELECT i, j, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) = 1)")
        if r < rounds:
            parts.append(f"m{r} AS (SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY p) AS c FROM (SELECT j, p, sum(v[p])::BIGINT AS s, count(*) AS n FROM (SELECT j, v, unnest(range(1, {width} + 1)) AS p FROM a{r} JOIN e USING (i)) GROUP BY ALL) GROUP BY j)")
            parts.append(f"c{r + 1} AS (SELECT j, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (j))")
    return f"""WITH {", ".join(parts)} SELECT vec_id, j::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN e USING (i) JOIN c{rounds} USING (j)"""


ORACLES: dict[str, str] = {
    "op1_decontaminate": _decontaminate(),
    "op5_near_dups": _near_dups(),
    "op8_chat": _chat(),
    "op9_top_k": _top_k(),
    "op10_licenses": _licenses(),
    "op13_clusters": _clusters(),
}
