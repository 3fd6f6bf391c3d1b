"""SQL that states the result of those queries that SQL can express over whole tables."""

from __future__ import annotations

from breathline.llm.quality_rules import MEASURES, SYMBOLS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def _components(ids: str, links: str) -> str:
    """reach(id, c) and comp(id, component_id) from the relations ``ids`` (id) and ``links`` (a, b), both ways."""
    return f"""reach AS (SELECT id, id AS c FROM {ids} UNION SELECT l.b, r.c FROM reach r JOIN {links} l ON l.a = r.id),
comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""


def near_dup_sql(words_each: int, percent: int) -> str:
    parts = ", ' ', ".join(f"w[i + {k}]" for k in range(words_each))
    return f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words_each}
    THEN list_transform(range(1, len(w) - {words_each - 2}), lambda i: concat({parts}))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
ids AS (SELECT DISTINCT doc_id AS id FROM documents),
{_components('ids', 'e')}
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def vector_dup_sql(least: float) -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {least}),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
ids AS (SELECT vec_id AS id FROM embeddings),
{_components('ids', 'e')}
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.id = vec_id LEFT JOIN n ON n.a = vec_id"""


def quality_rules_sql(min_words: int, max_repeat_percent: int, reach: float, min_group: int) -> str:
    """Exact quartiles in place of sketches, which hold tables of this size (nearly) whole."""
    ends, tests = {}, []
    for level in range(3):
        ends[level] = ", ".join(
            f"quantile_disc({m}, 0.25) AS {m}_low{level}, quantile_disc({m}, 0.75) AS {m}_high{level}" for m in MEASURES
        )
    for m, (sides, floor) in MEASURES.items():
        low, high = (f"CASE WHEN n0 >= {min_group} THEN {m}_{e}0 WHEN n1 >= {min_group} THEN {m}_{e}1 ELSE {m}_{e}2 END" for e in ("low", "high"))
        spread = f"{reach} * greatest(({high}) - ({low}), {floor})"
        tests.append(f"{m} <= ({high}) + {spread}" + (f" AND {m} >= ({low}) - {spread}" if sides == "both" else ""))
    return rf"""WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
x AS (SELECT doc_id, i, concat(w[i], ' ', w[i + 1], ' ', w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
o AS (SELECT doc_id, i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM o) GROUP BY 1),
k AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
c AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(k.n - k.d, 0) AS BIGINT) AS n_dup_lines, coalesce(k.n, 0) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)),
m AS (SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed,
  word_chars / greatest(n_words, 1) AS word_length, n_symbols / greatest(n_words, 1) AS symbol_share,
  n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share FROM c),
g0 AS (SELECT lang, source, count(*) AS n0, {ends[0]} FROM m WHERE NOT base_failed GROUP BY 1, 2),
g1 AS (SELECT lang, count(*) AS n1, {ends[1]} FROM m WHERE NOT base_failed GROUP BY 1),
g2 AS (SELECT {ends[2]} FROM m WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} AS kept
FROM m LEFT JOIN g0 ON g0.lang IS NOT DISTINCT FROM m.lang AND g0.source IS NOT DISTINCT FROM m.source
LEFT JOIN g1 ON g1.lang IS NOT DISTINCT FROM m.lang CROSS JOIN g2"""


SQL = {
    "op5_quality_rules": quality_rules_sql(50, 50, 3.0, 200),
    "op8_near_dup": near_dup_sql(4, 80),
    "op9_vector_dup": vector_dup_sql(0.95),
}
