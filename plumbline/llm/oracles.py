"""DuckDB SQL for the operators whose whole result SQL can express."""

from __future__ import annotations

from plumbline.llm import chat, divergence, mixing, quality

_SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"


def quality_rules(coverage: dict[int, float] = quality.COVERAGE) -> str:
    """Counts, coverages and verdicts from unnested windows instead of hashes."""
    parts, columns, joins, bad = [], [], [], []
    for n in sorted({5, *coverage}):
        parts.append(f"""
g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {n - 1}], chr(31))) AS c
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d WHERE len(w) >= {n})),
c{n} AS (SELECT x.doc_id, count(*) AS n, CAST(sum(length(d.w[x.i])) AS BIGINT) AS chars
         FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} WHERE c > 1) x JOIN d ON d.doc_id = x.doc_id GROUP BY 1)""")
        joins.append(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id")
        if n in coverage:
            columns.append(f"coalesce(c{n}.chars, 0) / greatest(k.word_chars, 1)::DOUBLE AS coverage_{n}")
            bad.append(f"coverage_{n} > {coverage[n]}")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPLIT} AS w FROM documents),
k AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^ \\t-\\r]')),
m AS (SELECT doc_id, count(*) FILTER (r > 1) AS n, coalesce(sum(length(line)) FILTER (r > 1), 0) AS chars FROM l GROUP BY 1),
{",".join(parts)},
x AS (SELECT d.doc_id, k.n_words, k.word_chars, k.n_symbols, coalesce(m.n, 0) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words,
      k.n_words < 10 OR 100 * coalesce(c5.n, 0) > 20 * k.n_words AS base_failed, coalesce(m.chars, 0) / greatest(length(d.text), 1)::DOUBLE AS line_coverage,
      {", ".join(columns)}
      FROM d JOIN k ON k.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id {" ".join(joins)})
SELECT *, NOT base_failed AND NOT (line_coverage > {quality.LINES} OR n_symbols > {quality.SYMBOL_RATIO} * n_words OR {" OR ".join(bad)}) AS kept FROM x
"""


def jaccard_join(threshold: float = 0.8) -> str:
    """Exact links by shared shingles and classes by a recursive closure, without sketches.

    A document is an id with a set: repeated rows count once, an id with two sets twice.
    """
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPLIT} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], chr(31))))) END AS s FROM d),
r AS (SELECT row_number() OVER (ORDER BY s) AS node, s, len(s) AS n, min(doc_id) AS rep, count(DISTINCT doc_id) AS copies FROM s WHERE doc_id IS NOT NULL GROUP BY s),
x AS (SELECT node, n, copies, unnest(s) AS g FROM r),
p AS (SELECT a.node AS a, b.node AS b, any_value(b.copies) AS copies FROM x a JOIN x b ON a.g = b.g AND a.node <> b.node
      GROUP BY 1, 2 HAVING count(*) >= {threshold} * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-6),
t AS (SELECT a, b FROM p UNION SELECT t.a, p.b FROM t JOIN p ON t.b = p.a),
c AS (SELECT t.a, min(r.rep) AS root FROM t JOIN r ON r.node = t.b GROUP BY 1),
l AS (SELECT a, CAST(sum(copies) AS BIGINT) AS links, count(*) AS texts FROM p GROUP BY 1)
SELECT s.doc_id, CASE WHEN s.doc_id IS NOT NULL THEN least(coalesce(c.root, r.rep), r.rep) END AS class_id, CASE WHEN s.doc_id IS NULL THEN 0 ELSE coalesce(l.links, 0) + r.copies - 1 END AS n_links,
  CASE WHEN s.doc_id IS NULL THEN 0 ELSE r.copies - 1 END AS n_copies, CASE WHEN s.doc_id IS NULL THEN 0 ELSE coalesce(l.texts, 0) END AS n_linked_texts
FROM s LEFT JOIN r ON r.s = s.s LEFT JOIN c ON c.a = r.node LEFT JOIN l ON l.a = r.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": chat.ORACLE_SQL, "op3_quality_rules": quality_rules(), "op10_jaccard_join": jaccard_join(), "op11_source_mixing": mixing.ORACLE_SQL, "op13_source_divergence": divergence.ORACLE_SQL}
