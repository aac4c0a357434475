"""DuckDB SQL for the queries of this subpackage that SQL expresses, over whole tables."""

from __future__ import annotations

from . import quality as Q

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item_id, regexp_extract_all({_LOWER}, {_ITEM_WORD}) AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
x AS (
  SELECT rid, k, p, array_to_string(w[p : p + k - 1], ' ') AS gram
  FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM g))),
h AS (SELECT x.rid, x.p, x.k, g.item_id FROM x JOIN g ON x.k = g.k AND x.gram = g.gram),
n AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + k)) AS q FROM h) GROUP BY rid),
s AS (SELECT rid, list_sort(list(DISTINCT item_id)) AS ids FROM h GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n_hit, 0)::BIGINT AS n_hit, coalesce(len(s.ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(s.ids, ','), '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN s USING (rid)
"""

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
x AS (SELECT rid, p, sha256(array_to_string(w[p : p + 34], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS p FROM d)),
r AS (SELECT g FROM x GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS q FROM x JOIN r USING (g)),
n AS (SELECT rid, count(*) AS n FROM c GROUP BY rid),
u AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS q FROM d),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY q) AS t FROM u ANTI JOIN c USING (rid, q) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _quality() -> str:
    lists = " ".join(f"WHEN {_quoted(k)} THEN [{', '.join(map(_quoted, v))}]" for k, v in Q.LANGUAGES.items())
    steps, left = [], "t"
    for i, pattern in enumerate(Q.CLASSES):
        steps.append(f"l{i} AS (SELECT *, regexp_replace({left}, {_quoted(pattern)}, '', 'g') AS x{i} FROM {'d' if i == 0 else f'l{i - 1}'})")
        left = f"x{i}"
    names = ["t", *[f"x{i}" for i in range(len(Q.CLASSES))]]
    chars = ", ".join([f"length({a}) - length({b})" for a, b in zip(names, names[1:])] + [f"length({names[-1]})"])

    def sums(column: str, n: int) -> str:
        return "[" + ", ".join(f"sum({column}[{i}])" for i in range(1, n + 1)) + "]"

    def distance(column: str, ref: str, n: int) -> str:
        p, q = f"({column}[i] / greatest(list_sum({column}), 1))", f"({ref}[i] / list_sum({ref}))"
        part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
        return f"CASE WHEN list_sum({column}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, {n + 1}), lambda i: {part(p)} + {part(q)})) / 2, 0)) ELSE 0 END"

    nc, nw = len(Q.CLASSES) + 1, Q.N_COMMON + 1
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    CASE WHEN lang IN ({', '.join(_quoted(k) for k in Q.LANGUAGES if k)}) THEN lang ELSE '' END AS lg FROM documents),
{', '.join(steps)},
m AS (SELECT *, CASE lg {lists} END AS own, [{chars}]::BIGINT[] AS hc FROM l{len(Q.CLASSES) - 1}),
h AS (SELECT *, list_transform(own, lambda k: len(list_filter(w, lambda x: lower(x) = k))) AS common FROM m),
f AS (SELECT *, list_append(common, len(w) - list_sum(common))::BIGINT[] AS hw FROM h),
x AS (SELECT rid, p, sha256(array_to_string(w[p : p + {Q.WINDOW - 1}], ' ')) AS g FROM (SELECT rid, w, unnest(range(1, len(w) - {Q.WINDOW - 2})) AS p FROM d)),
r AS (SELECT rid, g FROM x GROUP BY rid, g HAVING count(*) > 1),
n AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + {Q.WINDOW})) AS q FROM x JOIN r USING (rid, g)) GROUP BY rid),
e AS (SELECT f.*, coalesce(n, 0) AS n, len(w) < 20 OR 100 * coalesce(n, 0) > 30 * len(w) AS base_failed FROM f LEFT JOIN n USING (rid)),
refs AS (SELECT lg, {sums('hc', nc)} AS rc, {sums('hw', nw)} AS rw FROM e WHERE NOT base_failed GROUP BY lg),
b AS (
  SELECT doc_id, base_failed, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, hc[{Q.SYMBOLS + 1}] AS n_symbols,
    (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD}))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {_WORD})))))::BIGINT AS n_dup_lines,
    n::BIGINT AS n_repeat_words, list_sum(hc) AS size, {distance('hc', 'rc', nc)} AS dc, {distance('hw', 'rw', nw)} AS dw
  FROM e LEFT JOIN refs USING (lg))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (size >= {Q.MIN_CHARS} AND dc > {Q.MAX_CHAR_DISTANCE}) AND NOT (n_words >= {Q.MIN_WORDS} AND dw > {Q.MAX_WORD_DISTANCE}) AS kept FROM b
"""


ORACLES = {"op1_decontaminate": OP1, "op4_quality": _quality(), "op10_substring_dedup": OP10}
