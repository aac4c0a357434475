"""The same plans as DuckDB SQL: named common table expressions that ``sql`` puts together as a query needs them."""

from __future__ import annotations

import re

from ..functions import lexicon as L

_DEFS: dict[str, str] = {}
#: The words of a text in order, joined.
SORTED = "array_to_string(list_sort(list_filter(string_split({}, ' '), lambda x: x <> '')), ' ')"


def _map(values: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in values.items()) + "}"


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def define(name: str, text: str) -> None:
    _DEFS[name] = text.strip()


def sql(final: str) -> str:
    """A query over defined tables, with the definitions it needs before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bt_\w+", text)):
            if name not in order:
                need(_DEFS[name])
                order.append(name)

    need(final)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({_DEFS[n]})" for n in order) + "\n" + final


define("t_base", r"""
SELECT doc_id AS d, CASE lang WHEN 'en' THEN 'US' WHEN 'fr' THEN 'France' ELSE 'India' END AS country, 100 + doc_id * 37 % 9000 AS num, w
FROM (SELECT doc_id, lang, regexp_split_to_array(trim(substr(text, 1, 300)), '\s+') AS w FROM documents) WHERE len(w) >= 6""")
define("t_rec", """
SELECT 'S1-' || d AS entity_id, 1 AS src, country, w[1] || ' ' || w[2] || ' ' || w[3] AS business_name, num || ' ' || w[4] || ' ' || w[5] || ' road ' || w[6] AS business_address FROM t_base WHERE d % 4 <> 3
UNION ALL SELECT 'S2-' || d, 2, country, CASE WHEN d % 13 = 5 THEN translate(lower(w[1] || ' ' || w[3] || ' ' || w[2]), 'abcdefghijklmnopqrstuvwxyz', 'अबचदएफगहइजकलमनओपकरसतउववकयज') ELSE w[1] || ' ' || w[3] || ' ' || w[2] END || ' ltd', CASE WHEN d % 7 = 0 THEN '' ELSE num || ' ' || w[5] || ' ' || w[4] || ' rd ' || w[6] END FROM t_base WHERE d % 5 <> 0
UNION ALL SELECT 'S3-' || d, 3, country, 'the ' || w[1] || ' ' || w[2] || right(w[2], 1) || ' ' || w[3], '0' || (num + CASE WHEN d % 11 = 0 THEN 10 ELSE 0 END) || ' ' || w[4] || ' ' || w[5] || ' road' FROM t_base WHERE d % 3 <> 0""")
define("t_truth", "SELECT a.entity_id AS q_id, b.entity_id AS rec_id FROM t_rec a JOIN t_rec b ON substr(a.entity_id, 4) = substr(b.entity_id, 4) WHERE a.src = 1 AND b.src > 1")
# collapse in steps, so that no expression is repeated within itself
_A, _B = L.latin_pairs()


def _clean(c: str) -> str:
    c = f"translate(coalesce({c}, ''), '{_A}', '{_B}')"
    for letter, spelt in L.EXPANSIONS.items():
        c = f"replace({c}, '{letter}', '{spelt}')"
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')"


def _collapse(c: str) -> str:
    return f"trim(array_to_string(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN i = 1 OR {c}[i] <> {c}[i - 1] THEN {c}[i] ELSE '' END), ''))"


def _romanized(c: str) -> str:
    """The inherent vowel by two passes (matches of one do not overlap), then letter by letter."""
    c = f"translate(coalesce({c}, ''), '{_FIRST[0]}', '{_FIRST[1]}')"
    for _ in range(2):
        c = f"regexp_replace({c}, '([क-ह])([ँ-ःअ-औक-ह])', '\\1a\\2', 'g')"
    return f"array_to_string(list_transform(string_split({c}, ''), lambda ch: coalesce(({_map(L.brahmic_letters())})[ch], ch)), '')"


_FIRST = L.first_block()
_INDIC = "[" + "".join(f"\\p{{{x}}}" for x in L.INDIC_SCRIPTS) + "]"
define("t_latin", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN regexp_matches({c}, '{_INDIC}') THEN {_romanized(c)} ELSE {c} END AS {c}" for c in ("business_name", "business_address")) + ") FROM t_rec")
define("t_clean", f"SELECT t_rec.*, {_clean('l.business_name')} AS cn, {_clean('l.business_address')} AS ca FROM t_rec JOIN t_latin l USING (entity_id)")
define("t_flat", f"SELECT * EXCLUDE (cn, ca), {_collapse('cn')} AS name, {_collapse('ca')} AS na FROM t_clean")
define("t_toks", f"SELECT *, list_filter(string_split(name, ' '), lambda x: x <> '') AS toks, list_transform(list_filter(string_split(na, ' '), lambda x: x <> ''), lambda x: coalesce(({_map(L.ADDRESS)})[x], x)) AS atoks FROM t_flat")
define("t_core", f"""
SELECT *, list_filter(toks, lambda x: NOT list_contains({_list([*L.LEGAL, *L.STOP_NAME])}, x)) AS c1, list_filter(toks, lambda x: NOT list_contains({_list(L.STOP_NAME)}, x)) AS c2,
  array_to_string(list_transform(range(1, len(toks) + 1), lambda i: toks[i] || CASE WHEN i < len(toks) AND regexp_full_match(toks[i], '[a-z]') AND regexp_full_match(toks[i + 1], '[a-z]') THEN '' ELSE ' ' END), '') AS glued FROM t_toks""")
define("t_norm", f"""
SELECT entity_id, src, country, business_name, business_address, name, array_to_string(CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 ELSE toks END, ' ') AS core,
  array_to_string(atoks, ' ') AS addr, array_to_string(regexp_extract_all(array_to_string(atoks, ' '), '\\d+'), '') AS digits,
  coalesce(list_filter(list_transform(list_reverse(atoks[-4:]), lambda x: ({_map(L.STATES)})[x]), lambda x: x IS NOT NULL)[1], '') AS state,
  coalesce(list_aggregate(list_filter(list_transform(string_split(glued, ' '), lambda x: ({_map({k: L.LEGAL_BIT[v] for k, v in L.LEGAL.items()})})[x]), lambda x: x IS NOT NULL), 'bit_or'), 0)::INT AS legal FROM t_core""")
define("t_grams", r"""
SELECT src, entity_id, CASE WHEN country <> '' THEN country[1] ELSE '?' END AS c, replace(core, ' ', '') AS j, list_filter(string_split(core, ' ')[1:10], lambda x: length(x) >= 2) AS nt,
  list_filter(string_split(addr, ' '), lambda x: length(x) >= 3 AND NOT regexp_full_match(x, '\d+')) AS ta,
  list_filter(list_transform(regexp_extract_all(addr, '\d+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END), lambda x: length(x) >= 2) AS td FROM t_norm""")
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
define("t_lists", f"""
SELECT src, entity_id, c, {_DISTINCT.format('nt')} AS nt, list_transform(range(1, least(length(j) - 3, 16) + 1), lambda i: substr(j, i, 4)) AS g0, {_DISTINCT.format('ta')}[1:12] AS ta, {_DISTINCT.format('td')}[1:5] AS td FROM t_grams""")
define("t_all", f"""
SELECT src, entity_id, list_concat(list_concat(list_transform(nt, lambda x: 'n' || c || x), list_transform({_DISTINCT.format('g0')}, lambda x: 'g' || c || x)), list_concat(list_transform(ta, lambda x: 'a' || c || x), list_transform(td, lambda x: 'd' || c || x))) AS l FROM t_lists""")
define("t_tok", "SELECT src, entity_id, CASE WHEN l[p][1] IN ('n', 'g') THEN 'name' ELSE 'addr' END AS field, l[p] AS token, p - 1 AS pos FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM t_all)")
define("t_vocab", """
SELECT t.src, token, df, ln(n_rec / greatest(df, 1)) AS idf FROM (SELECT src, token, count(*) AS df FROM t_tok WHERE src > 1 GROUP BY ALL) t
JOIN (SELECT src, count(*) AS n_rec FROM t_norm GROUP BY src) n USING (src) WHERE df <= 60000""")
define("t_norms", """
SELECT r.src, r.entity_id, f.field, greatest(sqrt(coalesce(s, 0)), 0.001) AS norm FROM t_norm r CROSS JOIN (SELECT unnest(['name', 'addr']) AS field) f
LEFT JOIN (SELECT src, entity_id, field, sum(idf * idf) AS s FROM t_tok JOIN t_vocab USING (src, token) GROUP BY ALL) x ON x.src = r.src AND x.entity_id = r.entity_id AND x.field = f.field WHERE r.src > 1""")
define("t_sel", """
SELECT q_id, src, field, token, df, idf, pos, spent FROM (
  SELECT t.entity_id AS q_id, v.src, t.field, t.token, df, idf, pos, sum(df) OVER w AS spent, row_number() OVER w AS n FROM t_tok t JOIN t_vocab v ON t.token = v.token
  WHERE t.src = 1 AND df <= 8000 WINDOW w AS (PARTITION BY t.entity_id, v.src, t.field ORDER BY df, pos ROWS UNBOUNDED PRECEDING)) WHERE spent <= 60 OR n = 1""")
define("t_found", """
SELECT q_id, src, field, rec_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id, src, field ORDER BY score DESC, rec_id) - 1 AS rank FROM (
    SELECT q_id, s.src, s.field, t.entity_id AS rec_id, round(sum(idf * idf) / any_value(n.norm), 6) AS score FROM t_sel s JOIN t_tok t ON t.src = s.src AND t.token = s.token
    JOIN t_norms n ON n.src = t.src AND n.entity_id = t.entity_id AND n.field = s.field GROUP BY q_id, s.src, s.field, t.entity_id)) WHERE rank < 10""")
define("t_union", """
SELECT q_id, src, rec_id, coalesce(max(score) FILTER (WHERE field = 'name'), 0) AS blk_name, coalesce(max(score) FILTER (WHERE field = 'addr'), 0) AS blk_addr FROM t_found GROUP BY q_id, src, rec_id""")


def _jac(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def _con(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) ELSE 0.0 END"


def _cos(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b}))::DOUBLE / sqrt(len({a})::DOUBLE * len({b})) ELSE 0.0 END"


def _agree(a: str, b: str) -> str:
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.5 WHEN {a} = {b} THEN 1.0 ELSE 0.0 END"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END::DOUBLE"


def _toks(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda x: x <> '')"


def _tri(c: str) -> str:
    return f"CASE WHEN length({c}) >= 3 THEN list_distinct(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i, 3))) WHEN length({c}) > 0 THEN [{c}] ELSE [] END"


def _digs(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '\\d+'), lambda x: CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END)"


def _post(c: str) -> str:
    return f"coalesce(list_filter(regexp_extract_all({c}, '\\d+'), lambda x: length(x) IN (5, 6))[1], '')"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) > 0 AND length({b}) > 0 THEN least(length({a}), length({b}))::DOUBLE / greatest(length({a}), length({b})) ELSE 0.0 END"


def _initials(a: str, b: str) -> str:
    return f"(len({a}) = 1 AND length(coalesce({a}[1], '')) >= 2 AND length(coalesce({a}[1], '')) = len({b}) AND {a}[1] = array_to_string(list_transform({b}, lambda t: t[1]), ''))"


define("t_ref", "SELECT entity_id, src, CASE WHEN src = 1 THEN 2 ELSE src END AS ref, core, addr FROM t_norm")
define("t_ctok", "SELECT entity_id, src, ref, unnest(list_distinct(list_filter(string_split(core, ' '), lambda x: x <> ''))) AS token FROM t_ref")
define("t_cdf", "SELECT src AS ref, token, count(*) AS df FROM t_ctok WHERE src > 1 GROUP BY ALL")
define("t_rar", """
SELECT r.entity_id, round(ln(1 + coalesce(m, 0)), 6) AS name_rarity FROM t_ref r
LEFT JOIN (SELECT entity_id, min(coalesce(df, 0)) AS m FROM t_ctok LEFT JOIN t_cdf USING (ref, token) GROUP BY entity_id) USING (entity_id)""")
define("t_sat", """
SELECT r.entity_id, round(ln(1 + coalesce(n, 0)), 6) AS addr_sat FROM t_ref r
LEFT JOIN (SELECT ref, addr, count(*) AS n FROM t_ref WHERE src > 1 AND addr <> '' GROUP BY ALL) USING (ref, addr)""")
define("t_attr", """
SELECT u.*, q.country, q.core AS q_core, q.addr AS q_addr, q.legal AS q_legal, q.state AS q_state, qr.name_rarity AS q_name_rarity, qs.addr_sat AS q_addr_sat,
  p.core AS p_core, p.addr AS p_addr, p.legal AS p_legal, p.state AS p_state, pr.name_rarity AS p_name_rarity, ps.addr_sat AS p_addr_sat
FROM t_union u JOIN t_norm q ON q.entity_id = u.q_id JOIN t_norm p ON p.entity_id = u.rec_id JOIN t_rar qr ON qr.entity_id = u.q_id JOIN t_sat qs ON qs.entity_id = u.q_id
JOIN t_rar pr ON pr.entity_id = u.rec_id JOIN t_sat ps ON ps.entity_id = u.rec_id""")
define("t_arr", f"SELECT *, {_toks('q_core')} AS q, {_toks('p_core')} AS p, {_toks('q_addr')} AS qa, {_toks('p_addr')} AS pa, {_digs('q_addr')} AS qd0, {_digs('p_addr')} AS pd0 FROM t_attr")
define("t_sets", "SELECT *, list_distinct(q) AS qs, list_distinct(p) AS ps, list_distinct(qa) AS qas, list_distinct(pa) AS pas, list_distinct(qd0) AS qds, list_distinct(pd0) AS pds, coalesce(qd0[1], '') AS sq, coalesce(pd0[1], '') AS sp FROM t_arr")
_FEATURES = {
    "n_3gram": _cos(f"({_tri('q_core')})", f"({_tri('p_core')})"),
    "n_jacc": _jac("qs", "ps"),
    "n_contain": _con("qs", "ps"),
    "n_idfw": "CASE WHEN len(qs) > 0 AND len(ps) > 0 THEN coalesce(list_sum(list_transform(list_intersect(qs, ps), lambda x: length(x))), 0)::DOUBLE / greatest(list_sum(list_transform(list_distinct(list_concat(qs, ps)), lambda x: length(x))), 1) ELSE 0.0 END",
    "n_len_ratio": _ratio("q_core", "p_core"),
    "n_ntok_q": "len(qs)::DOUBLE",
    "n_ntok_p": "len(ps)::DOUBLE",
    "n_first_tok": _flag("q_core <> '' AND p_core <> '' AND q[1] = p[1]"),
    "n_last_tok": _flag("q_core <> '' AND p_core <> '' AND q[-1] = p[-1]"),
    "n_empty": _flag("q_core = '' OR p_core = ''"),
    "n_abbrev": _flag(f"{_initials('q', 'p')} OR {_initials('p', 'q')}"),
    "legal_state": "CASE WHEN q_legal = 0 AND p_legal = 0 THEN 0.0 WHEN q_legal = 0 OR p_legal = 0 THEN 3.0 WHEN q_legal & p_legal <> 0 THEN 1.0 ELSE 2.0 END::DOUBLE",
    "a_3gram": _cos(f"({_tri('q_addr')})", f"({_tri('p_addr')})"),
    "a_jacc": _jac("qas", "pas"),
    "a_contain": _con("qas", "pas"),
    "a_dig_jacc": _jac("qds", "pds"),
    "a_dig_any": _flag("len(list_intersect(qds, pds)) > 0"),
    "a_streetnum": _flag("sq <> '' AND sq = sp"),
    "streetnum_conflict": _flag("sq <> '' AND sp <> '' AND sq <> sp"),
    "a_postal": _agree(f"{_post('q_addr')}", f"{_post('p_addr')}") + "::DOUBLE",
    "a_city": _con("list_distinct(qa[-3:])", "list_distinct(pa[-3:])"),
    "a_state": _agree("q_state", "p_state") + "::DOUBLE",
    "a_len_ratio": _ratio("q_addr", "p_addr"),
    "a_empty_q": _flag("q_addr = ''"),
    "a_empty_p": _flag("p_addr = ''"),
    "a_short_p": _flag("length(p_addr) < 12"),
    "a_landmark": _flag(" OR ".join(f"regexp_matches({c}, '\\b({'|'.join(L.LANDMARKS)})\\b')" for c in ("q_addr", "p_addr"))),
    "dig_conflict": "CASE WHEN len(list_distinct(list_concat(qds, pds))) > 0 THEN (len(list_distinct(list_concat(qds, pds))) - len(list_intersect(qds, pds)))::DOUBLE / len(list_distinct(list_concat(qds, pds))) ELSE 0.0 END",
    "generic_and_addr_only": _flag("q_name_rarity > 8.0 AND p_addr_sat > 3.0"),
    "src_s2": _flag("src = 2"),
    "country_id": "CASE country WHEN 'US' THEN 0 WHEN 'India' THEN 1 WHEN 'France' THEN 2 ELSE 3 END::DOUBLE",
}
define("t_feat", "SELECT q_id, src, rec_id, country, blk_name, blk_addr, q_core, p_core, q_addr, p_addr, q_name_rarity, p_name_rarity, q_addr_sat, p_addr_sat, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _FEATURES.items()) + " FROM t_sets")
define("t_scored", "SELECT f.*, round(CASE WHEN a_empty_p > 0.5 THEN 0.92 * n_jacc ELSE 0.62 * n_jacc + 0.38 * a_jacc END, 6) AS score, CASE WHEN t.q_id IS NULL THEN 0 ELSE 1 END AS label FROM t_feat f LEFT JOIN t_truth t ON t.q_id = f.q_id AND t.rec_id = f.rec_id")
define("t_univ", "SELECT entity_id AS q_id, country, coalesce(n, 0) AS n_true, CASE WHEN coalesce(n, 0) >= 3 THEN '3+' ELSE coalesce(n, 0)::VARCHAR END AS bucket, CAST(substr(entity_id, 4) AS BIGINT) % 5 AS fold FROM t_norm LEFT JOIN (SELECT q_id, count(*) AS n FROM t_truth GROUP BY q_id) x ON x.q_id = entity_id WHERE src = 1")
define("t_rank", "SELECT *, max(score) OVER (PARTITION BY q_id) AS best, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, src, rec_id) - 1 AS rank FROM t_scored")
define("t_acc", "SELECT * EXCLUDE (best, rank) FROM t_rank WHERE score >= 0.5 AND round(best - score, 6) <= 0.12 AND rank < 12")
F_HALF = "CASE WHEN n_true = 0 THEN CASE WHEN npred = 0 THEN 1.0 ELSE 0.0 END WHEN npred = 0 OR tp = 0 THEN 0.0 ELSE 1.25 * (tp / npred) * (tp / n_true) / (0.25 * (tp / npred) + tp / n_true) END"
define("t_perq", f"SELECT *, round({F_HALF}, 6) AS f FROM (SELECT u.*, coalesce(tp, 0)::BIGINT AS tp, coalesce(npred, 0)::BIGINT AS npred FROM t_univ u LEFT JOIN (SELECT q_id, sum(label) AS tp, count(*) AS npred FROM t_acc GROUP BY q_id) USING (q_id))")
define("t_claims", "SELECT *, count(*) OVER w AS n_claims, row_number() OVER (w ORDER BY score DESC, q_id) AS r_low, row_number() OVER (w ORDER BY score DESC, q_id DESC) AS r_high, round(score - lead(score) OVER (w ORDER BY score DESC, q_id), 6) AS ahead FROM t_acc WINDOW w AS (PARTITION BY src, rec_id)")
define("t_emb", "SELECT vec_id, vec_id % 3 AS kind, label, embedding::DOUBLE[] AS v FROM embeddings")
define("t_dots", "SELECT q.vec_id AS q_id, CAST(p.kind + 1 AS INT) AS src, p.vec_id AS rec_id, q.label, round(list_inner_product(q.v, p.v), 6) AS cos FROM t_emb q JOIN t_emb p ON p.label = q.label WHERE q.kind = 0 AND p.kind > 0")
define("t_dense", "SELECT q_id, src, rec_id, cos, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id, src ORDER BY cos DESC, rec_id) - 1 AS rank FROM t_dots) WHERE rank < 10")
define("t_near", "SELECT q_id, src, rec_id, round(1.0 / (1 + abs(q_id - rec_id)), 6)::DOUBLE AS blk_name, 0.0::DOUBLE AS blk_addr FROM t_dots WHERE abs(q_id - rec_id) <= 60")
define("t_vtruth", "SELECT q_id, rec_id FROM t_dots WHERE abs(q_id - rec_id) <= 90 AND cos > 0.1")
