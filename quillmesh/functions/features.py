"""Pair features as native column expressions, and the relative features of a query's candidates.

Inputs are the columns of ``operators.candidates.attributed``: q_* and p_* core, addr, legal, state; country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import lexicon as L
from .text import words

DIGITS = 6


def _size(a: Column) -> Column:
    return F.size(a).cast("double")


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), _size(F.array_intersect(a, b)) / F.sqrt(_size(a) * F.size(b))).otherwise(0.0)


def trigrams(c: str | Column) -> Column:
    """Distinct character 3-grams, the whole text where it is shorter; none of an empty one."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.length(c)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).when(n > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def length_weight(a: Column, b: Column) -> Column:
    """Characters of shared tokens over those of all tokens."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda s, t: s + F.length(t)).cast("double")
    return F.when((F.size(a) > 0) & (F.size(b) > 0), total(F.array_intersect(a, b)) / F.greatest(total(F.array_union(a, b)), F.lit(1.0))).otherwise(0.0)


def length_ratio(a: Column, b: Column) -> Column:
    x, y = F.length(a), F.length(b)
    return F.when((x > 0) & (y > 0), F.least(x, y).cast("double") / F.greatest(x, y)).otherwise(0.0)


def digit_runs(c: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))


def postal(c: str) -> Column:
    return F.coalesce(F.get(F.filter(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.length(x).isin(5, 6)), F.lit(0)), F.lit(""))


def agreement(a: Column, b: Column) -> Column:
    """1 equal, 0 different, 0.5 where either is empty."""
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 1.0).otherwise(0.0)


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def initials(a: Column, b: Column) -> Column:
    """Token lists of which one is a single word made of the other's initials."""

    def one(x: Column, y: Column) -> Column:
        word = F.coalesce(F.get(x, F.lit(0)), F.lit(""))
        return (F.size(x) == 1) & (F.length(word) >= 2) & (F.length(word) == F.size(y)) & (word == F.array_join(F.transform(y, lambda t: F.substring(t, 1, 1)), ""))

    return flag(one(a, b) | one(b, a))


def tail3(a: Column) -> Column:
    return F.slice(a, F.greatest(F.size(a) - 2, F.lit(1)), F.lit(3))


def set_features(pairs: DataFrame, only: list[str] | None = None) -> DataFrame:
    """``pairs`` with every feature that needs no string alignment, or those of ``only``."""
    df = pairs.withColumns({"__q": words("q_core"), "__p": words("p_core"), "__qa": words("q_addr"), "__pa": words("p_addr"), "__qd": digit_runs("q_addr"), "__pd": digit_runs("p_addr")})
    df = df.withColumns({f"{x}s": F.array_distinct(x) for x in ("__q", "__p", "__qa", "__pa", "__qd", "__pd")})
    c = F.col
    q, p, qs, ps, qas, pas, qds, pds = map(c, ("__q", "__p", "__qs", "__ps", "__qas", "__pas", "__qds", "__pds"))
    sq, sp = F.coalesce(F.get("__qd", F.lit(0)), F.lit("")), F.coalesce(F.get("__pd", F.lit(0)), F.lit(""))
    union = F.size(F.array_union(qds, pds))
    landmark = r"\b(" + "|".join(L.LANDMARKS) + r")\b"
    country = F.lit(3.0)
    for name, number in L.COUNTRY_ID.items():
        country = F.when(c("country") == name, float(number)).otherwise(country)
    has_q, has_p = c("q_core") != "", c("p_core") != ""
    out = {
        "n_3gram": cosine(trigrams("q_core"), trigrams("p_core")),
        "n_jacc": jaccard(qs, ps),
        "n_contain": containment(qs, ps),
        "n_idfw": length_weight(qs, ps),
        "n_len_ratio": length_ratio(c("q_core"), c("p_core")),
        "n_ntok_q": _size(qs),
        "n_ntok_p": _size(ps),
        "n_first_tok": flag(has_q & has_p & (F.get(q, F.lit(0)) == F.get(p, F.lit(0)))),
        "n_last_tok": flag(has_q & has_p & (F.get(F.reverse(q), F.lit(0)) == F.get(F.reverse(p), F.lit(0)))),
        "n_empty": flag(~has_q | ~has_p),
        "n_abbrev": initials(q, p),
        "legal_state": F.when((c("q_legal") == 0) & (c("p_legal") == 0), 0.0).when((c("q_legal") == 0) | (c("p_legal") == 0), 3.0).when(c("q_legal").bitwiseAND(c("p_legal")) != 0, 1.0).otherwise(2.0),
        "a_3gram": cosine(trigrams("q_addr"), trigrams("p_addr")),
        "a_jacc": jaccard(qas, pas),
        "a_contain": containment(qas, pas),
        "a_dig_jacc": jaccard(qds, pds),
        "a_dig_any": flag(F.arrays_overlap(qds, pds)),
        "a_streetnum": flag((sq != "") & (sq == sp)),
        "streetnum_conflict": flag((sq != "") & (sp != "") & (sq != sp)),
        "a_postal": agreement(postal("q_addr"), postal("p_addr")),
        "a_city": containment(F.array_distinct(tail3(c("__qa"))), F.array_distinct(tail3(c("__pa")))),
        "a_state": agreement(c("q_state"), c("p_state")),
        "a_len_ratio": length_ratio(c("q_addr"), c("p_addr")),
        "a_empty_q": flag(c("q_addr") == ""),
        "a_empty_p": flag(c("p_addr") == ""),
        "a_short_p": flag(F.length("p_addr") < 12),
        "a_landmark": flag(c("q_addr").rlike(landmark) | c("p_addr").rlike(landmark)),
        "dig_conflict": F.when(union > 0, (union - F.size(F.array_intersect(qds, pds))).cast("double") / union).otherwise(0.0),
        "generic_and_addr_only": flag((c("q_name_rarity") > 8.0) & (c("p_addr_sat") > 3.0)),
        "src_s2": flag(c("src") == 2),
        "country_id": country,
    }
    return df.withColumns({k: F.round(v, DIGITS) for k, v in out.items() if only is None or k in only}).drop(*[x for x in df.columns if x.startswith("__")])


SET_FEATURES = "n_3gram n_jacc n_contain n_idfw n_len_ratio n_ntok_q n_ntok_p n_first_tok n_last_tok n_empty n_abbrev legal_state a_3gram a_jacc a_contain a_dig_jacc a_dig_any a_streetnum streetnum_conflict a_postal a_city a_state a_len_ratio a_empty_q a_empty_p a_short_p a_landmark dig_conflict generic_and_addr_only src_s2 country_id".split()
FUZZY = ["n_jw", "n_lev", "n_tokset", "n_toksort", "n_partial", "n_lcs", "a_lev", "a_tokset", "a_toksort"]


#: The features that the blends read.
BASE_SET, BASE_FUZZY = ["n_jacc", "a_jacc", "a_dig_jacc", "a_empty_p"], ["n_jw", "n_tokset", "n_toksort", "a_lev", "a_tokset"]
SET_SCORE = ["n_jacc", "a_jacc", "a_empty_p"]


def base_score() -> Column:
    """The unsupervised blend of name and address similarity; the name alone where the candidate has no address."""
    c = F.col
    name = 0.42 * c("n_tokset") + 0.22 * c("n_toksort") + 0.18 * c("n_jw") + 0.18 * c("n_jacc")
    addr = 0.40 * c("a_tokset") + 0.24 * c("a_jacc") + 0.20 * c("a_dig_jacc") + 0.16 * c("a_lev")
    return F.round(F.when(c("a_empty_p") > 0.5, 0.92 * name).otherwise(0.62 * name + 0.38 * addr), DIGITS)


def set_score() -> Column:
    """A blend of set features only, for plans that are to be checked in SQL."""
    c = F.col
    return F.round(F.when(c("a_empty_p") > 0.5, 0.92 * c("n_jacc")).otherwise(0.62 * c("n_jacc") + 0.38 * c("a_jacc")), DIGITS)


def grouped(value: str, prefix: str) -> dict[str, Column]:
    """Rank, distance to the best, ratio to the best and distance to the second best in a query's candidates."""
    v, whole = F.col(value), W.partitionBy("q_id")
    ordered = whole.orderBy(F.desc(value), "src", "rec_id")
    best = F.max(value).over(whole)
    second = F.nth_value(value, 2).over(ordered.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return {
        f"{prefix}_rank": (F.row_number().over(ordered) - 1).cast("double"),
        f"{prefix}_d_best": F.round(v - best, DIGITS),
        f"{prefix}_r_best": F.round(F.when(best > 1e-6, v / best).otherwise(0.0), DIGITS),
        f"{prefix}_d_second": F.round(v - F.coalesce(second, F.lit(0.0)), DIGITS),
    }


def relative(pairs: DataFrame, anchor: str = "s0", name: str = "n_tokset", address: str = "a_tokset", dense: str | None = None) -> DataFrame:
    """The features of a candidate among its query's candidates of both sources; one exchange by query serves all."""
    whole = W.partitionBy("q_id")
    s, best = F.col(anchor), F.max(anchor).over(whole)
    by_source = W.partitionBy("q_id", "src").orderBy(F.desc(anchor), "rec_id")
    spread, mean = F.stddev_pop(anchor).over(whole), F.avg(anchor).over(whole)
    out = {"n_cands": F.count("*").over(whole).cast("double"), "n_near_best": F.sum(F.when(F.round(s - best, DIGITS) >= -0.05, 1.0).otherwise(0.0)).over(whole)}
    out |= grouped(anchor, "s0")
    for column, prefix in ((name, "nt"), (address, "at"), (dense, "dcos")):
        if column:
            out |= {k: v for k, v in grouped(column, prefix).items() if k.endswith(("_rank", "_d_best"))}
    out |= {
        "s0_rank_src": (F.row_number().over(by_source) - 1).cast("double"),
        "s0_z": F.round(F.when(spread > 1e-6, (s - mean) / spread).otherwise(0.0), 4),
    }
    return pairs.withColumns(out).withColumn("s0_is_best", flag(F.col("s0_rank") == 0))
