"""The features of candidate pairs as one Arrow kernel: sets, alignment, the blend and the relative features of a query.

The same numbers as ``features.set_features``, ``similarity.fuzzy_features``, ``features.base_score`` and
``features.relative`` give; strings are cut into words and grams once a batch and counts are turned into features as
arrays, where column expressions make a pair's arrays anew for each feature, and windows sort rows of all columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .features import DIGITS, SET_FEATURES, set_features
from .similarity import ADDRESS, NAME, measures

#: Set features that are made here; the others need no arrays and stay expressions.
OF_SETS = "n_3gram n_jacc n_contain n_idfw n_ntok_q n_ntok_p n_first_tok n_last_tok n_abbrev a_3gram a_jacc a_contain a_dig_jacc a_dig_any a_streetnum streetnum_conflict a_postal a_city dig_conflict".split()
RELATIVE = "n_cands n_near_best s0_rank s0_d_best s0_r_best s0_d_second nt_rank nt_d_best at_rank at_d_best dcos_rank dcos_d_best s0_rank_src s0_z s0_is_best".split()
_RUNS = re.compile(r"[0-9]+")


def half_up(x: np.ndarray, digits: int = DIGITS) -> np.ndarray:
    """Spark's ``round``: halves, by the shortest decimal form, away from zero."""
    y, up = np.round(x, digits), np.abs(x) * 10.0**digits
    tied = np.flatnonzero(np.abs(up - np.floor(up) - 0.5) < 1e-3)
    unit = Decimal(1).scaleb(-digits)
    y[tied] = [float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in x[tied].tolist()]
    return y + 0.0


def _grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)} if len(text) >= 3 else {text} if text else set()


def _common(sets: list[set], q: list[int], p: list[int]) -> np.ndarray:
    return np.fromiter((len(sets[i] & sets[j]) for i, j in zip(q, p)), np.float64, len(q))


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.where(b > 0, a / np.maximum(b, 1e-300), 0.0)


def _numbered(texts: list[str]) -> tuple[list[str], list[int]]:
    """Distinct texts, and the number of each text among them."""
    number: dict[str, int] = {}
    at = [number.setdefault(x, len(number)) for x in texts]
    return list(number), at


def set_counts(q_core: list[str], p_core: list[str], q_addr: list[str], p_addr: list[str]) -> dict[str, np.ndarray]:
    """The features of OF_SETS for lists of normalised names and addresses."""
    n, out = len(q_core), {}
    size = lambda sets, at: np.fromiter(map(len, sets), np.float64, len(sets))[at]

    def shared(sets: list, q: list[int], p: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _common(sets, q, p), size(sets, q), size(sets, p)

    def both(x: tuple) -> np.ndarray:
        return (x[1] > 0) & (x[2] > 0)

    texts, at = _numbered(q_core + p_core)
    q, p = at[:n], at[n:]
    words = [[w for w in t.split(" ") if w] for t in texts]
    sets = [set(w) for w in words]
    met = [sets[i] & sets[j] for i, j in zip(q, p)]
    c, a, b = x = size(met, slice(None)), size(sets, q), size(sets, p)
    out["n_jacc"], out["n_contain"] = np.where(both(x), _ratio(c, a + b - c), 0.0), np.where(both(x), _ratio(c, np.minimum(a, b)), 0.0)
    out["n_ntok_q"], out["n_ntok_p"] = a, b
    letters = np.array([sum(map(len, s)) for s in sets], np.float64)
    held = np.fromiter((sum(map(len, m)) for m in met), np.float64, n)
    out["n_idfw"] = np.where(both(x), held / np.maximum(letters[q] + letters[p] - held, 1.0), 0.0)
    c, a, b = x = shared([_grams(t) for t in texts], q, p)
    out["n_3gram"] = np.where(both(x), _ratio(c, np.sqrt(a * b)), 0.0)
    first, last = [w[0] if w else None for w in words], [w[-1] if w else None for w in words]
    heads = ["".join(x[0] for x in w) for w in words]
    flags = lambda values: np.fromiter(values, np.float64, n)
    out["n_first_tok"] = flags(first[i] is not None and first[i] == first[j] for i, j in zip(q, p))
    out["n_last_tok"] = flags(last[i] is not None and last[i] == last[j] for i, j in zip(q, p))
    one = [len(w) == 1 and len(w[0]) >= 2 for w in words]
    out["n_abbrev"] = flags(one[i] and first[i] == heads[j] or one[j] and first[j] == heads[i] for i, j in zip(q, p))

    texts, at = _numbered(q_addr + p_addr)
    q, p = at[:n], at[n:]
    words = [[w for w in t.split(" ") if w] for t in texts]
    c, a, b = x = shared([set(w) for w in words], q, p)
    out["a_jacc"], out["a_contain"] = np.where(both(x), _ratio(c, a + b - c), 0.0), np.where(both(x), _ratio(c, np.minimum(a, b)), 0.0)
    c, a, b = x = shared([_grams(t) for t in texts], q, p)
    out["a_3gram"] = np.where(both(x), _ratio(c, np.sqrt(a * b)), 0.0)
    c, a, b = x = shared([set(w[-3:]) for w in words], q, p)
    out["a_city"] = np.where(both(x), _ratio(c, np.minimum(a, b)), 0.0)
    runs = [_RUNS.findall(t) for t in texts]
    plain = [[r.lstrip("0") or "0" for r in x] for x in runs]
    c, a, b = x = shared([set(r) for r in plain], q, p)
    union = a + b - c
    out["a_dig_jacc"], out["a_dig_any"], out["dig_conflict"] = np.where(both(x), _ratio(c, union), 0.0), (c > 0).astype(np.float64), _ratio(union - c, union)
    street = [x[0] if x else "" for x in plain]
    out["a_streetnum"] = flags(street[i] != "" and street[i] == street[j] for i, j in zip(q, p))
    out["streetnum_conflict"] = flags(street[i] != "" and street[j] != "" and street[i] != street[j] for i, j in zip(q, p))
    post = [next((r for r in x if len(r) in (5, 6)), "") for x in runs]
    out["a_postal"] = flags(0.5 if not post[i] or not post[j] else post[i] == post[j] for i, j in zip(q, p))
    return {k: half_up(v) for k, v in out.items()}


def base_scores(f: dict[str, np.ndarray]) -> np.ndarray:
    """``features.base_score``."""
    name = 0.42 * f["n_tokset"] + 0.22 * f["n_toksort"] + 0.18 * f["n_jw"] + 0.18 * f["n_jacc"]
    addr = 0.40 * f["a_tokset"] + 0.24 * f["a_jacc"] + 0.20 * f["a_dig_jacc"] + 0.16 * f["a_lev"]
    return half_up(np.where(f["a_empty_p"] > 0.5, 0.92 * name, 0.62 * name + 0.38 * addr))


def _ordered(group: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by group, descending value and place, and each row's rank in its group."""
    order = np.lexsort((-v, group))
    rank = np.empty(len(v), np.int64)
    rank[order] = np.arange(len(v)) - np.searchsorted(group, group)
    return order, rank


def relative(query: np.ndarray, source: np.ndarray, f: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """RELATIVE for whole queries, numbered in ascending order; rows are in order of query, source and record."""
    starts = np.searchsorted(query, np.arange(query[-1] + 1)) if len(query) else np.zeros(0, np.int64)
    count = np.diff(np.append(starts, len(query)))
    best = lambda v: np.maximum.reduceat(v, starts)[query]
    mean = lambda v: (np.add.reduceat(v, starts) / count)[query]
    out, s = {"n_cands": count[query].astype(np.float64)}, f["s0"]
    for v, prefix in ((s, "s0"), (f["n_tokset"], "nt"), (f["a_tokset"], "at"), (f["dense_cos"], "dcos")):
        order, rank = _ordered(query, v)
        out[f"{prefix}_rank"], out[f"{prefix}_d_best"] = rank.astype(np.float64), half_up(v - best(v))
        if prefix == "s0":
            second = np.where(count > 1, v[order][np.minimum(starts + 1, len(v) - 1)], 0.0)
            top = best(v)
            out |= {"s0_r_best": half_up(np.where(top > 1e-6, v / np.where(top > 1e-6, top, 1.0), 0.0)), "s0_d_second": half_up(v - second[query])}
    out["n_near_best"] = np.add.reduceat((out["s0_d_best"] >= -0.05).astype(np.float64), starts)[query]
    each = np.cumsum(np.append(False, (query[1:] != query[:-1]) | (source[1:] != source[:-1])))
    out["s0_rank_src"] = _ordered(each, s)[1].astype(np.float64)
    away = s - mean(s)
    spread = np.sqrt(mean(away * away))
    out["s0_z"] = half_up(np.where(spread > 1e-6, away / np.where(spread > 1e-6, spread, 1.0), 0.0), 4)
    out["s0_is_best"] = (out["s0_rank"] == 0).astype(np.float64)
    return out


def pair_features(pairs: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``keys`` of pairs and ``columns``, all as doubles: any of ``pairs``' own numbers, SET_FEATURES, FUZZY, s0 and RELATIVE.

    ``pairs`` has q_id, src, rec_id, dense_cos and what ``candidates.attributed`` adds. A query's pairs are brought into
    one task while rows are texts, in order; a batch ends with its last whole query, whose rest waits for the next.
    """
    plain = set_features(pairs, [x for x in SET_FEATURES if x not in OF_SETS])
    text = ["q_core", "p_core", "q_addr", "p_addr"]
    own = [c for c in columns if c in plain.columns]
    needed = [*dict.fromkeys([*keys, "q_id", "src", "rec_id", *text, *own, "a_empty_p", "dense_cos"])]
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer for few bytes: the time goes to measures
    rows = plain.select(*needed).repartition(tasks, "q_id").sortWithinPartitions("q_id", "src", "rec_id")

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = {c: batch.column(i) for i, c in enumerate(needed)}
        t = {c: [x or "" for x in of[c].to_pylist()] for c in text}
        f = {c: of[c].cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in {*own, "a_empty_p", "dense_cos"}}
        f |= set_counts(*(t[c] for c in text))
        for names, a, b in ((tuple(NAME), "q_core", "p_core"), (tuple(ADDRESS), "q_addr", "p_addr")):
            f |= dict(zip(names, measures(names, t[a], t[b]).T))
        f["s0"] = base_scores(f)
        ids = of["q_id"].to_pylist()
        query = np.cumsum(np.fromiter((i > 0 and ids[i] != ids[i - 1] for i in range(len(ids))), np.int64, len(ids)))
        f |= relative(query, of["src"].to_numpy(zero_copy_only=False), f)
        return pa.RecordBatch.from_arrays([*(of[k] for k in keys), *(pa.array(np.ascontiguousarray(f[c])) for c in columns)], names=[*keys, *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(needed.index("q_id"))
            last, cut = ids[batch.num_rows - 1].as_py(), batch.num_rows
            while cut and ids[cut - 1].as_py() == last:
                cut -= 1
            before = kept[0].column(needed.index("q_id"))[0].as_py() if kept else last
            if not cut and before == last:
                kept.append(batch)
                continue
            if kept or cut:
                yield made(_joined([*kept, batch.slice(0, cut)]))
            kept = [batch.slice(cut)]
        if kept:
            yield made(_joined(kept))

    schema = T.StructType([*plain.select(*keys).schema.fields, *(T.StructField(c, T.DoubleType()) for c in columns)])
    return rows.mapInArrow(run, schema)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
