"""Accept rules, conflict resolution and F0.5.

Scored pairs are (q_id, src, rec_id, score, label); a query's universe is given beside them, since queries without
candidates count. Everything is windows over one partitioning by query or by record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cardinality_bucket


@dataclass(frozen=True)
class Rule:
    tau: float = 0.90
    delta: float = 0.08
    tau2: float = 0.0
    tau_single: float = 0.0
    kmax: int = 12


def _ranked(scored: DataFrame, *more: str) -> DataFrame:
    w = W.partitionBy("q_id", *more)
    return scored.withColumn("best", F.max("score").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "src", "rec_id")) - 1)


def _passes(tau, delta, tau2, tau_single, kmax) -> Column:
    s, best, rank = F.col("score"), F.col("best"), F.col("rank")
    return (best >= tau_single) & (s >= tau) & (F.round(best - s, 6) <= delta) & ((rank == 0) | (s >= tau2)) & (rank < kmax)


def accept(scored: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The pairs that the rule accepts. Since a query's pairs are sorted, stopping at the first that fails is a filter."""
    return _ranked(scored).where(_passes(*map(F.lit, (rule.tau, rule.delta, rule.tau2, rule.tau_single, rule.kmax)))).drop("best", "rank")


def f_half(tp: Column, npred: Column, ntrue: Column) -> Column:
    """F0.5 of one query from its counts; an empty truth is met by an empty prediction only."""
    p, r = tp / npred, tp / ntrue
    return F.when(ntrue == 0, F.when(npred == 0, 1.0).otherwise(0.0)).when((npred == 0) | (tp == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def per_query(accepted: DataFrame, universe: DataFrame) -> DataFrame:
    """``universe`` (q_id, n_true, ...) with tp, npred and f of each query."""
    counts = accepted.groupBy("q_id").agg(F.sum("label").alias("tp"), F.count("*").alias("npred"))
    df = universe.join(counts, "q_id", "left").withColumns({"tp": F.coalesce("tp", F.lit(0)), "npred": F.coalesce("npred", F.lit(0))})
    return df.withColumn("f", F.round(f_half(F.col("tp"), F.col("npred"), F.col("n_true")), 6))


def universe(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """(q_id, country, n_true, bucket) of all queries."""
    n = truth.groupBy("q_id").agg(F.count("*").alias("n_true"))
    df = queries.select(F.col("entity_id").alias("q_id"), "country").join(n, "q_id", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)))
    return df.withColumn("bucket", cardinality_bucket(F.col("n_true")))


def report(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F, tp, fp, fn, empty predictions, hit singletons, micro precision and recall, over all queries or by stratum."""
    s = lambda c: F.sum(c.cast("long"))
    share = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6)
    tp, pred, true = F.col("tp"), F.col("npred"), F.col("n_true")
    return scores.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.round(F.avg("f"), 6).alias("mean_f"), s(tp).alias("tp"), s(pred - tp).alias("fp"), s(true - tp).alias("fn"), s(pred == 0).alias("empty_predictions"), s((true == 0) & (pred == 0)).alias("singletons_hit"),
        share(tp, pred).alias("precision"), share(tp, true).alias("recall"),
    )


def sweep(spark: SparkSession, scored: DataFrame, queries: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, its parameters, mean_f, mean_pred, empty_share), one row per rule.

    The grid is bounded, so each pair meets the rules it passes and nothing more leaves the join; queries that accept
    nothing are added from their number by truth, not as rows.
    """
    grid = F.broadcast(spark.createDataFrame([(i, r.tau, r.delta, r.tau2, r.tau_single, r.kmax) for i, r in enumerate(rules)], "rule int, tau double, delta double, tau2 double, tau_single double, kmax int"))
    ranked = _ranked(scored).where(F.col("score") >= min(r.tau for r in rules))
    hits = ranked.join(grid, _passes(*map(F.col, ("tau", "delta", "tau2", "tau_single", "kmax"))))
    q = hits.groupBy("rule", "q_id").agg(F.sum("label").alias("tp"), F.count("*").alias("npred")).join(queries.select("q_id", "n_true"), "q_id")
    q = q.withColumn("f", F.round(f_half(F.col("tp"), F.col("npred"), F.col("n_true")), 6))
    sums = q.groupBy("rule").agg(F.sum("f").alias("f"), F.count("*").alias("n"), F.sum("npred").alias("p"), F.sum((F.col("n_true") == 0).cast("long")).alias("e"))
    total = queries.agg(F.count("*").alias("n_q"), F.sum((F.col("n_true") == 0).cast("long")).alias("n_empty"))
    out = grid.join(sums, "rule", "left").crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    f = F.round((zero("f") + F.col("n_empty") - zero("e")) / F.col("n_q"), 6)
    return out.select("rule", "tau", "delta", "tau2", "tau_single", "kmax", f.alias("mean_f"), F.round(zero("p") / F.col("n_q"), 6).alias("mean_pred"), F.round(1 - zero("n") / F.col("n_q"), 6).alias("empty_share"))


def rule_grid() -> list[Rule]:
    """25 taus, 6 deltas, and the two-level thresholds where they are not below tau."""
    taus = [round(0.50 + 0.02 * i, 2) for i in range(25)]
    return [Rule(t, d, t2, ts, k) for t in taus for d in (0.05, 0.08, 0.12, 0.2, 0.3, 1.0) for t2 in (0.0, 0.94) for ts in (0.0, 0.94) for k in (8, 12) if not (t2 and t2 < t) and not (ts and ts < t)]


def resolve(accepted: DataFrame, variant: str, margin: float = 0.05) -> DataFrame:
    """Accepted pairs after records claimed by several queries are settled: ``none`` keeps all, ``drop_all`` no
    contested one, ``keep_best`` the best claim (ties to the least query id), ``margin`` the best claim if it leads by
    ``margin``, ``production`` the best claim with ties to the greatest query id."""
    w = W.partitionBy("src", "rec_id")
    if variant == "none":
        return accepted
    if variant == "drop_all":
        return accepted.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__n")
    order = w.orderBy(F.desc("score"), F.desc("q_id") if variant == "production" else F.asc("q_id"))
    df = accepted.withColumn("__r", F.row_number().over(order))
    if variant == "margin":
        lead = F.col("score") - F.lead("score").over(order)
        return df.withColumn("__l", lead).where((F.col("__r") == 1) & (F.col("__l").isNull() | (F.round("__l", 6) >= margin))).drop("__r", "__l")
    if variant in ("keep_best", "production"):
        return df.where("__r = 1").drop("__r")
    raise ValueError(variant)


def nested_selection(spark: SparkSession, scored: DataFrame, queries: DataFrame, taus: list[float], deltas: list[float], variants: list[str], kmax: int = 12) -> DataFrame:
    """(variant, fold, grid, f_own, f_other): for each fold the grid point with the best mean on the other folds.

    ``queries``: q_id, n_true, fold. Ties go to the first grid point.
    """
    points = [(i, t, d) for i, (t, d) in enumerate((t, d) for t in taus for d in deltas)]
    grid = F.broadcast(spark.createDataFrame(points, "grid int, tau double, delta double"))
    ranked = _ranked(scored).where(F.col("score") >= min(taus))
    hits = ranked.join(grid, (F.col("score") >= F.col("tau")) & (F.round(F.col("best") - F.col("score"), 6) <= F.col("delta")) & (F.col("rank") < kmax)).drop("best", "rank")
    w = W.partitionBy("grid", "src", "rec_id")
    order = w.orderBy(F.desc("score"), "q_id")
    claims = hits.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(order)).withColumn("l", F.round(F.col("score") - F.lead("score").over(order), 6))
    keep = {"none": F.lit(True), "drop_all": F.col("n") == 1, "keep_best": F.col("r") == 1, "margin": (F.col("r") == 1) & (F.col("l").isNull() | (F.col("l") >= 0.05))}
    tags = F.filter(F.array(*[F.when(keep[v], F.lit(v)) for v in variants]), lambda x: x.isNotNull())
    q = claims.select("grid", "q_id", "label", F.explode(tags).alias("variant")).groupBy("variant", "grid", "q_id").agg(F.sum("label").alias("tp"), F.count("*").alias("npred")).join(queries, "q_id")
    q = q.withColumn("f", F.round(f_half(F.col("tp"), F.col("npred"), F.col("n_true")), 6))
    sums = q.groupBy("variant", "grid", "fold").agg(F.sum("f").alias("f"), F.sum((F.col("n_true") == 0).cast("long")).alias("e"))
    folds = queries.groupBy("fold").agg(F.count("*").alias("n"), F.sum((F.col("n_true") == 0).cast("long")).alias("z"))
    frame = grid.select("grid").crossJoin(F.broadcast(folds)).crossJoin(F.broadcast(spark.createDataFrame([(v,) for v in variants], "variant string")))  # grid points x folds x variants
    cells = frame.join(sums, ["variant", "grid", "fold"], "left").withColumn("total", F.coalesce("f", F.lit(0.0)) + F.col("z") - F.coalesce("e", F.lit(0)))
    whole = W.partitionBy("variant", "grid")
    other = F.round((F.sum("total").over(whole) - F.col("total")) / (F.sum("n").over(whole) - F.col("n")), 6)
    cells = cells.withColumn("f_own", F.round(F.col("total") / F.col("n"), 6)).withColumn("f_other", other)
    best = cells.withColumn("r", F.row_number().over(W.partitionBy("variant", "fold").orderBy(F.desc("f_other"), "grid")))
    return best.where("r = 1").select("variant", "fold", "grid", "f_own", "f_other")


def fold_summary(chosen: DataFrame, baseline: str = "none") -> DataFrame:
    """Per variant: mean and sample deviation over folds, and the paired gain and wins against the baseline."""
    base = chosen.where(F.col("variant") == baseline).select("fold", F.col("f_own").alias("b"))
    df = chosen.join(base, "fold")
    d = F.col("f_own") - F.col("b")
    return df.groupBy("variant").agg(F.round(F.avg("f_own"), 6).alias("mean_f"), F.round(F.stddev_samp("f_own"), 6).alias("sd_f"), F.round(F.avg(d), 6).alias("gain"), F.sum((d > 0).cast("long")).alias("wins"))


def submission(candidates: DataFrame, accepted: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query, empties included: ids of accepted pairs, ids of all candidates and the latter's scores."""
    kept = accepted.select("q_id", "rec_id").withColumn("__a", F.lit(True))
    rows = candidates.join(kept, ["q_id", "rec_id"], "left")
    cells = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "rec_id", "score", F.coalesce("__a", F.lit(False)).alias("a"))))
    lists = rows.groupBy("q_id").agg(cells.alias("c"))
    pick = lambda c: F.array_join(F.transform(c, lambda x: x["rec_id"]), ",")
    out = queries.select(F.col("entity_id").alias("q_id")).join(lists, "q_id", "left").withColumn("c", F.coalesce("c", F.array().cast(lists.schema["c"].dataType)))
    return out.select("q_id", pick(F.filter("c", lambda x: x["a"])).alias("matched"), pick(F.col("c")).alias("candidates"), F.array_join(F.transform("c", lambda x: F.format_string("%.6f", x["score"])), ",").alias("scores"))
