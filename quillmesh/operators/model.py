"""The learned matcher: gradient-boosted trees on Spark ML, out-of-fold scores, isotonic calibration and its measures."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KINDS = {
    "gbt": lambda rounds: GBTClassifier(labelCol="label", featuresCol="features", maxDepth=5, maxIter=rounds, stepSize=0.1, subsamplingRate=0.8, seed=1),
    "gbt_deep": lambda rounds: GBTClassifier(labelCol="label", featuresCol="features", maxDepth=7, maxIter=max(2, rounds // 2), stepSize=0.1, subsamplingRate=0.8, seed=2),
    "forest": lambda rounds: RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=2 * rounds, maxDepth=8, seed=3),
}


def assemble(pairs: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(pairs)


def fit(pairs: DataFrame, columns: list[str], kind: str = "gbt", rounds: int = 20, holdout: str | None = None):
    """A classifier on label and columns. With ``holdout`` (a boolean column, for boosted trees) no tree is added once
    those rows' loss no longer falls."""
    learner = KINDS[kind](rounds)
    if holdout:
        learner = learner.setValidationIndicatorCol(holdout).setParams(validationTol=0.001)
    return learner.fit(assemble(pairs.withColumn("label", F.col("label").cast("double")), columns))


def predict(model, pairs: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with raw, the probability of label 1."""
    out = model.transform(assemble(pairs, columns))
    return out.withColumn("raw", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def save(model, path: str) -> None:
    """A classifier or calibrator, in Spark ML's own format."""
    model.write().overwrite().save(path)


def load(path: str, kind: str = "gbt"):
    """What ``save`` wrote; kind is one of KINDS or ``isotonic``."""
    classes = {"isotonic": IsotonicRegressionModel, "forest": RandomForestClassificationModel}
    return classes.get(kind, GBTClassificationModel).load(path)


def final_rounds(best: list[int]) -> int:
    """Rounds of the final model from the best rounds of its folds."""
    return int(sum(best) / len(best) * (1 + 1 / len(best)))


def out_of_fold(pairs: DataFrame, columns: list[str], k: int, kind: str = "gbt", rounds: int = 20, holdout: str | None = None) -> DataFrame:
    """``pairs`` (with fold) scored by models that have not seen their fold."""
    out = None
    for fold in range(k):
        model = fit(pairs.where(F.col("fold") != fold), columns, kind, rounds, holdout)
        part = predict(model, pairs.where(F.col("fold") == fold), columns)
        out = part if out is None else out.unionByName(part)
    return out


def calibrate(scored: DataFrame):
    """An isotonic map from raw to label."""
    df = assemble(scored.select(F.col("label").cast("double").alias("label"), "raw"), ["raw"])
    return IsotonicRegression(labelCol="label", featuresCol="features").fit(df)


def calibrated(model, scored: DataFrame) -> DataFrame:
    out = model.transform(assemble(scored, ["raw"]))
    return out.withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))).drop("features", "prediction")


def blend(scored: DataFrame, columns: list[str], name: str = "score") -> DataFrame:
    """The mean of score columns."""
    return scored.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))


def average_precision(scored: DataFrame, score: str = "score") -> DataFrame:
    """(n, n_pos, ap, roc_auc): the step sum of precision over gains in recall, and the chance that a positive stands
    above a negative; equal scores are one threshold.

    Scores are first counted by value; running counts over values are taken within score ranges and joined to the
    ranges' totals, so that no task orders all rows. The ranges are those of scores in [0, 1]; scores beyond fall into
    the outer ones.
    """
    levels = scored.groupBy(F.round(score, 6).alias("s")).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    levels = levels.withColumn("b", F.floor(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)) * 256))
    blocks = levels.groupBy("b").agg(F.sum("n").alias("bn"), F.sum("p").alias("bp"))
    before = W.partitionBy().orderBy(F.desc("b")).rowsBetween(W.unboundedPreceding, -1)  # 257 rows for scores in [0, 1]
    blocks = blocks.select("b", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("an"), F.coalesce(F.sum("bp").over(before), F.lit(0)).alias("ap"))
    w = W.partitionBy("b").orderBy(F.desc("s"))
    rows = levels.join(F.broadcast(blocks), "b").select("n", "p", (F.col("an") + F.sum("n").over(w)).alias("cn"), (F.col("ap") + F.sum("p").over(w)).alias("cp"))
    sums = rows.agg(F.sum("n").alias("n"), F.sum("p").alias("n_pos"), F.sum(F.col("p") * F.col("cp") / F.col("cn")).alias("s"), F.sum(F.col("p") * (F.col("cn") - F.col("cp") - (F.col("n") - F.col("p")) / 2)).alias("above"))
    both = F.col("n_pos") * (F.col("n") - F.col("n_pos"))
    auc = F.round(F.when(both > 0, 1 - F.col("above") / both), 6)
    return sums.select("n", "n_pos", F.round(F.when(F.col("n_pos") > 0, F.col("s") / F.col("n_pos")).otherwise(0.0), 6).alias("ap"), auc.alias("roc_auc"))


def calibration_table(scored: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, actual) between exact quantiles; a value on an edge counts on both sides."""
    cuts = scored.agg(F.percentile(score, F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("q")).select(F.posexplode("q").alias("bin", "lo"), "q")
    cuts = cuts.select("bin", "lo", F.get("q", F.col("bin") + 1).alias("hi")).where("hi IS NOT NULL")
    rows = scored.select(score, "label").join(F.broadcast(cuts), (F.col(score) >= F.col("lo")) & (F.col(score) <= F.col("hi")))  # as many rows as bins
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("actual"))


def importances(model, columns: list[str], spark) -> DataFrame:
    values = sorted(zip(model.featureImportances.toArray().tolist(), columns), reverse=True)
    return spark.createDataFrame([(c, float(v)) for v, c in values], "feature string, gain double")
