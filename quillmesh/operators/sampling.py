"""Splits, folds and closed evaluation sets. Every choice is an order of MD5 digests of ids, so it is the same on any
cluster and in any other engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE = 1_000_000


def digest(*keys: str, seed: int = 0) -> Column:
    """The hash of keys and a seed, as hex digits."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def hash_number(*keys: str, seed: int = 0) -> Column:
    """A number of 32 bits from the hash of keys."""
    return F.conv(F.substring(digest(*keys, seed=seed), 1, 8), 16, 10).cast("long")


def hash_share(*keys: str, seed: int = 0) -> Column:
    """A number in [0, 1) from the hash of keys."""
    return F.pmod(hash_number(*keys, seed=seed), F.lit(SCALE)) / SCALE


def sample(df: DataFrame, n: int, key: str = "entity_id", seed: int = 0) -> DataFrame:
    """n rows without replacement, those of the least hashes."""
    return df.orderBy(digest(key, seed=seed), key).limit(n)


def stratified_split(universe: DataFrame, n_val: int, n_fit: int, strata: tuple[str, ...] = ("country", "bucket"), seed: int = 0) -> DataFrame:
    """``universe`` (q_id and strata) with part val, fit or null: proportional shares, one at least, half to even, disjoint."""
    w = W.partitionBy(*strata)
    sizes = universe.groupBy(*strata).agg(F.count("*").alias("__m"))
    sizes = sizes.withColumn("__n", F.sum("__m").over(W.partitionBy()))  # a row per stratum
    share = F.col("__m") / F.col("__n")
    nv = F.least(F.greatest(F.bround(n_val * share).cast("long"), F.lit(1)), F.col("__m"))
    nf = F.least(F.greatest(F.bround(n_fit * share).cast("long"), F.lit(1)), F.col("__m") - nv)
    sizes = sizes.select(*strata, nv.alias("__v"), nf.alias("__f"))
    ranked = universe.withColumn("__r", F.row_number().over(w.orderBy(digest("q_id", seed=seed), "q_id"))).join(F.broadcast(sizes), list(strata))
    part = F.when(F.col("__r") <= F.col("__v"), "val").when(F.col("__r") <= F.col("__v") + F.col("__f"), "fit")
    return ranked.withColumn("part", part).drop("__r", "__v", "__f")


def folds(universe: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``universe`` with fold 0 to k - 1 by the hash of q_id: a query's pairs are always in one fold."""
    return universe.withColumn("fold", F.pmod(hash_number("q_id", seed=seed), F.lit(k)).cast("int"))


def equal_folds(universe: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """``universe`` with folds of equal size (one row more at most): places in the order of hashes, dealt in turn.

    The order is taken within 4096 ranges of the hash, and the ranges' sizes are added up, so that no task orders all.
    """
    df = universe.withColumn("__h", digest("q_id", seed=seed)).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sizes = df.groupBy("__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy().orderBy("__b").rowsBetween(W.unboundedPreceding, -1))  # 4096 rows
    sizes = sizes.select("__b", F.coalesce(before, F.lit(0)).alias("__a"))
    place = F.col("__a") + F.row_number().over(W.partitionBy("__b").orderBy("__h", "q_id")) - 1
    return df.join(F.broadcast(sizes), "__b").withColumn("fold", F.pmod(place, F.lit(k)).cast("int")).drop("__h", "__b", "__a")


def first_entities(entities: DataFrame, n: int, order: str = "entity_id") -> DataFrame:
    """The first n entities in the order of the source."""
    return entities.orderBy(order).limit(n)


def early_stop_holdout(pairs: DataFrame, share: float = 0.1, seed: int = 1) -> DataFrame:
    """``pairs`` with holdout true for a share of the queries."""
    return pairs.withColumn("holdout", hash_share("q_id", seed=seed) < share)


def closed_set(entities: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Entities (entity_id, country, place) of whole places: places in hash order, none larger than half the target, are
    taken while those before hold fewer than the target in their country."""
    places = entities.where("place <> ''").groupBy("country", "place").agg(F.count("*").alias("n")).where(F.col("n") <= target / 2)
    w = W.partitionBy("country").orderBy(digest("place", seed=seed), "place").rowsBetween(W.unboundedPreceding, -1)
    taken = places.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where(F.col("before") < target)
    return entities.join(taken.select("country", "place"), ["country", "place"], "left_semi")


def coverage(entities: DataFrame) -> DataFrame:
    """(country, n, share): share of entities with a place."""
    return entities.groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg((F.col("place") != "").cast("double")), 6).alias("share"))


def disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).intersect(b.select(key)).isEmpty()
