"""Linkage records derived from ``documents``: three sources that are rewritings of each other, truth known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Some names of source 2 are written in these letters.
DEVANAGARI = ("abcdefghijklmnopqrstuvwxyz", "\u0905\u092c\u091a\u0926\u090f\u092b\u0917\u0939\u0907\u091c\u0915\u0932\u092e\u0928\u0913\u092a\u0915\u0930\u0938\u0924\u0909\u0935\u0935\u0915\u092f\u091c")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, src, country, business_name, business_address), src 1 to 3."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.split(F.trim(F.substring("text", 1, 300)), r"\s+").alias("w")).where(F.size("w") >= 6)
    base = docs.select(
        "doc_id",
        F.when(F.col("lang") == "en", "US").when(F.col("lang") == "fr", "France").otherwise("India").alias("country"),
        (100 + F.col("doc_id") * 37 % 9000).alias("num"),
        *[F.get("w", F.lit(i)).alias(f"w{i + 1}") for i in range(6)],
    )
    d = F.col("doc_id")
    one = base.where(d % 4 != 3).select(F.lit(1).alias("src"), d, "country", F.concat_ws(" ", "w1", "w2", "w3").alias("business_name"), F.concat_ws(" ", F.col("num").cast("string"), "w4", "w5", F.lit("road"), "w6").alias("business_address"))
    plain = F.concat_ws(" ", "w1", "w3", "w2")
    name = F.concat_ws(" ", F.when(d % 13 == 5, F.translate(F.lower(plain), *DEVANAGARI)).otherwise(plain), F.lit("ltd"))
    two = base.where(d % 5 != 0).select(F.lit(2), d, "country", name, F.when(d % 7 == 0, "").otherwise(F.concat_ws(" ", F.col("num").cast("string"), "w5", "w4", F.lit("rd"), "w6")))
    number = F.when(d % 11 == 0, F.col("num") + 10).otherwise(F.col("num"))
    three = base.where(d % 3 != 0).select(F.lit(3), d, "country", F.concat_ws(" ", F.lit("the"), "w1", F.concat("w2", F.expr("right(w2, 1)")), "w3"), F.concat_ws(" ", F.concat(F.lit("0"), number.cast("string")), "w4", "w5", F.lit("road")))
    rows = one.union(two).union(three)
    return rows.select(F.concat(F.lit("S"), F.col("src").cast("string"), F.lit("-"), d.cast("string")).alias("entity_id"), "src", "country", "business_name", "business_address")


def truth(recs: DataFrame) -> DataFrame:
    """(q_id, rec_id): records of sources 2 and 3 that come from the same document as one of source 1."""
    key = F.substring("entity_id", 4, 30)
    ones = recs.where("src = 1").select(key.alias("d"), F.col("entity_id").alias("q_id"))
    return ones.join(recs.where("src > 1").select(key.alias("d"), F.col("entity_id").alias("rec_id")), "d").select("q_id", "rec_id")
