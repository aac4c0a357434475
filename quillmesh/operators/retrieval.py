"""Candidate retrieval: tokens, document frequencies, field norms, budgeted selection and top-k by field.

Token and posting tables are keyed by (src, token); a query's selected tokens meet the postings in an equi-join, and
the document-frequency ceiling bounds what any token can bring. Ties go by the rounded score, then the record id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import words
from ..sources.scratch import materialize

MAX_DF = 60_000
QUERY_DF = 8_000
NORM_FLOOR = 1e-3


def token_array() -> Column:
    """Name tokens, name 4-grams, address tokens and digit runs of a normalised record, prefixed n, g, a and d."""
    c = F.when(F.length("country") > 0, F.substring("country", 1, 1)).otherwise("?")
    name = F.filter(F.slice(words("core"), 1, 10), lambda x: F.length(x) >= 2)
    joined = F.replace(F.col("core"), F.lit(" "), F.lit(""))
    count = F.least(F.length(joined) - 3, F.lit(16))
    grams = F.when(count >= 1, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.substring(joined, i, F.lit(4)))).otherwise(F.array().cast("array<string>"))
    address = F.slice(F.array_distinct(F.filter(words("addr"), lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\d+$"))), 1, 12)
    runs = F.transform(F.regexp_extract_all("addr", F.lit(r"(\d+)"), F.lit(1)), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    runs = F.slice(F.array_distinct(F.filter(runs, lambda x: F.length(x) >= 2)), 1, 5)

    def marked(prefix: str, a: Column) -> Column:
        return F.transform(a, lambda x: F.concat(F.lit(prefix), c, x))

    return F.concat(*[marked(p, a) for p, a in (("n", F.array_distinct(name)), ("g", F.array_distinct(grams)), ("a", address), ("d", runs))])


def tokens(records: DataFrame) -> DataFrame:
    """(src, entity_id, field, token, pos) of normalised records; pos orders a record's tokens."""
    out = records.select("src", "entity_id", F.posexplode(token_array()).alias("pos", "token"))
    return out.select("src", "entity_id", F.when(F.substring("token", 1, 1).isin("n", "g"), "name").otherwise("addr").alias("field"), "token", "pos")


def vocabulary(toks: DataFrame, records: DataFrame, max_df: int = MAX_DF) -> DataFrame:
    """(src, token, df, idf) of indexed tokens."""
    sizes = records.groupBy("src").agg(F.count("*").alias("n_rec"))
    df = toks.groupBy("src", "token").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    return df.join(F.broadcast(sizes), "src").select("src", "token", "df", F.log(F.col("n_rec") / F.greatest("df", F.lit(1))).alias("idf"))


def norms(toks: DataFrame, vocab: DataFrame, records: DataFrame) -> DataFrame:
    """(src, entity_id, field, norm): root of the sum of squared idf, NORM_FLOOR at least."""
    sums = toks.join(vocab, ["src", "token"]).groupBy("src", "entity_id", "field").agg(F.sum(F.col("idf") * F.col("idf")).alias("s"))
    every = records.select("src", "entity_id", F.explode(F.array(F.lit("name"), F.lit("addr"))).alias("field"))
    return every.join(sums, ["src", "entity_id", "field"], "left").select("src", "entity_id", "field", F.greatest(F.sqrt(F.coalesce("s", F.lit(0.0))), F.lit(NORM_FLOOR)).alias("norm"))


def write_index(folder: str, vocab: DataFrame, postings: DataFrame, norm: DataFrame) -> None:
    """Vocabulary and postings (src, token, entity_id, field) in order of tokens, norms in order of records: a scan for
    some of them skips row groups."""
    for name, table, order in (("vocabulary", vocab, ["src", "token"]), ("postings", postings, ["src", "token"]), ("norms", norm, ["src", "entity_id"])):
        table.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``write_index`` wrote: vocabulary, postings, norms."""
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("vocabulary", "postings", "norms"))


def select_tokens(query: DataFrame, vocab: DataFrame, budget: int, query_df: int = QUERY_DF) -> DataFrame:
    """Each query's rarest known tokens by source and field while the running df is within the budget, the first always."""
    known = query.select(F.col("entity_id").alias("q_id"), "field", "token", "pos").join(vocab.where(F.col("df") <= query_df), "token")
    w = W.partitionBy("q_id", "src", "field").orderBy("df", "pos")
    spent = F.sum("df").over(w.rowsBetween(W.unboundedPreceding, 0))
    ranked = known.withColumn("spent", spent).withColumn("n", F.row_number().over(w))
    return ranked.where((F.col("spent") <= budget) | (F.col("n") == 1)).select("q_id", "src", "field", "token", "df", "idf", "pos", "spent")


def top_k(scored: DataFrame, keys: list[str], k: int, score: str = "score", record: str = "rec_id") -> DataFrame:
    """The first k rows of each group by descending score, then record; rank from 0."""
    w = W.partitionBy(*keys).orderBy(F.desc(score), record)
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def retrieve(selected: DataFrame, toks: DataFrame, norm: DataFrame, k: int) -> DataFrame:
    """(q_id, src, field, rec_id, score, rank): sum of squared idf of shared tokens over the record's norm.

    Queries that have selected the same tokens have the same list, so that each distinct selection meets the postings
    once. One that holds a token beyond the budget holds nothing else: all such selections together meet no posting
    twice, and the hits are in proportion to the rows, however many queries have nothing but a frequent token.
    """
    chosen = selected.groupBy("q_id", "src", "field").agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("chosen"))
    chosen = materialize(chosen, "selections")
    distinct = chosen.groupBy("src", "field", "chosen").agg(F.min("q_id").alias("like"))
    distinct = materialize(distinct, "distinct-selections")
    postings = toks.select("src", "token", F.col("entity_id").alias("rec_id"))
    terms = distinct.select("like", "src", "field", F.inline("chosen"))
    hits = terms.join(postings, ["src", "token"]).groupBy("like", "src", "field", "rec_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("s"))
    scored = hits.join(norm.withColumnRenamed("entity_id", "rec_id"), ["src", "rec_id", "field"])
    scored = scored.select("like", "src", "field", "rec_id", F.round(F.col("s") / F.col("norm"), 6).alias("score"))
    lists = top_k(scored, ["like", "src", "field"], k)
    alike = chosen.join(distinct, ["src", "field", "chosen"]).select("q_id", "src", "field", "like")
    return alike.join(lists, ["like", "src", "field"]).select("q_id", "src", "field", "rec_id", "score", "rank")


def retrieve_combined(query: DataFrame, vocab: DataFrame, toks: DataFrame, budget: int = 1200, k: int = 40) -> DataFrame:
    """The older form: one list per source, weights idf, no norm, the last token may overrun the budget."""
    known = query.select(F.col("entity_id").alias("q_id"), "token", "pos").join(vocab, "token")
    w = W.partitionBy("q_id", "src").orderBy("df", "pos")
    spent = F.sum("df").over(w.rowsBetween(W.unboundedPreceding, -1))
    chosen = known.withColumn("spent", F.coalesce(spent, F.lit(0))).where(F.col("spent") < budget)
    postings = toks.select("src", "token", F.col("entity_id").alias("rec_id"))
    hits = chosen.join(postings, ["src", "token"]).groupBy("q_id", "src", "rec_id").agg(F.round(F.sum("idf"), 6).alias("score"))
    return top_k(hits, ["q_id", "src"], k)


def sparse_union(found: DataFrame) -> DataFrame:
    """(q_id, src, rec_id, blk_name, blk_addr) of both fields' lists, 0.0 where a field has not found the record."""
    side = lambda f: F.coalesce(F.max(F.when(F.col("field") == f, F.col("score"))), F.lit(0.0))
    return found.groupBy("q_id", "src", "rec_id").agg(side("name").alias("blk_name"), side("addr").alias("blk_addr"))
