import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import features as X
from quillmesh.functions import pairwise as B
from quillmesh.functions import similarity as S
from quillmesh.operators import candidates as C
from quillmesh.operators import decisions as D
from quillmesh.operators import diagnostics as G
from quillmesh.operators import model as M
from quillmesh.operators import retrieval as R
from quillmesh.operators import sampling as P
from quillmesh.operators import validate as V
from quillmesh.queries import FEATURES
from quillmesh.sources import sinks, tables

SCORED = "q_id string, src int, rec_id string, score double, label int"


def test_budget_keeps_the_rarest(spark):
    query = spark.createDataFrame([("q", "name", t, i) for i, t in enumerate("abc")], "entity_id string, field string, token string, pos int")
    vocab = spark.createDataFrame([(2, "a", 9000, 0.1), (2, "b", 5000, 0.5), (2, "c", 100, 2.0)], "src int, token string, df long, idf double")
    assert [r.token for r in R.select_tokens(query, vocab, 4000).collect()] == ["c"]


def test_rule(spark):
    rows = spark.createDataFrame([("q", 2, "a", 0.95, 1), ("q", 2, "b", 0.93, 0), ("q", 2, "c", 0.80, 0), ("r", 2, "a", 0.5, 0)], SCORED)
    assert sorted(r.rec_id for r in D.accept(rows, D.Rule(0.9, 0.08, kmax=12)).collect()) == ["a", "b"]
    assert D.accept(rows, D.Rule(0.9, 0.08, tau_single=0.96)).count() == 0
    assert len(D.rule_grid()) > 500


def test_resolution(spark):
    rows = spark.createDataFrame([("S1-1", 2, "a", 0.91, 1), ("S1-2", 2, "a", 0.91, 0), ("S1-1", 2, "b", 0.95, 1), ("S1-3", 2, "b", 0.85, 0), ("S1-3", 3, "c", 0.7, 1)], SCORED)
    kept = lambda v: sorted((r.rec_id, r.q_id) for r in D.resolve(rows, v).collect())
    assert kept("none") == sorted((r.rec_id, r.q_id) for r in rows.collect())
    assert kept("drop_all") == [("c", "S1-3")]
    assert kept("keep_best") == [("a", "S1-1"), ("b", "S1-1"), ("c", "S1-3")]
    assert kept("production") == [("a", "S1-2"), ("b", "S1-1"), ("c", "S1-3")]
    assert kept("margin") == [("b", "S1-1"), ("c", "S1-3")]
    with pytest.raises(ValueError):
        D.resolve(rows, "other")


def test_f_half(spark):
    rows = spark.createDataFrame([(0, 0, 0, 1.0), (0, 1, 0, 0.0), (0, 0, 2, 0.0), (2, 3, 2, 0.714286), (0, 4, 2, 0.0)], "tp int, npred int, n int, e double")
    for r in rows.withColumn("f", F.round(D.f_half(F.col("tp"), F.col("npred"), F.col("n")), 6)).collect():
        assert r.f == r.e


def test_dense_fill(spark):
    sparse = spark.createDataFrame([("q", 2, "a", 1.0, 0.0), ("q", 2, "z", 2.0, 0.0), ("r", 2, "a", 3.0, 0.0)], "q_id string, src int, rec_id string, blk_name double, blk_addr double")
    dense = spark.createDataFrame([("q", 2, "a", 0.9, 0), ("q", 2, "b", 0.7, 1)], "q_id string, src int, rec_id string, cos double, rank int")
    got = {(r.q_id, r.rec_id): (r.blk_name, r.dense_cos, r.dense_rank, r.in_dense) for r in C.with_dense(sparse, dense, 2).collect()}
    assert got == {("q", "a"): (1.0, 0.9, 0.0, 1.0), ("q", "z"): (2.0, 0.7, 2.0, 0.0), ("q", "b"): (0.0, 0.7, 1.0, 1.0), ("r", "a"): (3.0, 0.0, 2.0, 0.0)}


def test_dense_topk_in_blocks(spark, monkeypatch):
    q = spark.createDataFrame([(i, 0, [float(i), 1.0]) for i in range(5)], "q_id long, country int, embedding array<float>")
    p = spark.createDataFrame([(2, i, i % 2, [float(i), -1.0]) for i in range(8)], "src int, rec_id long, country int, embedding array<float>")
    whole = {(r.q_id, r.rec_id, r.rank) for r in C.dense_topk(q, p, 2).collect()}
    monkeypatch.setattr(C, "BLOCK_BYTES", 16)
    assert {(r.q_id, r.rec_id, r.rank) for r in C.dense_topk(q, p, 2).collect()} == whole
    assert {(4, 6, 0), (4, 4, 1)} <= whole and len(whole) == 10
    assert C.dense_topk(q.limit(0), p, 2).count() == 0


def pair(spark, **values):
    base = {"q_id": "q", "src": 2, "rec_id": "r", "country": "US", "q_core": "", "p_core": "", "q_addr": "", "p_addr": "", "q_legal": 0, "p_legal": 0, "q_state": "", "p_state": "", "q_name_rarity": 0.0, "p_addr_sat": 0.0}
    return X.set_features(spark.createDataFrame([tuple((base | values).values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in base.items()))).first()


def test_features(spark):
    f = pair(spark, q_core="ibm", p_core="international business machines", q_legal=1, p_legal=2, q_addr="108 tower st", p_addr="19 tower st")
    assert (f.n_abbrev, f.legal_state, f.streetnum_conflict, f.a_streetnum, f.a_postal) == (1.0, 2.0, 1.0, 0.0, 0.5)
    f = pair(spark, p_legal=2)
    assert (f.legal_state, f.n_empty, f.n_jacc, f.a_empty_p, f.dig_conflict) == (3.0, 1.0, 0.0, 1.0, 0.0)


def test_relative(spark):
    rows = spark.createDataFrame([("q", 2, "a", 0.9), ("q", 3, "b", 0.7), ("q", 3, "c", 0.7), ("r", 2, "a", 0.0)], "q_id string, src int, rec_id string, s0 double").withColumns({"n_tokset": F.col("s0"), "a_tokset": -F.col("s0")})
    got = {(r.q_id, r.rec_id): r for r in X.relative(rows).collect()}
    assert got["q", "c"].s0_rank == 2 and got["q", "c"].s0_rank_src == 1 and got["q", "a"].s0_is_best == 1
    assert got["q", "a"].s0_d_second == 0.2 and got["r", "a"].s0_r_best == 0.0 and got["r", "a"].s0_z == 0.0


def test_splits(spark):
    u = spark.createDataFrame([(f"S1-{i}", "US" if i % 3 else "India", str(i % 2)) for i in range(120)], "q_id string, country string, bucket string")
    s = P.stratified_split(u, 20, 60)
    parts = {r.part: r.n for r in s.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts["val"] == 20 and parts["fit"] == 60
    assert P.disjoint(s.where("part = 'val'"), s.where("part = 'fit'"), "q_id")
    assert P.folds(u).groupBy("fold").count().count() == 5


def test_average_precision(spark):
    rows = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)], "score double, label int")
    assert M.average_precision(rows).first().ap == pytest.approx((1 + 2 / 4) / 2, abs=1e-6)


def test_validation(spark):
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "q_id string")
    match = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-2"), ("S1-9", "X"), ("S1-2", None)], "q_id string, ids string")
    cand = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", ""), ("S1-3", "")], "q_id string, ids string")
    found = {r.rule: r.n for r in V.validate(match, cand, need, spark.createDataFrame([("S2-1",)], "id string")).collect()}
    assert found == {"matching: row without tab": 1, "matching: duplicate row": 1, "matching: repeated id": 1, "matching: match in source 1": 1, "matching: bad prefix": 1, "matching: missing row": 1, "matching: unexpected row": 1, "match outside candidates": 2}
    assert V.validate(cand, None, need).first().rule == "candidates: no file"


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("S1-1", "S2-1", "S2-1,S3-2", "0.900000,0.100000"), ("S1-2", "", "", "")], "q_id string, matched string, candidates string, scores string")
    sinks.write_results(rows, str(tmp_path), 2)
    got = tables.load_truth(spark, f"{tmp_path}/matching_results.tsv").orderBy("q_id").collect()
    assert [(r.q_id, r.ids) for r in got] == [("S1-1", ["S2-1"]), ("S1-2", [])]
    assert [tuple(r) for r in tables.read_scores(spark, f"{tmp_path}/accepted_scores.tsv").collect()] == [("S1-1", "S2-1", 0.9)]
    with pytest.raises(ValueError):
        sinks.write_results(rows, str(tmp_path), 3)
    sinks.write_json(spark, {"tau": 0.9}, f"{tmp_path}/rule.json")
    assert tables.read_config(spark, f"{tmp_path}/rule.json") == {"tau": 0.9}
    sinks.write_once(rows, f"{tmp_path}/once")
    sinks.write_once(rows.limit(0), f"{tmp_path}/once")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 2
    assert tables.read_ids(spark, f"{tmp_path}/candidate_pairs.tsv").count() == 2


def test_dense_topk_keeps_the_best_over_tiles(spark, monkeypatch):
    q = spark.createDataFrame([("q1", 0, [1.0, 0.0]), ("q2", 0, [0.0, 1.0])], "q_id string, country int, embedding array<float>")
    p = spark.createDataFrame([(2, f"r{i}", 0, [float(i % 4), float(-i)]) for i in range(12)], "src int, rec_id string, country int, embedding array<float>").repartition(2)
    monkeypatch.setattr(C, "TILE", 2)
    got = sorted((r.q_id, r["rank"], r.rec_id) for r in C.dense_topk(q, p, 3).collect())
    assert got == [("q1", 0, "r11"), ("q1", 1, "r3"), ("q1", 2, "r7"), ("q2", 0, "r0"), ("q2", 1, "r1"), ("q2", 2, "r2")]


def test_index_is_loaded_as_written(spark, tmp_path):
    vocab = spark.createDataFrame([(2, "a", 3, 0.5), (3, "b", 1, 2.0)], "src int, token string, df long, idf double")
    postings = spark.createDataFrame([(2, "S2-1", "name", "a", 0)], "src int, entity_id string, field string, token string, pos int")
    norm = spark.createDataFrame([(2, "S2-1", "name", 1.0)], "src int, entity_id string, field string, norm double")
    R.write_index(str(tmp_path), vocab, postings, norm)
    for wrote, read in zip((vocab, postings, norm), R.load_index(spark, str(tmp_path))):
        assert read.columns == wrote.columns and sorted(map(tuple, read.collect())) == sorted(map(tuple, wrote.collect()))


def test_equal_folds(spark):
    df = spark.createDataFrame([(f"S1-{i}",) for i in range(503)], "q_id string")
    got = P.equal_folds(df, 4)
    assert sorted(r["count"] for r in got.groupBy("fold").count().collect()) == [125, 126, 126, 126]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, P.equal_folds(df.repartition(7), 4).collect()))


def test_file_findings(spark, tmp_path):
    cases = {"": ["empty file"], "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\n": [], "S1-1\tS2-1\n": ["no header"], "source1_entity_id,matched_entity_ids\nS1-1,S2-1\n": ["commas in place of tabs"]}
    for i, (text, expected) in enumerate(cases.items()):
        path = tmp_path / f"{i}.tsv"
        path.write_text(text)
        assert [r.rule for r in V.file_findings(spark, str(path)).collect()] == [f"matching: {x}" for x in expected]


def test_early_stopping_and_models_on_disk(spark, tmp_path):
    noise = F.pmod(F.xxhash64("id"), F.lit(10)) < 4
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("x"), F.when(noise, (F.col("id") % 7) <= 3).otherwise((F.col("id") % 7) > 3).cast("int").alias("label"), (F.col("id") % 5 == 0).alias("holdout"))
    model = M.fit(rows, ["x"], rounds=60, holdout="holdout")
    assert model.getNumTrees < 60
    M.save(model, str(tmp_path / "m"))
    again = M.load(str(tmp_path / "m"))
    assert sorted(r.raw for r in M.predict(again, rows, ["x"]).collect()) == sorted(r.raw for r in M.predict(model, rows, ["x"]).collect())
    assert M.importances(model, ["x"], spark).first().feature == "x" and M.final_rounds([10, 20]) == 22
    blended = M.blend(rows.withColumn("a", F.lit(0.2)).withColumn("b", F.lit(0.4)), ["a", "b"]).first()
    assert round(blended.score, 6) == 0.3


def test_hashed_grams(spark):
    records = spark.createDataFrame([("a", "acme inc"), ("b", "acme inc"), ("c", ""), ("d", None)], "entity_id string, name string")
    got = {r.entity_id: r.embedding for r in C.encode(records, C.hashed_grams(16), F.col("name"), 16).collect()}
    assert got["a"] == got["b"] and abs(sum(x * x for x in got["a"]) - 1) < 1e-6 and len(got["d"]) == 16


def test_sources(spark, tmp_path):
    folder = tmp_path / "train"
    folder.mkdir()
    (folder / "train_source2.tsv").write_text("entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\tAcme\t\tUS\n")
    got = tables.load_source(spark, str(tmp_path), "train", 2)
    assert [tuple(r) for r in got.collect()] == [("S2-1", "Acme", "", "US", 2)]
    assert tables.load_source(spark, str(tmp_path), "train", 2, ["entity_id"]).columns == ["entity_id", "src"]
    records = spark.createDataFrame([("S1-1", 1), ("S1-2", 1), ("S2-1", 2)], "entity_id string, src int")
    assert [r.entity_id for r in tables.load_queries(records, records.where("entity_id = 'S1-2'")).collect()] == ["S1-2"] and tables.load_queries(records).count() == 2
    (tmp_path / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-4\nS1-2\t\n")
    assert sorted(map(tuple, tables.truth_pairs(tables.load_truth(spark, str(tmp_path / "truth.tsv"))).collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-4")]
    dense = spark.createDataFrame([("S1-1", 2, "x", 0.5, 0), ("S1-1", 2, "y", 0.4, 1), ("S1-2", 2, "x", 0.3, 0)], "q_id string, src int, rec_id string, cos double, rank int")
    dense.write.parquet(str(tmp_path / "dense"))
    assert tables.load_dense(spark, str(tmp_path / "dense"), 1).count() == 2
    assert [r.rec_id for r in tables.load_dense(spark, str(tmp_path / "dense"), 5, spark.createDataFrame([("S1-2",)], "q_id string")).collect()] == ["x"]
    rows = spark.createDataFrame([("S1-1", "S2-1,S2-2", "US", "2")], "q_id string, matched string, country string, bucket string")
    sinks.write_truth(rows, str(tmp_path / "t"), str(tmp_path / "m"))
    assert [r.ids for r in tables.load_truth(spark, str(tmp_path / "t")).collect()] == [["S2-1", "S2-2"]]


def test_alike_selections_meet_the_postings_once(spark, monkeypatch):
    n = 200
    toks = spark.range(n).select(F.lit(2).alias("src"), F.format_string("p%03d", "id").alias("entity_id"), F.lit("name").alias("field"), F.lit("t").alias("token"))
    norm = toks.select("src", "entity_id", "field", F.lit(1.0).alias("norm"))
    chosen = spark.range(n).select(F.format_string("q%03d", "id").alias("q_id"), F.lit(2).alias("src"), F.lit("name").alias("field"), F.lit("t").alias("token"), F.lit(0.5).alias("idf"))
    scored, top_k = [], R.top_k
    monkeypatch.setattr(R, "top_k", lambda table, *more: scored.append(table.count()) or top_k(table, *more))
    rows = R.retrieve(chosen, toks, norm, 3).collect()
    assert scored == [n]  # not n * n
    assert len(rows) == 3 * n and {(r.rec_id, r.rank, r.score) for r in rows} == {("p000", 0, 0.25), ("p001", 1, 0.25), ("p002", 2, 0.25)}


def test_claim_pairs_are_counted_without_pairs(spark):
    place = [("q1", "A", "x"), ("q2", "A", "x"), ("q3", "B", "x"), ("q4", "A", ""), ("q5", "A", "")]
    place = spark.createDataFrame(place, "q_id string, country string, place string")
    rows = spark.createDataFrame([(q, 2, r, 0.9, 0) for q, r in [("q1", "a"), ("q2", "a"), ("q2", "a"), ("q3", "a"), ("q4", "a"), ("q5", "a"), ("q1", "b")]], SCORED)
    found = G.claim_pairs(rows, place)
    assert {r.kind: r.n for r in found.collect()} == {"same": 1, "different": 2, "unknown": 7}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # the place of each claim


def test_only_asked_features_are_made(spark):
    from quillmesh import queries as Q

    p = Q.Plan(spark, "/root/testdata/sf0.001")
    assert p.scored().columns == Q.PAIR and p.scored() is p.scored()
    assert p.accepted("n_contain").columns == [*Q.PAIR, "n_contain"]


def test_dense_topk_brings_no_more_than_the_lists_together(spark):
    rng = np.random.default_rng(3)
    vectors = lambda n: [[float(x) for x in v] for v in rng.integers(-3, 4, (n, 8))]
    queries, pool = vectors(30), vectors(900)
    pool[500:520] = [pool[0]] * 20  # equal products go by id
    q = spark.createDataFrame([(f"q{i}", i % 2, v) for i, v in enumerate(queries)], "q_id string, country int, embedding array<float>")
    p = spark.createDataFrame([(2, f"r{i}", i % 2, v) for i, v in enumerate(pool)], "src int, rec_id string, country int, embedding array<float>").repartition(3)
    found = C.dense_topk(q, p, 4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # tasks hold queries, not parts of the pool, and have their final lists
    want = set()
    for i, v in enumerate(queries):
        near = sorted((-round(float(np.dot(v, w)), 6), f"r{j}") for j, w in enumerate(pool) if j % 2 == i % 2)[:4]
        want |= {(f"q{i}", 2, r, -d, k) for k, (d, r) in enumerate(near)}
    assert {tuple(r) for r in found.collect()} == want
    huge = spark.createDataFrame([(2, f"r{i}", 0, [1e30 * i, 1.0]) for i in range(40)], "src int, rec_id string, country int, embedding array<float>")
    far = spark.createDataFrame([("q", 0, [1e30, 1.0])], "q_id string, country int, embedding array<float>")
    assert [r.rec_id for r in C.dense_topk(far, huge, 2).orderBy("rank").collect()] == ["r39", "r38"]


def test_pair_features_are_those_of_expressions(spark):
    rng = random.Random(2)
    name = lambda: " ".join(rng.choice(("ibm", "international", "business", "machines", "ab", "x", "")) for _ in range(rng.randint(0, 4))).strip()
    address = lambda: " ".join(rng.choice(("0108", "12", "560001", "tower", "st", "near", "temple", "")) for _ in range(rng.randint(0, 5))).strip()
    rows = [(f"q{i // 7:03}", 2 + i % 2, f"r{i}", "US", name(), name(), address(), address(), i % 3, i % 2, "", "ny", 9.0, 1.0, 0.5, 3.5, 0.1, 0.2, rng.choice((0.0, 0.25, 0.5)), 1.0, 1.0, i % 2) for i in range(400)]
    pairs = spark.createDataFrame(rows, "q_id string, src int, rec_id string, country string, q_core string, p_core string, q_addr string, p_addr string, q_legal int, p_legal int, q_state string, p_state string, q_name_rarity double, p_name_rarity double, q_addr_sat double, p_addr_sat double, blk_name double, blk_addr double, dense_cos double, dense_rank double, in_dense double, label int")
    full = S.fuzzy_features(X.set_features(pairs)).withColumn("s0", X.base_score())
    full = X.relative(full, dense="dense_cos").select("q_id", "rec_id", *[F.col(c).cast("double") + F.lit(0.0) for c in FEATURES])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)  # queries that go over the end of a batch
    try:
        got = B.pair_features(pairs, ["q_id", "rec_id"], FEATURES).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == sorted(map(tuple, full.collect()))
