from pyspark.sql import functions as F

from quillmesh.functions import lexicon as L
from quillmesh.functions import text as N


def one(spark, column, value, name="x"):
    return spark.createDataFrame([(value,)], f"{name} string").select(column.alias("y")).first()[0]


def test_normal_form(spark):
    cases = {"limittedd": "limited", "1100 Street": "10 stret", "Café  ÉTÉ-ß": "cafe ete s", "": "", None: ""}
    for value, expected in cases.items():
        assert one(spark, N.norm_text("x"), value) == expected


def test_legal_forms(spark):
    assert one(spark, N.legal_mask("x"), "acme l l c") == L.LEGAL_BIT["llc"]
    assert one(spark, N.legal_mask("x"), "acme ltd corp") == L.LEGAL_BIT["ltd"] | L.LEGAL_BIT["corp"]
    assert one(spark, N.legal_mask("x"), None) == 0


def test_core_falls_back(spark):
    core = lambda v: one(spark, N.core_tokens("t"), v, "x") if False else spark.createDataFrame([(v.split(),)], "t array<string>").select(N.core_tokens("t")).first()[0]
    assert core("the acme ltd") == ["acme"]
    assert core("the ltd") == ["ltd"]
    assert core("the of") == ["the", "of"]


def test_addresses_and_states(spark):
    df = spark.createDataFrame([("5 Main Road, Texas 12",), ("",), (None,)], "business_address string").withColumn("business_name", F.lit("a")).withColumn("x", F.lit(1))
    rows = N.normalize(df).select("addr", "digits", "state").collect()
    assert [tuple(r) for r in rows] == [("5 main rd texas 12", "512", "tx"), ("", "", ""), ("", "", "")]
    raw = spark.createDataFrame([("US", "1 A St, Austin, tx"), ("India", "x, Tamil Nadu"), ("US", None)], "c string, a string").select(N.raw_state(F.col("c"), "a")).collect()
    assert [r[0] for r in raw] == ["TX", "tamil nadu", ""]


def test_scripts(spark):
    assert one(spark, N.has_indic("x"), "नमस्ते") is True
    assert one(spark, N.has_indic("x"), "plain é") is False
    spelt = {"लिमिटेड": "limited", "भारत उद्योग": "bharat udyog", "ಕರ್ನಾಟಕ": "karnatak", "தமிழ்": "tamil", "ऐश औरत १२३": "ais aurat 123", "संग दुःख": "sang duhkh", "Café ड": "cafe d"}
    for text, expected in spelt.items():
        assert one(spark, N.norm_text("x"), text) == expected
    row = spark.createDataFrame([("भारत लिमिटेड", "१२ मेन रोड")], "business_name string, business_address string")
    assert tuple(N.normalize(row).select("name", "core", "addr", "digits").first()) == ("bharat limited", "bharat", "12 men rod", "12")


def test_small_functions(spark):
    assert one(spark, N.parse_ids("x"), " a,b ,,a") == ["a", "b"]
    assert [one(spark, N.match_count("x"), v) for v in ("", None, "a", "a,b")] == [0, 0, 1, 2]
    assert one(spark, N.id_code(F.col("x")), "S2-17") == 200_000_000_017
    assert one(spark, N.encoder_text(F.lit(" A "), F.col("x")), " B ") == "query: A, B"
    assert one(spark, N.rank_bucket(F.col("x").cast("int")), "24") == "<=24"
    assert one(spark, N.rank_bucket(F.col("x").cast("int")), None) == "none"
