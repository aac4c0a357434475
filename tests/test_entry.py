import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["normalize_records", "budget_select", "sparse_union", "dense_fill", "resolve_margin", "f05_report", "average_precision"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_against_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    expected = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)

    def rows(df):
        plain = lambda v: v if isinstance(v, str) else None if v != v else round(float(v), 5)
        return sorted(map(repr, (tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))))

    assert rows(got) == rows(expected)


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_names_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], capture_output=True, text=True, cwd=entry.ROOT)
    assert done.returncode == 0, done.stderr
