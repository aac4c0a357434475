import itertools
import random

import duckdb
import pytest

from quillmesh.functions import similarity as S


def slow_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert S.lcs(a, b) == slow_lcs(a, b)


def test_jaro_winkler_against_duckdb():
    rng = random.Random(2)
    con = duckdb.connect()
    for _ in range(150):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randint(1, 10))) for _ in range(2))
        expected = con.execute("SELECT jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0]
        assert S.jaro_winkler(a, b) == pytest.approx(expected, abs=1e-9), (a, b)


def test_token_measures():
    assert S.token_set("a b c", "c a b") == 1.0
    assert S.token_set("new york mets", "new york mets vs atlanta") == 1.0
    assert S.token_set("", "a") == 0.0
    assert S.token_sort("b a", "a b") == 1.0
    assert S.partial("abc", "xxabcxx") == 1.0
    assert S.ratio("ab", "cd") == 0.0


def test_partial_against_every_window():
    rng = random.Random(3)

    def slow(a, b):
        if len(a) > len(b):
            a, b = b, a
        ways = [(a, b), (b, a)] if len(a) == len(b) else [(a, b)]
        return max(S.ratio(x, y[max(0, i) : i + len(x)]) for x, y in ways for i in range(1 - len(x), len(y)))

    for _ in range(300):
        a, b = ("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 16))) for _ in range(2))
        assert S.partial(a, b) == pytest.approx(slow(a, b))


def test_fuzzy_features_of_nulls_and_clashes(spark):
    rows = [("acme inc", "acme", None, "", 1.0), ("", None, "1 main st", "1 main rd", 2.0), ("a b", "b a", "x", "x", 3.0)]
    got = S.fuzzy_features(spark.createDataFrame(rows, "q_core string, p_core string, q_addr string, p_addr string, n_lev double")).collect()
    assert got[0].n_tokset == 1.0 and got[0].a_lev == 0.0 and got[1].n_lev == 0.0 and 0 < got[1].a_lev < 1 and got[2].n_toksort == 1.0


def test_batches_measure_as_single_pairs():
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcé \U0001f600") for _ in range(rng.choice((0, 1, 2, 4, 9, 30, 63, 64, 65, 90))))
    a = [text() for _ in range(400)]
    b = [text() if rng.random() < 0.8 else x for x in a]
    for names in (tuple(S.NAME), tuple(S.ADDRESS)):
        assert S.measures(names, a, b).tolist() == [list(S._measures(names, x, y)) for x, y in zip(a, b)]
    assert S.measures(("n_jw", "n_lev"), [None, "a\0b"], ["x", "a\0b"]).tolist() == [[0.0, 0.0], [1.0, 1.0]]
