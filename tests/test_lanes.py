"""Both lanes give the same results, also on nulls, NaN, integers near the limits of a long, and numbers with exponents."""

from __future__ import annotations

import math

import pytest

from docloom.dynamic.evaluator import evaluate
from docloom.engine import Engine
from docloom.errors import QueryError

BIG = 1 << 62
ROWS = [
    {"id": 0, "n": BIG, "m": 3, "x": 1e300, "s": "straße", "o": {"p": None, "q": [1.5, math.nan]}},
    {"id": 1, "n": -BIG - 5, "m": -7, "x": math.nan, "s": "", "o": {"p": "a\"b\n", "q": []}},
    {"id": 2, "n": (1 << 63) - 1, "m": 2, "x": -0.00001234, "s": "ﬁn É", "o": {"p": "é", "q": [1e16, -1e-7, 12345678.25]}},
    {"id": 3, "n": -(1 << 63), "m": 1, "x": 12345678.0, "s": "B", "o": {"p": "", "q": [0.0001, 1e-300]}},
    {"id": 4, "n": 0, "m": BIG, "x": 0.1, "s": "a", "o": {"p": "x", "q": [math.inf, -math.inf, 1e15, 1e22]}},
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = "id long, n long, m long, x double, s string, o struct<p: string, q: array<double>>"
    return spark.createDataFrame([(r["id"], r["n"], r["m"], r["x"], r["s"], (r["o"]["p"], r["o"]["q"])) for r in ROWS], schema)


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "value",
    ["@.n + @.n", "@.n * 3", "@.n * @.m", "@.n - 7", "-@.n", "2 * @.n + 1", "@.m - @.n * @.n", "str(@.x)", "s_cat(@.x, `|`, @.n)", "s_upper(@.s)", "stringify(@.o)", "stringify(@.o.q)", "str(@.x * 1e-200)", "@.n & 255", "@.x * 2 + 1", "@.n / 3",
     "stringify(@.s)", "str(@.n)", "s_len(@.s)", "@.x == @.x", "isna(@.x)"],
)
def test_values(spark, odd, value, ansi):
    was = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = {r["id"]: r["v"] for r in Engine(spark).query(f"@[:]{{id: @.id, v: {value}}}", odd).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", was)
    expected = {r["id"]: r["v"] for r in evaluate(f"@[:]{{id: @.id, v: {value}}}", ROWS)}
    for i, v in expected.items():
        same = math.isnan(got[i]) if isinstance(v, float) and math.isnan(v) else got[i] == v
        assert same, (i, got[i], v)


@pytest.mark.parametrize("query", ["@[:][@.s < b].id", "@[:][@.s > a].id", "@[:][@.s <= `a`].id", "@[:][@.p < b].id", "@[:][@.p >= a].id", "@[:][@.p != a].id", "@[:].zzz", "sum(@[:].m)", "@[:][@.n * 2 > 0].id"])
def test_filters_with_nulls(spark, query):
    rows = [{"id": i, "s": s, "p": p, "m": i, "n": n} for i, (s, p, n) in enumerate([("a", None, BIG), ("b", "a", 1), ("c", "b", -1), ("a", "c", BIG + 1)])]
    df = spark.createDataFrame([(r["id"], r["s"], r["p"], r["m"], r["n"]) for r in rows], "id long, s string, p string, m long, n long")
    got = sorted(r[0] for r in Engine(spark).query(query, df).collect())
    expected = evaluate(query, rows)
    assert got == sorted(expected if isinstance(expected, list) else [expected])


def test_a_lookup_without_a_partner_fails(spark):
    orders = spark.createDataFrame([(1, 10), (2, 20)], "id long, k long")
    names = spark.createDataFrame([(10, "x")], "k long, name string")
    query = "@[:]{id: @.id, name: at(group_by(names, k), str(@.k))[0].name}"
    with pytest.raises(Exception, match="no group of the key 20"):
        Engine(spark, names=names).query(query, orders).collect()
    assert [tuple(r) for r in Engine(spark, names=names).query(query, orders.where("id = 1")).collect()] == [(1, "x")]


def test_a_quantile_of_nothing_fails(spark):
    df = spark.createDataFrame([([],)], "a array<double>")
    with pytest.raises(Exception, match="a quantile of nothing"):
        Engine(spark).query("@[:]{q: quantile(@.a, 0.5)}", df).collect()
    with pytest.raises(QueryError):
        evaluate("@[:]{q: quantile(@.a, 0.5)}", [{"a": []}])


def test_stringified_columns_keep_nulls(spark):
    from docloom.operators.tabularize import tabularize

    df = spark.createDataFrame([((None, float("nan")),), (None,)], "o struct<a: string, b: double>")
    assert [r["o"] for r in tabularize(df, "s").collect()] == ['{"a":null,"b":NaN}', None]


@pytest.mark.parametrize("query", ["sum(@.v)", "mean(@.v)", "avg(@.v)"])
def test_arrays_add_up_from_first_to_last(spark, query):
    rows = [{"id": 0, "v": [0.1] * 10}, {"id": 1, "v": [1e16, 1.0, -1e16]}, {"id": 2, "v": [-1e16, 1e16, 1.0]}, {"id": 3, "v": []}, {"id": 4, "v": [math.inf, 1.0, -math.inf]}]
    df = spark.createDataFrame([(r["id"], r["v"]) for r in rows], "id long, v array<double>")
    got = {r["id"]: r["x"] for r in Engine(spark).query(f"@[:]{{id: @.id, x: {query}}}", df).collect()}
    expected = {r["id"]: r["x"] for r in evaluate(f"@[:]{{id: @.id, x: {query}}}", rows)}
    by_hand = [((((((((0.1 + 0.1) + 0.1) + 0.1) + 0.1) + 0.1) + 0.1) + 0.1) + 0.1) + 0.1, 0.0, 1.0]
    assert [expected[i] for i in range(3)] == (by_hand if query == "sum(@.v)" else [by_hand[0] / 10, 0.0, 1.0 / 3])
    assert {i: repr(v) for i, v in got.items()} == {i: repr(v) for i, v in expected.items()}
