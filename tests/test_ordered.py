"""Running totals against brute force, hot values included."""

import pytest
from pyspark.sql import functions as F

from adfathom.operators import ordered


@pytest.fixture(params=[250_000, 40], ids=["one-range", "ranges"])
def limit(request, monkeypatch):
    monkeypatch.setattr(ordered, "RANGE_ROWS", request.param)


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_plain_loop(spark, descending):
    values = {float(i * 7 % 101): i % 5 for i in range(101)}
    df = spark.createDataFrame(list(values.items()), "v double, n int").repartition(5)
    got = ordered.running_totals(df, "v", ["n"], descending=descending, following=["n"]).collect()
    keys = sorted(values, reverse=descending)
    run, expected = 0, {}
    for i, key in enumerate(keys):
        run += values[key]
        following = values[keys[i + 1]] if i + 1 < len(keys) else None
        expected[key] = (run, sum(values.values()), following)
    assert {r["v"]: (r["run_n"], r["total_n"], r["next_n"]) for r in got} == expected


@pytest.mark.parametrize("range_rows", [1, 7, 500])
def test_running_totals_do_not_depend_on_the_range_count(spark, range_rows):
    df = spark.range(200).selectExpr("id * 3 AS v", "id % 7 AS n")
    got = {r["v"]: r["run_n"] for r in ordered.running_totals(df, "v", ["n"], range_rows=range_rows).collect()}
    run = 0
    for i in range(200):
        run += i % 7
        assert got[i * 3] == run


def test_running_totals_of_one_and_of_no_rows(spark):
    one = spark.createDataFrame([(4.0, 2)], "v double, n int")
    assert ordered.running_totals(one, "v", ["n"]).head()["run_n"] == 2
    assert ordered.running_totals(one.filter("v > 9"), "v", ["n"]).count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_a_null_key_is_the_lowest(spark, limit, descending):
    rows = [(None, 7)] + [(float(i), i) for i in range(120)]
    df = spark.createDataFrame(rows, "v double, n int")
    got = {r["v"]: r for r in ordered.running_totals(df, "v", ["n"], descending=descending, following=["n"]).collect()}
    total = 7 + sum(range(120))
    assert len(got) == 121 and got[None]["run_n"] == (total if descending else 7)
    assert got[None]["next_n"] == (None if descending else 0)
    assert got[0.0]["next_n"] == (7 if descending else 1)


def test_ranges_follow_the_rows_and_split_long_ids(spark):
    df = spark.range(1000).selectExpr("id + 1152921504606846976 AS v", "1 AS n")
    sizes = [r["count"] for r in ordered.in_ranges(df, "v", range_rows=50).groupBy("_range").count().collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 15 and max(sizes) < 200


def test_order_buckets_keep_infinity_and_long_ids(spark):
    ids = [2**60 + i for i in range(40)]
    df = spark.createDataFrame([(i, 1) for i in ids], "v bigint, n int")
    got = {r["v"]: r["run_n"] for r in ordered.running_totals(df, "v", ["n"]).collect()}
    assert got == {v: i + 1 for i, v in enumerate(ids)}
    inf = spark.createDataFrame([(1.0, 1), (float("inf"), 1), (2.0, 1)], "v double, n int")
    got = {r["v"]: r["run_n"] for r in ordered.running_totals(inf, "v", ["n"]).collect()}
    assert got[float("inf")] == 3
