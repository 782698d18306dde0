"""Values at positions, medians and first-k against brute force, hot values and several passes included."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from adfathom.operators import cuts


@pytest.fixture(params=[20_000, 25], ids=["one-pass", "passes"])
def few(request, monkeypatch):
    """With 25 keys to a pass, small tables take as many passes as very large ones."""
    monkeypatch.setattr(cuts, "FEW", request.param)
    if request.param < 100:
        monkeypatch.setattr(cuts, "_sample_size", lambda rows: 120.0)


def hot_values(n=600, seed=3):
    """A third of all rows share one value; the others repeat now and then."""
    rng = random.Random(seed)
    return [5.0 if i % 3 == 0 else float(rng.randrange(0, 150)) for i in range(n)]


@pytest.mark.parametrize("k", [1, 200, 201, 600])
def test_every_kind_of_position(spark, few, k):
    values = hot_values()
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    cut = cuts.cuts(df, [cuts.Order((F.col("v"),), lambda n: {k})])[0][k]
    expected = sorted(values)[k - 1]
    assert (float(cut.texts[0]), cut.before, cut.equal) == (expected, sum(v < expected for v in values), values.count(expected))


def test_many_orders_share_their_passes(spark, few, monkeypatch):
    rng = random.Random(9)
    day = datetime.date(2020, 1, 1)
    rows = [
        (i, rng.randrange(-(2**62), 2**62), rng.gauss(0, 1e9) if i % 4 else float("inf"), "x" * (i % 7) + str(i % 90), i % 3 == 0,
         day + datetime.timedelta(days=i % 400))
        for i in range(4000)
    ]
    df = spark.createDataFrame(rows, "id bigint, h bigint, d double, s string, b boolean, t date").repartition(6)
    keys = [("h",), ("d", "id"), ("s", "h"), ("b", "d", "id"), ("t", "id")]
    orders = [cuts.Order(tuple(F.col(c) for c in k), lambda n: {1, n // 3, n // 2, n}) for k in keys]
    orders.append(cuts.Order((F.col("h"),), lambda n: {n // 2}, F.col("id") % 5 == 0))
    passes = []
    frame = type(df)
    plain = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: passes.append(1) or plain(self))
    found = cuts.cuts(df, orders)
    at = {c: i for i, c in enumerate(("id", "h", "d", "s", "b", "t"))}
    for k, cut in zip(keys, found):
        ordered = sorted(tuple(r[at[c]] for c in k) for r in rows)
        for position in (1, len(rows) // 3, len(rows) // 2, len(rows)):
            assert cut[position].key == tuple(
                (False, v) if c == "d" else v.isoformat() if c == "t" else v for c, v in zip(k, ordered[position - 1])
            )
            assert cut[position].before == sum(o < ordered[position - 1] for o in ordered)
    mine = sorted(r[1] for r in rows if r[0] % 5 == 0)
    assert found[-1][400].key == (mine[399],)
    assert len(passes) == 1 if cuts.FEW == 20_000 else 2 <= len(passes) <= 10


def test_two_passes_do_for_a_hundred_thousand_rows(spark, monkeypatch):
    df = spark.range(100_000).selectExpr("id * 7919 % 100003 AS v", "id % 10 AS hot", "id")
    passes = []
    plain = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda self: passes.append(1) or plain(self))
    orders = [cuts.Order((F.col("v"),), lambda n: {n // 2}), cuts.Order((F.col("hot"), F.col("id")), lambda n: {n // 2})]
    first, second = cuts.cuts(df, orders)
    values = sorted(i * 7919 % 100003 for i in range(100_000))
    assert first[50_000].key == (values[49_999],)
    assert second[50_000].key == (4, 99_994) and second[50_000].before == 49_999
    assert len(passes) <= 3


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    """Brackets without room on either side miss most positions; the result is the same."""
    monkeypatch.setattr(cuts, "FEW", 10)
    monkeypatch.setattr(cuts, "MARGIN", 0.001)
    monkeypatch.setattr(cuts, "_sample_size", lambda rows: 40.0)
    df = spark.range(3000).selectExpr("id * 7919 % 3001 AS v").repartition(3)
    values = sorted(i * 7919 % 3001 for i in range(3000))
    for k in (1, 700, 1500, 2999, 3000):
        assert cuts.cuts(df, [cuts.Order((F.col("v"),), lambda n, k=k: {k})])[0][k].key == (values[k - 1],)


def test_a_position_past_the_end_is_refused(spark):
    df = spark.createDataFrame([(1.0,)], "v double")
    with pytest.raises(ValueError):
        cuts.cuts(df, [cuts.Order((F.col("v"),), lambda n: {2})])


@pytest.mark.parametrize("n", [1, 2, 600])
def test_medians_take_the_middle_and_skip_nulls(spark, few, n):
    values = hot_values(n)
    rows = [(v, v / 3, None) for v in values] + [(None, float("nan"), None)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    got = cuts.exact_medians(df, ["a", "b", "c"])
    assert got["a"] == statistics.median(values)
    assert got["b"] == statistics.median([v / 3 for v in values])
    assert got["c"] == 0.0


@pytest.mark.parametrize("k", [0, 150, 333, 700])
def test_first_k_is_exact_with_hot_ties(spark, few, k):
    rows = list(enumerate(hot_values()))
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(6)
    asked = [cuts.First(k, [-F.col("v"), F.col("id")], 600), cuts.First(k // 2, [F.col("v"), F.col("id")], 300, F.col("id") < 300)]
    falling, rising = cuts.first_k(df, asked)
    got = {r["id"] for r in df.filter(falling).collect()}
    assert got == {i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:k]}
    got = {r["id"] for r in df.filter("id < 300").filter(rising).collect()}
    assert got == {i for i, _ in sorted(rows[:300], key=lambda r: (r[1], r[0]))[: k // 2]}


def test_first_k_refuses_keys_that_leave_a_tie_open(spark, few):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double")
    with pytest.raises(ValueError):
        cuts.first_k(df, [cuts.First(1, [F.col("v")], 3)])


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5])
def test_tied_rows_are_taken_by_their_number(spark, few, k):
    values = [1.0, 1.0, 1.0, 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = cuts.select_first(df, [cuts.First(k, [F.col("v")], 5)])[0]
    got = df.agg(found.total(F.col("v")).alias("s"), (F.count_if(found.sure) + F.lit(found.count)).alias("n")).head()
    assert (got["s"], got["n"]) == (sum(values[:k]), k)
