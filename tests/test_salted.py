import random
from collections import defaultdict

import pytest

from graphweave.operators.salted import heavy_keys, salted_aggregate

AGGS = {"n": ("count", None), "c": ("count", "v"), "s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "m": ("avg", "v"), "d": ("count_distinct", "w")}


def brute(rows):
    by = defaultdict(list)
    for k, v, w in rows:
        by[k].append((v, w))
    out = {}
    for k, x in by.items():
        v = [a for a, _ in x if a is not None]
        out[k] = (len(x), len(v), sum(v) if v else None, min(v, default=None), max(v, default=None), sum(v) / len(v) if v else None, len({b for _, b in x if b is not None}))
    return out


def test_against_brute_force_with_a_hot_key(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", None, ""]), r.choice([None, 1, 2, 3, 50]), r.choice([None, "x", "y", "z"])) for _ in range(3000)]
    rows += rows[:100]  # repeated rows
    df = spark.createDataFrame(rows, "k string, v int, w string").withColumnRenamed("k", "__salted").withColumnRenamed("__salted", "k")
    got = {x[0]: tuple(x)[1:] for x in salted_aggregate(df, ["k"], AGGS, heavy_share=0.05, salts=8).collect()}
    assert got == brute(rows)


def test_two_keys_and_no_heavy_key(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (1, None, 7), (None, None, 1)], "k int, j string, v int")
    got = {tuple(x)[:2]: tuple(x)[2:] for x in salted_aggregate(df, ["k", "j"], {"n": ("count", None), "s": ("sum", "v")}, heavy_share=1.0).collect()}
    assert got == {(1, "a"): (2, 10), (1, None): (1, 7), (None, None): (1, 1)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, v int, w string")
    assert salted_aggregate(df, ["k"], AGGS).collect() == []


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([("a", 1, 9, 9), ("a", 2, 9, 9)], "k string, v int, __salt int, n int")
    assert [tuple(x) for x in salted_aggregate(df, ["k"], {"n": ("count", None), "s": ("sum", "v")}).collect()] == [("a", 2, 3)]


def test_heavy_keys_are_bounded(spark):
    df = spark.createDataFrame([(i % 3 if i < 90 else i,) for i in range(100)], "k int")
    assert sorted(x[0] for x in heavy_keys(df, ["k"], 0.2).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        heavy_keys(df, ["k"], 0)
    with pytest.raises(ValueError):
        salted_aggregate(df, ["k"], {"x": ("median", "k")})


def test_heavy_key_is_spread_over_salts(spark):
    df = spark.range(4000).selectExpr("'hot' AS k", "id AS v")
    plan = salted_aggregate(df, ["k"], {"n": ("count", None)}, salts=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "xxhash64" in plan
