import math
import random

import pytest
from pyspark.sql import functions as F

from acrelens.operators.quantile import exact_quantiles

ROWS = "g string, x double, n string, v int, salt int"


def by_hand(values, share):
    s = sorted(values)
    at = share * (len(s) - 1)
    a, b = s[math.floor(at)], s[math.ceil(at)]
    return a if a == b or at == math.floor(at) else (1 - (at - math.floor(at))) * a + (at - math.floor(at)) * b


def table(spark, groups):
    return spark.createDataFrame([(g, x, "n", 1, 2) for g, xs in groups.items() for x in xs], ROWS)


def found(df, share=0.5):
    return {r["g"]: (r["n"], r["quantile"]) for r in df.collect() if r["share"] == share}


def test_quantiles_are_exact_whatever_the_spread(spark):
    rng = random.Random(4)
    groups = {
        "hot": [rng.lognormvariate(0, 4) * rng.choice((-1, 1)) for _ in range(9_000)],
        "tie": [7.0] * 4_000 + [rng.random() for _ in range(600)],
        "far": [10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "even": [1.0, 2.0] * 50,
        "one": [3.5],
        None: [float(i) for i in range(40)],
    }
    df = table(spark, {**groups, "none": [None, None]}).unionByName(table(spark, {"hot": [None] * 20})).repartition(5)
    out = exact_quantiles(df, ["g"], F.col("x"), (0.9, 0.5, 0.505), few=12)
    for share in (0.5, 0.505, 0.9):
        got = found(out, share)
        assert got.pop("none") == (0, None)
        assert got == {g: (len(xs), by_hand(xs, share)) for g, xs in groups.items()}


def test_quantiles_at_the_ends_without_keys_and_of_nothing(spark):
    df = table(spark, {"a": [float(i % 50) for i in range(300)] + [math.inf, -math.inf]})
    ends = {r["share"]: r["quantile"] for r in exact_quantiles(df, [], F.col("x"), (0, 1), few=4).collect()}
    assert ends == {0.0: -math.inf, 1.0: math.inf}
    assert exact_quantiles(df.limit(0), ["g"], F.col("x")).count() == 0
    assert exact_quantiles(df.limit(0), [], F.col("x")).count() == 0
    with pytest.raises(ValueError):
        exact_quantiles(df, ["n"], F.col("x"))


def test_nan_comes_last(spark):
    df = table(spark, {"a": [math.nan] * 30 + [1.0, 2.0, 3.0]})
    out = exact_quantiles(df, ["g"], F.col("x"), (0.0, 0.5), few=4)
    assert found(out, 0.0)["a"] == (33, 1.0)
    assert math.isnan(found(out)["a"][1])


def test_median_equals_the_built_in_one(spark):
    df = spark.range(0, 60_000, numPartitions=6).select(F.when(F.col("id") % 10 < 9, "a").otherwise("b").alias("g"), ((F.col("id") * 7919) % 60_013 / 7).alias("x"))
    built_in = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("x").alias("m")).collect()}
    assert {g: q for g, (_, q) in found(exact_quantiles(df, ["g"], F.col("x"))).items()} == built_in
