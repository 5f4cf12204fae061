"""Exact percentiles by selection against numpy: hot groups, ties, spread values, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import reports, selection

SHARES = [0.0, 0.013, 0.5, 0.95, 1.0]


def check(spark, data, buffer):
    rows = spark.createDataFrame([(g, v, "x") for g, vs in data.items() for v in vs], "g string, v double, p50 string").repartition(5)
    got = {r.g: r for r in selection.percentiles(rows, "g", "v", SHARES, list("abcde"), buffer).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        kept = [v for v in vs if v is not None]
        for p, name in zip(SHARES, "abcde", strict=True):
            assert got[g][name] == (pytest.approx(np.percentile(kept, 100 * p), rel=1e-12, abs=1e-300) if kept else None), (g, p)


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = {
        "hot": rng.normal(size=9000).tolist(), "two": [1.0] * 2500 + [2.0] * 2500, "one": [7.0] * 3000, "spread": (10.0 ** rng.uniform(-300, 300, 3000)).tolist(),
        "skew": [0.0] * 2900 + rng.uniform(size=100).tolist(), "small": [3.0, 1.0, 2.0], "nulls": [None, None], None: [float(x) for x in range(2000)], "some": [None] * 50 + [5.0, 6.0],
        "signs": [*map(float, range(-1000, 1000)), -0.0],
    }
    check(spark, data, 100)
    check(spark, data, 10_000)


def test_several_rounds(spark):
    rows = spark.range(200_000).select(F.lit("a").alias("g"), F.pmod(F.xxhash64("id"), F.lit(150_001)).cast("double").alias("v"))
    values = np.sort([r.v for r in rows.collect()])
    got = selection.percentiles(rows, "g", "v", [0.5, 0.99], ["m", "n"], 5).first()
    assert (got.m, got.n) == (pytest.approx(np.percentile(values, 50)), pytest.approx(np.percentile(values, 99)))


def test_odd_tables(spark):
    none = spark.createDataFrame([], "g string, v int, found int, k int")
    assert selection.percentiles(none, "g", "v", [0.5]).count() == 0
    rows = spark.createDataFrame([("a", float("nan")), ("a", 1.0), ("a", float("inf")), ("b", 2.0)], "g string, v double")
    for buffer in (1, 100):
        got = {r.g: (r.low, r.most) for r in selection.percentiles(rows, "g", "v", [0.0, 1.0], ["low", "most"], buffer).collect()}
        assert got["a"][0] == 1.0 and np.isnan(got["a"][1]) and got["b"] == (2.0, 2.0)


def test_case_stats_of_a_hot_run(spark):
    rows = spark.range(4000).select((F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 < 5, "hot").otherwise((F.col("id") % 40).cast("string"))).alias("run_id"), (F.xxhash64("id") % 1000).cast("double").alias("latency_ms"))
    rows = rows.select("run_id", "latency_ms", F.lit(True).alias("abstained"), *[F.lit(1).cast("long").alias(c) for c in ("input_tokens", "output_tokens", "context_tokens")], F.lit(None).cast("double").alias("estimated_cost"), F.lit("{}").alias("raw_output"))
    key = lambda r: (r.run_id or "", r.executed_cases, round(r.p50_latency_ms, 9), round(r.p95_latency_ms, 9))
    plain, by_selection = reports.case_stats(rows), reports.case_stats(rows, buffer=100)
    assert plain.columns == by_selection.columns
    assert sorted(map(key, plain.collect())) == sorted(map(key, by_selection.collect()))
