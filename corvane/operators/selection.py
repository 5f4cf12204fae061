"""Exact percentiles of groups of any size, by selection instead of a buffer of all values.

A group of up to `buffer` rows is sorted by Spark's own aggregate. In a larger one, each wanted rank has a bracket of values that
holds it. A round takes a bounded sketch of the values in the bracket, which gives two values close about the rank, then counts the
values below, at, between and above them; the part that holds the rank is the next bracket. The two are about three
thousandths of the rows apart, however values are spread, and values that many rows share are a part of their own. When
`buffer` rows or one value are left, the rank is read from counts of the distinct values that are left.

Scale: a round is two scans of two narrow columns with map-side combining; what is shuffled is sketches and counts by task and group,
never the rows of a group, so that a group with a third of all rows costs no more than others. Brackets and ranks are one row each.

Cases: nulls in the value take no part, and a group of nothing else has null percentiles; a null group is a group; NaN comes after all
numbers, as Spark orders it; equal values are counted once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.session import written

BUFFER, ACCURACY = 1_000_000, 10_000
#: Each round leaves some thousandths of the rows, so that no table needs more than a few.
ROUNDS = 64


def large_groups(rows: DataFrame, by: str, value: str, buffer: int = BUFFER) -> DataFrame:
    """(by, n) of the groups with more than `buffer` values."""
    return rows.groupBy(by).agg(F.count(value).alias("n")).where(F.col("n") > buffer)


def _by_sorting(rows: DataFrame, by: str, value: str, shares: Sequence[float], names: Sequence[str]) -> DataFrame:
    return rows.groupBy(by).agg(*[F.percentile(F.col(value).cast("double"), p).alias(n) for p, n in zip(shares, names, strict=True)])


def percentiles(rows: DataFrame, by: str, value: str, shares: Sequence[float], names: Sequence[str] | None = None, buffer: int = BUFFER) -> DataFrame:
    """(by, a column for each share): the continuous percentile of each group, interpolated between neighbours in order."""
    names = list(names or [f"p{round(100 * p)}" for p in shares])
    kept = rows.select(by, F.col(value).cast("double").alias(value))
    large = written(large_groups(kept, by, value, buffer), "groups")
    if large.isEmpty():
        return _by_sorting(kept, by, value, shares, names)
    same = lambda a, b: a[by].eqNullSafe(b[by])
    small = _by_sorting(kept.join(large, same(kept, large), "left_anti"), by, value, shares, names)
    found = ranks(kept, large, by, value, shares, buffer)
    picked = found.groupBy(by).agg(*[F.max(F.when(F.col("share") == i, F.col("found"))).alias(n) for i, n in enumerate(names)])
    return small.unionByName(picked)


def ranks(rows: DataFrame, large: DataFrame, by: str, value: str, shares: Sequence[float], buffer: int = BUFFER) -> DataFrame:
    """(by, share: its place, found) of the large groups (by, n)."""
    wanted = F.array(*[F.struct(F.lit(i).alias("share"), F.lit(float(p)).alias("p")) for i, p in enumerate(shares)])
    at = large.select(by, "n", F.explode(wanted).alias("w")).select(by, "w.share", (F.col("w.p") * (F.col("n") - 1)).alias("place"), "n")
    below, above = F.floor("place"), F.ceil("place")
    targets = at.select(by, "share", F.explode(F.array_distinct(F.array(below, above))).alias("rank"), "n")
    values = written(values_at(rows, targets.select(by, "rank", "n").distinct(), by, value, buffer), "found")
    lower = values.select(F.col(by).alias("__g"), F.col("rank").alias("__low"), F.col("found").alias("low"))
    upper = values.select(F.col(by).alias("__h"), F.col("rank").alias("__up"), F.col("found").alias("up"))
    met = at.join(lower, at[by].eqNullSafe(F.col("__g")) & (below == F.col("__low"))).join(upper, at[by].eqNullSafe(F.col("__h")) & (above == F.col("__up")))
    between = (above - F.col("place")) * F.col("low") + (F.col("place") - below) * F.col("up")
    return met.select(by, "share", F.when(F.col("low") == F.col("up"), F.col("low")).otherwise(between).alias("found"))


def values_at(rows: DataFrame, targets: DataFrame, by: str, value: str, buffer: int = BUFFER, accuracy: int = ACCURACY) -> DataFrame:
    """(by, rank, found): the value at each wanted rank (by, rank from 0, n) of its group."""
    key = [by, "rank"]
    state = written(targets.select(by, "rank", F.col("rank").alias("k"), "n", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")), "brackets")
    done: list[DataFrame] = []
    for _ in range(ROUNDS):
        done.append(state.where(_one_value()).select(by, "rank", F.col("lo").alias("found")))
        done.append(_read(rows, state.where(~_one_value() & (F.col("n") <= buffer)), by, value))
        state = state.where(~_one_value() & (F.col("n") > buffer))
        if state.isEmpty():
            break
        state = written(_narrowed(rows, state, by, value, accuracy), "brackets")
    else:
        raise RuntimeError("values could not be told apart")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(*key, "found")


def _one_value():
    return F.col("lo").isNotNull() & (F.col("lo") == F.col("hi"))


def _inside(rows: DataFrame, state: DataFrame, by: str, value: str) -> DataFrame:
    """The values in each bracket, once for each rank that has it; a bracket without ends holds the whole group."""
    named = state.withColumnRenamed(by, "__g")
    inside = F.col("lo").isNull() | F.col(value).between(F.col("lo"), F.col("hi"))
    return rows.where(F.col(value).isNotNull()).join(named, rows[by].eqNullSafe(named["__g"]) & inside).drop("__g")


def _narrowed(rows: DataFrame, state: DataFrame, by: str, value: str, accuracy: int) -> DataFrame:
    """The brackets of the next round, with the rank's place in each and the number of its values."""
    key = [by, "rank", "k", "n"]
    # the sketch takes literal shares, so a grid is asked and the points next but one to the rank are taken, which the sketch's error can't cross
    step = 1 / 1000
    grid = [i * step for i in range(1001)]
    sketch = _inside(rows, state, by, value).groupBy(*key).agg(F.percentile_approx(value, grid, accuracy).alias("at"), F.min(value).alias("least"), F.max(value).alias("most"))
    share = F.col("k") / F.greatest(F.col("n") - 1, F.lit(1))
    first, last = F.floor(share / step).cast("int") - 1, F.floor(share / step).cast("int") + 2
    inner = sketch.select(*key, F.when(first < 0, F.col("least")).otherwise(F.get("at", first)).alias("a"), F.when(last > 1000, F.col("most")).otherwise(F.get("at", last)).alias("b"), F.col("least").alias("lo"), F.col("most").alias("hi"))
    v, part = F.col(value), F.col
    met = _inside(rows, written(inner, "inner"), by, value)
    where = F.when(v < part("a"), 0).when(v == part("a"), 1).when(v < part("b"), 2).when(v == part("b"), 3).otherwise(4)
    counted = met.groupBy(*key, where.alias("part")).agg(F.count("*").alias("size"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # five rows at most
    chosen = counted.withColumn("before", before).where((part("k") >= part("before")) & (part("k") < part("before") + part("size")))
    return chosen.select(by, "rank", (F.col("k") - F.col("before")).alias("k"), F.col("size").alias("n"), "lo", "hi")


def _read(rows: DataFrame, state: DataFrame, by: str, value: str) -> DataFrame:
    """The value at each rank from the counts of the values in its bracket, `buffer` at most."""
    key = [by, "rank", "k"]
    counts = _inside(rows, state, by, value).groupBy(*key, value).agg(F.count("*").alias("times"))
    upto = F.sum("times").over(W.partitionBy(*key).orderBy(value))
    return counts.withColumn("upto", upto).where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("times") <= F.col("k"))).select(by, "rank", F.col(value).alias("found"))
