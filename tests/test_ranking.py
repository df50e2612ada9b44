"""Blocks along the order must give what one window over the group gives, with one group holding most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridfare.functions import ranking
from gridfare.functions.ranking import exact_quantiles, order_block, positions, running_sums
from gridfare.session import scratch_path


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 11}", rng.choice([None, *range(-20, 50)]), i) for i in range(3000)]
    rows += [(None, 5, 10_000), (None, 4, 10_001)]
    return spark.createDataFrame(rows, "k string, v int, id long")


def plain(df, keys, order, sums, stats=()):
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({**{n: F.sum(v).over(upto) for n, v in sums.items()}, **{n: a.over(group) for n, a in stats}})


def same(one, other):
    assert sorted(one.collect(), key=str) == sorted(other.select(*one.columns).collect(), key=str)


@pytest.mark.parametrize("keys", [["k"], []])
def test_positions_equal_the_window(skewed, keys):
    same(positions(skewed, keys, ["v", "id"]), plain(skewed, keys, ["v", "id"], {"pos": F.lit(1).cast("long")}))


def test_descending_running_sum(skewed):
    sums = {"s": F.col("id"), "n": F.lit(1).cast("long")}
    same(running_sums(skewed, ["k"], ["v", "id"], sums, descending=True), plain(skewed, ["k"], [F.col("v").desc(), "id"], sums))


def test_sums_with_group_figures(skewed):
    stats = {"n": ("sum", F.lit(1)), "low": ("min", F.col("v"))}
    found = running_sums(skewed, ["k"], ["v", "id"], {"pos": F.lit(1).cast("long")}, stats=stats)
    want = plain(skewed, ["k"], ["v", "id"], {"pos": F.lit(1).cast("long")}, [("n", F.count(F.lit(1))), ("low", F.min("v"))])
    same(found, want)


@pytest.mark.parametrize("name", ["shared beginnings", "one popular value", "all different"])
def test_no_range_holds_far_more_than_the_others(spark, monkeypatch, name):
    """Names with the same twelve characters in front, one value in nine rows of ten, and different names."""
    values = {
        "shared beginnings": lambda i: f"collection-of-images-{i * 7919 % 20_000:06d}", "one popular value": lambda i: "same" if i % 10 else f"n{i}", "all different": lambda i: f"{i * 7919 % 20_000:06d}",
    }[name]
    df = spark.createDataFrame([(values(i), i) for i in range(20_000)], "name string, id long").repartition(8)
    paths = []
    monkeypatch.setattr(ranking, "scratch_path", lambda s, n: paths.append(scratch_path(s, n)) or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = positions(df, [], ["name", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    same(found, plain(df, [], ["name", "id"], {"pos": F.lit(1).cast("long")}))
    held = [r["count"] for r in spark.read.parquet(paths[0]).groupBy(F.shiftright("_line", 33)).count().collect()]
    assert len(held) > 4 and max(held) <= 2 * float(np.median(held))


def test_blocks_follow_the_order_of_every_kind(spark):
    numbers = [float("-inf"), -1e300, -5.5, -1.0, -1e-9, -0.0, 0.0, 1e-9, 0.5, 1.0, 1999.0, 2000.0, 1e12, 1e300, float("inf"), float("nan")]
    rows = [(x, str(i).zfill(14), i) for i, x in enumerate(numbers)] + [(None, None, None)]
    df = spark.createDataFrame(rows, "x double, s string, i long").withColumns({"d": F.expr("date_add('1960-01-01', CAST(i * 900 AS INT))"), "t": F.expr("timestamp_seconds(i * 100000000 - 500000000)")})
    for name in ("x", "s", "i", "d", "t"):
        blocks = [r["b"] for r in df.where(F.col(name).isNotNull()).select(name, order_block(df, name).alias("b")).orderBy(name).collect()]
        assert blocks == sorted(blocks) and None not in blocks
        assert df.where(F.col(name).isNull()).select(order_block(df, name)).first()[0] is None


def test_nothing_runs_when_the_plan_is_built(spark, skewed):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    exact_quantiles(skewed, ["k"], "v", {"m": 0.5})
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before


def test_exact_quantiles(skewed):
    probs = {"q10": 0.1, "q50": 0.5, "q99": 0.99}
    found = {r["k"]: r for r in exact_quantiles(skewed, ["k"], "v", probs).collect()}
    groups: dict = {}
    for row in skewed.where("v is not null").collect():
        groups.setdefault(row["k"], []).append(row["v"])
    assert set(found) == set(groups)
    for key, values in groups.items():
        for name, p in probs.items():
            assert found[key][name] == pytest.approx(np.quantile(values, p))
    whole = exact_quantiles(skewed, [], "v", probs).first()
    assert whole["q50"] == pytest.approx(np.quantile([v for g in groups.values() for v in g], 0.5))
