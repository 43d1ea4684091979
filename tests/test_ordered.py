"""Chunked helpers give the plain window's answer for any chunk width."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pacelane.operators import ordered


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    rows = []
    for key in range(3):
        t = -500
        for _ in range(150):
            t += rng.choice([1, 2, 3, 50, 400])
            rows.append((key, t, rng.random(), rng.choice([None, 1, 2])))
    return spark.createDataFrame(rows, "k int, t bigint, v double, z int").repartition(5)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[n] for n in names)) for r in df.collect()), key=str)


@pytest.mark.parametrize("chunk", [7, 300, 10**9])
def test_matches_plain_window(series, chunk):
    stages = [lambda w: {"p": F.lag("v").over(w), "n": F.lead("v", 2).over(w)}, lambda w: {"pp": F.lag("p", 2).over(w)}]
    assert rows(ordered.stencil(series, ["k"], ["t"], *stages, back=3, ahead=3, chunk=chunk)) == rows(ordered.stencil(series, ["k"], ["t"], *stages, chunk=None))
    kinds = dict(sums={"s": F.col("z")}, lasts={"l": F.col("z")}, nexts={"x": F.col("z")}, maxima={"m": F.col("z")})
    assert rows(ordered.running(series, ["k"], ["t"], chunk=chunk, **kinds)) == rows(ordered.running(series, ["k"], ["t"], chunk=None, **kinds))
    ranged = lambda r, w: {"low": F.min("v").over(r), "c": F.count("z").over(r)}
    assert rows(ordered.trailing(series, ["k"], "t", ranged, span=60, chunk=chunk)) == rows(ordered.trailing(series, ["k"], "t", ranged, span=60, chunk=None))
    assert rows(ordered.number(series, ["k"], ["t"], "i", chunk=chunk)) == rows(ordered.number(series, ["k"], ["t"], "i", chunk=None))


def test_no_window_spans_a_whole_key(series):
    """The row-level window of a chunked plan is partitioned by key and chunk."""
    plan = ordered.stencil(series, ["k"], ["t"], lambda w: {"p": F.lag("v").over(w)}, ahead=0, chunk=100)._jdf.queryExecution().executedPlan().toString()
    row_window = [line for line in plan.splitlines() if "lag(v" in line]
    assert row_window and all("__chunk" in line for line in row_window)


def test_hot_key_is_spread(spark):
    """A key with nine rows in ten is worked on by many tasks, also after a per-key value was joined."""
    rows = spark.range(60_000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7 + 1).otherwise(0).alias("k"), F.col("id").alias("t"), (F.col("id") % 13).cast("double").alias("v"))
    origin = rows.groupBy("k").agg(F.min("v").alias("low"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = ordered.attach(rows, origin, ["k"], "t")
        out = ordered.running(joined, ["k"], ["t"], chunk=500, sums={"s": F.col("v") - F.col("low")})
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000 and max(sizes) < 0.25 * 60_000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert spark.conf.get("spark.sql.shuffle.partitions") == old


def test_floor_division_is_exact_for_large_times(spark):
    big = 1_700_000_000_123_456_789
    df = spark.createDataFrame([(big,), (-1,), (0,), (-1000,)], "t bigint")
    got = {r[0]: r[1] for r in df.select("t", ordered.chunk_number("t", 1000)).collect()}
    assert got == {big: big // 1000, -1: -1, 0: 0, -1000: -1}


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_null_keys_and_orders_are_kept(spark, chunk):
    rows = [(None if k % 3 else "a", None if k % 11 == 0 else k * 3, k, float(k % 5)) for k in range(60)]
    df = spark.createDataFrame(rows, "key string, t long, n long, v double")
    both = []
    for width in (None, chunk):
        out = ordered.running(df, ["key"], ["t", "n"], chunk=width, sums={"total": F.col("v")}, lasts={"last": F.when(F.col("n") % 2 == 0, F.col("n"))}, maxima={"most": F.col("v")})
        both.append(sorted(map(str, out.select("key", "t", "n", "total", "last", "most").collect())))
    assert len(both[0]) == 60 and both[0] == both[1]


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_null_keys_in_a_stencil_and_an_attached_table(spark, chunk):
    df = spark.createDataFrame([(None if k % 3 else 1, k * 2, k) for k in range(40)], "key long, t long, n long")
    both = [sorted(map(str, ordered.stencil(df, ["key"], ["t", "n"], lambda w: {"before": F.lag("n").over(w), "after": F.lead("n").over(w)}, chunk=width).collect())) for width in (None, chunk)]
    assert both[0] == both[1]
    per_key = df.groupBy("key").agg(F.max("n").alias("most"))
    assert ordered.attach(df, per_key, ["key"], "n").count() == 40


def test_one_outlier_does_not_fill_a_chunk(spark):
    from pacelane.operators import ranking

    df = spark.range(40_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, F.lit(1e12)).otherwise(F.col("id") / 7.0).alias("v"))
    found = ranking.distribution(df, ["k"], "v")
    assert found.count() == 40_000 and found.agg(F.max("at_or_below")).first()[0] == 40_000
    got = ranking.quantiles(df, ["k"], "v", {"median": 0.5, "top": 1.0}).first()
    assert got.top == 1e12 and abs(got.median - 20_000.5 / 7) < 1e-6


def test_chunks_of_a_long_tail_are_even(spark, monkeypatch):
    from pacelane.operators import ranking

    seen = {}
    plain = ordered.running
    monkeypatch.setattr(ordered, "running", lambda df, keys, order, **more: seen.update(df=df, chunk=more["chunk"]) or plain(df, keys, order, **more))
    ranking.distribution(spark.range(60_000).select(F.lit(1).alias("k"), F.when(F.col("id") == 0, F.lit(1e12)).otherwise(F.col("id") / 7.0).alias("v")), ["k"], "v")
    sizes = [r["count"] for r in ordered.with_chunk(seen["df"], "__place", seen["chunk"]).groupBy(ordered.CHUNK).count().collect()]
    assert max(sizes) <= 60_000 / 8


def test_cuts_are_computed_once(spark):
    from pacelane.operators import ranking

    # Approximate percentiles may differ from one reading of the plan to the next; chunk sums and rows must see the same cuts.
    df = spark.range(0, 30_000, 1, 32).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 30_011 / 7.0).alias("v"))
    found = ranking.distribution(df, ["k"], "v")
    assert "percentile_approx" not in found._jdf.queryExecution().toString()
    want = F.row_number().over(Window.partitionBy("k").orderBy("value"))
    assert found.withColumn("want", want).filter("at_or_below <> want").count() == 0


@pytest.mark.parametrize("chunk", [7, 300, 10**9, None])
def test_maxima_of_earlier_rows(series, chunk):
    got = ordered.running(series, ["k"], ["t"], chunk=chunk, maxima_before={"m": F.col("z")})
    earlier = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    assert rows(got) == rows(series.withColumn("m", F.max("z").over(earlier)))


def test_rows_are_ordered_once_and_without_what_is_done(spark):
    """Positions are judged by one row-level window; the texts of their frames are not sorted along, and no row is copied."""
    from pacelane.sources import readers

    frames = "struct<_N: string, _T: string, _X: string, _Y: string, _Z: string>"
    sets = spark.range(1).selectExpr("'firstHalf' _GameSection", "'T' _TeamId", "'P' _PersonId", f"cast(array() as array<{frames}>) Frame")
    plan = readers.position_rows(sets, 0, chunk=40)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__chunk" in line.split("windowspec", 1)[-1]]
    assert not [line for line in windows if "collect_list" in line or "row_number" in line]
    assert len([line for line in windows if "__before" in line or "max(" in line]) <= 2  # rows, and one summary for each chunk
