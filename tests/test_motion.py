"""Known answers for steps, speed, gates, efforts, rolling peaks and segments."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pacelane.operators import kinematics as kin
from pacelane.operators import segments as seg

MS = 1_000_000


def track(spark, points, step_ns=100 * MS):
    rows = [("a", i, i * step_ns, float(x), float(y)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "e string, sample_index bigint, t bigint, x double, y double")


def series(spark, points, **kw):
    kw.setdefault("chunk", 700 * MS)
    return kin.locomotor_series(track(spark, points), ["e"], ["t"], "x", "y", **kw)


def test_constant_position_has_no_distance_or_speed(spark):
    row = kin.locomotor_summary(series(spark, [(1, 2)] * 12), ["e"], "t").first()
    assert row.distance_total_m == 0 and row.max_speed_m_s == 0 and row.max_acceleration_m_s2 == 0


def test_straight_line_is_exact(spark):
    row = kin.locomotor_summary(series(spark, [(0.5 * i, 0) for i in range(21)]), ["e"], "t").first()
    assert row.distance_total_m == pytest.approx(10.0)
    assert row.mean_speed_m_s == pytest.approx(5.0) and row.max_speed_m_s == pytest.approx(5.0)


def test_circle_speed_error_is_second_order(spark):
    errors = []
    for n in (40, 80):
        points = [(10 * math.cos(2 * math.pi * i / n), 10 * math.sin(2 * math.pi * i / n)) for i in range(n)]
        step = int(20e9 / n)
        df = kin.locomotor_series(track(spark, points, step), ["e"], ["t"], "x", "y", chunk=5_000_000_000)
        top = kin.locomotor_summary(df, ["e"], "t").first().max_speed_m_s
        errors.append(abs(top - math.pi))
    assert errors[0] / errors[1] == pytest.approx(4.0, rel=0.05)


def test_gate_invalidates_both_ends_and_drops_distance(spark):
    points = [(0, 0), (1, 0), (2, 0), (60, 0), (61, 0), (62, 0), (63, 0), (64, 0)]
    kept = series(spark, points, max_step_speed=15.0)
    dropped = series(spark, points, max_step_speed=15.0, drop_gated_distance=True)
    bad = [r.sample_index for r in kept.filter("sample_invalid").orderBy("sample_index").collect()]
    assert bad == [2, 3]
    speeds = {r.sample_index: r.speed_m_s for r in kept.collect()}
    assert all(speeds[i] is None for i in (1, 2, 3, 4)) and speeds[5] == pytest.approx(10.0)
    assert kin.locomotor_summary(kept, ["e"], "t").first().distance_total_m == pytest.approx(64.0)
    assert kin.locomotor_summary(dropped, ["e"], "t").first().distance_total_m == pytest.approx(6.0)


def test_zones_share_all_distance(spark):
    points = [(0.02 * i * i, 0) for i in range(30)]
    df = series(spark, points, edge=kin.ONE_SIDED_EDGE)
    zones = kin.zone_stats(df, ["e"], [("low", 0.0, 2.0), ("medium", 2.0, 5.5), ("high", 5.5, None)])
    assert zones.agg(F.sum("distance_m")).first()[0] == pytest.approx(kin.locomotor_summary(df, ["e"], "t").first().distance_total_m)


def efforts_by_hand(speed, step, t, dur, thr, hyst, low, gap):
    runs, on = [], None
    for i, v in enumerate(speed):
        if v is None or (on is not None and v < max(0, thr - hyst)):
            if on is not None:
                runs.append([on, i - 1])
            on = None
        elif on is None and v >= thr:
            on = i
    if on is not None:
        runs.append([on, len(speed) - 1])
    merged = []
    for b, e in runs:
        if merged and t[b] - t[merged[-1][1]] <= gap:
            merged[-1][1] = e
        else:
            merged.append([b, e])
    return [(b, e, round(sum(dur[b : e + 1]), 6), round(sum(step[b : e + 1]), 6)) for b, e in merged if sum(dur[b : e + 1]) + 1e-9 >= low]


@pytest.mark.parametrize("chunk", [250 * MS, 3_000 * MS, None])
def test_efforts_follow_hysteresis(spark, chunk):
    rng = np.random.default_rng(5)
    speed = [None if rng.random() < 0.05 else float(v) for v in np.abs(np.cumsum(rng.normal(0, 1.5, 120))) + rng.random(120)]
    t = [i * 100 * MS for i in range(120)]
    rows = [("a", i, t[i], speed[i], float(i % 7), 0.1) for i in range(120)]
    df = spark.createDataFrame(rows, "e string, sample_index bigint, t bigint, speed_m_s double, step_m double, duration_s double")
    got = kin.effort_segments(df, ["e"], ["t"], threshold=5.0, min_duration_s=0.3, merge_gap_s=0.2, hysteresis=1.0, chunk=chunk).orderBy("effort_index").collect()
    want = efforts_by_hand(speed, [r[4] for r in rows], t, [0.1] * 120, 5.0, 1.0, 0.3, 200 * MS)
    assert [(r.start_sample_index, r.end_sample_index, round(r.duration_s, 6), round(r.distance_m, 6)) for r in got] == want and want


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0, 9, allow_nan=False), min_size=12, max_size=40))
def test_rolling_peak_is_a_window_maximum(spark, steps):
    steps = [0.0] + [round(s, 3) for s in steps]
    rows = [("a", i, i * 100 * MS, s) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "e string, sample_index bigint, t bigint, step_m double")
    got = kin.rolling_peak(df, ["e"], ["t"], [0.5], chunk=700 * MS).first()
    sums = [round(sum(steps[max(0, e - 4) : e + 1]), 9) for e in range(len(steps))]
    best = max(range(5, len(steps)), key=lambda e: (sums[e], -e))
    assert got.peak_distance_m == pytest.approx(sums[best])
    assert sums[got.end_sample_index] == pytest.approx(sums[best])


def test_equal_windows_in_two_chunks_go_to_the_earliest(spark):
    # The windows ending at 6 and 7 hold the same steps; 7 opens a chunk, whose running sum starts at another row.
    steps = [0.0, 0.6, 0.0, 6.9, 6.4, 3.5, 5.8, 0.0, 0.0, 0.0]
    rows = [("a", i, i * 100 * MS, s) for i, s in enumerate(steps)]
    df = spark.createDataFrame(rows, "e string, sample_index bigint, t bigint, step_m double")
    got = kin.rolling_peak(df, ["e"], ["t"], [0.5], chunk=700 * MS).first()
    assert (got.end_sample_index, got.peak_distance_m) == (6, 22.6)


def test_cumulative_trapezoid_is_exact_for_a_line(spark):
    df = spark.createDataFrame([("a", i * MS, 3.0 * i) for i in range(50)], "e string, t bigint, v double")
    got = kin.cumulative_trapezoid(df, ["e"], ["t"], "v", "area", chunk=9 * MS).orderBy("t").collect()
    assert [r.area for r in got] == pytest.approx([1.5 * i * i * 1e-3 for i in range(50)])


def test_gap_starts_a_segment_and_breaks_runs(spark):
    times = [0, 1, 2, 9, 10, 30]
    df = spark.createDataFrame([("a", t, t != 10) for t in times], "e string, t bigint, ok boolean")
    got = {r.t: r.segment_index for r in seg.segment_by_gap(df, ["e"], ["t"], 5, chunk=4).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 9: 1, 10: 1, 30: 2}
    runs = sorted((r.start_ns, r.end_ns, r.samples) for r in seg.runs(df, ["e"], ["t"], F.col("ok"), 5, chunk=4).collect())
    assert runs == [(0, 2, 3), (9, 9, 1), (30, 30, 1)]


def test_dropouts_cover_start_middle_and_end(spark):
    rows = [("s", "a", t, t in (10, 20, 50)) for t in range(0, 80, 10)] + [("s", "b", 0, True), ("s", "b", 70, False)]
    df = spark.createDataFrame(rows, "s string, j string, t bigint, ok boolean")
    got = sorted((r.j, r.start_ns, r.end_ns) for r in seg.dropout_intervals(df, ["s"], ["j"], "t", 10, F.col("ok"), chunk=25).collect())
    assert got == [("a", 0, 10), ("a", 30, 50), ("a", 60, 80), ("b", 10, 80)]


@pytest.mark.parametrize("chunk,fan_in", [(40, 2), (100, 3), (10_000, 5)])
def test_sample_frames_matches_a_plain_walk(spark, chunk, fan_in):
    rng = np.random.default_rng(3)
    times = np.unique(np.cumsum(rng.choice([1, 4, 9, 70], 300)))
    df = spark.createDataFrame([("a", int(t)) for t in times], "s string, t bigint")
    want, last = [], None
    for t in times:
        if last is None or t - last >= 30:
            want.append(int(t))
            last = t
    got = sorted(r.t for r in seg.sample_frames(df, ["s"], "t", 30, chunk=chunk, fan_in=fan_in).collect())
    assert got == want


def test_grouped_kernels_take_many_groups_of_a_task(spark):
    # Groups reach over Arrow batches, keys may be null, and no group has an Arrow stream of its own.
    from pyspark.sql import types as T

    from pacelane.operators.grouped import apply_grouped, sorted_columns

    data = [(k, part, i) for k in ("a", "b", None) for part in (None, 0, 1) for i in range(7)] + [("z", 5, i) for i in range(25)]
    df = spark.createDataFrame(data, "k string, part int, i long").repartition(3)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("many", T.LongType()), T.StructField("seen", T.ArrayType(T.LongType()))])

    def kernel(key, table):
        (i,) = sorted_columns(table, "i")
        return {"k": [key[0]], "part": [key[1]], "many": [len(i)], "seen": [i.tolist()]}

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = apply_grouped(df, ["k", "part"], kernel, schema)
        got = {(r.k, r.part): (r.many, r.seen) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(k, p): (7, list(range(7))) for k in ("a", "b", None) for p in (None, 0, 1)} | {("z", 5): (25, list(range(25)))}
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
