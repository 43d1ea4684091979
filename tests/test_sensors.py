"""Jump identities, repetition turns and filters."""

import numpy as np
import pytest

from pacelane.functions.filters import LowPass
from pacelane.operators import biomech as bio
from pacelane.operators import filtering
from pacelane.operators import kinematics as kin

MS = 1_000_000


def test_jump_identities(spark):
    t = np.arange(600)
    ratio = 1 + 0.4 * np.sin(t / 90.0)
    df = spark.createDataFrame([("a", int(i), int(i) * MS, float(r)) for i, r in zip(t, ratio)], "e string, sample_index bigint, t bigint, ratio double")
    made = bio.jump_series(df, ["e"], ["t"], "ratio", chunk=37 * MS)
    row = bio.jump_metrics(made, kin.uniform_step(df, ["e"], ["t"], chunk=50 * MS), ["e"], ["t"], "ratio").first()
    a = 9.80665 * (ratio - 1)
    v = np.concatenate(([0], np.cumsum((a[1:] + a[:-1]) * 0.0005)))
    d = np.concatenate(([0], np.cumsum((v[1:] + v[:-1]) * 0.0005)))
    assert row.takeoff_velocity_m_s == pytest.approx(v[-1]) and row.com_displacement_to_takeoff_m == pytest.approx(d[-1])
    assert row.jump_height_jhwd_m == pytest.approx(v[-1] ** 2 / (2 * 9.80665) + d[-1])
    assert row.peak_specific_power_w_kg == pytest.approx(np.max(9.80665 * ratio * v))


def test_uneven_record_claims_nothing(spark):
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 1, MS, 1.2), ("a", 2, 5 * MS, 1.1)], "e string, sample_index bigint, t bigint, ratio double")
    row = bio.jump_metrics(bio.jump_series(df, ["e"], ["t"], "ratio", chunk=MS), kin.uniform_step(df, ["e"], ["t"], chunk=MS), ["e"], ["t"], "ratio").first()
    assert row.takeoff_velocity_m_s is None and row.peak_body_weight_ratio is None


def turns_by_hand(x, reversal):
    turns, direction, extreme, at = [0], 0, x[0], 0
    for i in range(1, len(x)):
        if direction == 0:
            if abs(x[i] - x[0]) > reversal:
                direction, extreme, at = (1 if x[i] > x[0] else -1), x[i], i
            continue
        if x[i] * direction > extreme * direction:
            extreme, at = x[i], i
        elif x[i] * direction <= extreme * direction - reversal:
            turns.append(at)
            direction, extreme, at = -direction, x[i], i
    return turns


def test_a_move_of_exactly_the_reversal_is_no_departure(spark):
    # 0.8 - 0.5 is above 0.3 in doubles, 0.8 is not above 0.5 + 0.3
    x = [0.5, 0.8, 0.4, 1.0, 0.6]
    df = spark.createDataFrame([("a", i * MS, v) for i, v in enumerate(x)], "k string, t bigint, x double")
    got = [(r.turn, r.t // MS, r.x) for r in bio.turning_points(df, ["k"], "t", "x", 0.3, chunk=2 * MS).orderBy("turn").collect()]
    assert got == [(0, 0, 0.5), (1, 3, 1.0)]


@pytest.mark.parametrize("chunk", [3, 11, 60, 10_000])
def test_turning_points_do_not_depend_on_chunks(spark, chunk):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for key in range(8):
        x = np.cumsum(rng.normal(0, 0.3 + 0.1 * key, 200))
        rows += [(key, int(i), float(v)) for i, v in enumerate(x)]
        want[key] = turns_by_hand(x, 1.0)
    for key in range(8, 108):  # steps of 5 mm, so that a reversal is often met exactly
        x = np.round(np.cumsum(rng.integers(-40, 41, 120)) * 0.005, 3)
        rows += [(key, int(i), float(v)) for i, v in enumerate(x)]
        want[key] = turns_by_hand(x, 1.0)
    df = spark.createDataFrame(rows, "k int, t bigint, x double")
    got: dict[int, list[int]] = {}
    for r in bio.turning_points(df, ["k"], "t", "x", 1.0, chunk=chunk).orderBy("k", "turn").collect():
        got.setdefault(r.k, []).append(r.t)
    assert got == want


def test_association_of_a_constant_side_is_unknown(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 1.1), ("a", 1.0, 0.0, 0.0, 1.3)], "e string, ax double, ay double, az double, ratio double")
    row = bio.sensor_association(df, ["e"], ["ax", "ay", "az"], "ratio").first()
    assert row.paired_samples == 2 and row.pearson_r is None


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_low_pass_gains(order):
    f = LowPass(order, 10.0, 200.0)
    gain = lambda hz: abs(f.D + f.C @ np.linalg.solve(np.exp(2j * np.pi * hz / 200) * np.eye(f.size) - f.A, f.B))
    assert gain(0.0) == pytest.approx(1.0) and gain(10.0) == pytest.approx(2**-0.5) and gain(95.0) < 0.1**order


def test_low_pass_blocks_match_single_steps():
    f, rng = LowPass(4, 15.0, 250.0), np.random.default_rng(1)
    x, state, want = rng.normal(size=333), np.zeros(4), []
    for v in x:
        y, state = f._step(float(v), state)
        want.append(y)
    got, end = f.run(x, np.zeros(4))
    assert np.allclose(got, want) and np.allclose(end, state)


@pytest.mark.parametrize("chunk", [17, 10_000])
@pytest.mark.parametrize("padding", ["odd", "constant"])
def test_zero_phase_matches_one_piece(spark, chunk, padding):
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=90))
    df = spark.createDataFrame([("a", i * 10, float(v)) for i, v in enumerate(x)] + [("short", i, 1.0) for i in range(5)], "k string, t bigint, x double")
    got = filtering.lowpass(df, ["k"], ["t"], "x", "y", order=3, cutoff_hz=8.0, rate_hz=100.0, padding=padding, chunk=chunk)
    f = LowPass(3, 8.0, 100.0)
    pad = f.pad_length
    left, right = x[pad:0:-1], x[-2 : -pad - 2 : -1]
    ext = np.concatenate((2 * x[0] - left, x, 2 * x[-1] - right)) if padding == "odd" else np.concatenate((np.full(pad, x[0]), x, np.full(pad, x[-1])))
    y, _ = f.run(ext, f.settled * ext[0])
    z, _ = f.run(y[::-1], f.settled * y[-1])
    want = z[::-1][pad:-pad]
    rows = {r.t: r.y for r in got.filter("k = 'a'").collect()}
    assert np.allclose([rows[i * 10] for i in range(90)], want)
    assert all(r.y is None for r in got.filter("k = 'short'").collect())
