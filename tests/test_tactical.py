"""Planar geometry against brute force, and known team shapes."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest

from pacelane.functions import planar
from pacelane.functions.scalar import arrival_time_s
from pacelane.operators import tactical as tac


def chain_area(points):
    pts = sorted(set(map(tuple, points)))
    if len(pts) < 3:
        return 0.0

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def test_hull_matches_a_sorted_sweep():
    rng = np.random.default_rng(0)
    for n in (3, 5, 11, 20):
        for _ in range(20):
            pts = rng.integers(-6, 7, size=(n, 2)).astype(float)
            assert planar.ring_area(planar.hull(pts)) == pytest.approx(chain_area(pts))
    assert planar.ring_area(planar.hull(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 0


def test_overlap_of_shifted_squares():
    square = np.array([[0.0, 0], [2, 0], [2, 2], [0, 2]])
    assert planar.ring_area(planar.overlap_ring(square, square + 1)) == pytest.approx(1.0)
    assert planar.ring_area(planar.overlap_ring(square, square + 5)) == 0
    assert planar.ring_area(planar.overlap_ring(square, square)) == pytest.approx(4.0)


def test_triangles_fill_the_hull_and_hold_no_other_point():
    rng = np.random.default_rng(4)
    for n in (3, 4, 7, 11):
        pts = rng.normal(size=(n, 2)) * 20
        found = planar.triangulate(pts)
        area = sum(abs((pts[b] - pts[a])[0] * (pts[c] - pts[a])[1] - (pts[b] - pts[a])[1] * (pts[c] - pts[a])[0]) / 2 for a, b, c in found)
        assert area == pytest.approx(chain_area(pts))


def test_points_on_one_circle_fan_out_from_the_smallest():
    square = np.array([[1.0, 1], [-1, 1], [-1, -1], [1, -1]])
    assert planar.triangulate(square) == [(0, 1, 2), (0, 2, 3)]
    ring = np.array([[5.0, 0], [3, 4], [0, 5], [-3, 4], [-5, 0], [0, -5]])
    found = planar.triangulate(ring)
    assert len(found) == 4 and all(t[0] == 0 for t in found)
    grid = np.array(list(itertools.product([0.0, 1, 2], [0.0, 1, 2])))
    area = sum(abs(np.linalg.det(np.array([grid[b] - grid[a], grid[c] - grid[a]]))) / 2 for a, b, c in planar.triangulate(grid))
    assert area == pytest.approx(4.0)


def test_collinear_players_have_no_triangle():
    assert planar.triangulate(np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]])) == []


def test_cells_share_the_pitch():
    rng = np.random.default_rng(8)
    pts = np.column_stack((rng.uniform(-52, 52, 22), rng.uniform(-34, 34, 22)))
    frames = np.stack((pts, pts[::-1], np.vstack((pts[:5], np.zeros((17, 2))))))
    present = np.ones((3, 22), dtype=bool)
    present[2, 5:] = False
    rings = planar.cell_rings(frames, present, 105.0, 68.0)
    areas = planar.rings_area(rings)
    area = areas[0]
    assert area.sum() == pytest.approx(105 * 68) and np.allclose(areas[1], area[::-1]) and areas[2][:5].sum() == pytest.approx(105 * 68)
    assert np.allclose(planar.left_of(rings, 1e3), areas) and np.allclose(planar.left_of(rings, -1e3), 0)
    grid = np.column_stack([g.ravel() for g in np.meshgrid(np.linspace(-52.4, 52.4, 150), np.linspace(-33.9, 33.9, 100))])
    owner = np.argmin(((grid[:, None, :] - pts[None]) ** 2).sum(axis=2), axis=1)
    for i in range(22):
        assert area[i] == pytest.approx((owner == i).mean() * 105 * 68, abs=25)
    alone = planar.cell_rings(pts[None, :1], np.ones((1, 1), dtype=bool), 105.0, 68.0)
    assert planar.rings_area(alone)[0, 0] == pytest.approx(105 * 68)


def test_arrival_column_agrees_with_array(spark):
    rng = np.random.default_rng(6)
    rows = [tuple(map(float, r)) for r in rng.normal(0, 12, size=(60, 6))] + [(0.0, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "px double, py double, vx double, vy double, tx double, ty double")
    got = [r[0] for r in df.select(arrival_time_s("px", "py", "vx", "vy", "tx", "ty", reaction=0.25, top_speed=7.0, top_accel=3.0)).collect()]
    assert np.allclose(got, planar.arrival(*np.array(rows).T, 0.25, 7.0, 3.0))


SCHEMA = "stream_id string, t_rel_ns bigint, sample_index bigint, object_id string, object_type string, group_id string, role string, x_m double, y_m double, is_detected boolean"


def frame(spark, people, t=0):
    rows = [("s", t, i, o, "ball" if g is None else "player", g, r, float(x), float(y), True) for i, (o, g, r, x, y) in enumerate(people)]
    return spark.createDataFrame(rows, SCHEMA)


def test_square_team(spark):
    people = [(f"p{i}", "A", "MID", x, y) for i, (x, y) in enumerate([(1, 1), (1, -1), (-1, 1), (-1, -1)])]
    row = tac.team_geometry(tac.players(frame(spark, people))).first()
    assert (row.centroid_x_m, row.centroid_y_m, row.length_m, row.width_m, row.hull_area_m2) == (0, 0, 2, 2, pytest.approx(4.0))
    assert row.pairwise_distance_min_m == 2 and row.pairwise_distance_max_m == pytest.approx(2 * math.sqrt(2))


def test_duplicate_object_keeps_the_first(spark):
    people = [("p0", "A", "MID", 0, 0), ("p0", "A", "MID", 9, 9), ("p1", "A", "MID", 3, 4)]
    df = frame(spark, people)
    row = tac.team_geometry(tac.players(df)).first()
    assert row.player_count == 2 and row.pairwise_distance_mean_m == pytest.approx(5.0)
    assert tac.frame_quality(df).first().duplicate_rows == 1


def test_coincident_players_keep_the_smallest_id(spark):
    people = [("p1", "A", "MID", 0, 0), ("p0", "A", "MID", 0, 0), ("p2", "A", "MID", 4, 0), ("p3", "A", "MID", 0, 3)]
    found = tac.shape_triangles(tac.players(frame(spark, people))).collect()
    assert [(r.a.object_id, r.b.object_id, r.c.object_id) for r in found] == [("p0", "p2", "p3")]
    cells = {r.object_id: r.cell_area_m2 for r in tac.territory(tac.players(frame(spark, people))).collect()}
    assert cells["p1"] == 0 and sum(cells.values()) == pytest.approx(105 * 68)


def test_defender_ties_go_to_the_smaller_id(spark):
    people = [("a1", "A", "ATT", 0, 0), ("a2", "A", "ATT", 30, 0), ("d2", "B", "DEF", 1, 0), ("d1", "B", "DEF", -1, 0)]
    rows = {r.attacker_id: r for r in tac.attacker_defender(tac.players(frame(spark, people))).collect()}
    assert rows["a1"].nearest_defender_id == "d1" and rows["a1"].second_nearest_defender_id == "d2" and rows["a1"].geometric_tie_up
    assert rows["a2"].nearest_defender_id == "d2" and not rows["a2"].geometric_tie_up
    assert rows["a1"].local_overload_margin_players == -1


def test_persistence_restarts_after_a_gap(spark):
    people = [(f"p{i}", "A", "MID", x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (0, 10)])]
    times = [i * 100_000_000 for i in range(12)] + [3_000_000_000 + i * 100_000_000 for i in range(3)]
    rows = tac.players(frame(spark, people, times[0]))
    for t in times[1:]:
        rows = rows.unionByName(tac.players(frame(spark, people, t)))
    edges = tac.shape_edges(tac.shape_triangles(rows))
    out = tac.persistence(edges, tac.window_frames(rows, chunk=700_000_000), ["group_id", "player_a_id", "player_b_id"], chunk=700_000_000)
    got = {(r.t_rel_ns, r.window_frames, r.is_stable) for r in out.filter("player_a_id = 'p0' AND player_b_id = 'p1'").collect()}
    assert (1_100_000_000, 11, True) in got and (700_000_000, 8, False) in got and (3_000_000_000, 1, False) in got


def test_influence_breaks_ties_by_group_then_id(spark):
    people = [("z", "A", "MID", 0, 0), ("b", "B", "MID", 0, 0)]
    moving = tac.velocity_fallback(tac.players(frame(spark, people)))
    each = tac.player_influence(tac.influence_frames(moving, tac.ball(frame(spark, people))))
    got = {r.object_id: r.grid_cells for r in each.collect()}
    assert got == {"z": 294, "b": 0}
    assert {r.group_id: r.grid_cells_controlled for r in tac.team_influence(each).collect()} == {"A": 294, "B": 0}


def test_frames_are_triangulated_together_as_one_by_one():
    rng = np.random.default_rng(8)
    frames = [rng.integers(-4, 5, size=(n, 2)).astype(float) for n in rng.choice([0, 1, 2, 3, 5, 9], 60)]
    frames = [np.unique(f, axis=0) for f in frames]
    got = planar.delaunay_of.func(*[pd.Series([f[:, k] for f in frames]) for k in range(2)])
    assert [[(t["a"], t["b"], t["c"]) for t in g] for g in got] == [planar.triangulate(f) for f in frames]
    many = rng.normal(size=(7, 9, 2))
    assert planar.triangulate_all(many) == [planar.triangulate(f) for f in many]


def test_an_axis_without_covariance_is_the_same_in_any_order(spark):
    # Heights are even about the middle player, so the covariance is zero but for rounding, whose sign depends on the order.
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    data = []
    for frame in range(300):
        x, step = rng.integers(-5000, 5000), rng.integers(1, 2000)
        spots = [((x - step) / 100, 7.0), (x / 100, 5.0 + rng.integers(0, 2)), ((x + step) / 100, 7.0)]
        order = rng.permutation(3)
        data += [(frame, int(k), float(spots[i][0]), float(spots[i][1]), f"p{i}") for k, i in enumerate(order) if step > 200]
    rows = spark.createDataFrame(data, "t_rel_ns long, k int, x_m double, y_m double, object_id string")
    rows = rows.withColumns({"stream_id": F.lit("s"), "group_id": F.lit("home"), "role": F.lit("ATT")}).repartition(4, "k")
    got = {r.orientation_deg for r in tac.functional_units(rows).collect()}
    assert got == {0.0}


def test_triangle_neighbours_follow_the_stated_ties(spark):
    from pyspark.sql import functions as F

    spots = [("home", "h1", 0.0, 0.0), ("home", "h2", 6.0, 0.0), ("home", "h3", 0.0, 6.0), ("away", "a1", 1.0, 1.0), ("away", "a2", 9.0, 9.0), ("away", "a0", 3.0, 3.0)]
    rows = spark.createDataFrame([("s", 0, *s) for s in spots], "stream_id string, t_rel_ns long, group_id string, object_id string, x_m double, y_m double")
    balls = rows.select("stream_id", "t_rel_ns", F.struct(F.lit(2.0).alias("x"), F.lit(2.0).alias("y")).alias("ball")).distinct()
    got = tac.triangle_metrics(tac.shape_triangles(rows.filter("group_id = 'home'")), rows, balls).collect()
    assert [(r.opponent_count_inside, r.nearest_team_at_centroid) for r in got] == [(2, "away")]
    assert got[0].nearest_team_distance_margin_m == pytest.approx(math.sqrt(2) - math.sqrt(8))
    alone = tac.triangle_metrics(tac.shape_triangles(rows.filter("group_id = 'home'")), rows.filter("group_id = 'home'"), balls).collect()
    assert [(r.opponent_count_inside, r.nearest_team_at_centroid, r.nearest_team_distance_margin_m) for r in alone] == [(0, "home", None)]
