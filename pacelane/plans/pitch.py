"""Tactical queries over the tracking stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.functions.scalar import arrival_time_s
from pacelane.operators import segments as seg
from pacelane.operators import tactical as tac
from pacelane.plans.registry import query, r6, rounded
from pacelane.session import settle
from pacelane.testbed import TRACK_CHUNK

KEYS = ["stream_id", "t_rel_ns"]



def _players(tb):
    return tac.players(tb.frames)


@query(
    "frame_quality",
    "G20, P16",
    """WITH r AS (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'NaN'::DOUBLE ELSE x_m * 1.02 END AS x FROM tb_tracking UNION ALL
                  SELECT *, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'NaN'::DOUBLE ELSE x_m * 1.02 END FROM tb_tracking WHERE sample_index % 50 = 0),
       f AS (SELECT *, x IS NOT NULL AND NOT isnan(x) AS known FROM r)
       SELECT stream_id, t_rel_ns, count(*) FILTER (NOT known) AS missing_rows, count(*) FILTER (known AND (abs(x) > 52.5 OR abs(y_m) > 34)) AS outside_rows,
              count(*) FILTER (known AND NOT is_detected) AS extrapolated_rows, count(*) FILTER (known) - count(DISTINCT object_id) FILTER (known) AS duplicate_rows
       FROM f GROUP BY 1, 2 HAVING count(*) FILTER (known) > 0""",
)
def frame_quality(tb):
    moved = F.expr("CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN double('NaN') ELSE x_m * 1.02D END")
    rows = tb.tracking.unionByName(tb.tracking.filter("sample_index % 50 = 0")).withColumn("x_m", moved)
    return tac.frame_quality(rows)


@query(
    "pitch_bounds",
    "P16",
    "SELECT stream_id, count(*) AS rows, count(*) FILTER (abs(x_m * 1.05) > 52.5 OR abs(y_m) > 33) AS outside FROM tb_tracking GROUP BY 1",
)
def pitch_bounds(tb):
    moved = tb.tracking.withColumn("x_m", F.col("x_m") * 1.05)
    return moved.groupBy("stream_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(tac.outside_pitch("x_m", "y_m", 105.0, 66.0)).alias("outside"))


HULL_SQL = """
    WITH pt AS (SELECT DISTINCT stream_id, t_rel_ns, group_id, x_m AS x, y_m AS y FROM tb_tracking),
    cr AS (SELECT a.stream_id, a.t_rel_ns, a.group_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_,
                  bool_and(CASE WHEN (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) > 0 THEN true
                                WHEN (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 THEN (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) <= 0 ELSE false END) AS edge
           FROM pt a JOIN pt b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id = b.group_id AND (a.x <> b.x OR a.y <> b.y)
           JOIN pt c ON a.stream_id = c.stream_id AND a.t_rel_ns = c.t_rel_ns AND a.group_id = c.group_id GROUP BY ALL),
    ha AS (SELECT stream_id, t_rel_ns, group_id, abs(sum(ax * by_ - bx * ay) / 2) AS hull, count(*) AS corners FROM cr WHERE edge GROUP BY ALL)"""

TEAM_SQL = (
    HULL_SQL
    + """,
    tm AS (SELECT stream_id, t_rel_ns, group_id, count(*) AS n, avg(x_m) AS cx, avg(y_m) AS cy, max(x_m) - min(x_m) AS l, max(y_m) - min(y_m) AS w, sqrt(var_pop(x_m) + var_pop(y_m)) AS rms
           FROM tb_tracking GROUP BY ALL),
    pw AS (SELECT a.stream_id, a.t_rel_ns, a.group_id, avg(d) AS pm, min(d) AS pn, max(d) AS px FROM (
             SELECT a.stream_id, a.t_rel_ns, a.group_id, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) AS d FROM tb_tracking a JOIN tb_tracking b
             ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id = b.group_id AND a.object_id < b.object_id) a GROUP BY ALL),
    team AS (SELECT tm.*, hull, corners, pm, pn, px, sqrt((cx - b.x_m) ** 2 + (cy - b.y_m) ** 2) AS bd FROM tm JOIN ha USING (stream_id, t_rel_ns, group_id) JOIN pw USING (stream_id, t_rel_ns, group_id)
             JOIN tb_ball b USING (stream_id, t_rel_ns))"""
)


@query(
    "team_geometry",
    "G17, J6, X1, X2",
    TEAM_SQL
    + """ SELECT stream_id, t_rel_ns, group_id, n AS player_count, round(cx, 6) + 0.0 AS centroid_x_m, round(cy, 6) + 0.0 AS centroid_y_m, round(l, 6) + 0.0 AS length_m, round(w, 6) + 0.0 AS width_m,
                 round(CASE WHEN w > 0 THEN l / w END, 9) + 0.0 AS length_width_ratio, round(hull, 6) + 0.0 AS hull_area_m2, round(rms / sqrt(105.0 ** 2 + 68.0 ** 2), 6) + 0.0 AS stretch_index,
                 round(pm, 6) + 0.0 AS pairwise_distance_mean_m, round(pn, 6) + 0.0 AS pairwise_distance_min_m, round(px, 6) + 0.0 AS pairwise_distance_max_m, corners AS hull_corners,
                 round(bd, 6) + 0.0 AS ball_distance_to_centroid_m FROM team""",
)
def team_geometry(tb):
    df = tac.team_geometry(_players(tb), tac.ball(tb.frames)).withColumn("hull_corners", F.size("hull_polygon").cast("bigint")).drop("hull_polygon")
    # Quotients by 64 end at the seventh digit, so six digits would round ties.
    df = rounded(df, "length_width_ratio", digits=9)
    return rounded(df, *[c for c in df.columns if c not in ("stream_id", "t_rel_ns", "group_id", "player_count", "hull_corners", "length_width_ratio")])


@query(
    "convex_hull",
    "X1, X2",
    HULL_SQL + " SELECT stream_id, t_rel_ns, group_id, corners, round(hull, 6) + 0.0 AS area FROM ha",
)
def convex_hull(tb):
    df = tac.team_geometry(_players(tb))
    ring = F.expr("""abs(aggregate(sequence(0, size(hull_polygon) - 1), 0D, (a, i) -> a + hull_polygon[i].x * hull_polygon[(i + 1) % size(hull_polygon)].y
                     - hull_polygon[(i + 1) % size(hull_polygon)].x * hull_polygon[i].y)) / 2""")
    return df.select("stream_id", "t_rel_ns", "group_id", F.size("hull_polygon").cast("bigint").alias("corners"), r6(ring).alias("area"))


@query(
    "nearest_neighbours",
    "J5",
    """WITH d AS (SELECT a.stream_id, a.t_rel_ns, a.object_id, a.group_id, any_value(a.x_m) AS x, any_value(a.y_m) AS y,
                    min(sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2)) FILTER (a.group_id = b.group_id AND a.object_id <> b.object_id) AS mate,
                    min(sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2)) FILTER (a.group_id <> b.group_id) AS foe,
                    avg(b.x_m) FILTER (a.group_id = b.group_id) AS cx, avg(b.y_m) FILTER (a.group_id = b.group_id) AS cy
             FROM tb_tracking a JOIN tb_tracking b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns GROUP BY 1, 2, 3, 4)
       SELECT stream_id, t_rel_ns, object_id, group_id, round(sqrt((x - cx) ** 2 + (y - cy) ** 2), 6) + 0.0 AS distance_to_team_centroid_m,
              round(mate, 6) + 0.0 AS nearest_teammate_distance_m, round(foe, 6) + 0.0 AS nearest_opponent_distance_m FROM d""",
)
def nearest_neighbours(tb):
    return rounded(tac.nearest_neighbours(_players(tb)), "distance_to_team_centroid_m", "nearest_teammate_distance_m", "nearest_opponent_distance_m")


# Overlap area by inclusion and exclusion is not available in SQL, so the oracle
# integrates the product of both hulls' x-extents over y strips between corners:
# inside a strip both outlines are straight, so the width of the overlap is
# piecewise linear and its breakpoints are added as extra strip borders.
OVERLAP_SQL = (
    HULL_SQL
    + """,
    ed AS (SELECT stream_id, t_rel_ns, group_id, ax, ay, bx, by_ FROM cr WHERE edge AND ay <> by_),
    xs AS (SELECT a.stream_id, a.t_rel_ns, (a.ay + ((b.ay - a.ay) * (b.bx - b.ax) - (b.ax - a.ax) * (b.by_ - b.ay)) / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax)) * 0) AS y0,
                  a.ay + (a.by_ - a.ay) * (((b.ax - a.ax) * (b.by_ - b.ay) - (b.ay - a.ay) * (b.bx - b.ax)) / ((a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax))) AS y
           FROM ed a JOIN ed b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id < b.group_id
           WHERE (a.bx - a.ax) * (b.by_ - b.ay) - (a.by_ - a.ay) * (b.bx - b.ax) <> 0),
    ys AS (SELECT DISTINCT stream_id, t_rel_ns, y FROM (SELECT stream_id, t_rel_ns, ay AS y FROM ed UNION ALL SELECT stream_id, t_rel_ns, by_ FROM ed UNION ALL SELECT stream_id, t_rel_ns, y FROM xs)),
    st AS (SELECT stream_id, t_rel_ns, y AS y1, lead(y) OVER (PARTITION BY stream_id, t_rel_ns ORDER BY y) AS y2 FROM ys),
    md AS (SELECT *, (y1 + y2) / 2 AS m FROM st WHERE y2 IS NOT NULL),
    wd AS (SELECT md.stream_id, md.t_rel_ns, y1, y2, group_id, min(ax + (bx - ax) * (m - ay) / (by_ - ay)) AS lo, max(ax + (bx - ax) * (m - ay) / (by_ - ay)) AS hi
           FROM md JOIN ed ON ed.stream_id = md.stream_id AND ed.t_rel_ns = md.t_rel_ns AND m > least(ay, by_) AND m < greatest(ay, by_) GROUP BY 1, 2, 3, 4, 5),
    ov AS (SELECT a.stream_id, a.t_rel_ns, sum((a.y2 - a.y1) * greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo))) AS area
           FROM wd a JOIN wd b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.y1 = b.y1 AND a.group_id < b.group_id GROUP BY 1, 2),
    cen AS (SELECT stream_id, t_rel_ns, group_id, avg(x_m) AS cx, avg(y_m) AS cy FROM tb_tracking GROUP BY ALL)"""
)


@query(
    "team_relations",
    "J7, X3",
    OVERLAP_SQL
    + """ SELECT a.stream_id, a.t_rel_ns, a.group_id AS group_a, b.group_id AS group_b, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2), 6) + 0.0 AS inter_centroid_distance_m,
                 round(coalesce(area, 0), 4) + 0.0 AS hull_overlap_area_m2
          FROM cen a JOIN cen b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id < b.group_id
          LEFT JOIN ov ON ov.stream_id = a.stream_id AND ov.t_rel_ns = a.t_rel_ns""",
)
def team_relations(tb):
    df = tac.team_relations(tac.team_geometry(_players(tb)))
    return rounded(rounded(df, "inter_centroid_distance_m"), "hull_overlap_area_m2", digits=4)


@query(
    "expansion_rate",
    "W14",
    """WITH t AS (SELECT stream_id, t_rel_ns, group_id, CASE WHEN count(*) >= 6 THEN max(x_m) - min(x_m) END AS l, CASE WHEN count(*) >= 6 THEN max(y_m) - min(y_m) END AS w
                  FROM tb_tracking GROUP BY ALL)
       SELECT stream_id, t_rel_ns, group_id, round((l - lag(l) OVER v) / ((t_rel_ns - lag(t_rel_ns) OVER v) / 1e9), 6) + 0.0 AS expansion_rate_x_m_s,
              round((w - lag(w) OVER v) / ((t_rel_ns - lag(t_rel_ns) OVER v) / 1e9), 6) + 0.0 AS expansion_rate_y_m_s FROM t WINDOW v AS (PARTITION BY stream_id, group_id ORDER BY t_rel_ns)""",
)
def expansion_rate(tb):
    rows = tac.players(tb.frames)
    teams = tac.team_geometry(rows, min_players=6).select("stream_id", "t_rel_ns", "group_id", "length_m", "width_m")
    df = tac.expansion_rate(teams, chunk=TRACK_CHUNK).drop("length_m", "width_m")
    return rounded(df, "expansion_rate_x_m_s", "expansion_rate_y_m_s")


UNIT_SQL = """WITH p AS (SELECT *, CASE WHEN group_id = 'away' THEN -x_m ELSE x_m END AS x, CASE WHEN group_id = 'away' THEN -y_m ELSE y_m END AS y FROM tb_tracking)"""
TURN = "CASE WHEN group_id = 'away' THEN 'right_to_left' ELSE 'left_to_right' END"


@query(
    "functional_units",
    "G18",
    UNIT_SQL
    + """, u AS (SELECT stream_id, t_rel_ns, group_id, role, count(*) AS n, avg(x) AS cx, avg(y) AS cy, max(x) - min(x) AS d, max(y) - min(y) AS w, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY ALL),
    v AS (SELECT *, sqrt(greatest(0.0, (xx - yy) ** 2 + 4 * xy * xy)) AS root FROM u),
    a AS (SELECT *, degrees(atan2(2 * xy, xx - yy) / 2) AS ang FROM v)
    SELECT stream_id, t_rel_ns, group_id, role AS functional_unit, n AS player_count, round(cx, 6) + 0.0 AS centroid_x_m, round(cy, 6) + 0.0 AS centroid_y_m, round(d, 6) + 0.0 AS depth_x_m,
           round(w, 6) + 0.0 AS width_y_m, round(sqrt(xx + yy), 6) + 0.0 AS dispersion_rms_m, round(CASE WHEN n >= 2 THEN sqrt(greatest(0.0, (xx + yy + root) / 2)) ELSE 0.0 END, 6) + 0.0 AS major_axis_sd_m,
           round(CASE WHEN n >= 2 THEN sqrt(greatest(0.0, (xx + yy - root) / 2)) ELSE 0.0 END, 4) + 0.0 AS minor_axis_sd_m,
           round(CASE WHEN n >= 2 AND root > 1e-12 THEN CASE WHEN ang < 0 THEN ang + 180 ELSE ang END END, 4) + 0.0 AS orientation_deg FROM a""",
)
def functional_units(tb):
    df = tac.functional_units(_players(tb), F.expr(TURN))
    df = rounded(df, "centroid_x_m", "centroid_y_m", "depth_x_m", "width_y_m", "dispersion_rms_m", "major_axis_sd_m")
    return rounded(df, "minor_axis_sd_m", "orientation_deg", digits=4)


@query(
    "line_gaps",
    "G19",
    UNIT_SQL
    + """ SELECT stream_id, t_rel_ns, group_id, round(abs(avg(x) FILTER (role = 'DEF') - avg(x) FILTER (role = 'MID')), 6) + 0.0 AS def_mid_gap_m,
                 round(abs(avg(x) FILTER (role = 'MID') - avg(x) FILTER (role = 'ATT')), 6) + 0.0 AS mid_att_gap_m,
                 round(max(x) FILTER (role <> 'GK') - min(x) FILTER (role <> 'GK'), 6) + 0.0 AS outfield_block_depth_m FROM p GROUP BY ALL""",
)
def line_gaps(tb):
    return rounded(tac.line_gaps(_players(tb), F.expr(TURN)), "def_mid_gap_m", "mid_att_gap_m", "outfield_block_depth_m")


@query(
    "attacker_defender",
    "J8, J9, L6",
    """WITH d AS (SELECT a.stream_id, a.t_rel_ns, a.group_id, a.object_id AS att, b.object_id AS def, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) AS m
                  FROM tb_tracking a JOIN tb_tracking b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id <> b.group_id WHERE a.role = 'ATT' AND b.role = 'DEF'),
       r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, t_rel_ns, att ORDER BY m, def) AS ra, row_number() OVER (PARTITION BY stream_id, t_rel_ns, def ORDER BY m, att) AS rd FROM d),
       n AS (SELECT a.stream_id, a.t_rel_ns, a.object_id AS att, count(*) FILTER (sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) <= 10) AS c
             FROM tb_tracking a JOIN tb_tracking b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id = b.group_id AND b.role = 'ATT' WHERE a.role = 'ATT' GROUP BY 1, 2, 3),
       g AS (SELECT stream_id, t_rel_ns, group_id, att AS attacker_id, max(def) FILTER (ra = 1) AS nearest_defender_id, round(max(m) FILTER (ra = 1), 6) + 0.0 AS nearest_defender_distance_m,
                    max(def) FILTER (ra = 2) AS second_nearest_defender_id, round(max(m) FILTER (ra = 2), 6) + 0.0 AS second_nearest_defender_distance_m,
                    bool_or(ra = 1 AND rd = 1) AS geometric_tie_up, CAST(count(*) FILTER (m <= 10) AS INTEGER) AS local_defender_count FROM r GROUP BY 1, 2, 3, 4)
       SELECT g.*, NOT geometric_tie_up AS geometric_free_attacker, CAST(c AS INTEGER) AS local_attacker_count, CAST(c - local_defender_count AS INTEGER) AS local_overload_margin_players
       FROM g JOIN n ON n.stream_id = g.stream_id AND n.t_rel_ns = g.t_rel_ns AND n.att = g.attacker_id""",
)
def attacker_defender(tb):
    return rounded(tac.attacker_defender(_players(tb)), "nearest_defender_distance_m", "second_nearest_defender_distance_m")


# Every 37 frames the clock jumps, so that windows and segments meet gaps.
LATER = "t_rel_ns + (frame {div} 37) * 280000000"
TRI_SQL = (
    f"""
    WITH late AS (SELECT * REPLACE ({LATER.format(div="//")} AS t_rel_ns) FROM tb_tracking), late_ball AS (SELECT * REPLACE ({LATER.format(div="//")} AS t_rel_ns) FROM tb_ball),"""
    + """
    pt AS (SELECT stream_id, t_rel_ns, group_id, x_m AS x, y_m AS y, min(object_id) AS id FROM late GROUP BY ALL),
    tr AS (SELECT a.stream_id, a.t_rel_ns, a.group_id, a.id AS a, b.id AS b, c.id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy,
                  (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS area
           FROM pt a JOIN pt b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id = b.group_id AND a.id < b.id
           JOIN pt c ON a.stream_id = c.stream_id AND a.t_rel_ns = c.t_rel_ns AND a.group_id = c.group_id AND b.id < c.id),
    tri AS (SELECT * FROM tr WHERE area <> 0 AND NOT EXISTS (
              SELECT 1 FROM pt d WHERE d.stream_id = tr.stream_id AND d.t_rel_ns = tr.t_rel_ns AND d.group_id = tr.group_id AND d.id NOT IN (tr.a, tr.b, tr.c)
              AND sign(area) * ((ax - d.x) * ((by_ - d.y) * ((cx - d.x) ** 2 + (cy - d.y) ** 2) - ((bx - d.x) ** 2 + (by_ - d.y) ** 2) * (cy - d.y))
                 - (ay - d.y) * ((bx - d.x) * ((cx - d.x) ** 2 + (cy - d.y) ** 2) - ((bx - d.x) ** 2 + (by_ - d.y) ** 2) * (cx - d.x))
                 + ((ax - d.x) ** 2 + (ay - d.y) ** 2) * ((bx - d.x) * (cy - d.y) - (by_ - d.y) * (cx - d.x))) > 0))"""
)


def _late(tb):
    return tb.frames.withColumn("t_rel_ns", F.expr(LATER.format(div="div")))


def _shape_rows(tb):
    return settle(tac.players(_late(tb)))


@query("delaunay", "X6", TRI_SQL + " SELECT stream_id, t_rel_ns, group_id, a, b, c FROM tri")
def delaunay(tb):
    found = tac.shape_triangles(_shape_rows(tb))
    return found.select("stream_id", "t_rel_ns", "group_id", *[F.col(f"{k}.object_id").alias(k) for k in "abc"])


EDGE_SQL = (
    TRI_SQL
    + """,
    ed AS (SELECT DISTINCT stream_id, t_rel_ns, group_id, p, q FROM (SELECT *, a AS p, b AS q FROM tri UNION ALL SELECT *, a, c FROM tri UNION ALL SELECT *, b, c FROM tri)),
    fr AS (SELECT DISTINCT stream_id, t_rel_ns FROM late),
    sg AS (SELECT *, sum(CASE WHEN t_rel_ns - p > 200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY t_rel_ns) AS seg FROM (SELECT *, lag(t_rel_ns) OVER (PARTITION BY stream_id ORDER BY t_rel_ns) AS p FROM fr)),
    wf AS (SELECT stream_id, t_rel_ns, seg, count(*) OVER w AS frames, t_rel_ns - min(t_rel_ns) OVER w AS cov FROM sg WINDOW w AS (PARTITION BY stream_id, seg ORDER BY t_rel_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW))"""
)


@query(
    "edge_persistence",
    "W16",
    EDGE_SQL
    + """, c AS (SELECT ed.*, frames, cov, count(*) OVER (PARTITION BY ed.stream_id, seg, group_id, p, q ORDER BY ed.t_rel_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW) AS n FROM ed JOIN wf ON wf.stream_id = ed.stream_id AND wf.t_rel_ns = ed.t_rel_ns)
    SELECT stream_id, t_rel_ns, group_id, p AS player_a_id, q AS player_b_id, frames AS window_frames, round(n / frames, 6) + 0.0 AS persistence_fraction, cov >= 800000000 AND n / frames >= 0.25 AS is_stable FROM c""",
)
def edge_persistence(tb):
    rows = _shape_rows(tb)
    edges = settle(tac.shape_edges(tac.shape_triangles(rows)))
    df = tac.persistence(edges, tac.window_frames(rows, chunk=TRACK_CHUNK), ["group_id", "player_a_id", "player_b_id"], min_fraction=0.25, chunk=TRACK_CHUNK)
    return rounded(df, "persistence_fraction")


@query(
    "triangle_metrics",
    "X7, J10, W16",
    TRI_SQL
    + """, m AS (SELECT *, abs(area) / 2 AS ar, sqrt((ax - bx) ** 2 + (ay - by_) ** 2) AS s1, sqrt((bx - cx) ** 2 + (by_ - cy) ** 2) AS s2, sqrt((cx - ax) ** 2 + (cy - ay) ** 2) AS s3,
                        CASE WHEN group_id = 'away' THEN -1 ELSE 1 END AS f, (ax + bx + cx) / 3 * CASE WHEN group_id = 'away' THEN -1 ELSE 1 END AS gx, (ay + by_ + cy) / 3 * CASE WHEN group_id = 'away' THEN -1 ELSE 1 END AS gy FROM tri),
    n AS (SELECT m.stream_id, m.t_rel_ns, m.group_id, m.a, m.b, m.c, min(sqrt((o.x_m * f - gx) ** 2 + (o.y_m * f - gy) ** 2)) FILTER (o.group_id = m.group_id) AS own,
                 min(sqrt((o.x_m * f - gx) ** 2 + (o.y_m * f - gy) ** 2)) FILTER (o.group_id <> m.group_id) AS oth,
                 CAST(count(*) FILTER (o.group_id <> m.group_id AND (
                   ((bx - ax) * (o.y_m - ay) - (by_ - ay) * (o.x_m - ax) >= -1e-10 AND (cx - bx) * (o.y_m - by_) - (cy - by_) * (o.x_m - bx) >= -1e-10 AND (ax - cx) * (o.y_m - cy) - (ay - cy) * (o.x_m - cx) >= -1e-10) OR
                   ((bx - ax) * (o.y_m - ay) - (by_ - ay) * (o.x_m - ax) <= 1e-10 AND (cx - bx) * (o.y_m - by_) - (cy - by_) * (o.x_m - bx) <= 1e-10 AND (ax - cx) * (o.y_m - cy) - (ay - cy) * (o.x_m - cx) <= 1e-10))) AS INTEGER) AS inside
          FROM m JOIN late o ON o.stream_id = m.stream_id AND o.t_rel_ns = m.t_rel_ns GROUP BY 1, 2, 3, 4, 5, 6)
    SELECT m.stream_id, m.t_rel_ns, m.group_id, m.a AS player_a_id, m.b AS player_b_id, m.c AS player_c_id, round(ar, 6) + 0.0 AS area_m2, round(greatest(s1, s2, s3) / least(s1, s2, s3), 4) + 0.0 AS aspect_ratio,
           round(gx, 6) + 0.0 AS centroid_x_m, round(gy, 6) + 0.0 AS centroid_y_m, round(sqrt((bl.x_m * f - gx) ** 2 + (bl.y_m * f - gy) ** 2), 6) + 0.0 AS ball_distance_m,
           CASE WHEN abs(gx) > 52.5 OR abs(gy) > 34 THEN 'out_of_bounds' WHEN gx < -17.5 THEN 'own_third' WHEN gx >= 17.5 THEN 'opponent_third' ELSE 'middle_third' END AS zone,
           inside AS opponent_count_inside, round(inside / ar, 4) + 0.0 AS opponent_density_per_m2, CASE WHEN own < oth THEN m.group_id WHEN own > oth THEN CASE m.group_id WHEN 'home' THEN 'away' ELSE 'home' END ELSE 'away' END AS nearest_team_at_centroid,
           round(oth - own, 6) + 0.0 AS nearest_team_distance_margin_m
    FROM m JOIN n USING (stream_id, t_rel_ns, group_id, a, b, c) JOIN late_ball bl ON bl.stream_id = m.stream_id AND bl.t_rel_ns = m.t_rel_ns WHERE ar > 1e-9""",
)
def triangle_metrics(tb):
    rows = _shape_rows(tb)
    df = tac.triangle_metrics(tac.shape_triangles(rows), rows, tac.ball(_late(tb)), F.expr(TURN)).drop("orientation_deg")
    df = rounded(df, "area_m2", "centroid_x_m", "centroid_y_m", "ball_distance_m", "nearest_team_distance_margin_m")
    return rounded(df, "aspect_ratio", "opponent_density_per_m2", digits=4)


@query(
    "ball_zone",
    "P19",
    """SELECT stream_id, t_rel_ns, CASE WHEN abs(x) > 52.5 OR abs(y_m) > 34 THEN 'out_of_bounds' WHEN way IS NULL THEN CASE WHEN x < -17.5 THEN 'left_third' WHEN x >= 17.5 THEN 'right_third' ELSE 'center_third' END
              WHEN x < -17.5 THEN 'own_third' WHEN x >= 17.5 THEN 'opponent_third' ELSE 'middle_third' END AS ball_zone
       FROM (SELECT *, CASE WHEN frame % 3 = 1 THEN -x_m * 6 ELSE x_m * 6 END AS x, CASE frame % 3 WHEN 1 THEN 'r' WHEN 2 THEN 'l' END AS way FROM tb_ball)""",
)
def ball_zone(tb):
    way = F.expr("CASE frame % 3 WHEN 1 THEN 'right_to_left' WHEN 2 THEN 'left_to_right' END")
    return tb.ball.select("stream_id", "t_rel_ns", tac.ball_zone(F.col("x_m") * 6, F.col("y_m"), way).alias("ball_zone"))


# Cell corners: meeting points of two border lines that satisfy all the others.
CELL_SQL = """
    WITH p AS (SELECT stream_id, t_rel_ns, object_id, group_id, least(52.5, greatest(-52.5, x_m)) AS x, least(34.0, greatest(-34.0, y_m)) AS y FROM tb_tracking),
    own AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY stream_id, t_rel_ns, x, y ORDER BY object_id) = 1),
    ln AS (SELECT a.stream_id, a.t_rel_ns, a.object_id, b.object_id AS other, 2 * (b.x - a.x) AS nx, 2 * (b.y - a.y) AS ny, b.x * b.x + b.y * b.y - a.x * a.x - a.y * a.y AS c
           FROM own a JOIN p b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND (abs(b.x - a.x) >= 1e-12 OR abs(b.y - a.y) >= 1e-12)
           UNION ALL SELECT stream_id, t_rel_ns, object_id, w.other, w.nx, w.ny, w.c FROM own, (VALUES ('w1', 1.0, 0.0, 52.5), ('w2', -1.0, 0.0, 52.5), ('w3', 0.0, 1.0, 34.0), ('w4', 0.0, -1.0, 34.0)) w(other, nx, ny, c)),
    mt AS (SELECT a.stream_id, a.t_rel_ns, a.object_id, a.other AS o1, b.other AS o2, (a.c * b.ny - b.c * a.ny) / (a.nx * b.ny - a.ny * b.nx) AS x, (a.nx * b.c - b.nx * a.c) / (a.nx * b.ny - a.ny * b.nx) AS y
           FROM ln a JOIN ln b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.object_id = b.object_id AND a.other < b.other AND abs(a.nx * b.ny - a.ny * b.nx) > 1e-12),
    ok AS (SELECT mt.stream_id, mt.t_rel_ns, mt.object_id, o1, o2, any_value(x) AS x, any_value(y) AS y FROM (SELECT * FROM mt WHERE abs(x) <= 52.5 + 1e-9 AND abs(y) <= 34 + 1e-9) mt
           JOIN ln ON ln.stream_id = mt.stream_id AND ln.t_rel_ns = mt.t_rel_ns AND ln.object_id = mt.object_id GROUP BY 1, 2, 3, 4, 5
           HAVING bool_and(ln.nx * mt.x + ln.ny * mt.y - ln.c <= 1e-9 * greatest(1.0, sqrt(ln.nx * ln.nx + ln.ny * ln.ny)))),
    ce AS (SELECT *, atan2(y - avg(y) OVER w, x - avg(x) OVER w) AS th FROM ok WINDOW w AS (PARTITION BY stream_id, t_rel_ns, object_id)),
    rg AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ce WINDOW w AS (PARTITION BY stream_id, t_rel_ns, object_id ORDER BY th)),
    sh AS (SELECT *, CASE WHEN x2 = x THEN 1.0 ELSE x2 - x END AS run, least(x, -17.5) AS u1, least(x2, -17.5) AS u2, least(x, 17.5) AS v1, least(x2, 17.5) AS v2 FROM rg),
    ar AS (SELECT stream_id, t_rel_ns, object_id, abs(sum(x * y2 - x2 * y)) / 2 AS area, abs(sum((2 * y + (y2 - y) * (u1 - x) / run + (y2 - y) * (u2 - x) / run) / 2 * (u2 - u1))) AS l1,
                  abs(sum((2 * y + (y2 - y) * (v1 - x) / run + (y2 - y) * (v2 - x) / run) / 2 * (v2 - v1))) AS l2 FROM sh GROUP BY 1, 2, 3),
    cell AS (SELECT p.stream_id, p.t_rel_ns, p.object_id, p.group_id, coalesce(area, 0.0) AS area, coalesce(l1, 0.0) AS t0, coalesce(l2 - l1, 0.0) AS t1, coalesce(area - l2, 0.0) AS t2 FROM p LEFT JOIN ar USING (stream_id, t_rel_ns, object_id))"""


@query(
    "voronoi_cell",
    "X4, X5",
    CELL_SQL
    + """ SELECT stream_id, t_rel_ns, object_id, group_id, round(area, 2) + 0.0 AS cell_area_m2, round(100 * area / 7140, 2) + 0.0 AS cell_percentage, round(t0, 2) + 0.0 AS frame_third_0_area_m2,
                 round(t1, 2) + 0.0 AS frame_third_1_area_m2, round(t2, 2) + 0.0 AS frame_third_2_area_m2 FROM cell""",
)
def voronoi_cell(tb):
    df = tac.territory(_players(tb), outline=False)
    return rounded(df, "cell_area_m2", "cell_percentage", "frame_third_0_area_m2", "frame_third_1_area_m2", "frame_third_2_area_m2", digits=2)


@query(
    "territory_team",
    "G33",
    CELL_SQL
    + """ SELECT stream_id, t_rel_ns, group_id, count(*) AS player_count, round(sum(area), 2) + 0.0 AS controlled_area_m2, round(100 * sum(area) / 7140, 2) + 0.0 AS control_percentage,
                 round(sum(t0), 2) + 0.0 AS frame_third_0_area_m2, round(sum(t1), 2) + 0.0 AS frame_third_1_area_m2, round(sum(t2), 2) + 0.0 AS frame_third_2_area_m2 FROM cell GROUP BY 1, 2, 3""",
)
def territory_team(tb):
    df = tac.territory_teams(tac.territory(_players(tb), outline=False))
    return rounded(df, "controlled_area_m2", "control_percentage", "frame_third_0_area_m2", "frame_third_1_area_m2", "frame_third_2_area_m2", digits=2)


# Every 20 frames the clock jumps, so that a velocity has no step to come from.
GAPPED = "t_rel_ns + (frame {div} 20) * 320000000"
VELOCITY_SQL = f"""
    WITH gap AS (SELECT * REPLACE ({GAPPED.format(div="//")} AS t_rel_ns) FROM tb_tracking), gap_ball AS (SELECT * REPLACE ({GAPPED.format(div="//")} AS t_rel_ns) FROM tb_ball),
    v AS (SELECT *, t_rel_ns - lag(t_rel_ns) OVER w AS dt, x_m - lag(x_m) OVER w AS dx, y_m - lag(y_m) OVER w AS dy FROM gap
               WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns)),
    mv AS (SELECT stream_id, t_rel_ns, group_id, object_id, x_m AS x, y_m AS y, CASE WHEN k % 4 = 1 THEN k / 20.0 WHEN dt <= 250000000 THEN dx / (dt / 1e9) ELSE 0.0 END AS vx,
                  CASE WHEN k % 4 = 1 THEN -k / 25.0 WHEN dt <= 250000000 THEN dy / (dt / 1e9) ELSE 0.0 END AS vy,
                  CASE WHEN k % 4 = 1 THEN 'provider' WHEN dt <= 250000000 THEN 'position_first_difference' ELSE 'zero_fallback' END AS src FROM v)"""


def _gapped(tb):
    return tb.frames.withColumn("t_rel_ns", F.expr(GAPPED.format(div="div")))


def _moving(tb):
    rows = _gapped(tb).withColumns(
        {"vx": F.expr("CASE WHEN k % 4 = 1 THEN cast(k as double) / 20 END"), "vy": F.expr("CASE WHEN k % 4 = 1 THEN -cast(k as double) / 25 END")}
    )
    return tac.velocity_fallback(tac.players(rows, fields=("vx", "vy")), vx="vx", vy="vy", chunk=TRACK_CHUNK)


@query(
    "velocity_fallback",
    "W15",
    VELOCITY_SQL + " SELECT stream_id, t_rel_ns, object_id, round(vx, 6) + 0.0 AS velocity_x_m_s, round(vy, 6) + 0.0 AS velocity_y_m_s, src AS velocity_source FROM mv",
)
def velocity_fallback(tb):
    return rounded(_moving(tb).select("stream_id", "t_rel_ns", "object_id", "velocity_x_m_s", "velocity_y_m_s", "velocity_source"), "velocity_x_m_s", "velocity_y_m_s")


def _arrival(p: str, tx: str, ty: str) -> str:
    """SQL of the arrival model: reaction 0.25 s, top speed 7, acceleration 3."""
    raw = f"sqrt({p}.vx * {p}.vx + {p}.vy * {p}.vy)"
    shrink = f"(CASE WHEN {raw} > 7 THEN 7 / {raw} ELSE 1.0 END)"
    gap = f"sqrt(({tx} - ({p}.x + {p}.vx * {shrink} * 0.25)) ** 2 + ({ty} - ({p}.y + {p}.vy * {shrink} * 0.25)) ** 2)"
    entry = f"least(7.0::DOUBLE, least({raw}, 7.0::DOUBLE) + 0.75)"
    ramp = f"greatest(0.0::DOUBLE, (49.0 - {entry} * {entry}) / 6.0)"
    return f"(0.25::DOUBLE + CASE WHEN {gap} <= 0 THEN 0.0 WHEN {gap} <= {ramp} THEN (sqrt({entry} * {entry} + 6.0 * {gap}) - {entry}) / 3.0 ELSE (7.0 - {entry}) / 3.0 + ({gap} - {ramp}) / 7.0 END)"


GRID_SQL = (
    VELOCITY_SQL
    + """,
    gr AS (SELECT a.range AS cell_x, b.range AS cell_y, -52.5::DOUBLE + (a.range + 0.5) * 5.0::DOUBLE AS gx, -34.0::DOUBLE + (b.range + 0.5) * (68.0::DOUBLE / 14) AS gy FROM range(21) a, range(14) b),
    ow AS (SELECT stream_id, t_rel_ns, cell_x, cell_y, min({t: """
    + _arrival("mv", "gx", "gy")
    + """, g: group_id, id: object_id}) AS best FROM mv, gr GROUP BY 1, 2, 3, 4)"""
)


def _frames_of(tb, sampled=None):
    return tac.influence_frames(settle(_moving(tb)), tac.ball(_gapped(tb)), sampled)


@query(
    "player_influence",
    "J12, G34, J11",
    GRID_SQL
    + """, cn AS (SELECT stream_id, t_rel_ns, best.id AS object_id, count(*) AS n FROM ow GROUP BY 1, 2, 3),
    fo AS (SELECT a.stream_id, a.t_rel_ns, a.object_id, min("""
    + _arrival("b", "a.x", "a.y")
    + """) AS f FROM mv a JOIN mv b ON a.stream_id = b.stream_id AND a.t_rel_ns = b.t_rel_ns AND a.group_id <> b.group_id GROUP BY 1, 2, 3)
    SELECT mv.stream_id, mv.t_rel_ns, mv.object_id, mv.group_id, src AS velocity_source, CAST(coalesce(n, 0) AS INTEGER) AS grid_cells, round(coalesce(n, 0) * (7140 / 294::DOUBLE), 4) + 0.0 AS influence_area_m2,
           round(100 * coalesce(n, 0) / 294::DOUBLE, 4) + 0.0 AS influence_percentage, round(f, 6) + 0.0 AS opponent_min_arrival_time_s, round("""
    + _arrival("mv", "bl.x_m", "bl.y_m")
    + """, 6) + 0.0 AS arrival_time_to_ball_s
    FROM mv LEFT JOIN cn USING (stream_id, t_rel_ns, object_id) LEFT JOIN fo USING (stream_id, t_rel_ns, object_id) LEFT JOIN gap_ball bl ON bl.stream_id = mv.stream_id AND bl.t_rel_ns = mv.t_rel_ns""",
)
def player_influence(tb):
    df = tac.player_influence(_frames_of(tb))
    return rounded(rounded(df, "influence_area_m2", "influence_percentage", digits=4), "opponent_min_arrival_time_s", "arrival_time_to_ball_s")


@query(
    "influence_team",
    "G34",
    GRID_SQL
    + """, cn AS (SELECT stream_id, t_rel_ns, best.g AS group_id, count(*) AS n FROM ow GROUP BY 1, 2, 3),
    tm AS (SELECT stream_id, t_rel_ns, group_id, count(*) AS player_count FROM mv GROUP BY 1, 2, 3)
    SELECT tm.*, coalesce(n, 0) AS grid_cells_controlled, round(coalesce(n, 0) * (7140 / 294::DOUBLE), 4) + 0.0 AS controlled_area_m2, round(100 * coalesce(n, 0) / 294::DOUBLE, 4) + 0.0 AS influence_percentage
    FROM tm LEFT JOIN cn USING (stream_id, t_rel_ns, group_id)""",
)
def influence_team(tb):
    df = tac.team_influence(tac.player_influence(_frames_of(tb)))
    return rounded(df, "controlled_area_m2", "influence_percentage", digits=4)


@query(
    "influence_grid",
    "J11, W25",
    GRID_SQL.replace("WITH gap AS", "WITH RECURSIVE gap AS", 1)
    + """, fr AS (SELECT DISTINCT stream_id, t_rel_ns FROM mv),
    walk(stream_id, t_rel_ns) AS (SELECT stream_id, min(t_rel_ns) FROM fr GROUP BY 1 UNION ALL
        SELECT w.stream_id, (SELECT min(fr.t_rel_ns) FROM fr WHERE fr.stream_id = w.stream_id AND fr.t_rel_ns >= w.t_rel_ns + 1000000000) FROM walk w WHERE w.t_rel_ns IS NOT NULL)
    SELECT stream_id, t_rel_ns, cell_x, cell_y, round(gx, 6) + 0.0 AS x_m, round(gy, 6) + 0.0 AS y_m, best.id AS owner_object_id, best.g AS owner_group_id, round(best.t, 6) + 0.0 AS arrival_time_s
    FROM ow JOIN walk USING (stream_id, t_rel_ns) JOIN gr USING (cell_x, cell_y)""",
)
def influence_grid(tb):
    moving = settle(_moving(tb))
    due = seg.sample_frames(moving, ["stream_id"], "t_rel_ns", 1_000_000_000, chunk=TRACK_CHUNK)
    df = tac.influence_grid(tac.influence_frames(moving, tac.ball(_gapped(tb)), due))
    return rounded(df, "x_m", "y_m", "arrival_time_s")


@query(
    "arrival_time",
    "2.9 kinematics",
    VELOCITY_SQL + " SELECT stream_id, t_rel_ns, object_id, round(" + _arrival("mv", "0.0", "0.0") + ", 6) + 0.0 AS to_centre_s FROM mv",
)
def arrival_time(tb):
    time = arrival_time_s("x_m", "y_m", "velocity_x_m_s", "velocity_y_m_s", F.lit(0.0), F.lit(0.0), reaction=0.25, top_speed=7.0, top_accel=3.0)
    return _moving(tb).select("stream_id", "t_rel_ns", "object_id", r6(time).alias("to_centre_s"))


@query(
    "frame_summary",
    "G47",
    "SELECT stream_id, t_rel_ns, count(*) FILTER (object_type <> 'ball') AS players, count(*) FILTER (NOT is_detected) AS extrapolated, bool_or(is_detected) FILTER (object_type = 'ball') AS ball_detected FROM tb_frames GROUP BY 1, 2",
)
def frame_summary(tb):
    return tac.frame_summary(tb.frames)
