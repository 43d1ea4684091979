"""Locomotor queries over the tracking and position stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import filtering
from pacelane.operators import kinematics as kin
from pacelane.plans.registry import query, rounded
from pacelane.testbed import SIGNAL_CHUNK, TICK_CHUNK, TRACK, TRACK_CHUNK, Testbed

ORDER = ["t_rel_ns"]

# The stand-in entities jump across the pitch, so the gates are set where both
# branches are taken: steps above 1500 m/s are gated, efforts start at 300 m/s.
GATE, THRESHOLD, HYSTERESIS, MIN_EFFORT, MERGE = 1500.0, 300.0, 120.0, 0.08, 0.08
WIDE_ZONES = [("low", 0.0, 200.0), ("medium", 200.0, 550.0), ("high", 550.0, None)]


def gated_series(tb: Testbed):
    return kin.locomotor_series(
        tb.tracking, TRACK, ORDER, "x_m", "y_m", detected="is_detected", max_step_speed=GATE, drop_gated_distance=True, chunk=TRACK_CHUNK
    )


SERIES_SQL = f"""
    WITH a AS (
        SELECT *, lag(t_rel_ns) OVER w AS pt, lead(t_rel_ns) OVER w AS nt,
               CASE WHEN lag(t_rel_ns) OVER w IS NULL THEN 0.0 ELSE sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2) END AS step
        FROM tb_tracking WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns)),
    b AS (SELECT *, coalesce(step / ((t_rel_ns - pt) / 1e9) > {GATE}, false) AS fast FROM a),
    c AS (SELECT *, fast OR coalesce(lead(fast) OVER w, false) OR NOT is_detected AS bad
          FROM b WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns)),
    d AS (SELECT *, bad OR coalesce(lag(bad) OVER w, false) OR coalesce(lead(bad) OVER w, false) AS dim,
                 (lead(x_m) OVER w - lag(x_m) OVER w) / ((nt - pt) / 1e9) AS vx0, (lead(y_m) OVER w - lag(y_m) OVER w) / ((nt - pt) / 1e9) AS vy0
          FROM c WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns)),
    e AS (SELECT *, CASE WHEN NOT dim THEN vx0 END AS vx, CASE WHEN NOT dim THEN vy0 END AS vy,
                 CASE WHEN fast THEN 0.0 ELSE step END AS kept,
                 CASE WHEN pt IS NULL AND nt IS NULL THEN 0.0 WHEN pt IS NULL THEN (nt - t_rel_ns) / 1e9 WHEN nt IS NULL THEN (t_rel_ns - pt) / 1e9
                      ELSE (nt - pt) / 1e9 / 2 END AS dur FROM d),
    s AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed,
                 (lead(vx) OVER w - lag(vx) OVER w) / ((nt - pt) / 1e9) AS ax, (lead(vy) OVER w - lag(vy) OVER w) / ((nt - pt) / 1e9) AS ay,
                 (lead(sqrt(vx * vx + vy * vy)) OVER w - lag(sqrt(vx * vx + vy * vy)) OVER w) / ((nt - pt) / 1e9) AS tang
          FROM e WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns))"""


@query(
    "step_distance",
    "W5",
    """SELECT stream_id, object_id, sample_index, round(CASE WHEN lag(t_rel_ns) OVER w IS NULL THEN 0.0
              ELSE sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2) END, 6) + 0.0 AS step_m
       FROM tb_tracking WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns)""",
)
def step_distance(tb):
    df = kin.step_distance(tb.tracking, TRACK, ORDER, "x_m", "y_m", chunk=TRACK_CHUNK)
    return rounded(df.select(*TRACK, "sample_index", "step_m"), "step_m")


@query(
    "path_length",
    "W5, U4",
    """WITH s AS (SELECT *, CASE WHEN lag(t_rel_ns) OVER w IS NULL THEN 0.0
              ELSE sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2) END AS step
       FROM tb_tracking WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns))
       SELECT stream_id, object_id, sample_index, round(sum(step) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns), 6) + 0.0 AS path_m FROM s""",
)
def path_length(tb):
    df = kin.path_length(tb.tracking, TRACK, ORDER, "x_m", "y_m", chunk=TRACK_CHUNK)
    return rounded(df.select(*TRACK, "sample_index", "path_m"), "path_m")


@query(
    "haversine_path",
    "W5, 2.9 geodesy",
    """WITH s AS (SELECT *, lag(latitude_deg) OVER w AS la, lag(longitude_deg) OVER w AS lo
                  FROM tb_gnss WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns)),
       d AS (SELECT *, CASE WHEN la IS NULL THEN 0.0 ELSE 2 * 6371008.8 * asin(least(1.0, sqrt(sin((radians(latitude_deg) - radians(la)) / 2) ** 2
                  + cos(radians(la)) * cos(radians(latitude_deg)) * sin((radians(longitude_deg) - radians(lo)) / 2) ** 2))) END AS step FROM s)
       SELECT entity_id, t_rel_ns, round(step, 4) + 0.0 AS step_m, round(sum(step) OVER (PARTITION BY entity_id ORDER BY t_rel_ns), 4) + 0.0 AS path_m FROM d""",
)
def haversine_path(tb):
    df = kin.path_length(tb.gnss, ["entity_id"], ORDER, "latitude_deg", "longitude_deg", method="haversine", chunk=SIGNAL_CHUNK)
    return rounded(df.select("entity_id", "t_rel_ns", "step_m", "path_m"), "step_m", "path_m", digits=4)


@query(
    "local_plane",
    "2.9 geodesy (ENU)",
    """WITH o AS (SELECT entity_id, arg_min(latitude_deg, t_rel_ns) AS la, arg_min(longitude_deg, t_rel_ns) AS lo FROM tb_gnss GROUP BY 1)
       SELECT entity_id, t_rel_ns, round(6371008.8 * (radians(longitude_deg) - radians(lo)) * cos(radians(la)), 4) + 0.0 AS east_m,
              round(6371008.8 * (radians(latitude_deg) - radians(la)), 4) + 0.0 AS north_m FROM tb_gnss JOIN o USING (entity_id)""",
)
def local_plane(tb):
    df = kin.local_plane(tb.gnss, ["entity_id"], ORDER, "latitude_deg", "longitude_deg")
    return rounded(df.select("entity_id", "t_rel_ns", "east_m", "north_m"), "east_m", "north_m", digits=4)


@query(
    "derivative",
    "W3",
    """SELECT entity_id, t_rel_ns,
              round(CASE WHEN lag(t_rel_ns) OVER w IS NULL THEN (lead(v) OVER w - v) / ((lead(t_rel_ns) OVER w - t_rel_ns) / 1e9)
                         WHEN lead(t_rel_ns) OVER w IS NULL THEN (v - lag(v) OVER w) / ((t_rel_ns - lag(t_rel_ns) OVER w) / 1e9)
                         ELSE (lead(v) OVER w - lag(v) OVER w) / ((lead(t_rel_ns) OVER w - lag(t_rel_ns) OVER w) / 1e9) END, 6) + 0.0 AS dv_one_sided,
              round((lead(v) OVER w - lag(v) OVER w) / ((lead(t_rel_ns) OVER w - lag(t_rel_ns) OVER w) / 1e9), 6) + 0.0 AS dv_open
       FROM tb_signal WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns)""",
)
def derivative(tb):
    from pacelane.operators import ordered

    df = ordered.stencil(
        tb.signal,
        ["entity_id"],
        ORDER,
        lambda w: {"dv_one_sided": kin.central_difference(w, "v", "t_rel_ns", kin.ONE_SIDED_EDGE), "dv_open": kin.central_difference(w, "v", "t_rel_ns")},
        chunk=SIGNAL_CHUNK,
    )
    return rounded(df.select("entity_id", "t_rel_ns", "dv_one_sided", "dv_open"), "dv_one_sided", "dv_open")


@query(
    "planar_speed",
    "W4",
    """SELECT stream_id, object_id, sample_index,
              round(sqrt(((lead(x_m) OVER w - lag(x_m) OVER w) / ((lead(t_rel_ns) OVER w - lag(t_rel_ns) OVER w) / 1e9)) ** 2
                       + ((lead(y_m) OVER w - lag(y_m) OVER w) / ((lead(t_rel_ns) OVER w - lag(t_rel_ns) OVER w) / 1e9)) ** 2), 6) + 0.0 AS speed_m_s
       FROM tb_tracking WINDOW w AS (PARTITION BY stream_id, object_id ORDER BY t_rel_ns)""",
)
def planar_speed(tb):
    df = kin.planar_speed(tb.tracking, TRACK, ORDER, "x_m", "y_m", chunk=TRACK_CHUNK)
    return rounded(df.select(*TRACK, "sample_index", "speed_m_s"), "speed_m_s")


@query(
    "sample_duration",
    "W7",
    """SELECT entity_id, t_rel_ns, round(CASE WHEN p IS NULL AND n IS NULL THEN 0.0 WHEN p IS NULL THEN (n - t_rel_ns) / 1e9
              WHEN n IS NULL THEN (t_rel_ns - p) / 1e9 ELSE (n - p) / 1e9 / 2 END, 8) + 0.0 AS duration_s
       FROM (SELECT *, lag(t_rel_ns) OVER w AS p, lead(t_rel_ns) OVER w AS n FROM tb_signal WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns))""",
)
def sample_duration(tb):
    df = kin.sample_durations(tb.signal, ["entity_id"], ORDER, chunk=SIGNAL_CHUNK)
    return rounded(df.select("entity_id", "t_rel_ns", "duration_s"), "duration_s", digits=8)


@query(
    "cumulative_trapezoid",
    "W6",
    """WITH a AS (SELECT *, coalesce((ratio + lag(ratio) OVER w) * ((t_rel_ns - lag(t_rel_ns) OVER w) / 1e9) / 2, 0.0) AS area
                  FROM tb_force WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns))
       SELECT entity_id, sample_index, round(sum(area) OVER (PARTITION BY entity_id ORDER BY t_rel_ns), 10) + 0.0 AS integral FROM a""",
)
def cumulative_trapezoid(tb):
    df = kin.cumulative_trapezoid(tb.force, ["entity_id"], ORDER, "ratio", "integral", chunk=TICK_CHUNK)
    return rounded(df.select("entity_id", "sample_index", "integral"), "integral", digits=10)


@query(
    "dilate",
    "W17",
    """SELECT stream_id, object_id, sample_index,
              bool_or(NOT is_detected) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS invalid
       FROM tb_tracking""",
)
def dilate(tb):
    flagged = tb.tracking.withColumn("missed", ~F.col("is_detected"))
    return kin.dilate(flagged, TRACK, ORDER, "missed", "invalid", chunk=TRACK_CHUNK).select(*TRACK, "sample_index", "invalid")


@query(
    "uniform_step",
    "W26",
    """WITH s AS (SELECT 'force' AS axis, entity_id, t_rel_ns, t_rel_ns - lag(t_rel_ns) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS d FROM tb_force
                  UNION ALL SELECT 'signal', entity_id, t_rel_ns, t_rel_ns - lag(t_rel_ns) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) FROM tb_signal)
       SELECT axis, entity_id, arg_min(d, t_rel_ns) FILTER (d IS NOT NULL) AS step_ns, count(*) AS samples,
              coalesce(min(d) > 0 AND greatest(max(d) - arg_min(d, t_rel_ns) FILTER (d IS NOT NULL), arg_min(d, t_rel_ns) FILTER (d IS NOT NULL) - min(d)) <= 1, false) AS is_uniform
       FROM s GROUP BY ALL""",
)
def uniform_step(tb):
    steady = kin.uniform_step(tb.force, ["entity_id"], ORDER, chunk=TICK_CHUNK).withColumn("axis", F.lit("force"))
    uneven = kin.uniform_step(tb.signal, ["entity_id"], ORDER, chunk=SIGNAL_CHUNK).withColumn("axis", F.lit("signal"))
    return steady.unionByName(uneven)


@query(
    "nominal_rate",
    "G48",
    """WITH s AS (SELECT entity_id, CASE WHEN entity_id % 3 = 0 THEN 10.0 WHEN entity_id % 3 = 1 THEN CAST(k % 2 + 1 AS DOUBLE) END AS rate,
                         t_rel_ns - lag(t_rel_ns) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS d FROM tb_signal)
       SELECT entity_id, count(DISTINCT rate) > 1 AS is_ambiguous,
              round(CASE WHEN count(DISTINCT rate) > 1 THEN NULL WHEN count(DISTINCT rate) = 1 THEN max(rate) ELSE 1e9 / median(d) END, 9) + 0.0 AS rate_hz
       FROM s GROUP BY 1""",
)
def nominal_rate(tb):
    declared = tb.signal.withColumn("rate", F.expr("CASE WHEN entity_id % 3 = 0 THEN 10.0D WHEN entity_id % 3 = 1 THEN cast(k % 2 + 1 AS double) END"))
    df = kin.nominal_rate(declared, ["entity_id"], ORDER, "rate", chunk=SIGNAL_CHUNK)
    return rounded(df, "rate_hz", digits=9)


@query(
    "locomotor_kinematics",
    "P17, P18, W3, W4, W17",
    SERIES_SQL
    + """ SELECT stream_id, object_id, sample_index, fast AS step_gated, bad AS sample_invalid, round(kept, 6) + 0.0 AS step_m, round(vx, 6) + 0.0 AS vx_m_s,
                 round(vy, 6) + 0.0 AS vy_m_s, round(speed, 6) + 0.0 AS speed_m_s, round(ax, 4) + 0.0 AS ax_m_s2, round(ay, 4) + 0.0 AS ay_m_s2 FROM s""",
)
def locomotor_kinematics(tb):
    df = gated_series(tb).select(*TRACK, "sample_index", "step_gated", "sample_invalid", "step_m", "vx_m_s", "vy_m_s", "speed_m_s", "ax_m_s2", "ay_m_s2")
    return rounded(rounded(df, "step_m", "vx_m_s", "vy_m_s", "speed_m_s"), "ax_m_s2", "ay_m_s2", digits=4)


@query(
    "locomotor_summary",
    "G21",
    SERIES_SQL
    + """ SELECT stream_id, object_id, count(*) AS samples, round(sum(kept), 4) + 0.0 AS distance_total_m, round((max(t_rel_ns) - min(t_rel_ns)) / 1e9, 4) + 0.0 AS duration_s,
                 round(CASE WHEN max(t_rel_ns) > min(t_rel_ns) THEN sum(kept) / ((max(t_rel_ns) - min(t_rel_ns)) / 1e9) ELSE 0.0 END, 4) + 0.0 AS mean_speed_m_s,
                 round(max(speed), 4) + 0.0 AS max_speed_m_s, round(coalesce(max(sqrt(ax * ax + ay * ay)), 0.0), 4) + 0.0 AS max_acceleration_m_s2,
                 round(greatest(0.0, -coalesce(min(tang), 0.0)), 4) + 0.0 AS max_deceleration_m_s2,
                 count(*) FILTER (bad) AS invalid_samples, count(*) FILTER (fast) AS excluded_steps FROM s GROUP BY ALL""",
)
def locomotor_summary(tb):
    df = kin.locomotor_summary(gated_series(tb), TRACK, "t_rel_ns")
    return rounded(df, "distance_total_m", "duration_s", "mean_speed_m_s", "max_speed_m_s", "max_acceleration_m_s2", "max_deceleration_m_s2", digits=4)


@query(
    "zone_stats",
    "G22",
    SERIES_SQL
    + ", z AS (SELECT * FROM (VALUES ('low', 0.0, 200.0), ('medium', 200.0, 550.0), ('high', 550.0, 1e300)) v(zone, lo, hi))"
    + """ SELECT stream_id, object_id, zone, round(coalesce(sum(kept) FILTER (speed >= lo AND speed < hi), 0.0), 4) + 0.0 AS distance_m,
                 round(coalesce(sum(dur) FILTER (speed >= lo AND speed < hi), 0.0), 4) + 0.0 AS duration_s,
                 round(coalesce(max(speed) FILTER (speed >= lo AND speed < hi), 0.0), 4) + 0.0 AS peak_speed_m_s,
                 count(*) FILTER (speed >= lo AND speed < hi) AS samples FROM s, z GROUP BY ALL""",
)
def zone_stats(tb):
    df = kin.zone_stats(gated_series(tb), TRACK, WIDE_ZONES)
    return rounded(df, "distance_m", "duration_s", "peak_speed_m_s", digits=4)


@query(
    "effort_segments",
    "W21",
    SERIES_SQL
    + f""", f AS (SELECT *, CASE WHEN speed IS NULL THEN 0 WHEN speed >= {THRESHOLD} THEN 1 WHEN speed < {THRESHOLD - HYSTERESIS} THEN 0 END AS decisive FROM s),
    g AS (SELECT *, coalesce(last_value(decisive IGNORE NULLS) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns), 0) AS st FROM f),
    h AS (SELECT *, CASE WHEN st = 1 AND coalesce(lag(st) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns), 0) = 0 THEN 1 ELSE 0 END AS starts FROM g),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns) AS run FROM h),
    r AS (SELECT stream_id, object_id, run, min(t_rel_ns) AS b, max(t_rel_ns) AS e FROM i WHERE st = 1 GROUP BY ALL),
    m AS (SELECT *, CASE WHEN b - lag(e) OVER (PARTITION BY stream_id, object_id ORDER BY b) <= {int(MERGE * 1e9)} THEN 0 ELSE 1 END AS fresh FROM r),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY stream_id, object_id ORDER BY b) AS grp FROM m),
    o AS (SELECT stream_id, object_id, grp, min(b) AS b, max(e) AS e FROM n GROUP BY ALL),
    p AS (SELECT o.stream_id, o.object_id, o.b, o.e, sum(s.dur) AS dur, sum(s.kept) AS dist, max(s.speed) AS peak, min(s.sample_index) AS i0, max(s.sample_index) AS i1
          FROM o JOIN s ON s.stream_id = o.stream_id AND s.object_id = o.object_id AND s.t_rel_ns BETWEEN o.b AND o.e GROUP BY ALL)
    SELECT stream_id, object_id, row_number() OVER (PARTITION BY stream_id, object_id ORDER BY b) - 1 AS effort_index, i0 AS start_sample_index, i1 AS end_sample_index,
           b AS start_ns, e AS end_ns, round(dur, 4) + 0.0 AS duration_s, round(dist, 4) + 0.0 AS distance_m, round(peak, 4) + 0.0 AS peak_speed_m_s, round(dist / dur, 4) + 0.0 AS mean_speed_m_s
    FROM p WHERE dur + 1e-9 >= {MIN_EFFORT}""",
)
def effort_segments(tb):
    df = kin.effort_segments(gated_series(tb), TRACK, ORDER, threshold=THRESHOLD, min_duration_s=MIN_EFFORT, merge_gap_s=MERGE, hysteresis=HYSTERESIS, chunk=TRACK_CHUNK)
    return rounded(df, "duration_s", "distance_m", "peak_speed_m_s", "mean_speed_m_s", digits=4)


@query(
    "rolling_peak",
    "W8",
    SERIES_SQL
    + """, c1 AS (SELECT *, sum(kept) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns) AS cum, min(t_rel_ns) OVER (PARTITION BY stream_id, object_id) AS t0 FROM s),
    c2 AS (SELECT *, 0.4 AS wlen, cum - min(cum) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns RANGE BETWEEN 400000000 PRECEDING AND CURRENT ROW) AS cov FROM c1
           UNION ALL
           SELECT *, 1.0, cum - min(cum) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns RANGE BETWEEN 1000000000 PRECEDING AND CURRENT ROW) FROM c1)
    SELECT stream_id, object_id, CAST(wlen AS DOUBLE) AS window_s, round(cov, 4) + 0.0 AS peak_distance_m, round(cov / wlen, 4) + 0.0 AS peak_mean_speed_m_s,
           sample_index AS end_sample_index, t_rel_ns AS end_ns
    FROM c2 WHERE t_rel_ns - t0 >= wlen * 1e9 QUALIFY row_number() OVER (PARTITION BY stream_id, object_id, wlen ORDER BY cov DESC, t_rel_ns) = 1""",
)
def rolling_peak(tb):
    df = kin.rolling_peak(gated_series(tb), TRACK, ORDER, [0.4, 1.0], chunk=TRACK_CHUNK)
    return rounded(df, "peak_distance_m", "peak_mean_speed_m_s", digits=4)


SUMMARY_SQL = """ SELECT {keys}, count(*) AS samples, round(sum(kept), 4) + 0.0 AS distance_total_m, round((max(t_rel_ns) - min(t_rel_ns)) / 1e9, 4) + 0.0 AS duration_s,
    round(CASE WHEN max(t_rel_ns) > min(t_rel_ns) THEN sum(kept) / ((max(t_rel_ns) - min(t_rel_ns)) / 1e9) ELSE 0.0 END, 4) + 0.0 AS mean_speed_m_s, round(max(speed), 4) + 0.0 AS max_speed_m_s,
    round(coalesce(max(sqrt(ax * ax + ay * ay)), 0.0), 4) + 0.0 AS max_acceleration_m_s2, round(greatest(0.0, -coalesce(min(tang), 0.0)), 4) + 0.0 AS max_deceleration_m_s2,
    count(*) FILTER (bad) AS invalid_samples, count(*) FILTER (fast) AS excluded_steps FROM s GROUP BY ALL"""

# The same chain on the local plane, with great-circle steps and a gate of 0.01 m/s.
GNSS_SQL = (
    SERIES_SQL.replace("stream_id, object_id", "entity_id")
    .replace("FROM tb_tracking", "FROM gn")
    .replace(f"> {GATE}", "> 0.01")
    .replace(
        "sqrt((x_m - lag(x_m) OVER w) ** 2 + (y_m - lag(y_m) OVER w) ** 2)",
        """2 * 6371008.8 * asin(least(1.0, sqrt(sin((radians(latitude_deg) - radians(lag(latitude_deg) OVER w)) / 2) ** 2
           + cos(radians(lag(latitude_deg) OVER w)) * cos(radians(latitude_deg)) * sin((radians(longitude_deg) - radians(lag(longitude_deg) OVER w)) / 2) ** 2)))""",
    )
    .replace(
        "WITH a AS (",
        """WITH o AS (SELECT entity_id, arg_min(latitude_deg, t_rel_ns) AS la0, arg_min(longitude_deg, t_rel_ns) AS lo0 FROM tb_gnss GROUP BY 1),
        gn AS (SELECT g.*, 6371008.8 * (radians(longitude_deg) - radians(lo0)) * cos(radians(la0)) AS x_m, 6371008.8 * (radians(latitude_deg) - radians(la0)) AS y_m, true AS is_detected FROM tb_gnss g JOIN o USING (entity_id)),
        a AS (""",
        1,
    )
)


@query("gnss_locomotor_summary", "G21 (haversine)", GNSS_SQL + SUMMARY_SQL.format(keys="entity_id"))
def gnss_locomotor_summary(tb):
    series = kin.locomotor_series(
        tb.gnss, ["entity_id"], ORDER, "latitude_deg", "longitude_deg", method="haversine", max_step_speed=0.01, drop_gated_distance=True, chunk=SIGNAL_CHUNK
    )
    df = kin.locomotor_summary(series, ["entity_id"], "t_rel_ns")
    return rounded(df, "distance_total_m", "duration_s", "mean_speed_m_s", "max_speed_m_s", "max_acceleration_m_s2", "max_deceleration_m_s2", digits=4)


# Second order, 100 Hz at 1 kHz: the coefficients as the bilinear map gives them.
LOWPASS_SQL = """
    WITH RECURSIVE g AS (SELECT tan(pi() * 0.1) AS w), co AS (SELECT w * w / (1 + sqrt(2.0) * w + w * w) AS b, 2 * (w * w - 1) / (1 + sqrt(2.0) * w + w * w) AS a1, (1 - sqrt(2.0) * w + w * w) / (1 + sqrt(2.0) * w + w * w) AS a2 FROM g),
    s AS (SELECT entity_id, sample_index AS i, v AS x FROM tb_ticks),
    f AS (SELECT s.entity_id, s.i, b * x AS y, 0.0::DOUBLE AS y1, x AS x0, 0.0::DOUBLE AS x1 FROM s, co WHERE i = 0
          UNION ALL SELECT f.entity_id, s.i, co.b * s.x + 2 * co.b * f.x0 + co.b * f.x1 - co.a1 * f.y - co.a2 * f.y1, f.y, s.x, f.x0 FROM f JOIN s ON s.entity_id = f.entity_id AND s.i = f.i + 1, co)"""


@query("lowpass", "2.11", LOWPASS_SQL + " SELECT entity_id, i AS sample_index, round(y, 6) + 0.0 AS filtered FROM f")
def lowpass(tb):
    df = filtering.lowpass(tb.ticks, ["entity_id"], ORDER, "v", "filtered", order=2, cutoff_hz=100.0, rate_hz=1000.0, phase=filtering.CAUSAL, chunk=1000)
    return rounded(df.select("entity_id", "sample_index", "filtered"), "filtered")


@query("lowpass_zero_phase", "2.11")
def lowpass_zero_phase(tb):
    df = filtering.lowpass(tb.ticks, ["entity_id"], ORDER, "v", "filtered", order=3, cutoff_hz=80.0, rate_hz=1000.0, chunk=1000)
    return rounded(df.select("entity_id", "sample_index", "filtered"), "filtered")
