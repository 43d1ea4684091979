"""Pose queries; joints of the stand-in skeleton are j00 to j19."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import pose
from pacelane.operators.pose import Angle, Segment
from pacelane.plans.registry import query, r6, rounded
from pacelane.testbed import POSE_CHUNK

STEP = 40_000_000
SEGMENTS = [Segment("thigh", "j01", "j02"), Segment("shank", "j02", "j03")]
LEFT, RIGHT = Angle("lknee", "j01", "j02", "j03"), Angle("rknee", "j04", "j05", "j06")
LANDMARKS = ["j01", "j05", "j18"]


def _series(tb):
    return pose.pose_series(tb.pose, SEGMENTS, [LEFT, RIGHT], step_ns=STEP, chunk=POSE_CHUNK)


def _dist(a: str, b: str) -> str:
    return f"sqrt(({a}x - {b}x) ** 2 + ({a}y - {b}y) ** 2 + ({a}z - {b}z) ** 2)"


def _angle(a: str, v: str, b: str) -> str:
    dot = " + ".join(f"({a}{c} - {v}{c}) * ({b}{c} - {v}{c})" for c in "xyz")
    return f"acos(greatest(-1.0, least(1.0, ({dot}) / ({_dist(a, v)} * {_dist(b, v)}))))"


def _wide(joints) -> str:
    picks = ", ".join(f"max({c}_m) FILTER (joint_name = '{j}' AND is_available) AS {j}{c}" for j in joints for c in "xyz")
    errors = ", ".join(f"max(error_m) FILTER (joint_name = '{j}' AND is_available) AS {j}e" for j in joints)
    return f"SELECT subject_id, t_rel_ns, {picks}, {errors} FROM tb_pose GROUP BY 1, 2"


# acos of least/greatest must stay NULL when a landmark is missing.
SERIES_SQL = f"""
    WITH w0 AS ({_wide(['j01', 'j02', 'j03', 'j04', 'j05', 'j06'])}),
    w1 AS (SELECT *, {_dist('j01', 'j02')} AS thigh, {_dist('j02', 'j03')} AS shank, j01e + j02e AS thigh_e, j02e + j03e AS shank_e,
                  CASE WHEN j01x + j02x + j03x IS NOT NULL THEN {_angle('j01', 'j02', 'j03')} END AS lk,
                  CASE WHEN j04x + j05x + j06x IS NOT NULL THEN {_angle('j04', 'j05', 'j06')} END AS rk FROM w0),
    w2 AS (SELECT *, t_rel_ns - lag(t_rel_ns) OVER w AS db, lead(t_rel_ns) OVER w - t_rel_ns AS da, lag(lk) OVER w AS lb, lead(lk) OVER w AS la, lag(rk) OVER w AS rb, lead(rk) OVER w AS ra
           FROM w1 WINDOW w AS (PARTITION BY subject_id ORDER BY t_rel_ns)),
    s AS (SELECT *, CASE WHEN db <= 60000000 AND da <= 60000000 THEN (la - lb) / ((da + db) / 1e9) END AS lv,
                    CASE WHEN db <= 60000000 AND da <= 60000000 THEN (ra - rb) / ((da + db) / 1e9) END AS rv,
                    CAST(sum(CASE WHEN db > 60000000 THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY t_rel_ns) AS BIGINT) AS segment_index FROM w2)"""


@query(
    "landmark_pivot",
    "J17",
    f"WITH w AS ({_wide(['j00', 'j07'])}) SELECT subject_id, t_rel_ns, j00x, j07x, round(j07e, 6) + 0.0 AS j07e FROM w",
)
def landmark_pivot(tb):
    df = pose.landmark_pivot(tb.pose, ["j00", "j07"])
    return df.select("subject_id", "t_rel_ns", F.col("j00.x").alias("j00x"), F.col("j07.x").alias("j07x"), r6("j07.error").alias("j07e"))


@query(
    "pose_series",
    "G26, W9",
    SERIES_SQL
    + """ SELECT subject_id, t_rel_ns, segment_index, round(thigh, 6) + 0.0 AS thigh, round(shank_e, 6) + 0.0 AS shank_bound, round(lk, 6) + 0.0 AS lknee, round(rv, 6) + 0.0 AS rknee_speed FROM s""",
)
def pose_series(tb):
    df = _series(tb)
    return df.select(
        "subject_id",
        "t_rel_ns",
        "segment_index",
        r6("segment_thigh_length_m").alias("thigh"),
        r6("segment_shank_error_bound_m").alias("shank_bound"),
        r6("angle_lknee_rad").alias("lknee"),
        r6("angular_velocity_rknee_rad_s").alias("rknee_speed"),
    )


@query(
    "pose_metrics",
    "G26",
    SERIES_SQL
    + """, fr AS (SELECT subject_id, count(*) AS n FROM s GROUP BY 1),
    jt AS (SELECT p.subject_id, p.joint_name, count(*) FILTER (is_available) / any_value(n) AS av, avg(error_m) FILTER (is_available) AS er FROM tb_pose p JOIN fr USING (subject_id) GROUP BY 1, 2),
    m AS (SELECT subject_id, 'pose.availability.' || joint_name AS metric_id, av AS value FROM jt
          UNION ALL SELECT subject_id, 'pose.error_radius_mean.' || joint_name, er FROM jt
          UNION ALL SELECT subject_id, 'pose.segment_length_mean.thigh', avg(thigh) FROM s GROUP BY 1
          UNION ALL SELECT subject_id, 'pose.segment_length_mean.shank', avg(shank) FROM s GROUP BY 1
          UNION ALL SELECT subject_id, 'pose.segment_length_error_bound.thigh', max(thigh_e) FROM s GROUP BY 1
          UNION ALL SELECT subject_id, 'pose.segment_length_error_bound.shank', max(shank_e) FROM s GROUP BY 1
          UNION ALL SELECT subject_id, 'pose.angular_rom.lknee', max(lk) - min(lk) FROM s GROUP BY 1 HAVING count(lk) >= 2
          UNION ALL SELECT subject_id, 'pose.angular_rom.rknee', max(rk) - min(rk) FROM s GROUP BY 1 HAVING count(rk) >= 2
          UNION ALL SELECT subject_id, 'pose.angular_velocity_peak.lknee', max(abs(lv)) FROM s GROUP BY 1 HAVING count(lk) >= 2
          UNION ALL SELECT subject_id, 'pose.angular_velocity_peak.rknee', max(abs(rv)) FROM s GROUP BY 1 HAVING count(rk) >= 2
          UNION ALL SELECT subject_id, 'pose.angular_velocity_rms.lknee', sqrt(avg(lv * lv)) FROM s GROUP BY 1 HAVING count(lk) >= 2
          UNION ALL SELECT subject_id, 'pose.angular_velocity_rms.rknee', sqrt(avg(rv * rv)) FROM s GROUP BY 1 HAVING count(rk) >= 2)
    SELECT subject_id, metric_id, round(value, 6) + 0.0 AS value FROM m WHERE value IS NOT NULL""",
)
def pose_metrics(tb):
    return rounded(pose.pose_metrics(tb.pose, _series(tb), SEGMENTS, [LEFT, RIGHT]), "value")


BILATERAL_SQL = """, c AS (SELECT subject_id, t_rel_ns, lk, rk, rk - lk AS d, lk IS NOT NULL AND rk IS NOT NULL AS ok FROM {source}),
    mx AS (SELECT subject_id, max(lk) FILTER (ok) AS ml, max(rk) FILTER (ok) AS mr FROM c GROUP BY 1),
    tp AS (SELECT c.subject_id, count(*) FILTER (ok AND lk = ml) AS nl, count(*) FILTER (ok AND rk = mr) AS nr, min(t_rel_ns) FILTER (ok AND lk = ml) AS tl, min(t_rel_ns) FILTER (ok AND rk = mr) AS tr
           FROM c JOIN mx USING (subject_id) GROUP BY 1),
    bl AS (SELECT subject_id, count(d) AS common_frames, count(d) / count(*) AS coverage, avg(d) AS mean, avg(abs(d)) AS mean_absolute, sqrt(avg(d * d)) AS rms,
                  CASE WHEN count(d) >= 2 THEN max(d) - min(d) END AS difference_range,
                  CASE WHEN count(d) >= 3 AND var_pop(lk) FILTER (ok) > 0 AND var_pop(rk) FILTER (ok) > 0
                       THEN covar_pop(lk, rk) FILTER (ok) / sqrt(var_pop(lk) FILTER (ok) * var_pop(rk) FILTER (ok)) END AS corr FROM c GROUP BY 1)"""


@query(
    "bilateral",
    "G27",
    SERIES_SQL
    + BILATERAL_SQL.format(source="s")
    + """ SELECT subject_id, common_frames, round(coverage, 6) + 0.0 AS coverage, round(mean, 6) + 0.0 AS mean, round(mean_absolute, 6) + 0.0 AS mean_absolute, round(rms, 6) + 0.0 AS rms,
                 round(difference_range, 6) + 0.0 AS difference_range, round(corr, 6) + 0.0 AS waveform_correlation,
                 round(CASE WHEN common_frames >= 3 AND nl = 1 AND nr = 1 THEN (tr - tl) / 1e9 END, 6) + 0.0 AS maximum_time_offset_s FROM bl JOIN tp USING (subject_id)""",
)
def bilateral(tb):
    df = pose.bilateral_metrics(pose.bilateral_series(_series(tb), "lknee", "rknee"))
    return rounded(df, "coverage", "mean", "mean_absolute", "rms", "difference_range", "waveform_correlation", "maximum_time_offset_s")


GRID_SQL = """
    WITH span AS (SELECT subject_id, min(t_rel_ns) AS f, max(t_rel_ns) AS l FROM tb_pose GROUP BY 1),
    grid AS (SELECT subject_id, f + r.range * 40000000 AS t FROM span, range(100000) r WHERE f + r.range * 40000000 <= l)"""


@query(
    "pose_quality_joints",
    "G28, W11",
    GRID_SQL
    + """, joints AS (SELECT DISTINCT subject_id, joint_name FROM tb_pose),
    cell AS (SELECT g.subject_id, j.joint_name, g.t, coalesce(p.is_available, false) AS ok, CASE WHEN p.is_available THEN p.error_m END AS e
             FROM grid g JOIN joints j USING (subject_id) LEFT JOIN tb_pose p ON p.subject_id = g.subject_id AND p.joint_name = j.joint_name AND p.t_rel_ns = g.t),
    isl AS (SELECT *, row_number() OVER (PARTITION BY subject_id, joint_name ORDER BY t) - row_number() OVER (PARTITION BY subject_id, joint_name, ok ORDER BY t) AS i FROM cell),
    dr AS (SELECT subject_id, joint_name, count(*) AS n FROM isl WHERE NOT ok GROUP BY subject_id, joint_name, i),
    dd AS (SELECT subject_id, joint_name, count(*) AS drops, max(n) AS longest FROM dr GROUP BY 1, 2)
    SELECT c.subject_id, c.joint_name, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0.0 AS availability, coalesce(any_value(drops), 0) AS dropout_count,
           round(coalesce(any_value(longest), 0) * 0.04::DOUBLE, 6) + 0.0 AS longest_dropout_s, round(avg(e), 6) + 0.0 AS error_mean, round(median(e), 6) + 0.0 AS error_median,
           round(quantile_cont(e, 0.95), 6) + 0.0 AS error_p95
    FROM cell c LEFT JOIN dd USING (subject_id, joint_name) GROUP BY 1, 2""",
)
def pose_quality_joints(tb):
    df = pose.quality_joints(tb.pose, step_ns=STEP, chunk=POSE_CHUNK)
    return rounded(df, "availability", "longest_dropout_s", "error_mean", "error_median", "error_p95")


@query(
    "pose_quality_requirements",
    "G28, W10",
    GRID_SQL
    + """, m AS (SELECT * FROM (VALUES ('knee', 'j01', 3), ('knee', 'j02', 3), ('knee', 'j03', 3), ('side', 'j05', 2), ('side', 'j08', 2)) v(metric, joint_name, need)),
    ok AS (SELECT g.subject_id, m.metric, g.t, count(p.joint_name) FILTER (p.is_available) = any_value(need) AS ok
           FROM grid g CROSS JOIN m LEFT JOIN tb_pose p ON p.subject_id = g.subject_id AND p.t_rel_ns = g.t AND p.joint_name = m.joint_name GROUP BY 1, 2, 3),
    isl AS (SELECT *, row_number() OVER (PARTITION BY subject_id, metric ORDER BY t) - row_number() OVER (PARTITION BY subject_id, metric, ok ORDER BY t) AS i FROM ok),
    run AS (SELECT subject_id, metric, ok, count(*) AS n FROM isl GROUP BY subject_id, metric, ok, i)
    SELECT subject_id, metric, round(coalesce(sum(n) FILTER (ok), 0) / sum(n), 6) + 0.0 AS coverage,
           round(coalesce(sum(n) FILTER (ok AND n >= 3), 0) / sum(n), 6) + 0.0 AS derivative_eligible_fraction FROM run GROUP BY 1, 2""",
)
def pose_quality_requirements(tb):
    needs = {"knee": ["j01", "j02", "j03"], "side": ["j05", "j08"]}
    return rounded(pose.quality_requirements(tb.pose, needs, step_ns=STEP, chunk=POSE_CHUNK), "coverage", "derivative_eligible_fraction")


@query(
    "pose_quality_subjects",
    "G28",
    """WITH x AS (SELECT subject_id, (max(t_rel_ns) - min(t_rel_ns)) // 40000000 + 1 AS n, count(DISTINCT t_rel_ns) AS a, count(DISTINCT t_rel_ns) FILTER (is_available) AS u FROM tb_pose GROUP BY 1)
       SELECT subject_id, n AS expected_ticks, round(a / n, 6) + 0.0 AS any_pose_present, round(u / n, 6) + 0.0 AS any_usable_pose FROM x""",
)
def pose_quality_subjects(tb):
    return rounded(pose.quality_subjects(tb.pose, step_ns=STEP), "any_pose_present", "any_usable_pose")


REL_SQL = (
    f"WITH w0 AS ({_wide(['j00', *LANDMARKS])}), r AS ("
    + " UNION ALL ".join(f"SELECT subject_id, t_rel_ns, '{j}' AS landmark, {j}x - j00x AS x, {j}y - j00y AS y, {j}z - j00z AS z, greatest({j}e, j00e) AS e, ({j}e + j00e) IS NOT NULL AS he FROM w0" for j in LANDMARKS)
    + """),
    k AS (SELECT *, coalesce(t_rel_ns - lag(t_rel_ns) OVER w <= 60000000 AND lag(x) OVER w IS NOT NULL AND x IS NOT NULL, false) AS j,
                 sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2) AS mv FROM r WINDOW w AS (PARTITION BY subject_id, landmark ORDER BY t_rel_ns)),
    l AS (SELECT *, CASE WHEN j THEN mv WHEN x IS NOT NULL THEN 0.0 END AS st, j AND coalesce(lead(j) OVER w, false) AS inn, (lead(t_rel_ns) OVER w - lag(t_rel_ns) OVER w) / 1e9 AS sp,
                 sum(CASE WHEN j THEN 0 ELSE 1 END) OVER w AS run, lead(x) OVER w - lag(x) OVER w AS dx, lead(y) OVER w - lag(y) OVER w AS dy, lead(z) OVER w - lag(z) OVER w AS dz
          FROM k WINDOW w AS (PARTITION BY subject_id, landmark ORDER BY t_rel_ns)),
    v AS (SELECT *, CASE WHEN inn THEN dx / sp END AS vx, CASE WHEN inn THEN dy / sp END AS vy, CASE WHEN inn THEN dz / sp END AS vz FROM l),
    a AS (SELECT *, sqrt(vx * vx + vy * vy + vz * vz) AS speed, sum(st) OVER (PARTITION BY subject_id, landmark, run ORDER BY t_rel_ns) AS path,
                 CASE WHEN inn THEN sqrt(((lead(vx) OVER w - lag(vx) OVER w) / sp) ** 2 + ((lead(vy) OVER w - lag(vy) OVER w) / sp) ** 2 + ((lead(vz) OVER w - lag(vz) OVER w) / sp) ** 2) END AS acc,
                 count(x) OVER rw >= 6 AND count(*) FILTER (x IS NOT NULL AND (NOT he OR e > 0.4)) OVER rw = 0 AS gate
          FROM v WINDOW w AS (PARTITION BY subject_id, landmark ORDER BY t_rel_ns), rw AS (PARTITION BY subject_id, landmark, run)),
    f AS (SELECT subject_id, landmark, arg_min(x, t_rel_ns) AS fx, arg_min(y, t_rel_ns) AS fy, arg_min(z, t_rel_ns) AS fz FROM r WHERE x IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT a.*, sqrt((x - fx) ** 2 + (y - fy) ** 2 + (z - fz) ** 2) AS disp, CASE WHEN gate THEN acc END AS accel FROM a LEFT JOIN f USING (subject_id, landmark))"""
)


@query(
    "landmark_series",
    "W23, W10, G30",
    REL_SQL
    + """ SELECT subject_id, landmark, t_rel_ns, x IS NOT NULL AS available, round(disp, 6) + 0.0 AS displacement_m, round(CASE WHEN x IS NOT NULL THEN path END, 6) + 0.0 AS path_length_m,
                 round(speed, 6) + 0.0 AS speed_m_s, round(accel, 4) + 0.0 AS acceleration_m_s2 FROM s""",
)
def landmark_series(tb):
    df = pose.landmark_series(tb.pose, "j00", LANDMARKS, step_ns=STEP, acceleration=(6, 0.4), chunk=POSE_CHUNK)
    df = df.select("subject_id", "landmark", "t_rel_ns", "available", "displacement_m", "path_length_m", "speed_m_s", "acceleration_m_s2")
    return rounded(rounded(df, "displacement_m", "path_length_m", "speed_m_s"), "acceleration_m_s2", digits=4)


@query(
    "landmark_metrics",
    "G30",
    REL_SQL
    + """ SELECT subject_id, landmark, round(avg(CASE WHEN x IS NOT NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) + 0.0 AS coverage, round(sum(st), 6) + 0.0 AS path_length,
                 round(arg_max(disp, t_rel_ns) FILTER (x IS NOT NULL), 6) + 0.0 AS displacement, round(avg(speed), 6) + 0.0 AS speed_mean, round(max(speed), 6) + 0.0 AS speed_peak,
                 round(max(accel), 4) + 0.0 AS acceleration_peak FROM s GROUP BY 1, 2""",
)
def landmark_metrics(tb):
    df = pose.landmark_metrics(pose.landmark_series(tb.pose, "j00", LANDMARKS, step_ns=STEP, acceleration=(6, 0.4), chunk=POSE_CHUNK))
    return rounded(rounded(df, "coverage", "path_length", "displacement", "speed_mean", "speed_peak"), "acceleration_peak", digits=4)


@query(
    "pose_range",
    "G29",
    SERIES_SQL.replace("WITH w0", "WITH ww0", 1).replace("FROM w0)", "FROM ww0)", 1)
    + ", "
    + REL_SQL[5:].replace("s AS (SELECT a.*", "ls AS (SELECT a.*")
    + """, sr AS (SELECT * FROM s WHERE t_rel_ns BETWEEN 330000000 AND 1210000000)"""
    + BILATERAL_SQL.format(source="sr")
    + """, lr AS (SELECT * FROM ls WHERE landmark = 'j05' AND t_rel_ns BETWEEN 330000000 AND 1210000000),
    pr AS (SELECT * FROM tb_pose WHERE t_rel_ns BETWEEN 330000000 AND 1210000000),
    sub AS (SELECT DISTINCT subject_id FROM tb_pose),
    cell AS (SELECT sub.subject_id, 360000000 + r.range * 40000000 AS t, lr.x IS NOT NULL AS ok FROM sub CROSS JOIN range(22) r
             LEFT JOIN lr ON lr.subject_id = sub.subject_id AND lr.t_rel_ns = 360000000 + r.range * 40000000),
    isl AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY t) - row_number() OVER (PARTITION BY subject_id, ok ORDER BY t) AS i FROM cell),
    dr AS (SELECT subject_id, count(*) AS n FROM isl WHERE NOT ok GROUP BY subject_id, i),
    dd AS (SELECT subject_id, count(*) AS drops, max(n) AS longest FROM dr GROUP BY 1),
    cov AS (SELECT subject_id, count(*) FILTER (ok) / 22 AS c FROM cell GROUP BY 1),
    seen AS (SELECT subject_id, count(DISTINCT t_rel_ns) / 22 AS a, count(DISTINCT t_rel_ns) FILTER (is_available) / 22 AS u, count(*) FILTER (is_available) / 22 AS l,
                    avg(error_m) FILTER (joint_name = 'j05' AND is_available) AS em, median(error_m) FILTER (joint_name = 'j05' AND is_available) AS emd,
                    quantile_cont(error_m, 0.95) FILTER (joint_name = 'j05' AND is_available) AS e95 FROM pr GROUP BY 1),
    pathr AS (SELECT subject_id, sum(CASE WHEN j AND pt IS NOT NULL THEN mv ELSE 0 END) AS p, avg(speed) AS sm, max(speed) AS sk,
                     sqrt((arg_max(x, t_rel_ns) FILTER (x IS NOT NULL) - arg_min(x, t_rel_ns) FILTER (x IS NOT NULL)) ** 2 + (arg_max(y, t_rel_ns) FILTER (x IS NOT NULL) - arg_min(y, t_rel_ns) FILTER (x IS NOT NULL)) ** 2
                        + (arg_max(z, t_rel_ns) FILTER (x IS NOT NULL) - arg_min(z, t_rel_ns) FILTER (x IS NOT NULL)) ** 2) AS d
              FROM (SELECT *, lag(t_rel_ns) OVER (PARTITION BY subject_id ORDER BY t_rel_ns) AS pt FROM lr) GROUP BY 1),
    bend AS (SELECT subject_id, CASE WHEN count(lk) >= 2 THEN max(lk) - min(lk) END AS rom, max(abs(lv)) AS vp FROM sr GROUP BY 1)
    SELECT sub.subject_id, round(coalesce(a, 0), 6) + 0.0 AS any_pose_present, round(coalesce(u, 0), 6) + 0.0 AS any_usable_pose, round(coalesce(l, 0), 6) + 0.0 AS mean_available_landmarks,
           round(c, 6) + 0.0 AS landmark_coverage, coalesce(drops, 0) AS dropout_count, round(coalesce(longest, 0) * 0.04::DOUBLE, 6) + 0.0 AS longest_dropout_s,
           round(d, 6) + 0.0 AS displacement, round(p, 6) + 0.0 AS path_length, round(sm, 6) + 0.0 AS speed_mean, round(sk, 6) + 0.0 AS speed_peak,
           round(em, 6) + 0.0 AS error_mean, round(emd, 6) + 0.0 AS error_median, round(e95, 6) + 0.0 AS error_p95, round(rom, 6) + 0.0 AS angle_rom, round(vp, 6) + 0.0 AS angular_velocity_peak,
           round(CASE WHEN common_frames > 0 THEN common_frames / 22 END, 6) + 0.0 AS bilateral_coverage, round(mean_absolute, 6) + 0.0 AS bilateral_mean_absolute, round(rms, 6) + 0.0 AS bilateral_rms
    FROM sub LEFT JOIN seen USING (subject_id) LEFT JOIN cov USING (subject_id) LEFT JOIN dd USING (subject_id) LEFT JOIN pathr USING (subject_id) LEFT JOIN bend USING (subject_id) LEFT JOIN bl USING (subject_id)""",
)
def pose_range(tb):
    df = pose.pose_range(tb.pose, 330_000_000, 1_210_000_000, anchor="j00", landmark="j05", angle=LEFT, other_angle=RIGHT, step_ns=STEP, chunk=POSE_CHUNK)
    return rounded(df, *[c for c in df.columns if c not in ("subject_id", "dropout_count")])
