"""Force, inertial and repetition queries."""

from __future__ import annotations


from pacelane.operators import biomech as bio
from pacelane.operators import joins
from pacelane.operators import kinematics as kin
from pacelane.plans.registry import query, rounded
from pacelane.testbed import TICK_CHUNK

KEY, ORDER = ["entity_id"], ["t_rel_ns"]

JUMP_SQL = """
    WITH a AS (SELECT *, 9.80665 * (ratio - 1) AS acc FROM tb_force),
    b AS (SELECT *, coalesce((acc + lag(acc) OVER w) * 0.0005, 0.0) AS g FROM a WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns)),
    c AS (SELECT *, sum(g) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS v FROM b),
    d AS (SELECT *, coalesce((v + lag(v) OVER w) * 0.0005, 0.0) AS h FROM c WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns)),
    s AS (SELECT *, sum(h) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS disp, 9.80665 * ratio * v AS p FROM d)"""


@query(
    "jump_series",
    "W6, G23",
    JUMP_SQL + " SELECT entity_id, sample_index, round(acc, 6) + 0.0 AS acceleration_m_s2, round(v, 6) + 0.0 AS velocity_m_s, round(disp, 8) + 0.0 AS displacement_m, round(p, 6) + 0.0 AS power_w_kg FROM s",
)
def jump_series(tb):
    df = bio.jump_series(tb.force, KEY, ORDER, "ratio", chunk=TICK_CHUNK).drop("t_rel_ns", "ratio")
    return rounded(rounded(df, "acceleration_m_s2", "velocity_m_s", "power_w_kg"), "displacement_m", digits=8)


@query(
    "jump_metrics",
    "G23",
    JUMP_SQL
    + """ SELECT entity_id, count(*) AS samples, round(arg_max(v, t_rel_ns), 6) + 0.0 AS net_impulse_per_mass_m_s, round(arg_max(v, t_rel_ns), 6) + 0.0 AS takeoff_velocity_m_s,
                 round(arg_max(disp, t_rel_ns), 8) + 0.0 AS com_displacement_to_takeoff_m, round(arg_max(v, t_rel_ns) ** 2 / (2 * 9.80665), 8) + 0.0 AS takeoff_to_apex_height_m,
                 round(arg_max(v, t_rel_ns) ** 2 / (2 * 9.80665) + arg_max(disp, t_rel_ns), 8) + 0.0 AS jump_height_jhwd_m,
                 round(max(p), 6) + 0.0 AS peak_specific_power_w_kg, round(max(ratio), 6) + 0.0 AS peak_body_weight_ratio
          FROM s GROUP BY 1""",
)
def jump_metrics(tb):
    usable = kin.uniform_step(tb.force, KEY, ORDER, chunk=TICK_CHUNK).select("entity_id", "is_uniform", "samples")
    df = bio.jump_metrics(bio.jump_series(tb.force, KEY, ORDER, "ratio", chunk=TICK_CHUNK), usable, KEY, ORDER, "ratio")
    df = rounded(df, "net_impulse_per_mass_m_s", "takeoff_velocity_m_s", "peak_specific_power_w_kg", "peak_body_weight_ratio")
    return rounded(df, "com_displacement_to_takeoff_m", "takeoff_to_apex_height_m", "jump_height_jhwd_m", digits=8)


@query(
    "imu_summary",
    "G24",
    """WITH a AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS r FROM tb_imu),
       b AS (SELECT *, (lead(r) OVER w - lag(r) OVER w) / ((lead(t_rel_ns) OVER w - lag(t_rel_ns) OVER w) / 1e9) AS j FROM a WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns))
       SELECT entity_id, round(avg(r), 6) + 0.0 AS resultant_mean, round(sqrt(avg(r * r)), 6) + 0.0 AS resultant_rms, round(max(r), 6) + 0.0 AS resultant_peak,
              round(sqrt(avg(j * j)), 4) + 0.0 AS jerk_rms, round(max(abs(j)), 4) + 0.0 AS jerk_peak FROM b GROUP BY 1""",
)
def imu_summary(tb):
    df = bio.imu_summary(bio.imu_series(tb.imu, KEY, ORDER, ["ax", "ay", "az"], chunk=TICK_CHUNK), KEY)
    return rounded(rounded(df, "resultant_mean", "resultant_rms", "resultant_peak"), "jerk_rms", "jerk_peak", digits=4)


@query(
    "sensor_association",
    "G25, J1",
    """WITH p AS (SELECT entity_id, sqrt(ax * ax + ay * ay + az * az) AS a, 9.80665 * (ratio - 1) AS b FROM tb_force JOIN tb_imu USING (entity_id, t_rel_ns))
       SELECT entity_id, count(*) AS paired_samples, round(CASE WHEN count(*) >= 2 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) + 0.0 AS pearson_r
       FROM p GROUP BY 1""",
)
def sensor_association(tb):
    pairs = joins.exact_time_join(tb.force.drop("sample_index"), tb.imu.drop("sample_index"), KEY, "t_rel_ns")
    return rounded(bio.sensor_association(pairs, KEY, ["ax", "ay", "az"], "ratio"), "pearson_r")


# The reversal machine as a recursive walk over samples: direction, extreme and
# the turn just confirmed, one step per sample.
TURNS_SQL = """
    WITH RECURSIVE s AS (SELECT entity_id, sample_index AS i, t_rel_ns AS t, position_m AS x FROM tb_lpt),
    m AS (
        SELECT entity_id, i, x AS x0, 0 AS d, x AS ex, i AS ei, CAST(NULL AS BIGINT) AS turned FROM s WHERE i = 0
        UNION ALL
        SELECT entity_id, i, x0,
               CASE WHEN d = 0 AND x > x0 + 0.3 THEN 1 WHEN d = 0 AND x < x0 - 0.3 THEN -1 WHEN flips THEN -d ELSE d END,
               CASE WHEN d = 0 OR flips OR (x - ex) * d > 0 THEN x ELSE ex END,
               CASE WHEN d = 0 OR flips OR (x - ex) * d > 0 THEN i ELSE ei END,
               CASE WHEN flips THEN ei END
        FROM (SELECT m.entity_id, s.i, m.x0, m.d, m.ex, m.ei, s.x, (m.d = 1 AND s.x <= m.ex - 0.3) OR (m.d = -1 AND s.x >= m.ex + 0.3) AS flips
              FROM m JOIN s ON s.entity_id = m.entity_id AND s.i = m.i + 1)),
    turns AS (SELECT entity_id, turned AS i FROM m WHERE turned IS NOT NULL UNION ALL SELECT DISTINCT entity_id, 0 FROM s),
    n AS (SELECT entity_id, i, row_number() OVER (PARTITION BY entity_id ORDER BY i) - 1 AS turn FROM turns)"""

REPS_SQL = (
    TURNS_SQL
    + """,
    p AS (SELECT a.entity_id, a.i AS i0, b.i AS i1 FROM n a JOIN n b ON a.entity_id = b.entity_id AND b.turn = a.turn + 2 WHERE a.turn % 2 = 0),
    v AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL THEN (lead(x) OVER w - x) * 1000 WHEN lead(t) OVER w IS NULL THEN (x - lag(x) OVER w) * 1000 ELSE (lead(x) OVER w - lag(x) OVER w) * 500 END AS speed
          FROM s WINDOW w AS (PARTITION BY entity_id ORDER BY t)),
    r AS (SELECT p.entity_id, i0, i1, max(x) - min(x) AS rom, (i1 - i0) * 0.001::DOUBLE AS dur, max(abs(speed)) AS peak, arg_min(x, i) AS x0, arg_max(x, i) AS x1
          FROM p JOIN v ON v.entity_id = p.entity_id AND v.i BETWEEN i0 AND i1 GROUP BY 1, 2, 3),
    k AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY i0) - 1 AS rep_index FROM r WHERE rom >= 0.5 AND dur >= 0.0035)"""
)


def _reps(tb):
    return bio.rep_segments(tb.lpt, KEY, "t_rel_ns", "position_m", reversal=0.3, min_range=0.5, min_duration_s=0.0035, chunk=TICK_CHUNK)


@query("turning_points", "W22", TURNS_SQL + " SELECT n.entity_id, n.turn, n.i * 1000000 AS t, s.x FROM n JOIN s ON s.entity_id = n.entity_id AND s.i = n.i")
def turning_points(tb):
    return bio.turning_points(tb.lpt, KEY, "t_rel_ns", "position_m", 0.3, chunk=TICK_CHUNK)


@query(
    "rep_segments",
    "W22",
    REPS_SQL
    + """ SELECT entity_id, rep_index, i0 AS start_sample_index, i1 AS end_sample_index, i0 * 1000000 AS start_ns, i1 * 1000000 AS end_ns, x0 AS start_position_m, x1 AS end_position_m,
                 round(rom, 6) + 0.0 AS rom_m, round(dur, 6) + 0.0 AS duration_s, round(rom / dur, 4) + 0.0 AS mean_speed_m_s, round(peak, 4) + 0.0 AS peak_speed_m_s FROM k""",
)
def rep_segments(tb):
    return rounded(rounded(_reps(tb), "rom_m", "duration_s"), "mean_speed_m_s", "peak_speed_m_s", digits=4)


@query(
    "reps_summary",
    "G35",
    REPS_SQL
    + """ SELECT e.entity_id, count(rep_index) AS rep_count, round(avg(rom), 6) + 0.0 AS rom_mean_m, round(max(rom), 6) + 0.0 AS rom_max_m, round(avg(dur), 6) + 0.0 AS duration_mean_s,
                 round(avg(rom / dur), 4) + 0.0 AS mean_speed_mean_m_s, round(max(peak), 4) + 0.0 AS peak_speed_max_m_s,
                 round(CASE WHEN count(rep_index) >= 2 AND arg_min(peak, rep_index) > 0 THEN (arg_min(peak, rep_index) - arg_max(peak, rep_index)) / arg_min(peak, rep_index) END, 6) + 0.0 AS velocity_loss_fraction
          FROM (SELECT DISTINCT entity_id FROM s) e LEFT JOIN k USING (entity_id) GROUP BY 1""",
)
def reps_summary(tb):
    df = bio.reps_summary(_reps(tb), KEY, tb.lpt)
    return rounded(rounded(df, "rom_mean_m", "rom_max_m", "duration_mean_s", "velocity_loss_fraction"), "mean_speed_mean_m_s", "peak_speed_max_m_s", digits=4)
