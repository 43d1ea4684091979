"""Segment, gap and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import ordered, segments as seg
from pacelane.plans.registry import query, r6, rounded
from pacelane.testbed import POSE_CHUNK, SIGNAL_CHUNK, TRACK, TRACK_CHUNK

HOUR = 3_600_000_000_000
ORDER = ["t_rel_ns"]


@query(
    "segment_by_gap",
    "W9",
    f"""SELECT entity_id, t_rel_ns, CAST(sum(CASE WHEN t_rel_ns - p > {9 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS BIGINT) AS segment_index
        FROM (SELECT *, lag(t_rel_ns) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS p FROM tb_signal)""",
)
def segment_by_gap(tb):
    return seg.segment_by_gap(tb.signal, ["entity_id"], ORDER, 9 * HOUR, chunk=SIGNAL_CHUNK).select("entity_id", "t_rel_ns", "segment_index")


@query(
    "runs",
    "W10",
    f"""WITH a AS (SELECT *, event_type <> 'error' AS ok, coalesce(t_rel_ns - lag(t_rel_ns) OVER w > {24 * HOUR}, false) AS gap,
                    coalesce(lag(event_type <> 'error') OVER w, false) AS before FROM tb_signal WINDOW w AS (PARTITION BY entity_id ORDER BY t_rel_ns)),
         b AS (SELECT *, sum(CASE WHEN ok AND (NOT before OR gap) THEN 1 ELSE 0 END) OVER (PARTITION BY entity_id ORDER BY t_rel_ns) AS run FROM a)
         SELECT entity_id, min(t_rel_ns) AS start_ns, max(t_rel_ns) AS end_ns, count(*) AS samples FROM b WHERE ok GROUP BY entity_id, run""",
)
def runs(tb):
    return seg.runs(tb.signal, ["entity_id"], ORDER, F.col("event_type") != "error", 24 * HOUR, chunk=SIGNAL_CHUNK)


@query(
    "dropout_intervals",
    "W11, G49",
    """WITH span AS (SELECT subject_id, min(t_rel_ns) AS f, max(t_rel_ns) AS l FROM tb_pose GROUP BY 1),
       grid AS (SELECT subject_id, f + r.range * 40000000 AS t FROM span, range(2000000) r WHERE f + r.range * 40000000 <= l),
       joints AS (SELECT DISTINCT subject_id, joint_name FROM tb_pose),
       cell AS (SELECT g.subject_id, j.joint_name, g.t, coalesce(p.is_available, false) AS ok
                FROM grid g JOIN joints j USING (subject_id) LEFT JOIN tb_pose p ON p.subject_id = g.subject_id AND p.joint_name = j.joint_name AND p.t_rel_ns = g.t),
       isl AS (SELECT *, row_number() OVER (PARTITION BY subject_id, joint_name ORDER BY t) - row_number() OVER (PARTITION BY subject_id, joint_name, ok ORDER BY t) AS i FROM cell)
       SELECT subject_id, joint_name, min(t) AS start_ns, max(t) + 40000000 AS end_ns, count(*) AS missing_frames, round(count(*) * 0.04::DOUBLE, 6) + 0.0 AS duration_s
       FROM isl WHERE NOT ok GROUP BY subject_id, joint_name, i""".replace("range(2000000)", "range(100000)"),
)
def dropout_intervals(tb):
    df = seg.dropout_intervals(tb.pose, ["subject_id"], ["joint_name"], "t_rel_ns", 40_000_000, F.col("is_available"), chunk=POSE_CHUNK)
    return rounded(df, "duration_s")


@query(
    "coverage_by_grid",
    "G49",
    """SELECT subject_id, joint_name, min(t_rel_ns) AS first_ns, max(t_rel_ns) AS last_ns, (max(t_rel_ns) - min(t_rel_ns) + 20000000) // 40000000 + 1 AS expected_ticks,
              count(*) FILTER (is_available) AS usable_ticks, 0::BIGINT AS off_grid_rows,
              round(count(*) FILTER (is_available) / ((max(t_rel_ns) - min(t_rel_ns) + 20000000) // 40000000 + 1), 6) + 0.0 AS coverage
       FROM tb_pose GROUP BY 1, 2""",
)
def coverage_by_grid(tb):
    return rounded(seg.coverage_by_grid(tb.pose, ["subject_id", "joint_name"], "t_rel_ns", 40_000_000, F.col("is_available")), "coverage")


@query(
    "duplicate_frames",
    "W18",
    """SELECT object_id, sample_index, copy_no, coalesce(frame <= lag(frame) OVER (PARTITION BY object_id ORDER BY sample_index, copy_no), false) AS is_duplicate FROM tb_source_rows""",
)
def duplicate_frames(tb):
    return seg.duplicate_frames(tb.source_rows, ["object_id"], ["sample_index", "copy_no"], "frame", chunk=2000).select("object_id", "sample_index", "copy_no", "is_duplicate")


@query(
    "first_per_object",
    "W18",
    "SELECT stream_id, t_rel_ns, object_id, min(copy_no) AS copy_no, arg_min(k, copy_no) AS k FROM tb_source_rows GROUP BY 1, 2, 3",
)
def first_per_object(tb):
    rows = tb.source_rows.select("stream_id", "t_rel_ns", "object_id", "sample_index", "copy_no", "k")
    return seg.first_per_object(rows, ["stream_id", "t_rel_ns", "object_id"], ["sample_index", "copy_no"]).drop("sample_index")


@query(
    "frame_time_check",
    "W19",
    """WITH r AS (SELECT stream_id, object_id, frame, t_rel_ns + CASE WHEN k % 9 = 0 THEN 2000000 ELSE 0 END AS t FROM tb_tracking),
       o AS (SELECT stream_id, object_id, arg_min(t, frame) AS t0, min(frame) AS f0 FROM r GROUP BY 1, 2)
       SELECT stream_id, object_id, frame, abs(t0 + (frame - f0) * 40000000 - t) > 1000000 AS time_mismatch FROM r JOIN o USING (stream_id, object_id)""",
)
def frame_time_check(tb):
    rows = tb.tracking.withColumn("t", F.col("t_rel_ns") + F.expr("CASE WHEN k % 9 = 0 THEN 2000000 ELSE 0 END"))
    return seg.frame_time_check(rows, TRACK, "frame", "t", 40_000_000, 1_000_000).select(*TRACK, "frame", "time_mismatch")


@query(
    "assign_sample_index",
    "W20",
    "SELECT stream_id, frame, object_id, row_number() OVER (PARTITION BY stream_id ORDER BY frame, object_id) - 1 AS new_index FROM tb_tracking",
)
def assign_sample_index(tb):
    df = ordered.number(tb.tracking, ["stream_id"], ["frame", "object_id"], "new_index", chunk=30)
    return df.select("stream_id", "frame", "object_id", "new_index")


@query(
    "wallclock_monotone",
    "W27, W29",
    """WITH s AS (SELECT stream_id, sample_index, t_rel_ns + CASE WHEN k = 3 THEN -40000000 ELSE 0 END AS t, frame FROM tb_tracking),
       d AS (SELECT *, lag(t) OVER w AS pt, lag(frame) OVER w AS pf FROM s WINDOW w AS (PARTITION BY stream_id ORDER BY sample_index))
       SELECT stream_id, count(*) FILTER (t < pt) AS t_reordered, count(*) FILTER (frame < pf) AS frame_reordered,
              count(*) FILTER (t = pt) AS t_repeated, count(*) FILTER (frame = pf) AS frame_repeated, count(*) AS rows FROM d GROUP BY 1""",
)
def wallclock_monotone(tb):
    rows = tb.tracking.withColumn("t", F.col("t_rel_ns") + F.expr("CASE WHEN k = 3 THEN -40000000 ELSE 0 END"))
    return seg.order_checks(rows.select("stream_id", "sample_index", "t", "frame"), ["stream_id"], ["sample_index"], ["t", "frame"], chunk=500)


@query(
    "clock_deltas",
    "G38",
    """SELECT contest_id, delta, count(*) AS steps FROM (SELECT contest_id, wall - lag(wall) OVER (PARTITION BY contest_id ORDER BY frame_idx) AS delta
       FROM (SELECT *, wall_clock_ms + (frame_idx // 7) * 40 AS wall FROM tb_frame_clock)) WHERE delta IS NOT NULL GROUP BY ALL""",
)
def clock_deltas(tb):
    late = tb.frame_clock.withColumn("wall_clock_ms", F.expr("wall_clock_ms + (frame_idx div 7) * 40"))  # a longer step every 7 frames
    return seg.step_histogram(late, ["contest_id"], ["frame_idx"], "wall_clock_ms", chunk=100)


@query(
    "trail",
    "W28",
    """SELECT stream_id, object_id, t_rel_ns, len(l) AS points, round(list_sum(l), 6) + 0.0 AS x_total FROM (
         SELECT stream_id, object_id, t_rel_ns, list(x_m) OVER (PARTITION BY stream_id, object_id ORDER BY t_rel_ns RANGE BETWEEN 200000000 PRECEDING AND CURRENT ROW) AS l FROM tb_tracking)""",
)
def trail(tb):
    df = seg.trail(tb.tracking, TRACK, "t_rel_ns", ["t_rel_ns", "x_m", "y_m"], 200_000_000, chunk=TRACK_CHUNK)
    return df.select(*TRACK, "t_rel_ns", F.size("trail").alias("points"), r6(F.expr("aggregate(trail, 0D, (a, p) -> a + p.x_m)")).alias("x_total"))


@query(
    "sample_frames",
    "W25",
    """WITH RECURSIVE f AS (SELECT DISTINCT entity_id, t_rel_ns FROM tb_signal),
       walk(entity_id, t_rel_ns) AS (
         SELECT entity_id, min(t_rel_ns) FROM f GROUP BY 1
         UNION ALL
         SELECT w.entity_id, (SELECT min(f.t_rel_ns) FROM f WHERE f.entity_id = w.entity_id AND f.t_rel_ns >= w.t_rel_ns + 36000000000000) FROM walk w WHERE w.t_rel_ns IS NOT NULL)
       SELECT entity_id, t_rel_ns FROM walk WHERE t_rel_ns IS NOT NULL""",
)
def sample_frames(tb):
    return seg.sample_frames(tb.signal, ["entity_id"], "t_rel_ns", 10 * HOUR, chunk=6 * SIGNAL_CHUNK, fan_in=2)
