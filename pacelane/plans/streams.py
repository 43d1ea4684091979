"""Structured Streaming queries over the event table read as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pacelane.plans.registry import query
from pacelane.schema import contract
from pacelane.session import work_folder
from pacelane.streaming import live, validator

DELAY = "1 hour"


def _events(tb):
    stream = live.stream_table(tb.spark, tb.folder, "events.parquet")
    return stream.select(F.col("user_id").alias("entity_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _path(tb, name):
    return f"{work_folder(tb.spark)}/{name}-{uuid.uuid4().hex}"


WATERMARK = "(SELECT max(us) - 3600000000 FROM tb_ev)"


@query(
    "live_segments",
    "T2",
    f"""WITH g AS (SELECT user_id, us, CASE WHEN us - lag(us) OVER w < 14400000000 THEN 0 ELSE 1 END AS s FROM tb_ev WINDOW w AS (PARTITION BY user_id ORDER BY us)),
        i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY us) AS seg FROM g)
        SELECT user_id AS entity_id, min(us) AS first_us, max(us) AS last_us, count(*) AS samples FROM i GROUP BY user_id, seg HAVING max(us) + 14400000000 <= {WATERMARK}""",
)
def live_segments(tb):
    out = live.run_available(live.live_segments(_events(tb), ["entity_id"], "ts", "4 hours", DELAY), _path(tb, "segments"))
    return out.select("entity_id", F.unix_micros("segment_start").alias("first_us"), F.unix_micros("segment_last").alias("last_us"), "samples")


@query(
    "live_envelope",
    "T3",
    f"""SELECT user_id AS entity_id, us // 43200000000 * 43200000000 AS bucket_us, count(*) AS bucket_rows, min(value) AS value_min, max(value) AS value_max FROM tb_ev GROUP BY 1, 2 HAVING (us // 43200000000 + 1) * 43200000000 <= {WATERMARK}""".replace(
        "GROUP BY 1, 2 HAVING (us // 43200000000 + 1)", "GROUP BY user_id, us // 43200000000 HAVING (us // 43200000000 + 1)"
    ),
)
def live_envelope(tb):
    out = live.run_available(live.live_envelope(_events(tb), ["entity_id"], "ts", "12 hours", DELAY, ["value"]), _path(tb, "envelope"))
    return out.select("entity_id", F.unix_micros("bucket_start").alias("bucket_us"), "bucket_rows", "value_min", "value_max")


@query(
    "live_event_join",
    "T4",
    """SELECT a.event_id, b.event_id AS frame_event FROM tb_ev a JOIN tb_ev b ON a.user_id = b.user_id AND a.k = b.k WHERE a.event_type = 'click' AND b.event_type = 'view' AND abs(a.us - b.us) <= 172800000000""",
)
def live_event_join(tb):
    clicks = _events(tb).filter("event_type = 'click'").select("entity_id", "k", "ts", "event_id")
    views = _events(tb).filter("event_type = 'view'").select("entity_id", "k", F.col("ts").alias("frame_ts"), F.col("event_id").alias("frame_event"))
    joined = live.live_event_join(clicks, views, ["entity_id", "k"], "ts", "frame_ts", DELAY, "48 hours")
    return live.run_available(joined, _path(tb, "join")).select("event_id", "frame_event")


@query("live_dedupe", "T5", "SELECT DISTINCT user_id AS entity_id, k FROM tb_ev")
def live_dedupe(tb):
    seen = live.live_dedupe(_events(tb), ["entity_id", "k"], "ts", DELAY)
    return live.run_available(seen, _path(tb, "dedupe")).select("entity_id", "k")


@query(
    "validate_stream",
    "T1",
    """WITH r AS (SELECT user_id, event_id, us + CASE WHEN k = 4 THEN -90000000000 ELSE 0 END AS t FROM tb_ev), d AS (SELECT *, t <= lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS bad FROM r)
       SELECT CAST(user_id AS VARCHAR) AS stream_id, count(*) AS rows, count(*) FILTER (bad) AS violations FROM d GROUP BY 1""",
)
def validate_stream(tb):
    rows = _events(tb).select(F.col("entity_id").cast("string").alias("stream_id"), F.col("event_id").alias("sample_index"), (F.unix_micros("ts") + F.expr("CASE WHEN k = 4 THEN -90000000000 ELSE 0 END")).alias("t_rel_ns"))
    return live.validate_stream(rows, _path(tb, "validate"), strict=True, chunk=2000).select("stream_id", "rows", "violations")


FORCE_SQL = """
    WITH r AS (SELECT 'st' || user_id % 50 AS stream_id, CASE WHEN k <> 1 THEN 'd' END AS dataset_id, 's' || CASE WHEN user_id % 50 = 3 THEN k % 2 ELSE 0 END AS session_id, CASE WHEN k <> 2 THEN user_id END AS subject_id,
                      CASE WHEN k <> 3 THEN event_id END AS i, CASE WHEN k <> 4 THEN us + CASE WHEN k = 5 THEN -90000000000 ELSE 0 END END AS t,
                      CASE WHEN k = 6 THEN 'GUESSED' WHEN k = 7 THEN NULL ELSE 'RAW_MEASURED' END AS c, CASE WHEN k <> 8 THEN 'clock' || CASE WHEN user_id % 50 = 4 THEN k % 3 ELSE 0 END END AS clock,
                      CASE WHEN k <> 9 THEN 'sync' END AS sync, CASE WHEN k <> 10 THEN 'frame' || CASE WHEN user_id % 50 = 5 THEN k % 2 ELSE 0 END END AS frame,
                      k <> 11 AND k % 2 = 0 AS newton, k <> 11 AND (k % 2 = 1 OR k = 12) AS ratio FROM tb_ev),
    o AS (SELECT *, i <= lag(i) OVER w AS bad_i, t <= lag(t) OVER w AS bad_t FROM r WHERE i IS NOT NULL WINDOW w AS (PARTITION BY stream_id ORDER BY i)),
    v AS (SELECT stream_id, unnest([{'rule': 'identity.null:dataset_id', 'n': count(*) FILTER (dataset_id IS NULL)}, {'rule': 'identity.multiple:session_id', 'n': CAST(min(session_id) <> max(session_id) AS BIGINT)},
                {'rule': 'identity.subject_required', 'n': count(*) FILTER (subject_id IS NULL)}, {'rule': 'authority.null:clock_id', 'n': count(*) FILTER (clock IS NULL)},
                {'rule': 'authority.multiple:clock_id', 'n': CAST(min(clock) <> max(clock) AS BIGINT)}, {'rule': 'authority.null:synchronization_spec_id', 'n': count(*) FILTER (sync IS NULL)},
                {'rule': 'authority.frame_required', 'n': count(*) FILTER (frame IS NULL)}, {'rule': 'authority.frame_multiple', 'n': CAST(min(frame) <> max(frame) AS BIGINT)},
                {'rule': 'measurement_class.illegal', 'n': count(*) FILTER (c = 'GUESSED')}, {'rule': 'measurement_class.null', 'n': count(*) FILTER (c IS NULL)},
                {'rule': 'force.payload.missing', 'n': count(*) FILTER (NOT newton AND NOT ratio)}, {'rule': 'force.payload.ambiguous', 'n': count(*) FILTER (newton AND ratio)},
                {'rule': 'time.null:sample_index', 'n': count(*) FILTER (i IS NULL)}, {'rule': 'time.null:t_rel_ns', 'n': count(*) FILTER (t IS NULL)}], recursive := true) FROM r GROUP BY 1
          UNION ALL
          SELECT stream_id, unnest([{'rule': 'time.monotonic:sample_index', 'n': count(*) FILTER (bad_i)}, {'rule': 'time.monotonic:t_rel_ns', 'n': count(*) FILTER (bad_t)}, {'rule': 'time.zero_based', 'n': CAST(min(i) <> 0 AS BIGINT)},
                {'rule': 'time.contiguous', 'n': CAST(max(i) <> count(*) - 1 AS BIGINT)}], recursive := true) FROM o GROUP BY 1)
    SELECT stream_id, rule, n AS violations FROM v WHERE n > 0"""


@query("validate_live", "T1", FORCE_SQL)
def validate_live(tb):
    """A force contract over the events as they arrive, with a defect of every kind planted."""
    user = F.col("entity_id") % 50
    word = lambda text, stream, by: F.concat(F.lit(text), F.when(user == stream, F.col("k") % by).otherwise(0).cast("string"))
    unless = lambda k, value: F.when(F.col("k") != k, value)
    newton = (F.col("k") != 11) & (F.col("k") % 2 == 0)
    ratio = (F.col("k") != 11) & ((F.col("k") % 2 == 1) | (F.col("k") == 12))
    time = F.unix_micros("ts") + F.expr("CASE WHEN k = 5 THEN -90000000000 ELSE 0 END")
    rows = _events(tb).select(
        F.concat(F.lit("st"), user.cast("string")).alias("stream_id"), unless(1, F.lit("d")).alias("dataset_id"), word("s", 3, 2).alias("session_id"), unless(2, F.col("entity_id")).alias("subject_id"),
        unless(3, F.col("event_id")).alias("sample_index"), unless(4, time).alias("t_rel_ns"), F.when(F.col("k") == 6, "GUESSED").when(F.col("k") != 7, "RAW_MEASURED").alias("measurement_class"),
        unless(8, word("clock", 4, 3)).alias("clock_id"), unless(9, F.lit("sync")).alias("synchronization_spec_id"), unless(10, word("frame", 5, 2)).alias("coordinate_frame_id"),
        F.when(newton, 1.0).alias("force_z_n"), F.when(ratio, 1.0).alias("force_z_body_weight_ratio"),
    )
    return validator.validate_live(rows, contract("force"), _path(tb, "live"), width=500)
