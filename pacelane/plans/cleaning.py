"""Projection, predicate and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import clean
from pacelane.plans.registry import query, r6


@query(
    "convert_units",
    "P1",
    """WITH u AS (SELECT event_id, value, ['km/h', 'mph', 'ft', 'm/s', 'degC'][CAST(event_id % 5 AS INTEGER) + 1] AS unit FROM events)
       SELECT event_id, round(CASE unit WHEN 'km/h' THEN value * (1000.0::DOUBLE / 3600) WHEN 'mph' THEN value * 0.44704 WHEN 'm/s' THEN value END, 6) + 0.0 AS speed_m_s,
              round(CASE unit WHEN 'ft' THEN value * 0.3048 / 0.01 END, 4) + 0.0 AS length_cm, round(CASE unit WHEN 'degC' THEN (value + 273.15 - 459.67 * 5.0::DOUBLE / 9) / (5.0::DOUBLE / 9) END, 6) + 0.0 AS temperature_degf FROM u""",
)
def convert_units(tb):
    df = tb.table("events").select("event_id", "value", F.expr("element_at(array('km/h', 'mph', 'ft', 'm/s', 'degC'), cast(event_id % 5 as int) + 1)").alias("unit"))
    return df.select(
        "event_id",
        r6(clean.convert_units("value", "unit", "m/s")).alias("speed_m_s"),
        r6(clean.convert_units("value", "unit", "cm"), 4).alias("length_cm"),
        r6(clean.convert_units("value", "unit", "degF")).alias("temperature_degf"),
    )


CLOCK_TEXT = "concat_ws(':', lpad(cast(event_id % 3 as string), 2, '0'), lpad(cast(k % 65 as string), 2, '0'), concat(lpad(cast(event_id % 60 as string), 2, '0'), CASE WHEN k % 11 = 0 THEN ',' ELSE '.' END, lpad(cast(k as string), 2, '0')))"


@query(
    "match_clock_ns",
    "P2",
    """SELECT event_id, CASE WHEN k % 65 < 60 AND k % 11 <> 0 THEN CAST(((event_id % 3) * 3600 + (k % 65) * 60 + event_id % 60) * 1000000000 + k * 10000000 AS BIGINT) END AS t_ns FROM tb_ev""",
)
def match_clock_ns(tb):
    return tb.ev.select("event_id", clean.match_clock_ns(F.expr(CLOCK_TEXT)).alias("t_ns"))


@query("relative_ns", "P3", "SELECT event_id, (us - min(us) OVER (PARTITION BY user_id)) * 1000 AS t_rel_ns FROM tb_ev")
def relative_ns(tb):
    return clean.relative_ns(tb.ev, ["user_id"], "us").select("event_id", "t_rel_ns")


@query(
    "map_clock",
    "P5",
    """SELECT event_id, 5000000000 + CAST(round_even((720.00 - CAST(value AS DECIMAL(20,6))) * 12.5, 0) AS BIGINT) AS down_ns, 7 + CAST(round_even(CAST(value AS DECIMAL(20,6)) * 12.5, 0) AS BIGINT) AS up_ns FROM events""".replace(
        "round_even((720.00 - CAST(value AS DECIMAL(20,6))) * 12.5, 0)", "round_even(CAST((720.00 - CAST(value AS DECIMAL(20,6))) * 12.5 AS DOUBLE), 0)"
    ).replace("round_even(CAST(value AS DECIMAL(20,6)) * 12.5, 0)", "round_even(CAST(CAST(value AS DECIMAL(20,6)) * 12.5 AS DOUBLE), 0)"),
)
def map_clock(tb):
    value = F.col("value")
    down = clean.map_clock(value, scale_to_ns="12.5", period_origin_ns=F.lit(5_000_000_000), counts_down_from=F.lit("720"))
    return tb.table("events").select("event_id", down.alias("down_ns"), clean.map_clock(value, scale_to_ns="12.5", period_origin_ns=F.lit(0).cast("bigint"), offset_ns=7).alias("up_ns"))


@query("apply_alignment", "P6", "SELECT event_id, CAST(round_even(t_rel_ns * 1.5::DOUBLE + 250, 0) AS BIGINT) AS aligned_ns FROM tb_signal")
def apply_alignment(tb):
    return tb.signal.select("event_id", clean.apply_alignment("t_rel_ns", 1.5, 250).alias("aligned_ns"))


@query(
    "rigid_transform",
    "P7",
    """WITH q AS (SELECT *, 0.1 AS a, 0.7 AS b, -0.1 AS c, 0.7 AS d FROM tb_pose)
       SELECT subject_id, t_rel_ns, joint_id, round((1 - 2 * (b * b + c * c)) * x_m + 2 * (a * b - c * d) * y_m + 2 * (a * c + b * d) * z_m + 1.5, 6) + 0.0 AS x,
              round(2 * (a * b + c * d) * x_m + (1 - 2 * (a * a + c * c)) * y_m + 2 * (b * c - a * d) * z_m - 2.5, 6) + 0.0 AS y,
              round(2 * (a * c - b * d) * x_m + 2 * (b * c + a * d) * y_m + (1 - 2 * (a * a + b * b)) * z_m, 6) + 0.0 AS z FROM q""",
)
def rigid_transform(tb):
    moved = clean.rigid_transform(["x_m", "y_m", "z_m"], [F.lit(v) for v in (0.1, 0.7, -0.1, 0.7)], [F.lit(v) for v in (1.5, -2.5, 0.0)])
    return tb.pose.select("subject_id", "t_rel_ns", "joint_id", *[r6(c).alias(n) for c, n in zip(moved, "xyz")])


@query("canonical_id", "P8", "SELECT c_custkey, 'subject-' || substr(md5('bed:subject:' || c_custkey), 1, 24) AS subject_id, 'xw-' || md5('bed:subject:' || c_custkey) AS crosswalk_id FROM customer")
def canonical_id(tb):
    key = F.col("c_custkey")
    return tb.table("customer").select("c_custkey", clean.canonical_id("bed", "subject", key).alias("subject_id"), clean.crosswalk_id("bed", "subject", key).alias("crosswalk_id"))


@query(
    "metric_row_id",
    "P9",
    """SELECT derived_metric_id, 'dm-' || substr(sha256('{"algorithm_id":"loco","dataset_id":"' || dataset_id || '","metric_id":"' || metric_id || '","subject_id":' || coalesce('"' || subject_id || '"', 'null') || '}'), 1, 32) AS row_id,
              'run-' || substr(sha256('{"algorithm_id":"loco","dataset_id":"' || dataset_id || '","input_checksums":["a' || session_id || '","b' || session_id || '"]}'), 1, 16) AS run FROM tb_metric""",
)
def metric_row_id(tb):
    fields = {"dataset_id": F.col("dataset_id"), "metric_id": F.col("metric_id"), "algorithm_id": F.lit("loco"), "subject_id": F.col("subject_id")}
    sums = F.array(F.concat(F.lit("b"), "session_id"), F.concat(F.lit("a"), "session_id"))
    return tb.metric.select(
        "derived_metric_id", clean.metric_row_id(fields).alias("row_id"), clean.run_id({"dataset_id": F.col("dataset_id"), "algorithm_id": F.lit("loco")}, sums).alias("run")
    )


@query("preserve_source", "P10", "SELECT s_suppkey AS source__s_suppkey, s_name AS source__s_name, s_acctbal AS source__s_acctbal, 'x' AS contest FROM supplier")
def preserve_source(tb):
    wide = tb.table("supplier").withColumns({"team_logo": F.col("s_name"), "page_href": F.col("s_name")}).drop("s_nationkey")
    return clean.unprefix_source(clean.preserve_source(wide).withColumn("contest", F.lit("x")))


@query(
    "event_attributes",
    "P12",
    """SELECT event_id, '{"event_type":"' || event_type || '","k":' || k || ',"user_id":' || user_id || '}' AS attributes FROM tb_ev""",
)
def event_attributes(tb):
    return tb.ev.select("event_id", clean.event_attributes(["user_id", "event_type", "k"]).alias("attributes"))


PAYLOAD = "CASE WHEN k % 5 = 0 THEN to_json(named_struct('kind', event_type)) WHEN k % 5 = 1 THEN to_json(named_struct('kind', k, 'n', k)) WHEN k % 5 = 2 THEN to_json(named_struct('kind', event_type, 'n', k, 'extra', k)) ELSE to_json(named_struct('kind', event_type, 'n', k)) END"


@query(
    "check_attributes",
    "P13",
    """SELECT event_id, CASE WHEN k % 5 = 0 THEN 'n' ELSE '' END AS missing, CASE WHEN k % 5 = 2 THEN 'extra' ELSE '' END AS unknown, CASE WHEN k % 5 = 1 THEN 'kind' ELSE '' END AS wrong_type FROM tb_ev""",
)
def check_attributes(tb):
    found = clean.check_attributes("payload", {"kind": "string", "n": "integer"}, required=["kind", "n"])
    return tb.ev.withColumn("payload", F.expr(PAYLOAD)).select("event_id", *[F.concat_ws(",", c).alias(n) for n, c in found.items()])


RECORD = "CASE k % 4 WHEN 0 THEN to_json(named_struct('eventId', event_id, 'loc', array(value, value + 1))) WHEN 1 THEN to_json(named_struct('id', event_id, 'location', named_struct('x', value, 'y', k, 'z', 1))) WHEN 2 THEN to_json(named_struct('event_id', event_id, 'startLoc', named_struct('xyz', array(value, 2, 3)))) ELSE to_json(named_struct('startLocation', 'none')) END"


@query(
    "first_present",
    "P14",
    """SELECT event_id, CASE WHEN k % 4 < 3 THEN CAST(event_id AS VARCHAR) END AS source_event_id, CASE k % 4 WHEN 0 THEN 'loc' WHEN 1 THEN 'location' WHEN 2 THEN 'startLoc' END AS field,
              CASE WHEN k % 4 < 3 THEN value END AS x, round(CASE k % 4 WHEN 0 THEN value + 1 WHEN 1 THEN CAST(k AS DOUBLE) WHEN 2 THEN 2.0 END, 6) + 0.0 AS y, CASE k % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 3.0 END AS z FROM tb_ev""",
)
def first_present(tb):
    rows = tb.ev.withColumn("record", F.expr(RECORD)).withColumn("at", clean.event_location("record"))
    return rows.select("event_id", clean.first_present("record", "id", "eventId", "event_id").alias("source_event_id"), F.col("at.field").alias("field"), F.col("at.x").alias("x"), r6("at.y").alias("y"), F.col("at.z").alias("z"))


@query(
    "finite_split",
    "P15, K2",
    """SELECT sample_index, copy_no, CASE WHEN x_m IS NULL THEN 'coordinate_missing' WHEN isnan(x_m) OR isinf(x_m) THEN 'non_finite_value' END AS rule FROM tb_source_rows""",
)
def finite_split(tb):
    return clean.finite_split(tb.source_rows, ["x_m", "y_m"]).select("sample_index", "copy_no", "rule")


@query(
    "role_domain",
    "P20",
    """WITH g AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN ' Full Back' WHEN 2 THEN 'Midfield' WHEN 3 THEN 'Wide Attacker' WHEN 4 THEN 'Coach' WHEN 5 THEN 'Central Defender' END AS grp, CASE WHEN c_custkey % 11 = 3 THEN 'gk' ELSE 'LW' END AS acr FROM customer)
       SELECT c_custkey, CASE WHEN acr = 'gk' THEN 'GK' WHEN grp = 'Goalkeeper' THEN 'GK' WHEN trim(grp) IN ('Full Back', 'Central Defender') THEN 'DEF' WHEN grp = 'Midfield' THEN 'MID' WHEN grp = 'Wide Attacker' THEN 'ATT' ELSE 'unknown' END AS role FROM g""",
)
def role_domain(tb):
    group = F.expr("CASE c_custkey % 7 WHEN 0 THEN 'Goalkeeper' WHEN 1 THEN ' Full Back' WHEN 2 THEN 'Midfield' WHEN 3 THEN 'Wide Attacker' WHEN 4 THEN 'Coach' WHEN 5 THEN 'Central Defender' END")
    acronym = F.expr("CASE WHEN c_custkey % 11 = 3 THEN 'gk' ELSE 'LW' END")
    return tb.table("customer").select("c_custkey", clean.role_domain(group, acronym).alias("role"))


@query("dead_time", "P21", "SELECT frame_idx, player_count = 0 AND NOT ball_present AS is_dead_time FROM tb_frame_clock")
def dead_time(tb):
    return tb.frame_clock.select("frame_idx", clean.dead_time(F.col("player_count"), F.col("ball_present")).alias("is_dead_time"))


@query(
    "snake_case",
    "P22, 2.9 string",
    r"""SELECT doc_id, lower(regexp_replace(substr(text, 1, 400), '([^\p{Lu}])(\p{Lu})', '\1_\2', 'g')) AS snake FROM documents""".replace("substr(text, 1, 400)", "text"),
)
def snake_case(tb):
    return tb.table("documents").select("doc_id", clean.snake_case("text").alias("snake"))


@query(
    "metric_token",
    "P23",
    r"""SELECT doc_id, nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_'), '') AS token FROM documents""",
)
def metric_token(tb):
    return tb.table("documents").select("doc_id", clean.metric_token("text").alias("token"))


@query(
    "token_collisions",
    "P23",
    r"""SELECT token, count(*) AS names FROM (SELECT DISTINCT lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN ' !' WHEN c_custkey % 3 = 1 THEN '' ELSE ' x' END AS name,
        trim(regexp_replace(lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN ' !' WHEN c_custkey % 3 = 1 THEN '' ELSE ' x' END, '[^a-z0-9]+', '_', 'g'), '_') AS token FROM customer) GROUP BY 1 HAVING count(*) > 1""",
)
def token_collisions(tb):
    return clean.token_collisions(tb.table("customer").select(F.expr("concat(lower(c_mktsegment), CASE WHEN c_custkey % 3 = 0 THEN ' !' WHEN c_custkey % 3 = 1 THEN '' ELSE ' x' END)").alias("name")), "name")


@query("numeric_with_unit", "2.9 string", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS load_kg FROM events")
def numeric_with_unit(tb):
    text = F.expr("concat(cast(cast(value as decimal(10,2)) as string), CASE event_id % 3 WHEN 0 THEN ' KG ' WHEN 1 THEN 'lb' ELSE '' END)")
    return tb.table("events").select("event_id", clean.numeric_with_unit(text, "kg").alias("load_kg"))


@query("iso_ns", "2.9 date/time", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN us * 1000 WHEN 1 THEN (us - 7200000000) * 1000 END AS t_ns FROM tb_ev")
def iso_ns(tb):
    stamp = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = F.concat(stamp, F.expr("CASE event_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '' END"))
    return tb.ev.select("event_id", clean.iso_ns(text).alias("t_ns"))


@query(
    "clean_value",
    "P32",
    "SELECT sample_index, copy_no, CASE WHEN isnan(x_m) OR isinf(x_m) THEN NULL ELSE x_m END AS x_m FROM tb_source_rows",
)
def clean_value(tb):
    return clean.clean_doubles(tb.source_rows.select("sample_index", "copy_no", "x_m"))


@query("event_presentation_class", "P31", "SELECT event_id, CASE WHEN k % 3 = 0 THEN event_type || ' A/' || event_type ELSE event_type || '_a_' || event_type END AS label FROM tb_ev")
def event_presentation_class(tb):
    kind = F.concat("event_type", F.lit(" A/"), "event_type")
    return tb.ev.select("event_id", clean.play_category(F.expr("CASE k % 3 WHEN 0 THEN 'basketball' WHEN 1 THEN 'nba' ELSE 'nhl' END"), kind).alias("label"))


@query(
    "range_position",
    "P39",
    """SELECT subject_id, round(CASE WHEN balance IS NULL OR lo IS NULL THEN NULL WHEN hi = lo THEN 0.5 ELSE least(1, greatest(0, (balance - lo) / (hi - lo))) END, 6) + 0.0 AS position
       FROM tb_season JOIN (SELECT team_id, min(balance) + 1000 AS lo, CASE WHEN team_id < 'C' THEN min(balance) + 1000 ELSE max(balance) - 1000 END AS hi FROM tb_season GROUP BY team_id) USING (team_id)""",
)
def range_position(tb):
    ends = tb.season.groupBy("team_id").agg((F.min("balance") + 1000).alias("lo"), F.when(F.col("team_id") < "C", F.min("balance") + 1000).otherwise(F.max("balance") - 1000).alias("hi"))
    joined = tb.season.join(ends, "team_id")
    return joined.select("subject_id", r6(clean.range_position(F.col("balance"), F.col("lo"), F.col("hi"))).alias("position"))


@query(
    "detection_gate",
    "P17, 2.9 boolean kernels",
    "SELECT stream_id, object_id, count(*) FILTER (is_detected) AS kept, count(*) FILTER (NOT is_detected) AS rejected, bool_or(is_detected) AS usable FROM tb_tracking GROUP BY 1, 2",
)
def detection_gate(tb):
    seen = F.coalesce("is_detected", F.lit(False))
    return tb.tracking.groupBy("stream_id", "object_id").agg(F.count_if(seen).alias("kept"), F.count_if(~seen).alias("rejected"), F.bool_or(F.col("is_detected")).alias("usable"))
