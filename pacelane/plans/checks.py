"""Quality, grain and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import clean
from pacelane.operators import quality as q
from pacelane.plans.registry import query
from pacelane.schema import contract

# A tracking table with planted faults in identity, authority, class and time.
DIRTY = {
    "subject_id": "CASE WHEN k = 5 THEN NULL ELSE object_id END",
    "session_id": "CASE WHEN k = 6 THEN NULL ELSE session_id END",
    "dataset_id": "CASE WHEN k = 7 AND sample_index % 3 = 0 THEN 'other' ELSE dataset_id END",
    "clock_id": "CASE WHEN k = 8 THEN NULL WHEN k = 9 THEN 'c2' ELSE 'c1' END",
    "synchronization_spec_id": "'sync'",
    "coordinate_frame_id": "CASE WHEN k = 10 THEN NULL ELSE 'pitch' END",
    "measurement_class": "CASE WHEN k = 11 THEN NULL WHEN k = 12 THEN 'GUESSED' ELSE 'SOURCE_DERIVED' END",
    "t_rel_ns": "CASE WHEN k = 13 THEN t_rel_ns - 90000000 ELSE t_rel_ns END",
}


def _dirty(tb):
    return tb.tracking.withColumns({n: F.expr(e) for n, e in DIRTY.items()})


DIRTY_SQL = "WITH d AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {n}" for n, e in DIRTY.items() if n in ("session_id", "dataset_id", "t_rel_ns")) + "), " + ", ".join(f"{e} AS {n}" for n, e in DIRTY.items() if n not in ("session_id", "dataset_id", "t_rel_ns")) + " FROM tb_tracking)"


def _rules_sql(keys: str, rules: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS rule, CAST({e} AS BIGINT) AS violations FROM {source} GROUP BY {keys}" for n, e in rules.items())


ROW_RULES = {
    "identity.null:dataset_id": "count(*) FILTER (dataset_id IS NULL)",
    "identity.multiple:dataset_id": "CASE WHEN count(DISTINCT dataset_id) > 1 THEN 1 ELSE 0 END",
    "identity.null:session_id": "count(*) FILTER (session_id IS NULL)",
    "identity.multiple:session_id": "CASE WHEN count(DISTINCT session_id) > 1 THEN 1 ELSE 0 END",
    "authority.null:clock_id": "count(*) FILTER (clock_id IS NULL)",
    "authority.multiple:clock_id": "CASE WHEN count(DISTINCT clock_id) > 1 THEN 1 ELSE 0 END",
    "authority.frame_required": "count(*) FILTER (coordinate_frame_id IS NULL)",
    "measurement_class.illegal": "count(*) FILTER (measurement_class = 'GUESSED')",
    "measurement_class.null": "count(*) FILTER (measurement_class IS NULL)",
    "time.zero_based": "CASE WHEN min(sample_index) <> 0 THEN 1 ELSE 0 END",
    "time.contiguous": "CASE WHEN max(sample_index) <> count(*) - 1 THEN 1 ELSE 0 END",
}

VALIDATE_SQL = (
    DIRTY_SQL
    + ", o AS (SELECT stream_id, count(*) FILTER (t_rel_ns < p) AS n FROM (SELECT *, lag(t_rel_ns) OVER (PARTITION BY stream_id ORDER BY sample_index) AS p FROM d) GROUP BY 1), r AS ("
    + _rules_sql("stream_id", ROW_RULES, "d")
    + " UNION ALL SELECT stream_id, 'time.monotonic:t_rel_ns', n FROM o), v AS (SELECT * FROM r WHERE violations > 0)"
)


@query("validate_tracking", "2.12 identity, time, authority, measurement class", VALIDATE_SQL + " SELECT stream_id, rule, violations FROM v")
def validate_tracking(tb):
    return q.validate(_dirty(tb), contract("tracking"), chunk=500)


@query(
    "quality_issue_rows",
    "2.12 issue rows",
    VALIDATE_SQL + """ SELECT 'qi-' || substr(sha256('bed|' || stream_id || '|' || rule), 1, 24) AS issue_id, 'bed' AS dataset_id, stream_id, rule, 'error' AS severity, '{"violations":' || violations || '}' AS evidence_json FROM v""",
)
def quality_issue_rows(tb):
    return q.to_issues(q.validate(_dirty(tb), contract("tracking"), chunk=500), "bed")


@query(
    "validate_force",
    "2.12 force payload",
    """WITH f AS (SELECT entity_id AS stream_id, CASE WHEN sample_index % 7 = 0 THEN NULL ELSE ratio END AS r, CASE WHEN sample_index % 5 = 0 THEN ratio * 700 END AS z FROM tb_force),
       v AS (SELECT stream_id, 'force.payload.missing' AS rule, count(*) FILTER (r IS NULL AND z IS NULL) AS violations FROM f GROUP BY 1
             UNION ALL SELECT stream_id, 'force.payload.ambiguous', count(*) FILTER (r IS NOT NULL AND z IS NOT NULL) FROM f GROUP BY 1)
       SELECT * FROM v WHERE violations > 0""",
)
def validate_force(tb):
    rows = tb.force.select(
        F.col("entity_id").alias("stream_id"), F.expr("CASE WHEN sample_index % 7 = 0 THEN NULL ELSE ratio END").alias("force_z_body_weight_ratio"), F.expr("CASE WHEN sample_index % 5 = 0 THEN ratio * 700 END").alias("force_z_n")
    )
    return q.count_rules(rows, ["stream_id"], q.force_rules(rows.columns)).drop("rows")


@query(
    "validate_pose",
    "2.12 pose payload",
    """WITH p AS (SELECT subject_id AS stream_id, CASE WHEN joint_id = 3 THEN NULL ELSE is_available END AS a, CASE WHEN joint_id = 4 THEN NULL ELSE x_m END AS x, y_m AS y,
                         CASE WHEN joint_id = 5 THEN 'NaN'::DOUBLE ELSE z_m END AS z, CASE WHEN joint_id = 6 THEN -1.0 WHEN joint_id = 7 THEN 'Infinity'::DOUBLE ELSE error_m END AS e FROM tb_pose),
       v AS (SELECT stream_id, 'pose.availability.null' AS rule, count(*) FILTER (a IS NULL) AS violations FROM p GROUP BY 1
             UNION ALL SELECT stream_id, 'pose.payload.missing_coordinates', count(*) FILTER (coalesce(a, false) AND (x IS NULL OR y IS NULL OR z IS NULL)) FROM p GROUP BY 1
             UNION ALL SELECT stream_id, 'pose.payload.unexpected_coordinates', count(*) FILTER (NOT coalesce(a, false) AND (x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL)) FROM p GROUP BY 1
             UNION ALL SELECT stream_id, 'pose.payload.non_finite', count(*) FILTER (coalesce(a, false) AND (x IS NULL OR isnan(z))) FROM p GROUP BY 1
             UNION ALL SELECT stream_id, 'pose.error.invalid', count(*) FILTER (e < 0 OR isinf(e)) FROM p GROUP BY 1)
       SELECT * FROM v WHERE violations > 0""",
)
def validate_pose(tb):
    rows = tb.pose.withColumns(
        {
            "stream_id": F.col("subject_id"),
            "is_available": F.expr("CASE WHEN joint_id = 3 THEN NULL ELSE is_available END"),
            "x_m": F.expr("CASE WHEN joint_id = 4 THEN NULL ELSE x_m END"),
            "z_m": F.expr("CASE WHEN joint_id = 5 THEN double('NaN') ELSE z_m END"),
            "error_m": F.expr("CASE WHEN joint_id = 6 THEN -1.0D WHEN joint_id = 7 THEN double('Infinity') ELSE error_m END"),
        }
    )
    return q.count_rules(rows, ["stream_id"], q.pose_rules()).drop("rows")


@query(
    "check_schema",
    "2.12 schema, units",
    """SELECT r.rule, r.c AS "column", (SELECT count(*) FROM tb_lpt) AS rows FROM (VALUES ('schema.field.missing', 'velocity_m_s'), ('schema.field.type', 'position_m'), ('schema.metadata.missing', 'load_kg'), ('schema.metadata.units', 'load_n'), ('units.not_si', 'load_n'),
        ('schema.field.unexpected', 'note')) r(rule, c)""",
)
def check_schema(tb):
    from pyspark.sql import types as T

    want = contract("lpt")
    rows = tb.lpt.select(F.col("position_m").cast("float").alias("position_m"), F.lit("x").alias("note"))
    for field in want.fields.fields:
        if field.name in ("position_m", "velocity_m_s"):
            continue
        meta = {} if field.name == "load_kg" else {"si_unit": "lbf"} if field.name == "load_n" else field.metadata
        value = F.lit(0) if not isinstance(field.dataType, T.StringType) else F.lit("")
        rows = rows.withColumn(field.name, (value.cast(field.dataType)).alias(field.name, metadata=meta))
    rows = rows.withColumn("position_m", F.col("position_m").alias("position_m", metadata={"si_unit": "m"}))
    found = q.check_schema(rows, want)
    return found.filter("rule <> 'schema.field.nullability'")


@query("grain_check", "2.12 grain", "SELECT count(*) AS rows, count(*) FILTER (contest_id IS NULL) AS null_key_rows, (SELECT count(*) FROM (SELECT 1 FROM p GROUP BY contest_id, sequence_index HAVING count(*) > 1)) AS duplicate_keys FROM p".replace("SELECT count(*) AS rows", "WITH p AS (SELECT * FROM tb_plays UNION ALL SELECT * FROM tb_plays WHERE sequence_index = 1) SELECT count(*) AS rows", 1))
def grain_check(tb):
    plays = tb.plays.withColumn("period_id", F.lit("p"))
    return q.grain_check(plays.unionByName(plays.filter("sequence_index = 1")), "PLAY_BY_PLAY")


@query(
    "session_participation",
    "2.12 participation",
    """WITH pa AS (SELECT 's' || (o_custkey % 300) AS session_id, 'c' || (o_custkey % 7) AS subject_id, o_orderstatus AS role FROM orders),
       r AS (SELECT session_id, subject_id, role, count(*) AS n FROM pa GROUP BY 1, 2, 3), c AS (SELECT session_id, count(DISTINCT subject_id) AS subjects, count(*) FILTER (n > 1) AS dup FROM r GROUP BY 1),
       s AS (SELECT DISTINCT 's' || (c_custkey % 320) AS session_id, c_custkey % 320 % 2 = 0 AS col FROM customer)
       SELECT session_id, coalesce(subjects, 0) AS subjects, coalesce(dup, 0) AS duplicate_roles, coalesce(subjects, 0) < CASE WHEN col THEN 2 ELSE 1 END AS too_few FROM s LEFT JOIN c USING (session_id)
       WHERE coalesce(subjects, 0) < CASE WHEN col THEN 2 ELSE 1 END OR coalesce(dup, 0) > 0""",
)
def session_participation(tb):
    people = tb.table("orders").select(
        F.expr("concat('s', cast(o_custkey % 300 as string))").alias("session_id"), F.expr("concat('c', cast(o_custkey % 7 as string))").alias("subject_id"), F.col("o_orderstatus").alias("role")
    )
    sessions = tb.table("customer").select(F.expr("concat('s', cast(c_custkey % 320 as string))").alias("session_id"), F.expr("c_custkey % 320 % 2 = 0").alias("is_collective")).distinct()
    return q.session_participation(sessions, people)


@query(
    "table_tests",
    "2.12 mart tests",
    """SELECT 'not_null:subject_id' AS rule, count(*) AS violations FROM tb_metric WHERE subject_id IS NULL UNION ALL SELECT 'accepted_values:dataset_id', count(*) FROM tb_metric WHERE dataset_id = 'd2'
       UNION ALL SELECT 'conditional:computed', count(*) FROM tb_metric WHERE metric_id LIKE 'cmj%' AND computed_at IS NULL UNION ALL SELECT 'unique:session_id', count(*) FROM (SELECT 1 FROM tb_metric GROUP BY session_id HAVING count(*) > 1)""",
)
def table_tests(tb):
    return q.table_tests(
        tb.metric, unique=["derived_metric_id", "session_id"], not_null=["metric_id", "subject_id"], accepted={"dataset_id": ["d0", "d1"]}, conditional={"computed": ("computed_at", "metric_id LIKE 'cmj%'")}
    )


@query(
    "stream_reconciliation",
    "G16",
    """WITH r AS (SELECT stream_id, CASE WHEN copy_no = 1 THEN 'i' WHEN x_m IS NULL OR isnan(x_m) OR isinf(x_m) THEN 'q' ELSE 'c' END AS part FROM tb_source_rows)
       SELECT stream_id, count(*) AS source_records, count(*) FILTER (part = 'c') AS canonical_rows, count(*) FILTER (part = 'q') AS quarantined_rows, count(*) FILTER (part = 'i') AS ignored_records, true AS balances FROM r GROUP BY 1""",
)
def stream_reconciliation(tb):
    rows = clean.finite_split(tb.source_rows, ["x_m", "y_m"])
    kept = rows.filter("copy_no = 0")
    return q.stream_reconciliation(rows, kept.filter("rule IS NULL"), kept.filter("rule IS NOT NULL"), rows.filter("copy_no = 1"))
