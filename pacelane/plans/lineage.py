"""Revision, mart, upsert and sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pacelane.operators import clean
from pacelane.operators import revisions as rev
from pacelane.plans.registry import query
from pacelane.session import work_folder
from pacelane.sinks import tables

CURRENT_SQL = """
    WITH m AS (SELECT *, json_extract_string(provenance, '$.algorithm_id') AS algorithm_id, json_extract_string(provenance, '$.entity_id') AS entity_id FROM tb_metric),
    k AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, metric_id, coalesce(subject_id, ''), session_id, entity_id ORDER BY computed_at DESC NULLS LAST, run_id DESC) AS r,
                 first_value(run_id) OVER (PARTITION BY dataset_id, algorithm_id, coalesce(subject_id, ''), session_id ORDER BY computed_at DESC NULLS LAST, run_id DESC) AS sr FROM m),
    cur AS (SELECT * EXCLUDE (r, sr) FROM k WHERE r = 1 AND run_id = sr)"""


def _metrics(tb):
    return rev.with_provenance(tb.metric)


def _current(tb):
    return rev.current_revision(_metrics(tb))


def _scratch(tb, name: str) -> str:
    return f"{work_folder(tb.spark)}/{name}-{uuid.uuid4().hex}"


@query("current_revision", "W1", CURRENT_SQL + " SELECT derived_metric_id, dataset_id, metric_id, subject_id, session_id, run_id, computed_at, value_num, algorithm_id, entity_id FROM cur")
def current_revision(tb):
    return _current(tb).drop("provenance")


@query("duplicate_current_identity", "W1, 2.12 marts", CURRENT_SQL + " SELECT (SELECT count(*) FROM cur) AS current_rows, (SELECT count(*) FROM (SELECT 1 FROM cur GROUP BY dataset_id, metric_id, subject_id, session_id, entity_id HAVING count(*) > 1)) AS duplicates")
def duplicate_current_identity(tb):
    current = _current(tb)
    bad = rev.duplicate_identities(current).agg(F.count(F.lit(1)).alias("duplicates"))
    return current.agg(F.count(F.lit(1)).alias("current_rows")).join(F.broadcast(bad))  # two one-row sides


@query(
    "latest_run_artifacts",
    "W2",
    """WITH a AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS artifact, l_suppkey % 20 AS scope, l_orderkey AS run_id, l_shipdate FROM lineitem),
       k AS (SELECT *, first_value(run_id) OVER (PARTITION BY scope ORDER BY l_shipdate DESC, run_id DESC) AS f FROM a) SELECT artifact, scope, run_id FROM k WHERE run_id = f""",
)
def latest_run_artifacts(tb):
    rows = tb.table("lineitem").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("artifact"),
        (F.col("l_suppkey") % 20).alias("scope"),
        F.col("l_orderkey").alias("run_id"),
        "l_shipdate",
    )
    return rev.latest_run_rows(rows, ["scope"], "l_shipdate").select("artifact", "scope", "run_id")


DEFINITIONS = "SELECT DISTINCT metric_id, upper(metric_id) AS name, CASE WHEN metric_id LIKE 'cmj%' THEN 'm' ELSE 's' END AS si_unit FROM tb_metric WHERE metric_id NOT LIKE '%low%'"


def _definitions(tb):
    return tb.metric.filter("metric_id NOT LIKE '%low%'").select("metric_id", F.upper("metric_id").alias("name"), F.expr("CASE WHEN metric_id LIKE 'cmj%' THEN 'm' ELSE 's' END").alias("si_unit")).distinct()


@query("metric_with_definition", "J20", CURRENT_SQL + f", d AS ({DEFINITIONS}) SELECT derived_metric_id, cur.metric_id, d.name, d.si_unit FROM cur LEFT JOIN d USING (metric_id)")
def metric_with_definition(tb):
    return rev.metric_with_definition(_current(tb), _definitions(tb)).select("derived_metric_id", "metric_id", "name", "si_unit")


@query(
    "gold_reconciles",
    "2.12 marts, W1",
    CURRENT_SQL + f", d AS ({DEFINITIONS}) SELECT (SELECT count(*) FROM cur LEFT JOIN d USING (metric_id)) AS gold_rows, (SELECT count(*) FROM cur) AS staged_rows",
)
def gold_reconciles(tb):
    current = _current(tb)
    gold = rev.metric_with_definition(current, _definitions(tb)).agg(F.count(F.lit(1)).alias("gold_rows"))
    return gold.join(F.broadcast(current.agg(F.count(F.lit(1)).alias("staged_rows"))))  # two one-row sides


MART_KEYS = ["dataset_id", "session_id", "subject_id", "algorithm_id", "run_id"]


def _mart_sql(where: str, picks: str) -> str:
    return CURRENT_SQL + f" SELECT dataset_id, session_id, subject_id, algorithm_id, run_id, {picks} FROM cur WHERE metric_id LIKE '{where}' GROUP BY ALL"


@query(
    "mart_jump",
    "G1",
    _mart_sql("cmj.%", "max(value_num) FILTER (metric_id = 'cmj.high') AS high, max(value_num) FILTER (metric_id = 'cmj.urgent') AS urgent, max(value_num) FILTER (metric_id = 'cmj.low') AS low, max(value_num) FILTER (metric_id = 'cmj.medium') AS medium"),
)
def mart_jump(tb):
    picks = {n: ("max", f"cmj.{n}") for n in ("high", "urgent", "low", "medium")}
    return rev.pivot_metrics(_current(tb).filter("metric_id LIKE 'cmj.%'"), MART_KEYS, picks)


@query(
    "mart_pose_summary",
    "G2",
    _mart_sql("pose.%", "count(*) AS pose_metric_count, max(value_num) FILTER (metric_id LIKE 'pose.h%') AS max_h, min(value_num) FILTER (metric_id LIKE 'pose.%') AS min_any, max(value_num) FILTER (metric_id LIKE 'pose.not%') AS max_not"),
)
def mart_pose_summary(tb):
    picks = {"max_h": ("max", "pose.h%"), "min_any": ("min", "pose.%"), "max_not": ("max", "pose.not%")}
    return rev.pivot_metrics(_current(tb).filter("metric_id LIKE 'pose.%'"), MART_KEYS, picks, count="pose_metric_count")


@query(
    "mart_player_load",
    "G3",
    CURRENT_SQL
    + """ SELECT dataset_id, session_id, subject_id, entity_id, algorithm_id, run_id, count(*) AS locomotor_metric_count, max(value_num) FILTER (metric_id = 'locomotor.high') AS high,
                 max(value_num) FILTER (metric_id = 'locomotor.low') AS low, max(value_num) FILTER (metric_id = 'locomotor.not_specified') AS not_specified FROM cur WHERE metric_id LIKE 'locomotor.%' GROUP BY ALL""",
)
def mart_player_load(tb):
    picks = {n: ("max", f"locomotor.{n}") for n in ("high", "low", "not_specified")}
    return rev.pivot_metrics(_current(tb).filter("metric_id LIKE 'locomotor.%'"), [*MART_KEYS, "entity_id"], picks, count="locomotor_metric_count")


@query(
    "mart_provenance",
    "G4, J21",
    CURRENT_SQL
    + """, a AS (SELECT 'run-' || lpad(CAST(l_orderkey AS VARCHAR), 8, '0') AS run_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT cur.run_id, dataset_id, algorithm_id, min(computed_at) AS first_computed_at, max(computed_at) AS last_computed_at, count(*) AS metric_count, coalesce(any_value(n), 0) AS artifact_count
    FROM cur LEFT JOIN a USING (run_id) GROUP BY 1, 2, 3""",
)
def mart_provenance(tb):
    artifacts = tb.table("lineitem").select(F.concat(F.lit("run-"), F.lpad(F.col("l_orderkey").cast("string"), 8, "0")).alias("run_id"))
    return rev.mart_provenance(_current(tb), artifacts)


def _halves(tb):
    rows = tb.table("orders").select("o_orderkey", (F.col("o_custkey") % 400).alias("key"), "o_totalprice", "o_orderstatus")
    return rows.filter("o_orderkey % 3 = 0"), rows.filter("o_orderkey % 3 <> 0")


HALVES = """WITH o AS (SELECT o_orderkey, o_custkey % 400 AS key, o_totalprice, o_orderstatus FROM orders), a0 AS (SELECT * FROM o WHERE o_orderkey % 3 = 0), b AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0),
    a AS (SELECT * FROM a0 WHERE key % 2 = 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderkey) = 1)"""


def _stored(tb):
    first, _ = _halves(tb)
    return rev.insert_or_ignore(first.limit(0), first.filter("key % 2 = 0"), ["key"], ["o_orderkey"])


@query("insert_or_ignore", "K6", HALVES + " SELECT * FROM b WHERE key NOT IN (SELECT key FROM a) QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderkey) = 1")
def insert_or_ignore(tb):
    return rev.insert_or_ignore(_stored(tb), _halves(tb)[1], ["key"], ["o_orderkey"])


@query(
    "upsert_refresh",
    "K7",
    HALVES + " SELECT * FROM (SELECT *, 0 AS n FROM a UNION ALL SELECT *, 1 FROM b WHERE key % 5 = 0) QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, o_orderkey DESC) = 1".replace("SELECT * FROM (SELECT", "SELECT * EXCLUDE (n) FROM (SELECT", 1),
)
def upsert_refresh(tb):
    return rev.upsert_refresh(_stored(tb), _halves(tb)[1].filter("key % 5 = 0"), ["key"], ["o_orderkey"])


@query("replace_by_path", "K8", HALVES + " SELECT * FROM a0 WHERE key NOT IN (SELECT key FROM b WHERE key % 7 = 0) UNION ALL SELECT * FROM b WHERE key % 7 = 0")
def replace_by_path(tb):
    old, new = _halves(tb)
    return rev.replace_by_path(old, new.filter("key % 7 = 0"), ["key"])


@query(
    "definition_conflicts",
    "K9",
    """SELECT p_partkey AS metric_id, concat_ws(',', CASE WHEN p_partkey % 4 = 0 THEN 'unit' END, CASE WHEN p_partkey % 6 = 0 THEN 'name' END) AS fields FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 6 = 0""",
)
def definition_conflicts(tb):
    known = tb.table("part").select(F.col("p_partkey").alias("metric_id"), F.col("p_brand").alias("unit"), F.col("p_name").alias("name"))
    given = known.select("metric_id", F.expr("CASE WHEN metric_id % 4 = 0 THEN concat(unit, '?') ELSE unit END").alias("unit"), F.expr("CASE WHEN metric_id % 6 = 0 THEN NULL ELSE name END").alias("name"))
    return rev.definition_conflicts(known, given, "metric_id", ["unit", "name"]).withColumn("fields", F.array_join("fields", ","))


@query(
    "import_source_metrics",
    "K10",
    """SELECT 'dm-' || substr(sha256('{"dataset_id":"' || dataset_id || '","metric_id":"source.' || metric_id || '","subject_id":' || coalesce('"' || subject_id || '"', 'null') || '}'), 1, 32) AS derived_metric_id,
              dataset_id, 'source.' || metric_id AS metric_id, arg_min(value_num, tb_metric.derived_metric_id) AS value_num, 'source-provided' AS origin FROM tb_metric GROUP BY dataset_id, metric_id, subject_id""",
)
def import_source_metrics(tb):
    given = tb.metric.withColumn("metric_id", F.concat(F.lit("source."), "metric_id"))
    key = clean.metric_row_id({n: F.col(n) for n in ("dataset_id", "metric_id", "subject_id")})
    rows = given.select(key.alias("id"), "dataset_id", "metric_id", "value_num", F.lit("source-provided").alias("origin"), F.col("derived_metric_id").alias("seq"))
    stored = rev.insert_or_ignore(rows.limit(0), rows, ["id"], ["seq"])
    return stored.select(F.col("id").alias("derived_metric_id"), "dataset_id", "metric_id", "value_num", "origin")


@query(
    "pending_inputs",
    "K12",
    """SELECT s_suppkey AS stream_id FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 5 <> 2)""",
)
def pending_inputs(tb):
    base = tb.table("supplier").select(F.col("s_suppkey").alias("stream_id"), F.lit("loco").alias("algorithm_id"), F.lit("p1").alias("parameters_hash"), F.array(F.concat(F.lit("c"), F.col("s_suppkey").cast("string")), F.lit("meta")).alias("checksums"))
    other = F.when(F.col("stream_id") % 5 == 2, F.array(F.lit("old"), F.lit("meta"))).otherwise(F.col("checksums"))
    status = F.expr("CASE WHEN stream_id % 3 = 0 THEN 'completed' ELSE 'failed' END")
    runs = base.select("stream_id", "algorithm_id", "parameters_hash", other.alias("input_checksums"), status.alias("status"))
    return rev.pending_inputs(base, runs.unionByName(runs)).select("stream_id")


@query("fingerprint", "K11, G45", None)
def fingerprint(tb):
    plain = rev.fingerprint(tb.table("documents")).withColumn("copy", F.lit("written"))
    # Dealt by id, not by one of a few languages: no task reads more than its share.
    again = rev.fingerprint(tb.table("documents").repartition("doc_id")).withColumn("copy", F.lit("reordered"))
    return plain.unionByName(again)


@query("acceptance_rerun", "G45, K11", "SELECT source, count(*) AS rows, true AS identical FROM documents GROUP BY 1")
def acceptance_rerun(tb):
    first = rev.fingerprint(tb.table("documents"), ["source"])
    second = rev.fingerprint(tb.table("documents").repartition("doc_id"), ["source"]).withColumnsRenamed({"rows": "r2", "hash_sum": "s2", "hash_xor": "x2"})
    same = (F.col("rows") == F.col("r2")) & (F.col("hash_sum") == F.col("s2")) & (F.col("hash_xor") == F.col("x2"))
    return first.join(second, "source", "full_outer").select("source", "rows", F.coalesce(same, F.lit(False)).alias("identical"))


@query("write_stream", "K1, L8", "SELECT dataset_id, 'tracking' AS modality, session_id, stream_id, t_rel_ns, object_id, round(x_m, 6) + 0.0 AS x_m FROM tb_tracking")
def write_stream(tb):
    path = _scratch(tb, "stream")
    rows = tb.tracking.withColumn("modality", F.lit("tracking")).select("dataset_id", "modality", "session_id", "stream_id", "t_rel_ns", "object_id", F.round("x_m", 6).alias("x_m"))
    tables.write_stream(rows, path, slice_ns=2_000_000_000)
    return tb.spark.read.parquet(path).withColumn("x_m", F.col("x_m") + F.lit(0.0))


@query(
    "write_quarantine",
    "K2",
    "SELECT CASE WHEN x_m IS NULL THEN 'coordinate_missing' ELSE 'non_finite_value' END AS rule, count(*) AS rows, min(sample_index) AS first_row FROM tb_source_rows WHERE x_m IS NULL OR isnan(x_m) OR isinf(x_m) GROUP BY 1",
)
def write_quarantine(tb):
    path = _scratch(tb, "quarantine")
    tables.write_quarantine(clean.finite_split(tb.source_rows, ["x_m", "y_m"]), path)
    return tb.spark.read.parquet(path).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"), F.min("sample_index").alias("first_row"))


@query("write_series", "K3", "SELECT 'loco' AS algorithm_id, s.series, count(*) AS rows FROM tb_ball, (VALUES ('a'), ('b')) s(series) GROUP BY 1, 2")
def write_series(tb):
    path = _scratch(tb, "series")
    rows = tb.ball.select("stream_id", "t_rel_ns", "x_m")
    digest = clean.parameters_hash({"window_s": 1.0, "edge": "none"})
    for series in ("a", "b", "a"):
        tables.write_series(rows, path, algorithm_id="loco", parameters_hash=digest, series=series)
    return tb.spark.read.parquet(path).groupBy("algorithm_id", "series").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "export_serving",
    "K4",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, '{\"s\":\"' || o_orderstatus || '\",\"c\":' || o_custkey || '}' AS detail FROM orders",
)
def export_serving(tb):
    path = _scratch(tb, "serving")
    orders = tb.table("orders").select("o_orderkey", "o_orderdate", F.struct(F.col("o_orderstatus").alias("s"), F.col("o_custkey").alias("c")).alias("detail"))
    tables.export_serving({"orders": (orders, ["o_orderkey"])}, path)
    return tb.spark.read.parquet(f"{path}/orders")


@query("publish_marts", "K5", CURRENT_SQL + " SELECT dataset_id, count(*) AS rows FROM cur GROUP BY 1")
def publish_marts(tb):
    path = _scratch(tb, "marts")
    runs = tb.metric.select("run_id", F.lit("processor").alias("origin"), F.md5("run_id").alias("code_sha"))
    tables.publish_marts({"counts": _current(tb).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("rows"))}, runs, path)
    return tb.spark.read.parquet(f"{path}/counts")


@query("unpublishable_runs", "K5", "SELECT run_id FROM tb_metric WHERE derived_metric_id % 50 = 0")
def unpublishable_runs(tb):
    runs = tb.metric.select("run_id", F.lit("processor").alias("origin"), F.expr("CASE WHEN derived_metric_id % 50 = 0 THEN ' ' ELSE run_id END").alias("code_sha"))
    return tables.unpublishable_runs(runs)
