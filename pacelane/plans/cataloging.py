"""Catalog, capability, provenance and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import catalog as cat
from pacelane.plans.lineage import CURRENT_SQL, _current
from pacelane.plans.registry import query
from pacelane.sources import taxonomy

CAPS = "CASE entry_id % 4 WHEN 0 THEN array('TRACKING', 'EVENTS') WHEN 1 THEN array('SEASON_AGGREGATE') WHEN 2 THEN array('FORCE') ELSE cast(array() as array<string>) END"
GRAINS = "CASE WHEN entry_id % 3 = 0 THEN array('FRAME_SERIES', 'TRIAL_SERIES') ELSE array('PLAYER_SEASON', 'EVENT_SERIES') END"


@query(
    "readiness",
    "P28",
    """SELECT entry_id, CASE WHEN availability_state = 'ACQUISITION_FAILED' THEN 'UPSTREAM_FAILED' WHEN entry_id % 4 < 3 THEN 'UPSTREAM_AVAILABLE' ELSE 'UPSTREAM_UNAVAILABLE' END AS readiness,
              CASE availability_state WHEN 'UPSTREAM_AVAILABLE' THEN 'register' WHEN 'REGISTERED' THEN 'acquire' WHEN 'ACQUISITION_FAILED' THEN 'acquire' WHEN 'ACQUIRED' THEN 'materialize'
                   WHEN 'MATERIALIZATION_FAILED' THEN 'materialize' WHEN 'MATERIALIZED' THEN 'validate' WHEN 'VALIDATION_FAILED' THEN 'validate' END AS next_action FROM tb_catalog""",
)
def readiness(tb):
    state = F.col("availability_state")
    return tb.catalog.select("entry_id", cat.readiness(state, F.expr(CAPS)).alias("readiness"), cat.next_action(state).alias("next_action"))


STAGE = "CASE availability_state WHEN 'UPSTREAM_AVAILABLE' THEN 1 WHEN 'REGISTERED' THEN 2 WHEN 'ACQUISITION_FAILED' THEN 2 WHEN 'ACQUIRED' THEN 3 WHEN 'MATERIALIZATION_FAILED' THEN 3 WHEN 'MATERIALIZED' THEN 4 WHEN 'VALIDATION_FAILED' THEN 4 ELSE 5 END"


@query("stage_max", "W30", f"SELECT competition_id, availability_state AS best_state FROM tb_catalog QUALIFY row_number() OVER (PARTITION BY competition_id ORDER BY {STAGE} DESC, availability_state) = 1")
def stage_max(tb):
    return cat.stage_max(tb.catalog, ["competition_id"]).drop("actions")


@query(
    "route_products",
    "P29",
    """WITH e AS (SELECT entry_id, p.product, CASE p.product WHEN 'match' THEN entry_id % 4 = 0 WHEN 'game' THEN entry_id % 4 = 0 WHEN 'season' THEN entry_id % 4 = 1 ELSE entry_id % 4 = 2 END AS cap,
                      CASE p.product WHEN 'match' THEN entry_id % 3 = 0 WHEN 'performance' THEN entry_id % 3 = 0 ELSE entry_id % 3 <> 0 END AS gr FROM tb_catalog, (VALUES ('match'), ('game'), ('season'), ('performance')) p(product))
       SELECT entry_id, product, cap AND gr AS ready, CASE WHEN cap THEN '' ELSE CASE product WHEN 'match' THEN 'TRACKING' WHEN 'game' THEN 'PLAY_BY_PLAY,EVENTS' WHEN 'season' THEN 'SEASON_AGGREGATE' ELSE 'FORCE,IMU,LPT,GNSS' END END AS missing FROM e""",
)
def route_products(tb):
    df = cat.route_products(tb.catalog.select("entry_id", F.expr(CAPS).alias("capabilities"), F.expr(GRAINS).alias("grains")))
    return df.select("entry_id", "product", "ready", F.array_join("missing_capabilities", ",").alias("missing"))


@query(
    "capability_profile",
    "P30",
    """SELECT competition_id, coalesce(string_agg(DISTINCT edition_id, ',' ORDER BY edition_id) FILTER (entry_id % 3 = 0), '') AS upstream, coalesce(string_agg(DISTINCT edition_id, ',' ORDER BY edition_id) FILTER (entry_id % 3 = 1), '') AS local,
              coalesce(string_agg(DISTINCT edition_id, ',' ORDER BY edition_id) FILTER (entry_id % 3 = 2), '') AS registered, coalesce(string_agg(DISTINCT edition_id, ',' ORDER BY edition_id) FILTER (entry_id % 5 = 0), '') AS model_estimated FROM tb_catalog GROUP BY 1""",
)
def capability_profile(tb):
    evidence = tb.catalog.select(
        "competition_id", F.col("edition_id").alias("capability"), F.expr("element_at(array('UPSTREAM', 'LOCAL', 'REGISTERED'), cast(entry_id % 3 as int) + 1)").alias("scope"), F.expr("CASE WHEN entry_id % 5 = 0 THEN 'MODEL_ESTIMATED' ELSE 'SOURCE' END").alias("origin")
    )
    df = cat.capability_profile(evidence, ["competition_id"])
    return df.select("competition_id", *[F.array_join(c, ",").alias(c) for c in ("upstream", "local", "registered", "model_estimated")])


@query(
    "advance_state",
    "P37",
    """WITH m AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{a}', '{b}')" for a, b in cat.TRANSITIONS)
    + """) t(f, t)), r AS (SELECT entry_id, availability_state AS s, ['REGISTERED', 'ACQUIRED', 'READY', 'MATERIALIZATION_FAILED', 'ACQUISITION_FAILED'][CAST(entry_id % 5 AS INTEGER) + 1] AS q, CASE WHEN entry_id % 2 = 0 THEN 'log' END AS ev FROM tb_catalog),
       p AS (SELECT r.*, CASE WHEN m.f IS NULL THEN 'invalid transition' WHEN q LIKE '%_FAILED' AND ev IS NULL THEN 'evidence required' END AS rejected FROM r LEFT JOIN m ON m.f = s AND m.t = q)
       SELECT entry_id, q AS requested_state, rejected, CASE WHEN rejected IS NULL THEN q ELSE s END AS new_state, CASE WHEN rejected IS NULL AND q LIKE '%_FAILED' THEN lower(replace(q, '_FAILED', '')) END AS failure_stage FROM p""",
)
def advance_state(tb):
    requests = tb.catalog.select(
        "entry_id", F.expr("element_at(array('REGISTERED', 'ACQUIRED', 'READY', 'MATERIALIZATION_FAILED', 'ACQUISITION_FAILED'), cast(entry_id % 5 as int) + 1)").alias("requested_state"), F.expr("CASE WHEN entry_id % 2 = 0 THEN 'log' END").alias("evidence")
    )
    return cat.advance_state(tb.catalog, requests)


@query(
    "search_catalog",
    "P38",
    """WITH t AS (SELECT p_partkey, p_name AS title, p_brand || ' ' || p_type AS context, p_size > 25 AS ready, lower(p_name || ' ' || p_brand || ' ' || p_type) AS x FROM part),
       s AS (SELECT *, list_transform(['brand', '1'], lambda w: CASE WHEN strpos(x, w) = 0 THEN NULL WHEN strpos(x, w) = 1 THEN 3 WHEN x[strpos(x, w) - 1] = ' ' THEN 2 ELSE 1 END) AS sc FROM t)
       SELECT p_partkey, title, CAST(sc[1] + sc[2] + CASE WHEN ready THEN 1 ELSE 0 END AS INTEGER) AS score FROM s WHERE sc[1] IS NOT NULL AND sc[2] IS NOT NULL ORDER BY score DESC, title, p_partkey LIMIT 12""",
)
def search_catalog(tb):
    rows = tb.table("part").select("p_partkey", F.col("p_name").alias("title"), F.concat_ws(" ", "p_brand", "p_type").alias("context"), (F.col("p_size") > 25).alias("ready"))
    return cat.search_catalog(rows, "Brand 1").select("p_partkey", "title", "score")


@query(
    "catalog_rows",
    "P40",
    """WITH f AS (SELECT s_suppkey, 'ds' || s_nationkey AS d, 'v' || (s_suppkey % 3) AS v, k.key, CASE WHEN (s_suppkey + k.i) % 2 = 0 THEN 'abc' END AS sha, CASE WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'ok' END AS st, k.i FROM supplier, (VALUES ('a.csv', 0), ('b.json', 1)) k(key, i))
       SELECT 'src-' || md5('registry:' || d || ':' || v || ':' || key) AS entry_id, d || '/' || v || '/' || key AS external_id, CASE WHEN s_suppkey % 2 = 0 THEN 'basketball' END AS sport_id,
              CASE WHEN s_suppkey % 3 = 0 THEN 'EVENTS,TRACKING' ELSE 'FORCE' END AS capabilities, CASE WHEN st = 'failed' THEN 'ACQUISITION_FAILED' WHEN sha IS NOT NULL THEN 'ACQUIRED' ELSE 'REGISTERED' END AS availability_state,
              CASE WHEN st = 'failed' THEN 'acquisition' END AS failure_stage FROM f""",
)
def catalog_rows(tb):
    item = lambda key, i: F.struct(F.lit(key).alias("key"), F.expr(f"CASE WHEN (s_suppkey + {i}) % 2 = 0 THEN 'abc' END").alias("sha256"))
    sources = tb.table("supplier").select(
        F.concat(F.lit("ds"), F.col("s_nationkey").cast("string")).alias("dataset_id"),
        F.concat(F.lit("v"), (F.col("s_suppkey") % 3).cast("string")).alias("version"),
        F.lit("driver").alias("provider"),
        F.expr("CASE WHEN s_suppkey % 2 = 0 THEN 'basketball' ELSE 'chess' END").alias("domain"),
        F.expr("CASE WHEN s_suppkey % 3 = 0 THEN array('tracking', 'event', 'tracking') ELSE array('force', 'audio') END").alias("modalities"),
        F.expr("CASE WHEN s_suppkey % 7 = 0 THEN 'failed' ELSE 'ok' END").alias("status"),
        F.array(item("a.csv", 0), item("b.json", 1)).alias("files"),
    )
    return cat.catalog_rows(sources).drop("provider").withColumn("capabilities", F.array_join("capabilities", ","))


@query(
    "catalog_entries",
    "J22",
    """SELECT c.entry_id, c.title, r_name AS sport_name, n_name AS competition_name, coalesce(string_agg(DISTINCT 's' || l_linenumber, ',' ORDER BY 's' || l_linenumber), '') AS sessions
       FROM tb_catalog c LEFT JOIN region ON lower(r_name) = c.sport_id LEFT JOIN nation ON CASE WHEN n_nationkey > 3 THEN lower(n_name) END = c.competition_id LEFT JOIN (SELECT DISTINCT CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END AS of, l_linenumber FROM lineitem) ON of = c.entry_id GROUP BY 1, 2, 3, 4""",
)
def catalog_entries(tb):
    sports = tb.table("region").select(F.lower("r_name").alias("sport_id"), F.col("r_name").alias("sport_name"))
    competitions = tb.table("nation").select(F.expr("CASE WHEN n_nationkey > 3 THEN lower(n_name) END").alias("competition_id"), F.col("n_name").alias("competition_name"))
    links = tb.table("lineitem").select(F.expr("CASE WHEN l_suppkey % 3 = 0 THEN l_suppkey END").alias("entry_id"), F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("session_id"))
    df = cat.catalog_entries(tb.catalog, sports, competitions, links)
    return df.select("entry_id", "title", "sport_name", "competition_name", F.array_join("sessions", ",").alias("sessions"))


@query(
    "catalog_tree",
    "G42",
    "SELECT sport_id, competition_id, edition_id, count(*) AS entries, count(*) FILTER (availability_state = 'READY') AS ready, CAST(grouping_id(sport_id, competition_id, edition_id) AS BIGINT) AS level FROM tb_catalog GROUP BY ROLLUP (sport_id, competition_id, edition_id)",
)
def catalog_tree(tb):
    return cat.catalog_tree(tb.catalog)


@query(
    "dataset_summary",
    "G12",
    CURRENT_SQL
    + """, d AS (SELECT DISTINCT dataset_id FROM tb_metric) SELECT d.dataset_id, (SELECT count(DISTINCT session_id) FROM tb_metric x WHERE x.dataset_id = d.dataset_id) AS sessions, (SELECT count(DISTINCT subject_id) FROM tb_metric x WHERE x.dataset_id = d.dataset_id) AS subjects,
           (SELECT count(*) FROM cur x WHERE x.dataset_id = d.dataset_id) AS current_metrics, (SELECT count(*) FROM tb_metric x WHERE x.dataset_id = d.dataset_id AND computed_at IS NULL) AS issues FROM d""",
)
def dataset_summary(tb):
    m = tb.metric
    return cat.dataset_summary(
        m.select("dataset_id").distinct(), {"sessions": (m, "session_id"), "subjects": (m, "subject_id"), "current_metrics": (_current(tb), None), "issues": (m.filter("computed_at IS NULL"), None)}
    )


@query("metric_catalog", "G13", "SELECT metric_id, string_agg(DISTINCT dataset_id, ',' ORDER BY dataset_id) AS datasets, count(value_num) AS value_count FROM tb_metric GROUP BY 1")
def metric_catalog(tb):
    return cat.metric_catalog(tb.metric)


@query("quality_issue_counts", "G43", "SELECT dataset_id, session_id, CASE WHEN computed_at IS NULL THEN 'error' ELSE 'info' END AS severity, count(*) AS issues FROM tb_metric GROUP BY 1, 2, 3")
def quality_issue_counts(tb):
    return tb.metric.groupBy("dataset_id", "session_id", F.expr("CASE WHEN computed_at IS NULL THEN 'error' ELSE 'info' END").alias("severity")).agg(F.count(F.lit(1)).alias("issues"))


@query("rights_summary", "G43", "SELECT c_mktsegment AS policy, string_agg(DISTINCT 'd' || c_nationkey, ',' ORDER BY 'd' || c_nationkey) AS datasets FROM customer GROUP BY 1")
def rights_summary(tb):
    return cat.rights_summary(tb.table("customer").select(F.col("c_mktsegment").alias("policy"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dataset_id")))


@query("status_counts", "G43", "SELECT (SELECT count(DISTINCT dataset_id) FROM tb_metric) AS datasets, (SELECT count(DISTINCT session_id) FROM tb_metric) AS sessions, (SELECT count(DISTINCT run_id) FROM tb_metric) AS runs, (SELECT count(*) FROM tb_metric) AS metrics")
def status_counts(tb):
    return tb.metric.agg(F.countDistinct("dataset_id").alias("datasets"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("run_id").alias("runs"), F.count(F.lit(1)).alias("metrics"))


@query(
    "session_detail",
    "G46",
    """WITH s AS (SELECT DISTINCT c_nationkey AS session_id FROM customer) SELECT session_id, (SELECT count(DISTINCT c_mktsegment) FROM customer WHERE c_nationkey = session_id AND c_acctbal > 9000) AS participants,
           (SELECT count(*) FROM customer WHERE c_nationkey = session_id) AS trials, (SELECT count(*) FROM supplier WHERE s_nationkey = session_id) AS streams, CAST((SELECT coalesce(sum(s_suppkey), 0) FROM supplier WHERE s_nationkey = session_id) AS BIGINT) AS sample_rows,
           coalesce((SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM supplier WHERE s_nationkey = session_id), '') AS artifact_ids FROM s""",
)
def session_detail(tb):
    c, s = tb.table("customer").withColumn("session_id", F.col("c_nationkey")), tb.table("supplier").withColumn("session_id", F.col("s_nationkey"))
    df = cat.session_detail(
        c.select("session_id").distinct(), c.filter("c_acctbal > 9000").select("session_id", F.col("c_mktsegment").alias("subject_id")), c.select("session_id"), s.select("session_id", F.col("s_suppkey").alias("row_count")), s.select("session_id", F.col("s_name").alias("artifact_id"))
    )
    return df.withColumn("artifact_ids", F.coalesce(F.array_join("artifact_ids", ","), F.lit("")))


@query(
    "roster",
    "J24",
    """SELECT o_orderkey AS provider_player_id, CASE WHEN c_custkey IS NOT NULL THEN 'sub' || c_custkey END AS subject_id, n_nationkey AS team_id, r_name AS side
       FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 6) ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def roster(tb):
    known = tb.table("customer").filter("c_custkey % 5 <> 0").select(F.concat(F.lit("sub"), F.col("c_custkey").cast("string")).alias("subject_id"), "c_custkey", "c_nationkey")
    players = tb.table("orders").select(F.col("o_orderkey").alias("provider_player_id"))
    crosswalk = tb.table("orders").join(known, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("provider_player_id"), "subject_id")
    teams = tb.table("nation").filter("n_nationkey <> 6")
    membership = known.join(teams, F.col("c_nationkey") == F.col("n_nationkey")).select("subject_id", F.col("n_nationkey").alias("team_id"))
    sides = tb.table("nation").join(tb.table("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("team_id"), F.col("r_name").alias("side"))
    return cat.roster(players, crosswalk, membership, sides).select("provider_player_id", "subject_id", "team_id", "side")


@query("player_links", "J25", "SELECT DISTINCT c_custkey AS subject_id, l_partkey AS contest_id FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'MACHINERY'")
def player_links(tb):
    subjects = tb.table("customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("subject_id"))
    crosswalk = tb.table("orders").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("provider_player_id"))
    seen = tb.table("lineitem").select(F.col("l_orderkey").alias("provider_player_id"), F.col("l_partkey").alias("contest_id"))
    return cat.player_links(subjects, crosswalk, seen)


@query(
    "provenance_edges",
    "J29",
    """WITH e AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber AS s, 'run' || l_orderkey AS t, 'computed_by' AS relation FROM lineitem
       UNION SELECT 'run' || o_orderkey, o_orderstatus, 'executes' FROM orders
       UNION SELECT 'run' || o_orderkey, 'art' || p_partkey, 'reads' FROM orders JOIN part ON p_partkey IN (o_orderkey % 500, o_custkey % 500)
       UNION SELECT 'art' || p_partkey, 'str' || (p_partkey % 40), 'stores' FROM part UNION SELECT 'str' || (p_partkey % 40), 'ds' || (p_partkey % 40 % 4), 'belongs_to' FROM part)
       SELECT s AS source, t AS target, relation FROM e""",
)
def provenance_edges(tb):
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))
    metrics = tb.table("lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("derived_metric_id"), text("run", "l_orderkey").alias("run_id"))
    runs = tb.table("orders").select(text("run", "o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("algorithm_id"), F.array(F.col("o_orderkey") % 500, F.col("o_custkey") % 500).alias("input_checksums"))
    artifacts = tb.table("part").select(F.col("p_partkey").alias("checksum"), text("art", "p_partkey").alias("artifact_id"), text("str", F.col("p_partkey") % 40).alias("stream_id"))
    streams = tb.table("part").select(text("str", F.col("p_partkey") % 40).alias("stream_id"), text("ds", F.col("p_partkey") % 40 % 4).alias("dataset_id"))
    return cat.provenance_edges(metrics, runs, artifacts, streams)


@query("sync_pairs", "J28", "SELECT a.s_suppkey AS source_stream_id, b.s_suppkey AS target_stream_id, 'm' || (a.s_suppkey % 3) AS source_modality, 'm' || (b.s_suppkey % 3) AS target_modality FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_nationkey % 2 = 0")
def sync_pairs(tb):
    streams = tb.table("supplier").select(F.col("s_suppkey").alias("stream_id"), F.concat(F.lit("m"), (F.col("s_suppkey") % 3).cast("string")).alias("modality"), F.concat(F.lit("d"), (F.col("s_nationkey") % 2).cast("string")).alias("dataset_id"))
    pairs = tb.table("supplier").select(F.col("s_suppkey").alias("source_stream_id"), (F.col("s_suppkey") + 1).alias("target_stream_id"))
    return cat.sync_pairs(pairs, streams, "d0").drop("dataset_id")


TAG = "concat(CASE p_partkey % 5 WHEN 0 THEN 'espn_nba_' WHEN 1 THEN 'nhl_' WHEN 2 THEN 'ncaa_wbb_' WHEN 3 THEN 'mlb_' ELSE 'cricket_' END, CASE p_size % 7 WHEN 0 THEN 'pbp' WHEN 1 THEN 'pbp_lite' WHEN 2 THEN 'schedules' WHEN 3 THEN 'player_boxscores' WHEN 4 THEN 'team_box' WHEN 5 THEN 'game_rosters' ELSE 'notes' END)"


@query(
    "classify_family",
    "S19",
    """SELECT p_partkey, ['nba', 'nhl', 'wbb', 'mlb', NULL][CAST(p_partkey % 5 AS INTEGER) + 1] AS league_id, ['basketball', 'ice_hockey', 'basketball', 'baseball', NULL][CAST(p_partkey % 5 AS INTEGER) + 1] AS sport_id,
              ['play_by_play', 'play_by_play', 'schedule', 'player_game', 'team_game', 'roster', 'unmapped'][CAST(p_size % 7 AS INTEGER) + 1] AS family_kind,
              ['PLAY_BY_PLAY', 'PLAY_BY_PLAY', 'GAME_SUMMARY', 'PLAYER_GAME', 'TEAM_GAME', NULL, NULL][CAST(p_size % 7 AS INTEGER) + 1] AS grain, p_partkey % 5 < 4 AND p_size % 7 < 5 AS mapped,
              CASE WHEN p_partkey % 3 = 0 THEN 2000 + p_size % 20 WHEN p_partkey % 3 = 1 THEN 2001 + p_size % 20 END AS season,
              CASE WHEN p_partkey % 3 < 2 THEN CASE WHEN p_partkey % 5 < 3 THEN (1999 + p_size % 20 + p_partkey % 3) || '-' || right(CAST(2000 + p_size % 20 + p_partkey % 3 AS VARCHAR), 2) ELSE CAST(2000 + p_size % 20 + p_partkey % 3 AS VARCHAR) END END AS label FROM part""",
)
def classify_family(tb):
    rows = tb.table("part").withColumns(
        {
            "tag": F.expr(TAG),
            "asset": F.expr("CASE p_partkey % 3 WHEN 0 THEN concat('play_by_play_', cast(2000 + p_size % 20 as string), '.parquet') WHEN 1 THEN concat('box-', cast(2000 + p_size % 20 as string), '-', right(cast(2001 + p_size % 20 as string), 2), '.csv') ELSE 'all.csv' END"),
        }
    )
    named = rows.select("p_partkey", taxonomy.asset_season(F.col("asset")).alias("season"), *[c.alias(n) for n, c in taxonomy.classify_family(F.col("tag")).items()])
    return named.withColumn("label", taxonomy.edition_label(F.coalesce("league_id", F.lit("")), F.col("season")))
