"""Ranks, joins by time, revisions, updates, games, readers and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pacelane.operators import catalog, clean, compare, games, joins, quality, ranking, revisions, season, serve
from pacelane.schema import contract, grain_columns
from pacelane.sources import readers
from pacelane.streaming import live


def test_inclusive_percentile_and_best_rank_for_ties(spark):
    df = spark.createDataFrame([("e", v) for v in (1.0, 2.0, 2.0, 4.0, None)], "g string, v double")
    got = sorted((r.v or 0, r["rank"], r.percentile) for r in ranking.rank_within(df, ["g"], "v").collect())
    assert got == [(0, None, None), (1.0, 4, 25.0), (2.0, 2, 75.0), (2.0, 2, 75.0), (4.0, 1, 100.0)]
    row = ranking.rank_within(df, ["g"], "v").first()
    assert (row.population_n, row.valid_n, row.minimum, row.median, row.maximum) == (5, 4, 1.0, 2.0, 4.0)


def test_row_outside_its_population_is_ranked(spark):
    population = spark.createDataFrame([("e", v) for v in (1.0, 2.0, 4.0)], "g string, v double")
    target = spark.createDataFrame([("e", 3.0), ("e", 0.5), ("e", 9.0)], "g string, v double")
    got = {r.v: (r["rank"], r.percentile) for r in ranking.rank_within(population, ["g"], "v", targets=target).collect()}
    assert got == {3.0: (2, 66.7), 0.5: (4, 0.0), 9.0: (1, 100.0)}


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(9)
    values = np.concatenate((rng.exponential(50, 400), np.full(300, 7.0), [1e9, -1e9]))
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    row = ranking.quantiles(df, ["k"], "v", {"p5": 0.05, "p50": 0.5, "p999": 0.999}).first()
    assert [row.p5, row.p50, row.p999] == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.999])))


def test_nearest_frame_tie_goes_to_the_earlier(spark):
    frames = spark.createDataFrame([("s", t) for t in (0, 100, 200)], "s string, t bigint")
    events = spark.createDataFrame([("e1", "s", 50), ("e2", "s", 151), ("e3", "s", 900), ("e4", "x", 5)], "event_id string, s string, t bigint")
    got = {r.event_id: r.frame_ns for r in joins.nearest_event_join(events, frames, ["s"], "t", chunk=60).collect()}
    assert got == {"e1": 0, "e2": 200, "e3": 200, "e4": None}


def test_unsynchronised_event_stays_with_zero_counts(spark):
    tracking = spark.createDataFrame([("s", 0, 0, "p", "player", "A", 1.0, 1.0)], "stream_id string, t_rel_ns bigint, sample_index bigint, object_id string, object_type string, group_id string, x_m double, y_m double")
    events = spark.createDataFrame([("e", "s", 10**9, 1.0, 2.0)], "event_id string, stream_id string, t_rel_ns bigint, x_m double, y_m double")
    row = joins.event_snapshot(events, tracking, ["stream_id"]).first()
    assert not row.synchronized and row.tracking_entity_count == 0 and row.tracking_t_rel_ns is None and row.sync_delta_ns == 10**9


def test_retired_entity_does_not_resurface(spark):
    rows = [
        (1, "d", "m", "run-1", 10, 1.0, "loco", "kept"), (2, "d", "m", "run-1", 10, 2.0, "loco", "retired"), (3, "d", "m", "run-2", 20, 3.0, "loco", "kept"), (4, "d", "m", "run-9", None, 4.0, "loco", "kept"), (5, "d", "m", "run-1", 10, 5.0, "other", "x"),
    ]
    df = spark.createDataFrame(rows, "derived_metric_id bigint, dataset_id string, metric_id string, run_id string, computed_at bigint, value_num double, algorithm_id string, entity_id string")
    got = sorted(r.derived_metric_id for r in revisions.current_revision(df).collect())
    assert got == [3, 5]


def test_updates(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, seq int")
    new = spark.createDataFrame([(2, "B", 1), (2, "C", 2), (3, "c", 1)], "k int, v string, seq int")
    assert sorted((r.k, r.v) for r in revisions.insert_or_ignore(old, new, ["k"], ["seq"]).collect()) == [(3, "c")]
    assert sorted((r.k, r.v) for r in revisions.upsert_refresh(old, new, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "C"), (3, "c")]


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    one = revisions.fingerprint(df).first()
    assert one == revisions.fingerprint(df.orderBy(F.desc("a"))).first()
    assert one != revisions.fingerprint(df.withColumn("b", F.when(F.col("a") == 3, "x").otherwise(F.col("b")))).first()


def test_ambiguous_pair_is_dropped_and_units_are_compared(spark):
    rows = [("a", "t0", 1.0, "m"), ("a", "t1", 1.0, "m"), ("a", "t1", 2.0, "m"), ("b", "t0", 3.0, "s"), ("b", "t1", 4.0, "s")]
    df = spark.createDataFrame(rows, "metric_id string, trial string, value_num double, si_unit string")
    got = compare.pair_metrics(df, "a", "b", ["trial"]).collect()
    assert [(r.trial, r.a, r.b, r.same_unit) for r in got] == [("t0", 1.0, 3.0, False)]


def test_period_clock(spark):
    df = spark.createDataFrame([(1, 720.0, False), (5, 300.0, False), (4, 800.0, False), (5, 10.0, True)], "p int, c double, post boolean")
    got = [tuple(r) for r in df.select(games.game_clock_ns(games.NBA, F.col("p"), F.col("c"), F.col("post")), games.game_clock_ns(games.NHL, F.col("p"), F.col("c"), F.col("post"))).collect()]
    s = 10**9
    assert got == [(0, 720 * s), (2880 * s, 4200 * s), (None, None), (3170 * s, 4810 * s)]


# Columns of provider tables, as far as rates need them.
SHOTS = "attempts two_attempts three_attempts ft_attempts fouled_fg_attempts corner_three_attempts catch_two_attempts rim_attempts".split()
DRIVES = "total_drives fga_in_drive turnovers".split()
PICKS = [f"{role}_{name}" for role in ("handler", "screener") for name in "total_picks fga_in_pick picks_vs_drop picks_vs_blitz_high picks_at_elbow score_2pt_vs_drop miss_2pt_vs_drop score_2pt_at_rim miss_2pt_at_rim".split()]


def test_weighted_merge_refuses_unknown_weights():
    assert season.rate_weights("catch_two_fg_percentage", SHOTS) == ["catch_two_attempts"]
    assert season.rate_weights("three_pt_percentage", SHOTS) == ["three_attempts"]
    assert season.rate_weights("handler_ppp_vs_drop", PICKS) == ["handler_picks_vs_drop"]
    assert season.rate_weights("screener_fg2_pct_at_rim", PICKS) == ["screener_score_2pt_at_rim", "screener_miss_2pt_at_rim"]
    assert season.rate_weights("blowby_rate", DRIVES) == ["total_drives"] and season.rate_weights("odd_rate", SHOTS) == []
    # a rate of a part is never weighted by the whole, nor by half of a sum
    assert season.rate_weights("wing_fg_percentage", SHOTS) == [] and season.rate_weights("handler_ppp_vs_ice", PICKS) == []
    assert season.rate_weights("handler_fg2_pct_vs_drop", [c for c in PICKS if "miss" not in c]) == []


def test_unknown_family_is_refused(spark):
    with pytest.raises(ValueError):
        season.season_metric_spec(spark.createDataFrame([("x",)], "column string"), "tennis")


def test_catalog_moves(spark):
    entries = spark.createDataFrame([(1, "REGISTERED"), (2, "READY")], "entry_id int, availability_state string")
    asked = spark.createDataFrame([(1, "ACQUISITION_FAILED", None), (1, "ACQUIRED", None), (2, "REGISTERED", "x"), (9, "READY", None)], "entry_id int, requested_state string, evidence string")
    got = {(r.entry_id, r.requested_state): r.rejected for r in catalog.advance_state(entries, asked).collect()}
    assert got == {(1, "ACQUISITION_FAILED"): "evidence required", (1, "ACQUIRED"): None, (2, "REGISTERED"): "invalid transition", (9, "READY"): "unknown entry"}


def test_contracts():
    assert len(contract("tracking").fields.fields) == 28 and not contract("tracking").strict_time
    assert contract("event").fields["nominal_sampling_rate_hz"].nullable and not contract("imu").fields["accel_x_m_s2"].nullable
    assert grain_columns("EVENT_SERIES", ["session_id", "trial_id", "event_id"]) == ["session_id", "trial_id", "event_id"]
    with pytest.raises(ValueError):
        grain_columns("TEAM_GAME", ["team_id"])


def test_window_is_refused_when_too_large(spark):
    df = spark.range(100).select(F.col("id").alias("t_rel_ns"), F.lit("a").alias("object_id"))
    with pytest.raises(ValueError):
        serve.bounded_window(df, 0, 50, max_rows=10)
    with pytest.raises(ValueError):
        serve.scan_stream(df, 0, 50, ["nope"])
    env = serve.envelope(df, ["object_id"], [], 0, 99, 10)
    assert env.count() <= 10 and env.agg(F.sum("bucket_rows")).first()[0] == 100


def test_clean_expressions(spark):
    df = spark.createDataFrame([("00:01:02.03", "TeamIDCode"), ("00:61:02.03", "aB"), ("1:2:3", "X")], "c string, n string")
    got = df.select(clean.match_clock_ns("c"), clean.snake_case("n"), clean.metric_token("n")).collect()
    assert [tuple(r) for r in got] == [(62_030_000_000, "team_idcode", "teamidcode"), (None, "a_b", "ab"), (None, "x", "x")]


def test_event_xml_reader(spark, tmp_path):
    text = (
        '<Put><Event EventId="1" EventTime="2023-01-01T00:00:00+00:00"/><Event EventId="2" EventTime="2023-01-01T00:00:01+00:00" X-Position="1.5" Y-Position="2">\n'
        '  <!-- note --><ShotAtGoal Team="T" TypeOfShot="head" Player="A"><SuccessfulShot Player="B" Evaluation="x &lt; y"/></ShotAtGoal>\n</Event>'
        '<Event EventId="3" EventTime="never"><Play/></Event><Event EventId="4" EventTime="2023-01-01T00:00:02Z"><Delete/></Event></Put>'
    )
    (tmp_path / "e.xml").write_text(text)
    rows = {r.event_id: r for r in readers.read_events_xml(spark, str(tmp_path), 0).collect()}
    assert set(rows) == {"1", "2", "3"} and rows["1"].rule == "schema_failure" and rows["3"].rule == "timestamp_unparsable"
    good = rows["2"]
    assert (good.event_type, good.event_subtype, good.provider_player_id, good.body_part, good.outcome, good.rule) == ("shot_at_goal", "successful_shot", "B", "head", "x < y", None)
    assert json.loads(good.provider_context_json) == {"Evaluation": "x < y", "Player": "B", "Team": "T", "TypeOfShot": "head"}


def test_rejected_rows_do_not_move_the_clock(spark):
    rows = [("s", "1", "2024-01-01 00:00:01.000", "1", "1", "3.6"), ("s", "2", "2024-01-01 00:00:09.000", None, "1", "1"), ("s", "3", "2024-01-01 00:00:02.000", "1", "1", None), ("s", "4", "2024-01-01 00:00:02.000", "1", "1", None), ("s", "5", "soon", "1", "1", None)]
    got = {r.row_no: (r.rule, r.speed_m_s) for r in readers.gnss_rows(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in readers.GNSS_COLUMNS)), chunk=2).collect()}
    assert got[1] == (None, pytest.approx(1.0)) and [got[i][0] for i in (2, 3, 4, 5)] == ["required_field_null", None, "time_out_of_range", "timestamp_unparsable"]


def test_unreadable_rows_are_set_aside_not_lost(spark):
    rows = [(None, "1", "2024-01-01 00:00:01.000", "1", "1", None), ("s", "x", "2024-01-01 00:00:02.000", "1", "1", None), ("s", None, "2024-01-01 00:00:02.000", "1", "1", None), ("s", "2", "2024-01-01 00:00:03.000", "1", "1", None)]
    got = [(r.sheet, r.row_no, r.rule) for r in readers.gnss_rows(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in readers.GNSS_COLUMNS)), chunk=2).collect()]
    assert sorted(got, key=str) == sorted([(None, 1, "required_field_null"), ("s", None, "required_field_null"), ("s", None, "required_field_null"), ("s", 2, None)], key=str)


def test_streamed_validation_sees_across_batches(spark, tmp_path):
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "stream_id string, sample_index bigint, t_rel_ns bigint"
    batches = [[("a", 0, 0), ("a", 1, 10), ("b", 0, 5)], [("a", 2, 7), ("a", 3, 20)], [("b", 1, 5), ("a", 4, 30)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        state = live.validate_stream(stream, work, strict=True, chunk=3)
    got = {r.stream_id: (r.rows, r.violations, r.last_index) for r in state.collect()}
    assert got == {"a": (5, 1, 4), "b": (2, 1, 1)}
    again = live.validate_stream(spark.readStream.schema(schema).parquet(source), work, strict=True, chunk=3)  # a restart without new files
    assert {r.stream_id: (r.rows, r.violations, r.last_index) for r in again.collect()} == got


def test_violations_of_each_rule_are_counted_once(spark):
    df = spark.createDataFrame([("s", 0, 0), ("s", 1, 5), ("s", 2, 3), ("s", 2, 9)], "stream_id string, sample_index bigint, t_rel_ns bigint")
    got = {r.rule: r.violations for r in quality.time_rules(df, ["stream_id"], strict=False, chunk=2).collect()}
    assert got == {"time.monotonic:sample_index": 1, "time.monotonic:t_rel_ns": 1, "time.contiguous": 1}


def test_window_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "dense")
    spark.range(1000).select(F.col("id").alias("t_rel_ns"), (F.col("id") % 5).cast("string").alias("object_id"), F.lit(1.0).alias("x_m"), F.lit(2.0).alias("y_m")).write.parquet(path)
    plan = serve.scan_stream(spark.read.parquet(path), 10, 20, ["t_rel_ns", "x_m"], "3")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(t_rel_ns,10)" in plan and "EqualTo(object_id,3)" in plan
    assert "y_m" not in plan.split("ReadSchema:")[1]


def test_stream_files_split_a_large_session(spark, tmp_path):
    from pacelane.sinks import tables

    rows = spark.range(20_000).select(F.lit("d").alias("dataset_id"), F.lit("tracking").alias("modality"), F.lit("s").alias("session_id"), F.lit("st").alias("stream_id"), F.col("id").alias("t_rel_ns"))
    # Adaptive execution would merge these few bytes into one file.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tables.write_stream(rows, str(tmp_path / "out"), slice_ns=2_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    folder = tmp_path / "out" / "dataset_id=d" / "modality=tracking" / "session_id=s"
    assert len(list(folder.glob("*.parquet"))) > 1 and spark.read.parquet(str(tmp_path / "out")).count() == 20_000


def test_publish_is_refused_without_a_code_revision(spark, tmp_path):
    from pacelane.sinks import tables

    runs = spark.createDataFrame([("r1", "processor", None), ("r2", "source", None)], "run_id string, origin string, code_sha string")
    mart = spark.range(3)
    with pytest.raises(ValueError):
        tables.publish_marts({"m": mart}, runs, str(tmp_path / "marts"))
    tables.publish_marts({"m": mart}, runs.filter("run_id = 'r2'"), str(tmp_path / "marts"))
    assert spark.read.parquet(str(tmp_path / "marts" / "m")).count() == 3


def test_package_is_on_the_workers(spark):
    from pacelane.session import ship_package

    ship_package(spark)
    assert "pacelane.zip" in spark.sparkContext._python_includes


def test_exported_times_keep_their_fraction(spark):
    from pacelane.sinks.tables import serving_form

    rows = spark.sql("SELECT TIMESTAMP '2024-01-02 00:00:00.123456' AS a, TIMESTAMP '2024-01-02 03:04:05' AS b, CAST(NULL AS TIMESTAMP) AS c")
    assert tuple(serving_form(rows).first()) == ("2024-01-02T00:00:00.123456", "2024-01-02T03:04:05", None)


def test_counts_behind_rates():
    from pacelane.operators.season import is_rate, rate_weights

    tables = {"shots": SHOTS, "drives": DRIVES, "picks": PICKS}
    expected = {
        ("shots", "fg_percentage"): ["attempts"],
        ("shots", "corner_three_fg_percentage"): ["corner_three_attempts"],
        ("shots", "rim_efg_percentage"): ["rim_attempts"],
        ("shots", "fouled_fg_percentage"): ["fouled_fg_attempts"],
        ("shots", "three_attempt_rate"): ["attempts"],
        ("shots", "ft_percentage"): ["ft_attempts"],
        ("shots", "three_pa_rate"): ["attempts"],
        ("shots", "avg_attempts_distance"): ["attempts"],
        ("shots", "points_per_shot"): ["attempts"],
        ("shots", "attempts"): [],
        ("drives", "turnover_rate"): ["total_drives"],
        ("drives", "points_per_shot_in_drive"): ["fga_in_drive"],
        ("picks", "handler_fg2_pct_vs_drop"): ["handler_score_2pt_vs_drop", "handler_miss_2pt_vs_drop"],
        ("picks", "handler_points_per_shot_in_pick"): ["handler_fga_in_pick"],
        ("picks", "screener_ppp_at_elbow"): ["screener_picks_at_elbow"],
        ("picks", "screener_direct_ppp"): ["screener_total_picks"],
        ("picks", "handler_pass_rate_vs_blitz_high"): ["handler_picks_vs_blitz_high"],
        ("picks", "handler_rate_left"): ["handler_total_picks"],
        ("picks", "handler_picks"): [],
    }
    assert {(t, c): rate_weights(c, tables[t]) for t, c in expected} == expected
    assert is_rate("three_pa_rate") and is_rate("avg_speed") and not is_rate("operations") and not is_rate("attempts")


def test_seasons_in_asset_names(spark):
    from pyspark.sql import functions as F

    from pacelane.sources.taxonomy import asset_season

    expected = {
        "play_by_play_2021.parquet": 2021, "pbp-2019_lite.csv": 2019, "box-2020-21.csv.gz": 2021, "2005.rds": 2005, "all.csv": None, "x_2021.txt": None,
        "x_1821.csv": None, "x2021.csv": None, "x_2020_21.csv": None, "lite.csv": None, "": None,
    }
    rows = spark.createDataFrame([(n,) for n in expected], "name string")
    assert {r.name: r.season for r in rows.select("name", asset_season(F.col("name")).alias("season")).collect()} == expected


def test_packed_files_are_verified_like_loose_ones(spark, tmp_path):
    bodies = {"a.html": b"<p>\n", "b.html": b"", "c.html": "ü".encode(), "d.html": b"x", "e.html": b"y"}
    for name, body in bodies.items():
        (tmp_path / "loose").mkdir(exist_ok=True)
        (tmp_path / "loose" / name).write_bytes(body)
    spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "key string, content binary").write.parquet(str(tmp_path / "packs"))
    digest = lambda v: F.sha2(F.lit(bytearray(v)), 256)
    rows = [("a.html", bodies["a.html"], 4), ("b.html", bodies["b.html"], 0), ("c.html", bodies["c.html"], 3), ("d.html", b"other", 1), ("f.html", b"z", 1)]
    manifest = spark.range(0).select(F.lit("").alias("key"), F.lit("").alias("sha256"), F.lit(0).cast("bigint").alias("size_bytes"))
    for key, body, size in rows:
        manifest = manifest.unionByName(spark.range(1).select(F.lit(key).alias("key"), digest(body).alias("sha256"), F.lit(size).cast("bigint").alias("size_bytes")))
    want = {"a.html": "verified", "b.html": "verified", "c.html": "size_mismatched", "d.html": "mismatched", "e.html": "unlisted", "f.html": "missing"}
    assert dict(map(tuple, readers.verify_manifest(spark, str(tmp_path / "packs"), manifest, packed=True).collect())) == want
    loose = want | {"b.html": "missing"}  # Spark lists no empty file
    assert dict(map(tuple, readers.verify_manifest(spark, str(tmp_path / "loose"), manifest).collect())) == loose


def test_verify_manifest_writes_no_file_for_each_page(spark, tmp_path):
    """2,000 pages of one table, read by a few tasks, make a few files."""
    import os

    from pacelane.plans.registry import QUERIES
    from pacelane.session import work_folder

    page = F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") != 4, F.concat(F.lit("<p>"), F.col("id").cast("string"))).alias("html")
    spark.range(0, 2000, 1, 2).select(*page).write.parquet(str(tmp_path / "pages.parquet"))
    files = lambda: sum(len(f) for _, _, f in os.walk(work_folder(spark)))
    before = files()
    got = QUERIES["verify_manifest"](spark, str(tmp_path)).groupBy("status").count().collect()
    assert dict(map(tuple, got)) == dict.fromkeys(("verified", "missing", "mismatched", "size_mismatched", "unlisted"), 400)
    assert files() - before < 100
