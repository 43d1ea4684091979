"""Catalog states, capabilities, summaries, search and provenance edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.operators.clean import _map

# Order of availability stages, the next action of a state, the
# allowed moves, and the states that need failure evidence.
STAGE_ORDER = {
    "UPSTREAM_AVAILABLE": 1, "REGISTERED": 2, "ACQUISITION_FAILED": 2, "ACQUIRED": 3, "MATERIALIZATION_FAILED": 3, "MATERIALIZED": 4, "VALIDATION_FAILED": 4, "READY": 5,
}
NEXT_ACTION = {
    "UPSTREAM_AVAILABLE": "register", "REGISTERED": "acquire", "ACQUISITION_FAILED": "acquire", "ACQUIRED": "materialize", "MATERIALIZATION_FAILED": "materialize", "MATERIALIZED": "validate", "VALIDATION_FAILED": "validate",
}
TRANSITIONS = [
    ("UPSTREAM_AVAILABLE", "REGISTERED"), ("REGISTERED", "ACQUIRED"), ("REGISTERED", "ACQUISITION_FAILED"), ("ACQUISITION_FAILED", "REGISTERED"), ("ACQUIRED", "MATERIALIZED"),
    ("ACQUIRED", "MATERIALIZATION_FAILED"), ("MATERIALIZATION_FAILED", "ACQUIRED"), ("MATERIALIZED", "READY"), ("MATERIALIZED", "VALIDATION_FAILED"), ("VALIDATION_FAILED", "MATERIALIZED"),
]
FAILURES = ("ACQUISITION_FAILED", "MATERIALIZATION_FAILED", "VALIDATION_FAILED")
# What each product needs, as alternatives of capabilities and of grains.
PRODUCT_GATES = [
    ("match", ["TRACKING"], ["FRAME_SERIES"]),
    ("game", ["PLAY_BY_PLAY", "EVENTS"], ["PLAY_BY_PLAY", "EVENT_SERIES"]),
    ("season", ["SEASON_AGGREGATE"], ["PLAYER_SEASON", "TEAM_SEASON"]),
    ("performance", ["FORCE", "IMU", "LPT", "GNSS"], ["TRIAL_SERIES", "SENSOR_SERIES"]),
]
MODALITY_CAPABILITY = {"tracking": "TRACKING", "pose": "POSE", "event": "EVENTS", "force": "FORCE", "imu": "IMU", "lpt": "LPT", "gnss": "GNSS"}
CATALOG_SPORTS = ("football", "basketball", "ice_hockey", "baseball")


def readiness(state: Column, upstream_capabilities: Column) -> Column:
    return F.when(state == "ACQUISITION_FAILED", "UPSTREAM_FAILED").when(F.size(upstream_capabilities) > 0, "UPSTREAM_AVAILABLE").otherwise("UPSTREAM_UNAVAILABLE")


def next_action(state: Column) -> Column:
    return F.try_element_at(_map(NEXT_ACTION), state)


def stage_max(df: DataFrame, keys: Sequence[str], state: str = "availability_state") -> DataFrame:
    """Furthest stage of the entries of a key; of equal stages the smaller name."""
    order = F.struct(-F.coalesce(F.try_element_at(_map(STAGE_ORDER), F.col(state)), F.lit(0)), F.col(state))
    return df.groupBy(*keys).agg(F.min_by(state, order).alias("best_state"), F.array_sort(F.collect_set(next_action(F.col(state)))).alias("actions"))


def advance_state(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested moves of catalog entries with the outcome and why a move is refused."""
    moves = F.array(*[F.lit(f"{a}>{b}") for a, b in TRANSITIONS])
    joined = requests.join(entries.select("entry_id", "availability_state"), "entry_id", "left")
    allowed = F.array_contains(moves, F.concat_ws(">", "availability_state", "requested_state"))
    needs = F.col("requested_state").isin(*FAILURES) & (F.coalesce("evidence", F.lit("")) == "")
    problem = F.when(F.col("availability_state").isNull(), "unknown entry").when(~allowed, "invalid transition").when(needs, "evidence required")
    return joined.select(
        "entry_id",
        "requested_state",
        problem.alias("rejected"),
        F.when(problem.isNull(), F.col("requested_state")).otherwise(F.col("availability_state")).alias("new_state"),
        F.when(problem.isNull() & F.col("requested_state").isin(*FAILURES), F.lower(F.regexp_replace("requested_state", "_FAILED$", ""))).alias("failure_stage"),
    )


def route_products(df: DataFrame, capabilities: str = "capabilities", grains: str = "grains") -> DataFrame:
    """One row per product: ready when one capability and one grain alternative is available."""
    items = []
    for product, caps, kinds in PRODUCT_GATES:
        cap, kind = F.array(*[F.lit(c) for c in caps]), F.array(*[F.lit(k) for k in kinds])
        no_cap, no_kind = ~F.arrays_overlap(cap, capabilities), ~F.arrays_overlap(kind, grains)
        empty = F.array().cast("array<string>")
        items.append(F.struct(F.lit(product).alias("product"), (~no_cap & ~no_kind).alias("ready"), F.when(no_cap, cap).otherwise(empty).alias("missing_capabilities"), F.when(no_kind, kind).otherwise(empty).alias("missing_grains")))
    rest = [c for c in df.columns if c not in (capabilities, grains)]
    return df.select(*rest, F.inline(F.array(*items)))


def capability_profile(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted capabilities per scope, and those that rest on a model estimate."""
    pick = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col("capability"))))
    return evidence.groupBy(*keys).agg(
        pick(F.col("scope") == "UPSTREAM").alias("upstream"),
        pick(F.col("scope") == "LOCAL").alias("local"),
        pick(F.col("scope") == "REGISTERED").alias("registered"),
        pick(F.col("origin") == "MODEL_ESTIMATED").alias("model_estimated"),
    )


def catalog_rows(sources: DataFrame) -> DataFrame:
    """One metadata row per source, version and file, with capabilities from the modalities."""
    files = sources.select("*", F.explode("files").alias("file")).drop("files")
    known = F.create_map(*[F.lit(x) for pair in MODALITY_CAPABILITY.items() for x in pair])
    caps = F.array_sort(F.array_distinct(F.array_compact(F.transform("modalities", lambda m: F.try_element_at(known, m)))))
    identity = F.concat_ws(":", F.lit("registry"), "dataset_id", "version", "file.key")
    state = F.when(F.col("status") == "failed", "ACQUISITION_FAILED").when(F.col("file.sha256").isNotNull(), "ACQUIRED").otherwise("REGISTERED")
    return files.select(
        F.concat(F.lit("src-"), F.md5(identity)).alias("entry_id"),
        "provider",
        F.concat_ws("/", "dataset_id", "version", "file.key").alias("external_id"),
        F.when(F.col("domain").isin(*CATALOG_SPORTS), F.col("domain")).alias("sport_id"),
        caps.alias("capabilities"),
        state.alias("availability_state"),
        F.when(F.col("status") == "failed", "acquisition").alias("failure_stage"),
    )


def catalog_entries(entries: DataFrame, sports: DataFrame, competitions: DataFrame, links: DataFrame) -> DataFrame:
    """Entries with display names and the sessions linked to them."""
    sessions = links.groupBy("entry_id").agg(F.array_sort(F.collect_set("session_id")).alias("sessions"))
    return entries.join(sports, "sport_id", "left").join(competitions, "competition_id", "left").join(sessions, "entry_id", "left").withColumn("sessions", F.coalesce("sessions", F.array().cast("array<string>")))


def catalog_tree(entries: DataFrame) -> DataFrame:
    """Entries and distinct editions by sport, competition and edition, with totals per level."""
    ready = F.coalesce(F.try_element_at(_map(STAGE_ORDER), F.col("availability_state")), F.lit(0)) == 5
    return entries.rollup("sport_id", "competition_id", "edition_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(ready).alias("ready"), F.grouping_id().alias("level"))


def search_catalog(resources: DataFrame, query: str, *, title: str = "title", context: str = "context", ready: str = "ready", limit: int = 12) -> DataFrame:
    """Resources that hold every query word, best first.

    A word scores 3 at the start of the text, 2 at the start of a word and 1
    elsewhere; ready resources get one point more.
    """
    words = query.lower().split()
    if not words:
        return resources.limit(0).withColumn("score", F.lit(0))
    text = F.lower(F.concat_ws(" ", title, context))
    every, score = F.lit(True), F.lit(0)
    for word in words:
        at = F.instr(text, word)
        every = every & (at > 0)
        score = score + F.when(at == 1, 3).when(F.substr(text, at - 1, F.lit(1)) == " ", 2).otherwise(1)
    hits = resources.withColumn("score", F.when(every, score + F.when(F.col(ready), 1).otherwise(0))).filter("score IS NOT NULL")
    return hits.orderBy(F.desc("score"), F.asc(title), *[F.asc(c) for c in resources.columns if c != title][:1]).limit(limit)


def _counts(df: DataFrame, key: str, name: str, distinct: str | None = None) -> DataFrame:
    return df.groupBy(key).agg((F.countDistinct(distinct) if distinct else F.count(F.lit(1))).alias(name))


def dataset_summary(datasets: DataFrame, children: Mapping[str, tuple[DataFrame, str | None]], key: str = "dataset_id") -> DataFrame:
    """Child counts per dataset: every child table is reduced before it is joined."""
    out = datasets
    for name, (df, distinct) in children.items():
        out = out.join(_counts(df, key, name, distinct), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))
    return out


def metric_catalog(metrics: DataFrame) -> DataFrame:
    """Per metric: in which datasets it occurs and how many values it has."""
    pairs = metrics.groupBy("metric_id", "dataset_id").agg(F.count("value_num").alias("n"))
    return pairs.groupBy("metric_id").agg(F.array_join(F.array_sort(F.collect_set("dataset_id")), ",").alias("datasets"), F.sum("n").alias("value_count"))


def rights_summary(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("policy").agg(F.array_join(F.array_sort(F.collect_set("dataset_id")), ",").alias("datasets"))


def session_detail(sessions: DataFrame, participants: DataFrame, trials: DataFrame, streams: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per session: child counts, sample rows and the sorted artifact ids."""
    out = sessions.join(_counts(participants, "session_id", "participants", "subject_id"), "session_id", "left")
    out = out.join(_counts(trials, "session_id", "trials"), "session_id", "left")
    out = out.join(streams.groupBy("session_id").agg(F.count(F.lit(1)).alias("streams"), F.sum("row_count").alias("sample_rows")), "session_id", "left")
    out = out.join(artifacts.groupBy("session_id").agg(F.array_sort(F.collect_set("artifact_id")).alias("artifact_ids")), "session_id", "left")
    return out.na.fill(0, ["participants", "trials", "streams", "sample_rows"])


def roster(players: DataFrame, crosswalk: DataFrame, membership: DataFrame, sides: DataFrame) -> DataFrame:
    """Players with canonical id, team and side; every link may be missing."""
    return players.join(crosswalk, "provider_player_id", "left").join(membership, "subject_id", "left").join(sides, "team_id", "left")


def player_links(season_rows: DataFrame, crosswalk: DataFrame, appearances: DataFrame) -> DataFrame:
    """Distinct contests in which a season subject appeared, through the crosswalk."""
    return season_rows.select("subject_id").distinct().join(crosswalk, "subject_id").join(appearances, "provider_player_id").select("subject_id", "contest_id").distinct()


def provenance_edges(metrics: DataFrame, runs: DataFrame, artifacts: DataFrame, streams: DataFrame) -> DataFrame:
    """Edges metric -> run -> algorithm, run -> input artifact -> stream -> dataset."""
    edge = lambda df, a, b, kind: df.select(F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"), F.lit(kind).alias("relation"))
    inputs = runs.select("run_id", F.explode("input_checksums").alias("checksum")).join(artifacts, "checksum")
    parts = [
        edge(metrics, "derived_metric_id", "run_id", "computed_by"),
        edge(runs, "run_id", "algorithm_id", "executes"),
        edge(inputs, "run_id", "artifact_id", "reads"),
        edge(artifacts, "artifact_id", "stream_id", "stores"),
        edge(streams, "stream_id", "dataset_id", "belongs_to"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def sync_pairs(pairs: DataFrame, streams: DataFrame, dataset_id: str) -> DataFrame:
    """Declared stream pairs of one dataset with both modalities."""
    side = lambda name: streams.select(F.col("stream_id").alias(f"{name}_stream_id"), F.col("modality").alias(f"{name}_modality"), "dataset_id")
    return pairs.join(side("source"), "source_stream_id").join(side("target").drop("dataset_id"), "target_stream_id").filter(F.col("dataset_id") == dataset_id)
