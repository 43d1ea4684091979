"""Window, envelope, entity and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacelane.operators import compare as cmp
from pacelane.operators import games, serve
from pacelane.operators.grouped import spread
from pacelane.plans.lineage import CURRENT_SQL, _current, _metrics
from pacelane.plans.registry import query, rounded

DAY = 86_400_000_000_000


@query("scan_stream", "S1, P27", f"SELECT entity_id, t_rel_ns, v FROM tb_signal WHERE entity_id = 7 AND t_rel_ns BETWEEN {2 * DAY} AND {25 * DAY}")
def scan_stream(tb):
    return serve.scan_stream(tb.signal, 2 * DAY, 25 * DAY, ["entity_id", "t_rel_ns", "v"], 7)


@query("entity_filter", "P27", "SELECT stream_id, t_rel_ns, x_m FROM tb_tracking WHERE object_id = 'p07'")
def entity_filter(tb):
    return serve.entity_filter(tb.tracking, "p07").select("stream_id", "t_rel_ns", "x_m")


@query("window_rows", "G8", f"SELECT count(*) AS rows FROM tb_signal WHERE t_rel_ns BETWEEN {DAY} AND {9 * DAY}")
def window_rows(tb):
    return serve.window_rows(tb.signal, DAY, 9 * DAY)


@query("bounded_window", "G8", f"SELECT entity_id, t_rel_ns FROM tb_signal WHERE t_rel_ns BETWEEN {DAY} AND {2 * DAY}")
def bounded_window(tb):
    return serve.bounded_window(tb.signal, DAY, 2 * DAY, max_rows=5_000_000, columns=["entity_id", "t_rel_ns"])


@query("timespan", "G8", "SELECT min(t_rel_ns) AS first_ns, max(t_rel_ns) AS last_ns FROM tb_signal")
def timespan(tb):
    return serve.timespan(tb.signal)


@query(
    "envelope",
    "G5",
    f"""WITH w AS (SELECT * FROM tb_signal WHERE t_rel_ns BETWEEN {DAY} AND {20 * DAY}),
        n AS (SELECT greatest(1, 2000 // count(DISTINCT entity_id)) AS share FROM w),
        b AS (SELECT w.*, (t_rel_ns - {DAY}) // (({19 * DAY + 1} + share - 1) // share) AS bucket FROM w, n)
        SELECT entity_id, bucket, min(t_rel_ns) AS t_start_ns, max(t_rel_ns) AS t_end_ns, count(*) AS bucket_rows, min(v) AS v_min, max(v) AS v_max, min(k) AS k_min, max(k) AS k_max FROM b GROUP BY 1, 2""",
)
def envelope(tb):
    return serve.envelope(tb.signal, ["entity_id"], ["v", "k"], DAY, 20 * DAY, 2000)


@query("entity_count", "G6", "SELECT count(DISTINCT object_id) AS entities FROM tb_frames")
def entity_count(tb):
    return serve.entity_count(tb.frames)


@query("entity_list", "G6", "SELECT DISTINCT CAST(entity_id AS VARCHAR) AS entity_id FROM tb_signal")
def entity_list(tb):
    return serve.entity_list(tb.signal)


@query(
    "entity_observations",
    "G7",
    "SELECT subject_id AS entity_id, min(t_rel_ns) AS first_observed_ns, max(t_rel_ns) AS last_observed_ns, count(DISTINCT t_rel_ns) AS observation_count FROM tb_pose WHERE is_available GROUP BY 1",
)
def entity_observations(tb):
    return serve.entity_observations(tb.pose, F.col("is_available") & F.col("x_m").isNotNull())


@query("list_streams", "S2", "SELECT dataset_id, session_id, stream_id, modality FROM (SELECT DISTINCT dataset_id, session_id, stream_id, 'tracking' AS modality FROM tb_tracking) WHERE session_id = 's2'")
def list_streams(tb):
    streams = tb.tracking.select("dataset_id", "session_id", "stream_id", F.lit("tracking").alias("modality")).distinct()
    return serve.list_streams(streams, dataset_id="bed", modality="tracking", session_id="s2")


@query("metric_filter", "P26", CURRENT_SQL + " SELECT derived_metric_id, value_num FROM m WHERE dataset_id = 'd1' AND session_id = 's4' AND entity_id = 'e0'")
def metric_filter(tb):
    return serve.metric_filter(_metrics(tb), dataset_id="d1", session_id="s4", entity_id="e0", subject_id=None).select("derived_metric_id", "value_num")


@query("metric_page", "L5, P26", CURRENT_SQL + " SELECT derived_metric_id, dataset_id, metric_id, value_num FROM cur ORDER BY dataset_id, metric_id, derived_metric_id LIMIT 100 OFFSET 200")
def metric_page(tb):
    rows = _current(tb).select("derived_metric_id", "dataset_id", "metric_id", "value_num")
    return games.page(rows, [F.col(c).asc() for c in ("dataset_id", "metric_id", "derived_metric_id")], limit=100, offset=200)


@query("session_artifacts", "U1", "SELECT o_custkey AS artifact FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def session_artifacts(tb):
    return tb.table("orders").select(F.col("o_custkey").alias("artifact")).union(tb.table("customer").filter("c_acctbal > 0").select("c_custkey")).distinct()


@query("shared_keys", "U3", "SELECT o_custkey AS key FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def shared_keys(tb):
    return tb.table("orders").select(F.col("o_custkey").alias("key")).intersect(tb.table("customer").filter("c_acctbal > 0").select("c_custkey"))


@query("missing_columns", "U2", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def missing_columns(tb):
    return tb.table("customer").select(F.col("c_custkey").alias("key")).exceptAll(tb.table("orders").filter("o_totalprice > 200000").select("o_custkey").distinct())


@query("merged_families", "U5, S13", "SELECT object_type AS family, count(*) AS rows FROM tb_frames GROUP BY 1")
def merged_families(tb):
    home = tb.tracking.filter("group_id = 'home'").select("object_type", "t_rel_ns")
    away = tb.tracking.filter("group_id = 'away'").select("t_rel_ns", "object_type")
    ball = tb.ball.select("t_rel_ns", F.lit("ball").alias("object_type"))
    return home.unionByName(away).unionByName(ball).groupBy(F.col("object_type").alias("family")).agg(F.count(F.lit(1)).alias("rows"))


# -- comparison ---------------------------------------------------------------------

PAIR_SQL = """WITH u AS (SELECT *, CASE WHEN metric_id LIKE 'cmj%' THEN 'm' ELSE 's' END AS si_unit FROM tb_metric),
    s AS (SELECT metric_id, dataset_id, coalesce(subject_id, '') AS subject_id, session_id, count(*) AS n, min(value_num) AS v, min(si_unit) AS un FROM u GROUP BY 1, 2, 3, 4),
    p AS (SELECT x.dataset_id, x.subject_id, x.session_id, x.v AS a, x.un AS unit_a, y.v AS b, y.un AS unit_b, x.un = y.un AS same_unit FROM s x JOIN s y USING (dataset_id, subject_id, session_id)
          WHERE x.n = 1 AND y.n = 1 AND x.metric_id = 'cmj.high' AND y.metric_id = 'locomotor.high')"""


def _pairs(tb):
    rows = tb.metric.withColumn("si_unit", F.expr("CASE WHEN metric_id LIKE 'cmj%' THEN 'm' ELSE 's' END"))
    return cmp.pair_metrics(rows, "cmj.high", "locomotor.high", ["dataset_id", "subject_id", "session_id"])


@query("pair_metrics", "J27", PAIR_SQL + " SELECT * FROM p")
def pair_metrics(tb):
    return _pairs(tb)


@query(
    "paired_comparison",
    "G31",
    PAIR_SQL
    + """ SELECT dataset_id, count(*) AS n, round(avg(a - b), 4) + 0.0 AS bias, round(avg(abs(a - b)), 4) + 0.0 AS mae, round(sqrt(avg((a - b) ** 2)), 4) + 0.0 AS rmse, round(max(abs(a - b)), 4) + 0.0 AS max_abs_error,
                 round(avg(a), 4) + 0.0 AS mean_a, round(avg(b), 4) + 0.0 AS mean_b, count(*) FILTER (abs(a - b) <= 50000) AS within_tolerance,
                 round(CASE WHEN var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2 > 0 THEN 2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + (avg(a) - avg(b)) ** 2) END, 6) + 0.0 AS ccc,
                 round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) + 0.0 AS pearson_r FROM p GROUP BY 1""",
)
def paired_comparison(tb):
    df = cmp.paired_comparison(_pairs(tb), ["dataset_id"], "a", "b", tolerance=50_000.0)
    return rounded(rounded(df, "bias", "mae", "rmse", "max_abs_error", "mean_a", "mean_b", digits=4), "ccc", "pearson_r")


@query(
    "bland_altman",
    "G32",
    PAIR_SQL
    + """ SELECT dataset_id, count(*) AS n, round(CASE WHEN count(*) >= 30 THEN avg(a - b) END, 4) + 0.0 AS mean_difference, round(CASE WHEN count(*) >= 30 THEN stddev_pop(a - b) END, 4) + 0.0 AS sd_difference,
                 round(CASE WHEN count(*) >= 30 THEN avg(a - b) - 1.96 * stddev_pop(a - b) END, 4) + 0.0 AS lower_limit, round(CASE WHEN count(*) >= 30 THEN avg(a - b) + 1.96 * stddev_pop(a - b) END, 4) + 0.0 AS upper_limit FROM p GROUP BY 1""",
)
def bland_altman(tb):
    return rounded(cmp.bland_altman(_pairs(tb), ["dataset_id"], "a", "b"), "mean_difference", "sd_difference", "lower_limit", "upper_limit", digits=4)


@query(
    "difference_summary",
    "G40",
    PAIR_SQL
    + """, d AS (SELECT dataset_id, b - a AS d, (a + b) / 2 AS m FROM p), g AS (SELECT dataset_id, count(*) AS n, avg(d) AS md, stddev_samp(d) AS sd, corr(d, m) AS r FROM d GROUP BY 1 HAVING count(*) >= 3)
    SELECT dataset_id, n AS count, round(md, 4) + 0.0 AS mean_difference, round(md - 1.96 * sd, 4) + 0.0 AS lower_limit, round(md + 1.96 * sd, 4) + 0.0 AS upper_limit, round(r, 6) + 0.0 AS bias_correlation, abs(r) >= 0.5 AS proportional_bias FROM g""",
)
def difference_summary(tb):
    return rounded(rounded(cmp.difference_summary(_pairs(tb), ["dataset_id"], "a", "b"), "mean_difference", "lower_limit", "upper_limit", digits=4), "bias_correlation")


@query(
    "five_number",
    "G39",
    """SELECT metric_id, count(value_num) AS valid_n, round(min(value_num), 4) + 0.0 AS minimum, round(quantile_cont(value_num, 0.25), 4) + 0.0 AS q1, round(median(value_num), 4) + 0.0 AS median,
              round(quantile_cont(value_num, 0.75), 4) + 0.0 AS q3, round(max(value_num), 4) + 0.0 AS maximum FROM tb_metric GROUP BY 1""",
)
def five_number(tb):
    return rounded(cmp.five_number(tb.metric, ["metric_id"], "value_num"), "minimum", "q1", "median", "q3", "maximum", digits=4)


@query("group_values", "G39", "SELECT metric_id, session_id, count(value_num) AS n, round(min(value_num), 4) + 0.0 AS low, round(max(value_num), 4) + 0.0 AS high FROM tb_metric GROUP BY 1, 2")
def group_values(tb):
    grouped = tb.metric.groupBy("metric_id", "session_id").agg(F.count("value_num").alias("n"), F.min("value_num").alias("low"), F.max("value_num").alias("high"))
    return rounded(grouped, "low", "high", digits=4)


@query(
    "headline_metric",
    "G41",
    """WITH c AS (SELECT session_id, metric_id, count(value_num) AS n FROM tb_metric WHERE NOT (metric_id = 'cmj.low' AND session_id < 's3') GROUP BY 1, 2)
       SELECT session_id, metric_id AS headline_metric_id, n AS values FROM c QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY CASE metric_id WHEN 'cmj.low' THEN 1 WHEN 'pose.none' THEN 2 ELSE 3 END, n DESC, metric_id) = 1""",
)
def headline_metric(tb):
    return cmp.headline_metric(tb.metric.filter("NOT (metric_id = 'cmj.low' AND session_id < 's3')"), ["session_id"], ["cmj.low", "pose.none"])


@query(
    "discriminating_field",
    "G41",
    CURRENT_SQL + " SELECT metric_id, CASE WHEN greatest(count(DISTINCT entity_id), count(DISTINCT subject_id)) = count(DISTINCT entity_id) THEN 'entity_id' ELSE 'subject_id' END AS field FROM m GROUP BY 1",
)
def discriminating_field(tb):
    return cmp.discriminating_field(_metrics(tb), ["metric_id"], ("entity_id", "subject_id"))


@query("rank_metric", "G41", "SELECT metric_id, subject_id, value_num AS value, rank() OVER (PARTITION BY metric_id ORDER BY value_num DESC) AS rank FROM tb_metric WHERE subject_id IS NOT NULL")
def rank_metric(tb):
    return cmp.rank_metric(tb.metric, ["metric_id"], "subject_id")


@query(
    "zone_breakdown",
    "G41",
    """SELECT session_id, subject_id, max(value_num) FILTER (metric_id = 'cmj.low') AS low, max(value_num) FILTER (metric_id = 'cmj.medium') AS medium, max(value_num) FILTER (metric_id = 'cmj.high') AS high,
              round(coalesce(max(value_num) FILTER (metric_id = 'cmj.low'), 0) + coalesce(max(value_num) FILTER (metric_id = 'cmj.medium'), 0) + coalesce(max(value_num) FILTER (metric_id = 'cmj.high'), 0), 4) + 0.0 AS total
       FROM tb_metric WHERE metric_id IN ('cmj.low', 'cmj.medium', 'cmj.high') AND subject_id IS NOT NULL
       AND session_id IN (SELECT session_id FROM tb_metric WHERE metric_id IN ('cmj.low', 'cmj.medium', 'cmj.high') AND subject_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT metric_id) = 3) GROUP BY 1, 2""",
)
def zone_breakdown(tb):
    df = cmp.zone_breakdown(tb.metric.filter("subject_id IS NOT NULL"), ["session_id"], "subject_id", "cmj.")
    return rounded(df, "total", digits=4)


@query("source_metric_lookup", "J35", """SELECT session_id, max(value_num) FILTER (metric_id = 'cmj.high') AS "cmj.high", max(value_num) FILTER (metric_id = 'pose.low') AS "pose.low" FROM tb_metric GROUP BY 1""")
def source_metric_lookup(tb):
    return cmp.source_metric_lookup(tb.metric, ["session_id"], ["cmj.high", "pose.low"])


@query(
    "profile_table",
    "G36",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, min(CAST({c} AS VARCHAR)) AS minimum, max(CAST({c} AS VARCHAR)) AS maximum FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
)
def profile_table(tb):
    return cmp.profile_table(tb.table("documents"))


@query("structure_discovery", "G37", "SELECT event_type AS section, count(*) AS rows, count(CASE WHEN k > 50 THEN k END) AS high_k, count(user_id) AS user_id FROM tb_ev GROUP BY 1")
def structure_discovery(tb):
    rows = tb.ev.withColumn("high_k", F.when(F.col("k") > 50, F.col("k")))
    return cmp.structure_counts(rows, F.col("event_type"), ["high_k", "user_id"])


STRUCTURE_SQL = """
    WITH l AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 3 = 0) AS gaps, count(*) FILTER (l_linenumber % 2 = 0) AS even FROM lineitem GROUP BY 1),
    o AS (SELECT o_orderstatus AS key, o_orderkey, o_orderkey % 4 = 0 AS bare, o_orderkey % 5 = 0 AS odd, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(even, 0) AS even FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
    p AS (SELECT key, unnest([
        {'path': '$', 'kinds': ['object'], 'documents': count(*), 'occurrences': count(*), 'least': 1, 'most': 1, 'optional': false},
        {'path': '$.id', 'kinds': CASE WHEN bool_and(odd) THEN ['text'] WHEN bool_or(odd) THEN ['integer', 'text'] ELSE ['integer'] END, 'documents': count(*), 'occurrences': count(*), 'least': 1, 'most': 1, 'optional': false},
        {'path': '$.price', 'kinds': ['number'], 'documents': count(*) FILTER (NOT bare), 'occurrences': count(*) FILTER (NOT bare), 'least': CASE WHEN bool_or(bare) THEN 0 ELSE 1 END, 'most': 1, 'optional': bool_or(bare)},
        {'path': '$.lines', 'kinds': ['array'], 'documents': count(*), 'occurrences': count(*), 'least': 1, 'most': 1, 'optional': false},
        {'path': '$.lines[]', 'kinds': ['object'], 'documents': count(*) FILTER (n > 0), 'occurrences': CAST(sum(n) AS BIGINT), 'least': CASE WHEN min(n) = 0 THEN 0 ELSE min(n) END, 'most': max(n), 'optional': min(n) = 0},
        {'path': '$.lines[].part', 'kinds': ['integer'], 'documents': count(*) FILTER (n > 0), 'occurrences': CAST(sum(n) AS BIGINT), 'least': 1, 'most': 1, 'optional': false},
        {'path': '$.lines[].flags', 'kinds': ['object'], 'documents': count(*) FILTER (n > gaps), 'occurrences': CAST(sum(n - gaps) AS BIGINT), 'least': CASE WHEN sum(gaps) > 0 THEN 0 ELSE 1 END, 'most': 1, 'optional': sum(gaps) > 0},
        {'path': '$.lines[].flags.even', 'kinds': ['boolean'], 'documents': count(*) FILTER (n > gaps), 'occurrences': CAST(sum(n - gaps) AS BIGINT), 'least': 1, 'most': 1, 'optional': false}], recursive := true) FROM o GROUP BY key)
    SELECT key, path, kinds, documents, occurrences, CAST(least AS BIGINT) AS least, CAST(most AS BIGINT) AS most, optional FROM p WHERE occurrences > 0"""


@query("structure_json", "G37", STRUCTURE_SQL)
def structure_json(tb):
    """Paths of one nested document for each order."""
    from pacelane.operators import structure as st

    flags = F.when(F.col("l_linenumber") % 3 != 0, F.struct((F.col("l_linenumber") % 2 == 0).alias("even")))
    lines = tb.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), flags.alias("flags"))).alias("lines"))  # an order has a few lines
    # Orders are few bytes but much work as documents, so they are dealt over all tasks before the texts are made.
    orders = spread(tb.table("orders"), "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast(lines.schema["lines"].dataType)
    number = F.concat(F.lit('{"id":'), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('"'), F.col("o_orderkey").cast("string"), F.lit('"'))).otherwise(F.col("o_orderkey").cast("string")))
    price = F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit(',"price":'), F.col("o_totalprice").cast("string")))
    text = F.concat(number, price, F.lit(',"lines":'), F.to_json(F.coalesce("lines", none)), F.lit("}"))
    return st.structure(orders.select("o_orderstatus", text.alias("text")), "o_orderstatus", "text")


@query(
    "structure_xml",
    "G37",
    """WITH p AS (SELECT n_regionkey AS key, count(DISTINCT n_nationkey) AS docs, count(s_suppkey) AS people, count(*) FILTER (s_suppkey % 3 = 0) AS noted, count(DISTINCT n_nationkey) FILTER (s_suppkey % 3 = 0) AS noted_docs, count(DISTINCT n_nationkey) FILTER (s_suppkey IS NOT NULL) AS peopled FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1),
       c AS (SELECT n_regionkey AS key, n_nationkey, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2), m AS (SELECT key, min(n) AS least, max(n) AS most FROM c GROUP BY 1)
       SELECT CAST(key AS INTEGER) AS key, r.path, r.kinds, r.documents, r.occurrences, r.least, r.most, r.optional FROM (SELECT key, unnest([
           {'path': '/Team', 'kinds': ['element'], 'documents': docs, 'occurrences': docs, 'least': CAST(1 AS BIGINT), 'most': CAST(1 AS BIGINT), 'optional': false},
           {'path': '/Team/@name', 'kinds': ['text'], 'documents': docs, 'occurrences': docs, 'least': 1, 'most': 1, 'optional': false},
           {'path': '/Team/Player', 'kinds': ['element'], 'documents': peopled, 'occurrences': people, 'least': least, 'most': most, 'optional': least = 0},
           {'path': '/Team/Player/@no', 'kinds': ['integer'], 'documents': peopled, 'occurrences': people, 'least': 1, 'most': 1, 'optional': false},
           {'path': '/Team/Player/Note', 'kinds': ['element'], 'documents': noted_docs, 'occurrences': noted, 'least': CASE WHEN noted < people THEN 0 ELSE 1 END, 'most': 1, 'optional': noted < people},
           {'path': '/Team/Player/Note/text()', 'kinds': ['number'], 'documents': noted_docs, 'occurrences': noted, 'least': 1, 'most': 1, 'optional': false}]) AS r FROM p JOIN m USING (key)) WHERE r.occurrences > 0""",
)
def structure_xml(tb):
    """Paths of one document for each nation, its suppliers inside."""
    from pacelane.operators import structure as st

    note = F.when(F.col("s_suppkey") % 3 == 0, F.lit("<Note>1.5</Note>")).otherwise("")
    player = F.concat(F.lit('<Player no="'), F.col("s_suppkey").cast("string"), F.lit('">'), note, F.lit("</Player>"))
    people = tb.table("supplier").groupBy("s_nationkey").agg(F.array_join(F.collect_list(player), "").alias("players"))
    nations = tb.table("nation").join(people, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    text = F.concat(F.lit('<Team name="'), F.col("n_name"), F.lit('">'), F.coalesce("players", F.lit("")), F.lit("</Team>"))
    return st.structure(nations.select(F.col("n_regionkey").cast("int").alias("n_regionkey"), text.alias("text")), "n_regionkey", "text", "xml")


@query("exact_quantile", "G36", "SELECT l_returnflag, count(*) AS valid_n, round(quantile_cont(l_extendedprice, 0.01), 4) + 0.0 AS p01, round(quantile_cont(l_extendedprice, 0.999), 4) + 0.0 AS p999 FROM lineitem GROUP BY 1")
def exact_quantile(tb):
    from pacelane.operators import ranking

    return rounded(ranking.quantiles(tb.table("lineitem"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "p999": 0.999}), "p01", "p999", digits=4)
