"""The testbed views of ``pacelane.testbed`` as SQL text for the oracle."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "tb_ev": """
        SELECT event_id, user_id, event_type, value,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) AS us
        FROM events""",
    "tb_tracking": """
        SELECT 'bed' AS dataset_id, 's' || (frame // 100) AS session_id, 'trk' || (frame // 100) AS stream_id,
               'p' || lpad(CAST(n AS VARCHAR), 2, '0') AS object_id,
               CASE WHEN n IN (0, 11) THEN 'goalkeeper' ELSE 'player' END AS object_type,
               CASE WHEN n < 11 THEN 'home' ELSE 'away' END AS group_id,
               CASE WHEN n % 11 = 0 THEN 'GK' WHEN n % 11 <= 4 THEN 'DEF' WHEN n % 11 <= 7 THEN 'MID' ELSE 'ATT' END AS role,
               frame, event_id AS sample_index, frame * 40000000 AS t_rel_ns,
               value % 105 - 52.5 AS x_m, CAST(k % 68 - 34 AS DOUBLE) AS y_m, event_type <> 'error' AS is_detected, k
        FROM (SELECT *, event_id // 22 AS frame, event_id % 22 AS n FROM tb_ev)
        WHERE frame < (SELECT (max(event_id) + 1) // 22 FROM tb_ev)""",
    "tb_ball": """
        SELECT dataset_id, session_id, stream_id, frame, t_rel_ns, avg(x_m) AS x_m, avg(y_m) AS y_m
        FROM tb_tracking GROUP BY ALL""",
    "tb_frames": """
        SELECT dataset_id, session_id, stream_id, object_id, object_type, group_id, role, frame, sample_index, t_rel_ns,
               x_m, y_m, is_detected, k FROM tb_tracking
        UNION ALL
        SELECT dataset_id, session_id, stream_id, 'ball', 'ball', NULL, NULL, frame, -1 - frame, t_rel_ns, x_m, y_m, true, NULL
        FROM tb_ball""",
    "tb_signal": """
        SELECT user_id AS entity_id, (us - (SELECT min(us) FROM tb_ev)) * 1000 AS t_rel_ns, value AS v, k, event_id, event_type
        FROM tb_ev""",
    "tb_gnss": """
        SELECT entity_id, t_rel_ns, event_id, 43.36 + (k - 50) * 1e-4 AS latitude_deg, -5.92 + (v % 50) * 1e-4 AS longitude_deg
        FROM tb_signal""",
    "tb_ticks": """
        SELECT entity_id, row_number() OVER (PARTITION BY entity_id ORDER BY t_rel_ns, event_id) - 1 AS sample_index,
               (row_number() OVER (PARTITION BY entity_id ORDER BY t_rel_ns, event_id) - 1) * 1000000 AS t_rel_ns, v, k, event_id
        FROM tb_signal""",
    "tb_force": "SELECT entity_id, sample_index, t_rel_ns, 0.8 + v / 1000 AS ratio FROM tb_ticks",
    "tb_imu": """
        SELECT entity_id, sample_index, t_rel_ns, v AS ax, CAST(k AS DOUBLE) AS ay, CAST(9.80665 AS DOUBLE) AS az
        FROM tb_ticks WHERE sample_index % 2 = 0""",
    "tb_lpt": "SELECT entity_id, sample_index, t_rel_ns, v % 2 AS position_m FROM tb_ticks",
    "tb_event": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, entity_id, t_rel_ns, v, k
        FROM tb_signal WHERE event_type IN ('purchase', 'click')""",
    "tb_source_event": """
        SELECT 'e' || sample_index AS event_id, stream_id, CASE WHEN is_detected THEN 'pass' ELSE 'shot' END AS event_type,
               object_id AS provider_player_id, group_id AS provider_team_id,
               t_rel_ns + k * 1300000 - 60000000 AS t_rel_ns, x_m, y_m
        FROM tb_tracking WHERE k % 10 = 3""",
    "tb_frame_clock": """
        SELECT contest_id, frame AS frame_idx, frame // 120 + 1 AS period_number, frame * 40 + 1700000000000 AS wall_clock_ms,
               frame * 40000000 AS canonical_time_ns, CAST(120 - (frame % 120) // 2 AS DOUBLE) AS game_clock_s,
               CAST(24 - frame % 24 AS DOUBLE) AS shot_clock_s,
               CASE WHEN frame % 10 = 0 THEN 0 ELSE 10 END AS player_count, frame % 10 <> 0 AS ball_present
        FROM (SELECT 'g' || frame // 240 AS contest_id, frame % 240 AS frame FROM tb_ball)""",
    "tb_dynamic_event": """
        SELECT contest_id, CASE WHEN k % 2 = 0 THEN 'passes' WHEN k % 3 = 0 THEN 'chance_players' ELSE 'shots' END AS family,
               sample_index AS event_no, frame // 120 + 1 AS period_number,
               CASE WHEN sample_index % 5 = 0 THEN frame END AS source_frame_idx,
               CASE WHEN sample_index % 5 = 1 THEN frame * 40 + 1700000000000
                    WHEN sample_index % 10 = 0 THEN (frame + 1) * 40 + 1700000000000 END AS wall_clock_ms,
               CASE WHEN sample_index % 5 IN (2, 3) THEN CAST(120 - (frame % 120) // 2 AS DOUBLE) END AS game_clock_s,
               CASE WHEN sample_index % 5 = 2 THEN CAST(24 - frame % 24 AS DOUBLE) END AS shot_clock_s
        FROM (SELECT * REPLACE (frame % 240 AS frame), 'g' || frame // 240 AS contest_id FROM tb_tracking WHERE k % 7 = 2)""",
    "tb_pose": """
        SELECT 'sub' || label AS subject_id, n * 40000000 AS t_rel_ns, joint_id, 'j' || lpad(CAST(joint_id AS VARCHAR), 2, '0') AS joint_name,
               CAST(embedding[joint_id * 3 + 1] AS DOUBLE) AS x_m, CAST(embedding[joint_id * 3 + 2] AS DOUBLE) AS y_m,
               CAST(embedding[joint_id * 3 + 3] AS DOUBLE) AS z_m,
               abs(CAST(embedding[61 + joint_id % 4] AS DOUBLE)) AS error_m, CAST(embedding[61 + joint_id % 4] AS DOUBLE) > -0.15 AS is_available
        FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings),
             (SELECT CAST(range AS INTEGER) AS joint_id FROM range(20))
        WHERE vec_id % 13 <> 0""",
    "tb_plays": """
        SELECT *, CAST(sum(CASE WHEN team_id = 'home' THEN points ELSE 0 END) OVER w AS BIGINT) AS home_score,
               CAST(sum(CASE WHEN team_id = 'away' THEN points ELSE 0 END) OVER w AS BIGINT) AS away_score
        FROM (SELECT conv_id AS contest_id, turn AS sequence_index,
                     CASE role WHEN 'user' THEN 'home' WHEN 'assistant' THEN 'away' END AS team_id,
                     CAST(CASE WHEN role IN ('user', 'assistant') THEN length(text) % 4 ELSE 0 END AS INTEGER) AS points,
                     turn // 2 + 1 AS period_number, CAST(720 - (turn * 97) % 800 AS DOUBLE) AS clock_s
              FROM conversations)
        WINDOW w AS (PARTITION BY contest_id ORDER BY sequence_index)""",
    "tb_schedule": """
        SELECT contest_id,
               CAST(home_points + CASE WHEN contest_id % 7 = 0 THEN 1 ELSE 0 END + CASE WHEN contest_id % 11 = 5 THEN 2 ELSE 0 END AS BIGINT) AS home_final,
               away_points AS away_final, contest_id % 7 = 0 AS shootout, contest_id % 13 <> 3 AS completed, contest_id % 5 = 0 AS neutral_site
        FROM (SELECT conv_id AS contest_id,
                     CAST(sum(CASE WHEN role = 'user' THEN length(text) % 4 ELSE 0 END) AS BIGINT) AS home_points,
                     CAST(sum(CASE WHEN role = 'assistant' THEN length(text) % 4 ELSE 0 END) AS BIGINT) AS away_points
              FROM conversations GROUP BY conv_id)""",
    "tb_season": """
        SELECT c_custkey AS subject_id, c_name AS player_name, n_name AS team_id, c_mktsegment AS position_group,
               CAST(coalesce(m, 0) AS BIGINT) AS count_match, c_acctbal AS balance, floor(a) AS avg_price, x AS max_price
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS m, avg(o_totalprice) AS a, max(o_totalprice) AS x FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "tb_metric": """
        SELECT o_orderkey AS derived_metric_id, 'd' || (o_custkey % 3) AS dataset_id,
               CASE o_orderstatus WHEN 'F' THEN 'locomotor.' WHEN 'O' THEN 'cmj.' ELSE 'pose.' END || lower(replace(substr(o_orderpriority, 3), ' ', '_')) AS metric_id,
               CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE 'c' || o_custkey END AS subject_id, 's' || c_nationkey AS session_id,
               'run-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS run_id,
               CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE epoch_us(o_orderdate) END AS computed_at, o_totalprice AS value_num,
               '{"algorithm_id":"' || o_orderstatus || '","entity_id":"e' || (o_orderkey % 2) || '"}' AS provenance
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "tb_source_rows": """
        SELECT * REPLACE (CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'NaN'::DOUBLE WHEN k = 2 THEN 'Infinity'::DOUBLE ELSE x_m END AS x_m), 0 AS copy_no
        FROM tb_tracking
        UNION ALL
        SELECT * REPLACE (CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'NaN'::DOUBLE WHEN k = 2 THEN 'Infinity'::DOUBLE ELSE x_m END AS x_m), 1
        FROM tb_tracking WHERE sample_index % 500 = 0""",
    "tb_alias_map": """
        SELECT CAST(s_suppkey AS VARCHAR) AS alias_id, CAST(s_suppkey % 50 AS VARCHAR) AS canonical_id FROM supplier WHERE s_suppkey >= 50""",
    "tb_alias_rows": """
        SELECT CAST(l_suppkey AS VARCHAR) AS player_id, 't' || (l_suppkey % 5) AS team_id,
               CASE WHEN l_suppkey % 23 = 7 THEN 'Total' ELSE 'Team ' || (l_suppkey % 5) END AS team_name, games_played,
               CASE WHEN l_suppkey % 10 = 4 THEN 0.0 WHEN l_suppkey % 29 = 3 THEN NULL ELSE q END AS attempts,
               CASE WHEN l_suppkey % 10 = 4 THEN 0.0 WHEN l_suppkey % 31 = 9 THEN NULL ELSE round(d, 4) END AS fg_percentage
        FROM (SELECT l_suppkey, sum(l_quantity) AS q, avg(l_discount) AS d, count(*) AS games_played FROM lineitem GROUP BY 1)""",
    "tb_catalog": """
        SELECT s_suppkey AS entry_id, lower(r_name) AS sport_id, lower(n_name) AS competition_id, 'ed' || (s_suppkey % 7) AS edition_id, s_name AS title,
               ['UPSTREAM_AVAILABLE', 'REGISTERED', 'ACQUIRED', 'MATERIALIZED', 'READY', 'ACQUISITION_FAILED', 'MATERIALIZATION_FAILED', 'VALIDATION_FAILED'][CAST(s_suppkey % 8 AS INTEGER) + 1] AS availability_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
}


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in sorted(set(re.findall(r"\btb_\w+", text))):
        if name in VIEWS and name not in seen:
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def with_views(sql: str) -> str:
    """Prefix a query with the testbed views it mentions."""
    names = _needed(sql, [])
    if not names:
        return sql.strip()
    clauses = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {clauses},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {clauses},\n{body[5:]}"
    return f"WITH {clauses}\n{body}"
