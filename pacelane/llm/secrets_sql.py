"""DuckDB SQL for the secret scan: every rule over every text, no index."""

from pacelane.llm.secrets import BASE, RULES, Rule


def _spans(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    hits = f"regexp_extract_all(body, '{pattern}')"
    gaps = f"string_split_regex(body, '{pattern}')"
    values = f"regexp_extract_all(body, '{pattern}', {rule.group})"
    return f"""SELECT doc_id, row, s.start AS start, {rank} AS rank, '{rule.kind}' AS kind, s.stop AS stop FROM (
      SELECT doc_id, row, unnest(list_filter(list_transform(range(1, len(hits) + 1), lambda k: {{
        'start': list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0),
        'stop': list_sum(list_transform(gaps[1:k], lambda x: length(x))) + list_sum(list_transform(hits[1:k], lambda x: length(x))),
        'long': length(vals[k]) >= {rule.least}}}), lambda x: x.long)) AS s
      FROM (SELECT doc_id, row, {hits} AS hits, {gaps} AS gaps, {values} AS vals FROM texts) WHERE len(hits) > 0)"""


def sql() -> str:
    kinds = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(s.kind) FILTER (s.kind = '{k}') AS n_{k}" for k in BASE)
    shown = "string_agg(s.kind || ':' || CAST(s.start AS BIGINT) || ':' || CAST(s.stop AS BIGINT), ',' ORDER BY s.start, s.rank)"
    return f"""WITH texts AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS body FROM documents),
    spans AS ({" UNION ALL ".join(_spans(r, k) for k, r in enumerate(RULES))})
    SELECT t.doc_id, {counts}, sha256(coalesce({shown} FILTER (s.kind IN ({kinds})), '')) AS base_sha256, coalesce({shown}, '') AS spans
    FROM texts t LEFT JOIN spans s ON t.row = s.row GROUP BY t.doc_id, t.row"""
