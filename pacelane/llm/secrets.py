"""Secrets in texts: a trigram inverted index, intersected postings, verified candidates.  DataFrame functions only.

Every rule is a regular expression.  From its syntax follows a Boolean condition on trigrams
(``trigrams.condition``).  The index holds, for each trigram that occurs in a condition and each block of documents,
the numbers of the documents that contain it; a rule's candidates are unions of intersections of these lists.
Rules without a mandatory trigram have every document as candidate.  Candidates are verified by the expression itself,
whose matches and the pieces between them give the positions.

A document's number is a hash of its id, so rows that share an id (null too) share candidates, which verification
settles row by row.  Null and empty texts have no span.  Matches of one rule never overlap; different rules may.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import fresh, plain
from pacelane.llm.trigrams import condition


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    """Characters that the group must have, or the match is dropped."""


# The first three kinds are the base rules, in the order in which spans are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
BLOCK = 4096
"""Documents in a block of the index, so that no posting list is long."""
MASK = "[SECRET]"


def _number(id_column: str) -> Column:
    return F.xxhash64(F.col(f"`{id_column}`"))


def postings(df: DataFrame, trigrams: list[str], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Inverted index: ``trigram``, ``block`` and the sorted distinct ``numbers`` of the documents that hold it, in any case."""
    rows = plain(df, id_column, text_column)
    blocks = max(1, -(-rows.count() // BLOCK))
    lower = rows.select(_number(id_column).alias("number"), F.lower(text_column).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    listed = lower.select("number", F.explode(held).alias("trigram"))
    return listed.groupBy("trigram", F.pmod("number", F.lit(blocks)).alias("block")).agg(F.array_sort(F.collect_set("number")).alias("numbers"))


def candidates(df: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``number`` and the ``kinds`` whose trigram condition the document fulfils; rules without a condition are left out."""
    conditions = {r.kind: condition(r.pattern) for r in rules}
    clauses = [(kind, n, trigram, len(clause)) for kind, found in conditions.items() if found for n, clause in enumerate(found) for trigram in sorted(clause)]
    spark = df.sparkSession
    if not clauses:
        return spark.createDataFrame([], "number long, kinds array<string>")
    asked = spark.createDataFrame(clauses, "kind string, clause int, trigram string, size int")
    index = postings(df, sorted({t for _, _, t, _ in clauses}), id_column, text_column)
    lists = index.join(F.broadcast(asked), "trigram").groupBy("kind", "clause", "block", "size").agg(F.collect_list("numbers").alias("lists"))
    shared = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1), lambda all_of, one: F.array_intersect(all_of, one))
    found = lists.where(F.size("lists") == F.col("size")).select("kind", F.explode(shared).alias("number"))
    return found.groupBy("number").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, text: str, order: int, hits: str, values: str, gaps: str) -> Column:
    """Spans of a rule from its matches and the pieces between them."""
    begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,rank:int,kind:string,end:int>>)").alias("spans"))

    def step(state, k):
        start = state["at"] + F.length(F.get(F.col(gaps), k))
        end = start + F.length(F.get(F.col(hits), k))
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        long = F.length(F.get(F.col(values), k)) >= rule.least
        return F.struct(end.alias("at"), F.when(long, F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    every = F.when(F.size(hits) > 0, F.sequence(F.lit(0), F.size(hits) - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.aggregate(every, begin, step, lambda state: state["spans"])


def with_spans(df: DataFrame, out: str = "spans", rules: tuple[Rule, ...] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``df`` with all spans of each text: array of ``start``, ``rank``, ``kind``, ``end`` in code points, by start and rule."""
    columns = [c for c in df.columns if c != out]
    found = candidates(df, rules, id_column, text_column)
    number, kinds, text = fresh("number"), fresh("kinds"), fresh("text")
    rows = df.withColumn(number, _number(id_column)).withColumn(text, F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    rows = rows.join(found.select(F.col("number").alias(number), F.col("kinds").alias(kinds)), number, "left")
    none = F.expr("CAST(array() AS array<string>)")
    hits, values, gaps = fresh("hits"), fresh("values"), fresh("gaps")
    first, second, third = {}, {}, {}
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        asked = F.array_contains(kinds, rule.kind) if condition(rule.pattern) is not None else F.lit(True)
        first[f"{hits}{k}"] = F.when(asked, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)
        some = F.size(f"{hits}{k}") > 0
        second[f"{gaps}{k}"] = F.when(some, F.split(text, rule.pattern, -1)).otherwise(none)
        if rule.group:
            second[f"{values}{k}"] = F.when(some, F.regexp_extract_all(text, pattern, F.lit(rule.group))).otherwise(none)
        third[f"{out}{k}"] = _spans(rule, text, k, f"{hits}{k}", f"{values}{k}" if rule.group else f"{hits}{k}", f"{gaps}{k}")
    rows = rows.withColumns(first).withColumns(second)
    return rows.select(*[F.col(f"`{c}`") for c in columns], F.array_sort(F.concat(*third.values())).alias(out))


def masked(text: Column, spans: Column) -> Column:
    """Text with every stretch that spans cover replaced by one mark."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, span):
        apart = span["start"] >= state["at"]
        kept = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(apart, F.concat(state["out"], kept, F.lit(MASK))).otherwise(state["out"]).alias("out"))

    return F.aggregate(spans, begin, step, lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))


def mask_secrets(df: DataFrame) -> DataFrame:
    """Documents with their secrets masked and ``n_chars`` counted anew; a null text stays null."""
    spans = fresh("spans")
    rows = with_spans(df, spans)
    text = F.when(F.size(spans) > 0, masked(F.col("text"), F.col(spans))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in df.columns:
        changed = F.when(F.size(spans) > 0, F.length("text")).otherwise(F.col("n_chars"))
        rows = rows.withColumn("n_chars", changed.cast(df.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])


def _is(*kinds: str):
    return lambda span: span["kind"].isin(*kinds)


def digest(rows: DataFrame) -> DataFrame:
    """Per row: id, span counts of the base rules, digest of their spans, and all spans as text."""
    base = F.filter("spans", _is(*BASE))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return rows.select("doc_id", *counts, F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))
