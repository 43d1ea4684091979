"""Mixing sources to target weights by hash thresholds.

Every row has a key, the hexadecimal digest of a seed, its id and its text.  A source's target is met by nested
budgets: the first copy of its rows is taken up to ``min(target, size)`` words, the second up to what is left, and so on;
each budget is a threshold, and a row is taken once for each threshold above its key.  So a smaller target always
takes a part of what a larger one takes.

Thresholds are found without a sort.  Words are summed by source and first key digits; the bucket in which a budget
ends is split by the next digits, and only rows of such buckets are read again, until no bucket holds two rows.  The
row in which a budget ends is taken if that brings the sum nearer to the budget (a tie takes it).  Rows with equal keys
are copies of one row; they are told apart by their place in the written table and are interchangeable.

Targets: sources by code point, null last, have the weights 5, 2, 1, repeating; a share of all words is dealt by
weight; no target exceeds ``epochs`` times its source's words, what is above goes to the others by weight.  A null or
empty text has size 0 and is taken for nothing.  A null source is a source; a null id is an id.  Without rows there is
no target and no result.  The result depends on the rows and the seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
DIGITS = 3
"""Key digits that a round looks at: 4096 buckets for each open budget."""
FEW = 10_000
"""Sources whose thresholds, some 300 bytes each, are sent to the tasks; more are joined by shuffle."""

_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def row_key(seed: int, id_column: Column, text: Column) -> Column:
    """32 hexadecimal digits."""
    part = [F.coalesce(id_column.cast("string"), F.lit("-")), F.coalesce(F.md5(text.cast("binary")), F.lit("-"))]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *part).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` (``source``, ``source_size``: a row for each source) with ``weight`` and ``target``.

    A source is full at its limit.  Sorted by limit for each weight, the full ones come first: the first source whose
    share of what the ones before it leave is under its limit sets the level of all that follow.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", chosen).withColumn("limit", F.col("source_size") * epochs)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    budget = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    left = budget - F.coalesce(F.sum("limit").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(after))
    level = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(Window.partitionBy())
    rows = rows.withColumn("level", level["level"])
    target = F.when(F.col("level").isNull(), F.col("limit").cast("double")).otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
    return rows.withColumn("target", target).select("source", "source_size", "weight", "target")


def _by_source(rows: DataFrame, table: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """A join on source, null included; ``table`` has a bounded number of rows for each source."""
    name = F.xxhash64(F.col("source").isNull(), "source")
    table = table.withColumn("__source", name).drop("source")
    return rows.withColumn("__source", name).join(F.broadcast(table) if few else table, "__source", how).drop("__source")


def thresholds(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """For each of ``budgets`` (``source``, ``copy``, ``budget``) the ``head`` and ``taken`` that end it: rows of ``rows`` (``source``,
    ``key``, ``size``) whose key begins with less than ``head`` lie in the budget, and if ``taken`` also those that begin with it.

    A budget that no row exceeds has no threshold: all rows lie in it.
    """
    opened = budgets.withColumns({"head": F.lit(""), "under": F.lit(0).cast("long")})
    found, width, depth = None, rows.agg(F.max(F.length("key"))).first()[0] or 0, 0
    while True:
        depth += DIGITS
        inside = _by_source(rows, opened, few).where(F.substring("key", 1, depth - DIGITS) == F.col("head"))
        part = F.substring("key", 1, depth).alias("part")
        sums = inside.groupBy("source", "copy", "budget", "under", part).agg(F.sum("size").alias("words"), F.count("*").alias("many"))
        along = Window.partitionBy("source", "copy").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.col("under") + F.sum("words").over(along)).where(F.col("upto") > F.col("budget"))
        ends = sums.groupBy("source", "copy", "budget").agg(F.min(F.struct("part", "words", "many", "upto")).alias("end"))
        ends = ends.select("source", "copy", "budget", F.col("end.part").alias("head"), (F.col("end.upto") - F.col("end.words")).alias("under"), "end.words", "end.many")
        ends = settle(ends)
        near = 2 * F.col("under") + F.col("words") <= 2 * F.col("budget")
        done = ends.where("many = 1").select("source", "copy", "head", near.alias("taken"))
        found = done if found is None else found.unionByName(done)
        opened = ends.where("many > 1").select("source", "copy", "budget", "head", "under")
        if depth >= width or opened.isEmpty():
            return settle(found)


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 12, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``df`` (``doc_id``, ``text``, ``source``): the named ``columns``, ``source``, ``size`` (words), ``source_size``, ``target`` and
    ``copies``, how often the mix takes the row.

    The named columns are written once, with size and key; so leave long ones out unless they are wanted.
    """
    kept = {f"__{k}": F.col(f"`{c}`") for k, c in enumerate(columns)}
    text = F.col("text")
    rows = settle(df.select(*[c.alias(n) for n, c in kept.items()], "source", word_count(text).alias("size"), row_key(seed, F.col("doc_id"), text).alias("key")))
    place = F.lpad(F.lower(F.hex(F.xxhash64("_metadata.file_name", "_metadata.row_index"))), 16, "0")
    rows = rows.withColumn("key", F.concat("key", place))
    goals = settle(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs))
    few = goals.count() <= FEW
    left = F.col("target") - F.col("copy") * F.col("source_size")
    budgets = goals.select("source", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("copy"))
    budgets = budgets.withColumn("budget", F.least(F.greatest(left, F.lit(0.0)), F.col("source_size").cast("double")))
    ends = thresholds(rows, budgets.where("budget < source_size").select("source", "copy", "budget"), few)
    ends = budgets.join(ends.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")) & (budgets["copy"] == ends["copy"]), "left")
    ends = ends.groupBy("source", "source_size", "target").agg(F.collect_list(F.struct("head", "taken", "budget")).alias("ends"))
    begins = lambda e: F.substring(F.col("key"), F.lit(1), F.length(e["head"]))
    lies = lambda e: F.when(e["head"].isNull(), F.lit(1)).when(begins(e) < e["head"], 1).when(begins(e) == e["head"], e["taken"].cast("int")).otherwise(0)
    copies = F.aggregate("ends", F.lit(0), lambda total, e: total + lies(e))
    dealt = _by_source(rows, ends, few, "left").withColumn("copies", copies)
    return dealt.select(*[F.col(n).alias(c) for n, c in zip(kept, columns, strict=True)], "source", "size", "source_size", "target", "copies")


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as often as the mix takes it."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies")


def sql(seed: int = 12) -> str:
    """The query's rows by a sort: words summed in key order instead of histograms."""
    return f"""
    WITH rows AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
            md5(concat_ws(':', '{seed}', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(md5(text), '-'))) AS key
        FROM documents
    ), sizes AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
    ), weighed AS (
        SELECT *, 2 * source_size AS most, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes
    ), levels AS (
        SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
                   - coalesce(CAST(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0))
                  / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
        FROM weighed
    ), chosen AS (
        SELECT arg_min(level, most / weight) AS level FROM levels WHERE level * weight < most
    ), goals AS (
        SELECT w.source, source_size, CASE WHEN c.level IS NULL THEN CAST(most AS DOUBLE) ELSE least(CAST(most AS DOUBLE), c.level * weight) END AS target
        FROM weighed w CROSS JOIN chosen c
    ), sums AS (
        SELECT doc_id, size, source_size, target,
            sum(size) OVER (PARTITION BY rows.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
        FROM rows JOIN goals ON rows.source IS NOT DISTINCT FROM goals.source
    )
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * (
        CASE WHEN target >= source_size OR 2 * upto - size <= 2 * target THEN 1 ELSE 0 END
        + CASE WHEN target >= 2 * source_size OR 2 * upto - size <= 2 * (target - source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
    FROM sums
    """
