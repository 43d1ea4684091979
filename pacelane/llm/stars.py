"""Links inside buckets without comparing a bucket pair by pair in rows.

Every member of a bucket is compared with the bucket's lead, the node of the smallest id.  Members that are not
linked to it form what is left of the bucket: of up to ``SMALL`` members it is compared pair by pair.  Larger ones are
bucketed anew by sharper keys, if there are any.  Nodes of buckets that are still large are first thinned out: a node too much
of which no other one shares has no link.  The others form clusters, nodes tied by common buckets, so that two nodes meet
once however many buckets they share.  A cluster is cut into blocks of about ``BLOCK`` nodes, and two blocks meet in one
task, which returns a few links that connect what all links of the two blocks connect.

What is still open are links between a member linked to a lead and one that is not.  The Jaccard distance obeys the
triangle inequality, so with distances ``p`` and ``q`` to the lead these two can only be linked if ``|p - q|`` is at most the
allowed distance; just such members of different groups are compared, in pairs if they are few and else in blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacelane.llm.components import components
from pacelane.llm.frames import settle

SMALL = 32
BLOCK = 512

Compare = Callable[[DataFrame], DataFrame]
"""From pairs ``a``, ``b`` to ``a``, ``b``, ``jaccard``."""
Meet = Callable[[DataFrame], DataFrame]
"""From nodes (``cell``, ``side``, ``node``) to the links ``a``, ``b`` between sides 0 and 1 of a cell, or inside side 0 if there is no side 1."""
Possible = Callable[[DataFrame], DataFrame]
"""From nodes (``node``) to those of them that may be linked to another one of them."""


def _order() -> Column:
    """Nodes by smallest id, null ids last, then by the node itself."""
    return F.struct(F.col("rep").isNull().alias("none"), "rep", "node")


def shared_buckets(spread: DataFrame) -> DataFrame:
    """``node``, ``rep``, ``bucket``, ``size``, ``lead`` of the buckets with several nodes, written to the shared folder."""
    leads = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min(_order()).alias("lead")).where("size > 1")
    return settle(spread.join(leads.select("bucket", "size", F.col("lead.node").alias("lead")), "bucket"))


def _pairs(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Each pair of nodes once, whichever way round."""
    return rows.select(F.least(one, other).alias("a"), F.greatest(one, other).alias("b")).where("a <> b").distinct()


def _inside(few: DataFrame) -> DataFrame:
    """All pairs of the small buckets ``few`` (``node``, ``bucket``)."""
    few = few.select("node", "bucket")
    return _pairs(few.join(few.withColumnRenamed("node", "lead"), "bucket").where("node < lead"), "node", "lead")


def _blocks(size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(size / BLOCK)).cast("int")


def _clusters(large: DataFrame, possible: Possible | None) -> DataFrame:
    """``node``, ``bucket``, ``size``: the nodes of large buckets (``node``, ``lead``) that may have links, each in one cluster instead of many buckets."""
    tied = components(large.select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("component", "bucket")
    nodes = settle(large.select("node").distinct())
    kept = settle((nodes if possible is None else possible(nodes)).join(tied, "node").select("node", "bucket"))
    sizes = kept.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return kept.join(sizes, "bucket")


def _cells_inside(rows: DataFrame) -> DataFrame:
    """Cells in which any two nodes of a cluster (``node``, ``bucket``, ``size``) meet."""
    blocks = _blocks(F.col("size"))
    rows = rows.select("node", "bucket", blocks.alias("n"), F.pmod(F.xxhash64("node", "bucket"), blocks).cast("int").alias("own"))
    rows = rows.select("node", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    # two different blocks of one cell are its sides; a block meets itself as the only side
    cell = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other"))
    return rows.select(cell.alias("cell"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node")


def _cells_between(outside: DataFrame, inside: DataFrame, sizes: DataFrame) -> DataFrame:
    """Cells in which nodes outside (``lead``, ``a``) meet nodes inside (``lead``, ``b``); ``sizes``: ``lead``, ``n_out``, ``n_in``."""
    both = []
    for side, (rows, node, mine, theirs) in enumerate([(outside, "a", "n_out", "n_in"), (inside, "b", "n_in", "n_out")]):
        rows = rows.join(sizes, "lead").select("lead", F.col(node).alias("node"), _blocks(F.col(mine)).alias("own"), _blocks(F.col(theirs)).alias("n"))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node", "lead"), F.col("own"))).select("lead", "node", "own", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
        places = ("own", "other") if side == 0 else ("other", "own")
        both.append(rows.select(F.xxhash64("lead", *[F.col(c).cast("long") for c in places]).alias("cell"), F.lit(side).alias("side"), "node"))
    return both[0].unionByName(both[1])


def bucket_links(spread: DataFrame, compare: Compare, near: float, sharper: Callable[[DataFrame], DataFrame] | None = None, meet: Meet | None = None, possible: Possible | None = None) -> DataFrame:
    """Links ``a``, ``b`` that connect just what all pairs of a bucket with a similarity of ``near`` connect.

    ``spread``: the buckets (``shared_buckets``); ``sharper`` gives, for some nodes (``node``, ``rep``), other buckets
    (``node``, ``rep``, ``bucket``) in which any two nodes as near as asked meet as well; without ``meet`` all is done in pairs.
    """
    linked = F.col("jaccard") >= near
    stars = spread.where("node <> lead").select("node", "rep", "bucket", "lead")
    measured = settle(compare(_pairs(stars, "node", "lead")))
    links = measured.where(linked).select("a", "b")
    judged = stars.withColumns({"a": F.least("node", "lead"), "b": F.greatest("node", "lead")}).join(measured, ["a", "b"]).drop("a", "b")
    judged = settle(judged.select("bucket", "lead", "node", "rep", "jaccard"))
    failed = judged.where(~linked).select("node", "rep", "bucket")
    rest = settle(failed.join(failed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"), "bucket"))
    few = rest if meet is None else rest.where(F.col("size") <= SMALL)
    links = links.unionByName(settle(compare(_inside(few)).where(linked).select("a", "b")))
    large = rest.where(F.col("size") > SMALL)
    if meet is not None and not large.isEmpty():
        if sharper is not None:
            large = shared_buckets(sharper(large.select("node", "rep").distinct()))
            links = links.unionByName(settle(compare(_inside(large.where(F.col("size") <= SMALL))).where(linked).select("a", "b")))
            large = large.where(F.col("size") > SMALL)
        links = links.unionByName(settle(meet(_cells_inside(_clusters(large, possible))).distinct()))
    return _across(links, judged.select("lead", "node", "jaccard").distinct(), compare, near, meet)


def _across(links: DataFrame, judged: DataFrame, compare: Compare, near: float, meet: Meet | None) -> DataFrame:
    """All links and those between members that are linked to a lead and members that are not."""
    linked = F.col("jaccard") >= near
    group = components(links).withColumnRenamed("component", "of")
    home = group.select(F.col("node").alias("lead"), F.col("of").alias("home"))
    named = judged.where(F.col("jaccard") >= 2 * near - 1 - 1e-9).join(group, "node", "left").join(home, "lead", "left")
    named = named.select("lead", "node", "jaccard", F.coalesce("of", "node").alias("of"), F.coalesce("home", "lead").alias("home"))
    outside = settle(named.where(~linked & (F.col("of") != F.col("home"))).select("lead", F.col("node").alias("a"), F.col("jaccard").alias("p")))
    reach = outside.groupBy("lead").agg(F.count("*").alias("n_out"), F.max("p").alias("most"))
    inside = named.where(linked).join(reach, "lead").where(F.col("jaccard") - F.col("most") <= 1 - near + 1e-9)
    inside = settle(inside.select("lead", F.col("node").alias("b"), F.col("jaccard").alias("q")))
    sizes = reach.drop("most").join(inside.groupBy("lead").agg(F.count("*").alias("n_in")), "lead")
    few = sizes if meet is None else sizes.where(F.col("n_out") * F.col("n_in") <= SMALL * SMALL)
    pairs = outside.join(few.select("lead"), "lead").join(inside, "lead").where(F.col("q") - F.col("p") <= 1 - near + 1e-9)
    if meet is not None:
        many = sizes.where(F.col("n_out") * F.col("n_in") > SMALL * SMALL)
        links = links.unionByName(settle(meet(_cells_between(outside, inside, many)).distinct()))
    return links.unionByName(settle(compare(_pairs(pairs, "a", "b")).where(linked).select("a", "b")))


def grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest ``rep`` of its group, of all ``nodes`` (``node``, ``rep``)."""
    named = nodes.select("node", "rep").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    return named.join(least, "component").select("node", F.col("least").alias("component"))
