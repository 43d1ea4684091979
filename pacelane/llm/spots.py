"""SpotSigs fingerprints.  DataFrame functions only.

A text is read as lower-case words (runs of letters and digits).  Every common word, an anchor, starts a chain: the
anchor and the next ``CHAIN`` content words after it, where up to ``SKIP`` further anchors before each content word are
passed over.  The start of the text counts as an anchor, and the end as content words, so a text with any word
has a chain.  The fingerprint is the set of the chains' hashes.  Likeness of two fingerprints is their Jaccard
similarity; sizes bound it, so documents are partitioned by set size and compared only within and with the next partition.

Null and empty texts have an empty fingerprint.  A text without words has one chain made of the text itself.
Two empty fingerprints have likeness 1, an empty one and another 0.  Equal texts have equal fingerprints.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle
from pacelane.llm.stars import bucket_links, grouped, shared_buckets

# The common words that start chains, by language.
ANCHORS = (
    "a an and are as at be by for from in is it not of on or that the this to was with",
    "als am auf aus bei das dem den der des die ein eine es für im ist mit nicht sich sie und von zu",
    "au aux avec ce dans de des du en est et il la le les pas pour par que qui se sur un une",
    "al como con de del el en es la las lo los no para por que se su un una y",
)
CHAIN = 2
SKIP = 8
CHUNK = 1024
MOST_CHUNKS = 100_000

_ANY = "|".join([*sorted(set(" ".join(ANCHORS).split()), key=lambda w: (-len(w), w)), "\\^"])
_NEXT = f"(?: (?:{_ANY})(?= )){{0,{SKIP}}} (?!(?:{_ANY}) )[^ ]+"
_CHAIN = f"(?<= )(?=((?:{_ANY}){_NEXT * CHAIN} ))"
_INNER = f" (?:{_ANY})(?= )"


def signatures(text: Column) -> Column:
    """Sorted distinct 64-bit chain hashes of a text."""
    words = F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "))
    line = F.concat(F.lit(" ^ "), words, F.lit(" $" * CHAIN + " "))
    chains = F.regexp_extract_all(line, F.lit(_CHAIN), F.lit(1))
    hashed = F.transform(chains, lambda c: F.xxhash64(F.regexp_replace(c, _INNER, "")))
    alone = F.when(F.length(text) > 0, F.array(F.xxhash64(text))).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return F.when(F.length(words) > 0, F.array_sort(F.array_distinct(hashed))).otherwise(alone)


def shown(signatures: Column) -> Column:
    """A fingerprint as text: upper 40 bits of each hash in hexadecimal, sorted."""
    return F.array_join(F.transform(signatures, lambda h: F.hex(F.shiftrightunsigned(h, 24))), " ")


def likeness(one: Column, other: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(one, other))
    union = F.size(one) + F.size(other) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def partition_of(size: Column, threshold: float) -> Column:
    """Set sizes whose ratio is at least ``threshold`` lie in the same or in neighbouring partitions."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9))


def alike_groups(df: DataFrame, threshold: float = 0.8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: its id and ``component``, the smallest id of the group that likeness of ``threshold`` or more ties it to.

    Equal fingerprints are one node.  Of two sets as alike as asked, the first ``n - ceil(threshold * n) + 1`` hashes of
    each share one, and their sizes put them in the same or in neighbouring partitions; hash and partition are the bucket
    in which nodes are compared (``stars``).  Rows with an empty fingerprint are alone.
    """
    rows = settle(plain(df, id_column, text_column).select(F.col(f"`{id_column}`").alias("id"), signatures(F.coalesce(F.col(f"`{text_column}`"), F.lit(""))).alias("spots")))
    some = rows.where(F.size("spots") > 0).withColumn("node", F.sha2(F.array_join(F.transform("spots", lambda h: h.cast("string")), ","), 256))
    nodes = settle(some.groupBy("node").agg(F.min("id").alias("rep"), F.first("spots").alias("spots")))
    size = F.size("spots")
    head = F.slice("spots", F.lit(1), (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    part = partition_of(size, threshold)
    spread = nodes.select("node", "rep", F.explode(F.array(part, part + 1)).alias("part"), head.alias("head"))
    spread = spread.select("node", "rep", "part", F.explode("head").alias("spot")).select("node", "rep", F.xxhash64("spot", "part").alias("bucket"))
    sides = [nodes.select(F.col("node").alias(k), F.col("spots").alias(f"spots_{k}")) for k in "ab"]

    def compare(pairs: DataFrame) -> DataFrame:
        near, far = F.least(F.size("spots_a"), F.size("spots_b")), F.greatest(F.size("spots_a"), F.size("spots_b"))
        joined = pairs.join(sides[0], "a").join(sides[1], "b")
        # sizes far apart bound the likeness below what any later step asks for
        value = F.when(near / far < 2 * threshold - 1, F.lit(0.0)).otherwise(likeness(F.col("spots_a"), F.col("spots_b")))
        return joined.select("a", "b", value.alias("jaccard"))

    named = grouped(nodes, bucket_links(shared_buckets(spread), compare, threshold))
    found = some.select("id", "node").join(named, "node").select("id", "component")
    bare = rows.where(F.size("spots") == 0).select("id", F.col("id").alias("component"))
    return found.unionByName(bare).withColumnRenamed("id", id_column)


def id_ranges(rows: DataFrame, count: int, low: int, high: int, per: int) -> tuple[DataFrame, list[tuple[int, int, int, int]]]:
    """``rows`` with ``__chunk``, the number of an id range of at most ``2 * per`` rows (or of one id); number, least and greatest id and rows of each.

    A range that holds more is cut again, into even parts of its own span, so a few far ids cost a pass over the ids and not a full range.
    """
    rows, found = rows.withColumn("__chunk", F.lit(low).cast("long")), [(low, low, high, count)]
    while full := [(chunk, least, min(1 << 62, max(1, (top - least + 1) * per // n))) for chunk, least, top, n in found if n > 2 * per and top > least]:
        cut = lambda least, width: F.greatest(least, F.try_subtract("doc_id", F.pmod("doc_id", width)))
        if len(found) == 1:
            rows = rows.withColumn("__chunk", cut(*[F.lit(x).cast("long") for x in full[0][1:]]))
        else:
            again = F.broadcast(rows.sparkSession.createDataFrame(full, "__chunk long, __least long, __width long"))
            part = F.when(F.col("__width").isNull(), F.col("__chunk")).otherwise(cut(F.col("__least"), F.col("__width")))
            rows = rows.join(again, "__chunk", "left").withColumn("__chunk", part).drop("__least", "__width")
        ranges = rows.groupBy("__chunk").agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1)))
        found = sorted(map(tuple, ranges.collect()))  # one row per range
    return rows, found


def beside_next(df: DataFrame, columns: dict[str, Column], out: dict[str, str]) -> DataFrame:
    """``doc_id``, ``text``, ``columns`` and, of the next document by falling id, the columns named in ``out`` (old: new name).

    After the last document comes the first.  The ids are cut into ranges of about ``CHUNK`` rows, however unevenly they lie (of more
    rows if there would be more than ``MOST_CHUNKS`` ranges); each range is ordered in one task and gets a copy of
    the next range's first row.  Rows that share an id follow each other by a hash of their text.  A row with a null id is
    no one's next and has none (nulls).
    """
    rows = plain(df, "doc_id", "text")
    kinds = rows.withColumns(columns).schema
    bare = rows.where("doc_id IS NULL").withColumns(columns).withColumns({new: F.lit(None).cast(kinds[old].dataType) for old, new in out.items()})
    count, low, high = rows.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if not count:
        return bare
    per = max(CHUNK, -(-count // MOST_CHUNKS))
    rows, found = id_ranges(rows.where("doc_id IS NOT NULL"), count, low, high, per)
    tops = [(chunk, top) for chunk, _, top, _ in found]
    asked = [(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)]
    copies = F.broadcast(df.sparkSession.createDataFrame(asked, "__top long, __to long"))
    places = F.array_compact(F.array(F.struct(F.col("__chunk").alias("chunk"), F.lit(False).alias("copy")), F.when(F.col("__to").isNotNull(), F.struct(F.col("__to").alias("chunk"), F.lit(True).alias("copy")))))
    dealt = rows.join(copies, F.col("doc_id") == F.col("__top"), "left").select("doc_id", "text", F.explode(places).alias("__place"))
    dealt = dealt.select("doc_id", "text", F.col("__place.chunk").alias("__chunk"), F.col("__place.copy").alias("__copy"))
    along = Window.partitionBy("__chunk").orderBy("__copy", F.desc("doc_id"), F.xxhash64("text"), "text")
    full = dealt.repartition("__chunk").withColumns(columns).withColumns({new: F.lead(old).over(along) for old, new in out.items()})
    return full.where("NOT __copy").drop("__chunk", "__copy").unionByName(bare)


def with_edits(df: DataFrame) -> DataFrame:
    """Per document: ``text``, ``spots``, ``next_spots``, ``edited`` (its last third replaced by the next document's beginning) and ``edited_spots``."""
    whole = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = beside_next(whole, {"spots": signatures(F.col("text"))}, {"text": "next_text", "spots": "next_spots"})
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    rows = rows.withColumn("edited", edited).drop("next_text")
    return rows.withColumn("edited_spots", signatures(F.col("edited")))
