"""MinHash near-duplicate groups.

Words are runs without white space, ``A-Z`` in lower case; a document is the set of its distinct
shingles.  Documents with equal sets are one node from the start.  Universal hash minima of each
set are cut into bands; nodes that agree on a band share a bucket.  Candidates are checked on their
signatures, then on the full sets.  Links become groups by alternating large-star and small-star.

No bucket is compared pair by pair (``stars``).  Band and row counts put the odds of missing a link at the threshold
under one in ten million.

Null, empty and wordless texts have an empty set and are linked with nothing.  A text with fewer words than a
shingle is one shingle.  Repeated rows and equal texts are in one group.  Rows with a null id are grouped
like others; a group's id is its smallest id that is not null (null if there is none).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacelane.llm.frames import plain, settle, ship_package
from pacelane.llm.stars import bucket_links, grouped, shared_buckets
from pacelane.llm.words import U64, find_words, shingle_set, slices

BANDS = 32
SHARP = 96
"""Longer bands for nodes that share a large bucket without being alike; they miss a link at the threshold once in 50,000."""
LENIENT = 0.2
"""A signature may show this much less likeness than asked for before a pair is dropped unseen (over 5 deviations)."""


def band_rows(threshold: int) -> int:
    """Minima in a band: the most that miss a link of ``threshold`` per cent less than once in 1e7."""
    rows = 1
    while (1 - (threshold / 100) ** (rows + 1)) ** BANDS <= 1e-7:
        rows += 1
    return rows


class Minima:
    """``count`` universal hash functions ``(a * x + b) mod 2**64 >> 32`` and their minima over a set."""

    def __init__(self, count: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 1 << 63, count, dtype=np.int64).astype(U64) * U64(2) + U64(1))[:, None]
        self.b = rng.integers(0, 1 << 63, count, dtype=np.int64).astype(U64)[:, None]

    def of(self, codes: np.ndarray) -> np.ndarray:
        least = np.full(len(self.a), np.iinfo(np.uint64).max, U64)
        for at in range(0, len(codes), 4096):
            np.minimum(least, (self.a * codes[None, at : at + 4096] + self.b).min(axis=1), out=least)
        return (least >> U64(32)).astype(np.uint32).view(np.int32)


def signatures(df: DataFrame, width: int, count: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``n_shingles``, ``node`` (digest of the set; null if empty), ``signature`` and ``text_hash`` of every document."""
    ship_package(df.sparkSession)
    source = plain(df, id_column, text_column).withColumn("__hash", F.xxhash64(F.col(f"`{text_column}`")))
    kind = source.schema[id_column].dataType.simpleString()

    def sign(batches):
        minima = Minima(count)
        for batch in batches:
            sizes, nodes, signs = [], [], []
            for _, _, data, offsets in slices(batch.column(1)):
                words = find_words(data, offsets)
                for k in range(len(offsets) - 1):
                    codes = shingle_set(words.code[words.first[k] : words.first[k + 1]], width)
                    sizes.append(len(codes))
                    nodes.append(hashlib.blake2b(codes.tobytes(), digest_size=16).digest() if len(codes) else None)
                    signs.append(minima.of(codes) if len(codes) else None)
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signs, pa.list_(pa.int32())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_shingles", "node", "signature", "text_hash"])

    return source.mapInArrow(sign, f"id {kind}, n_shingles long, node binary, signature array<int>, text_hash long")


def _compare(pairs: DataFrame, sets: DataFrame, width: int, threshold: int) -> DataFrame:
    """``a``, ``b``, ``jaccard`` of pairs of nodes; 0 where the signatures are too far apart."""
    sides = [sets.select(F.col("node").alias(s), F.col("signature").alias(f"sign_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab"]
    rows = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sign_a", "sign_b", "text_a", "text_b")
    floor = threshold / 100 - LENIENT - 2 * (1 - threshold / 100)

    def measure(batches):
        for batch in batches:
            sign = [np.stack([np.asarray(s) for s in batch.column(k).to_numpy(zero_copy_only=False)]) if len(batch) else np.zeros((0, 1)) for k in (2, 3)]
            hopeful = (sign[0] == sign[1]).mean(axis=1) >= floor if len(batch) else np.zeros(0, bool)
            found = np.zeros(len(batch))
            for at in range(0, len(batch), 256):
                near = np.flatnonzero(hopeful[at : at + 256]) + at
                if not len(near):
                    continue
                sides = []
                for k in (4, 5):
                    column = batch.column(k).take(pa.array(near))
                    sets = []
                    for _, _, data, offsets in slices(column):
                        words = find_words(data, offsets)
                        sets += [shingle_set(words.code[words.first[i] : words.first[i + 1]], width) for i in range(len(offsets) - 1)]
                    sides.append(sets)
                for k, one, other in zip(near, *sides, strict=True):
                    both = len(np.intersect1d(one, other, assume_unique=True))
                    union = len(one) + len(other) - both
                    # a share just under the threshold must not round up to it
                    found[k] = max(both / union, threshold / 100) if 100 * both >= threshold * union else min(both / union, threshold / 100 - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], ["a", "b", "jaccard"])

    return rows.mapInArrow(measure, "a binary, b binary, jaccard double")


def node_links(nodes: DataFrame, texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """Verified links ``a``, ``b`` that connect just what all links connect.

    ``nodes``: ``node``, ``rep`` (smallest id), ``text_hash`` (of a text of that id), ``signature``; ``texts``: ``id``, ``text`` of the documents.
    """
    rows = band_rows(threshold)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("signature", i * rows + 1, rows)))
    level = shared_buckets(nodes.select("node", "rep", F.explode(bands).alias("bucket")))
    members = level.select(F.col("rep").alias("key_rep"), F.col("node").alias("key_node")).distinct()
    keys = settle(members.join(nodes.select(F.col("node").alias("key_node"), "signature", "text_hash"), "key_node"))
    sets = settle(_texts_of(keys, texts, width))
    if sets.count() > keys.count():  # rows that agree in id and text
        sets = settle(sets.dropDuplicates(["node"]))
    picks = np.random.default_rng(23)
    picked = F.array(*[F.array(*[F.lit(int(k) + 1) for k in picks.choice(BANDS * rows, 2 * rows, replace=False)]) for _ in range(SHARP)])

    def sharper(some: DataFrame) -> DataFrame:
        """Bands of twice the length, drawn from all minima."""
        band = F.transform(picked, lambda p, i: F.xxhash64(F.lit(-1), i, F.transform(p, lambda k: F.element_at("signature", k))))
        return some.join(sets.select("node", "signature").distinct(), "node").select("node", "rep", F.explode(band).alias("bucket"))

    return bucket_links(
        level,
        lambda pairs: _compare(pairs, sets, width, threshold),
        threshold / 100,
        sharper,
        lambda cells: _meet(cells, sets, width, threshold),
        lambda some: _sharing(some, sets, width, threshold),
    )


def _sharing(some: DataFrame, sets: DataFrame, width: int, threshold: int) -> DataFrame:
    """Those of ``some`` nodes that share enough shingles with the others of them, taken together, to be linked to any; asked twice,
    since without the nodes that go the others share less."""

    def spell(batches):
        for batch in batches:
            at = 0
            for _, _, data, offsets in slices(batch.column(1)):
                words = find_words(data, offsets)
                for k in range(len(offsets) - 1):
                    codes = shingle_set(words.code[words.first[k] : words.first[k + 1]], width)
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[at], len(codes)), pa.array(codes.view(np.int64))], ["node", "code"])
                    at += 1

    rows = settle(sets.select("node", "text").join(some, "node", "left_semi").mapInArrow(spell, "node binary, code long"))
    size = rows.groupBy("node").agg(F.count("*").alias("size"))
    for _ in range(2):
        often = rows.groupBy("code").agg(F.count("*").alias("many")).where("many > 1").select("code")
        shared = rows.join(often, "code").groupBy("node").agg(F.count("*").alias("shared")).join(size, "node")
        rows = settle(rows.join(shared.where(100 * F.col("shared") >= threshold * F.col("size")).select("node"), "node", "left_semi"))
    return rows.select("node").distinct()


def _meet(cells: DataFrame, sets: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links that connect what links between the two sides of a cell, or inside a cell of one side, connect; by products of
    shingle incidence matrices.  At most one for each node of the cell."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        sets = []
        for _, _, data, offsets in slices(table.column("text").chunk(0)):
            words = find_words(data, offsets)
            sets += [shingle_set(words.code[words.first[k] : words.first[k + 1]], width) for k in range(len(offsets) - 1)]
        size = np.array([len(s) for s in sets])
        _, shingle, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(sets)), size)
        common = often > 1
        column = np.cumsum(common) - 1
        use = common[shingle]
        owner, column = owner[use], column[shingle[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        one = np.flatnonzero(side == 0)
        other = np.flatnonzero(side == 1) if (side == 1).any() else one
        both = np.zeros((len(one), len(other)), np.float32)
        for first in range(0, int(common.sum()), 4096):
            part = slice(*np.searchsorted(column, [first, first + 4096]))
            matrix = np.zeros((len(sets), 4096), np.float32)
            matrix[owner[part], column[part] - first] = 1
            both += matrix[one] @ matrix[other].T
        shared = both.astype(np.int64)
        near = 100 * shared >= threshold * (size[one][:, None] + size[other][None, :] - shared)
        # one link from each node to the first one that links lead to, instead of all links
        far, first = len(sets), np.arange(len(sets))
        while True:
            before = first.copy()
            first[one] = np.minimum(first[one], np.where(near, first[other][None, :], far).min(axis=1, initial=far))
            first[other] = np.minimum(first[other], np.where(near, first[one][:, None], far).min(axis=0, initial=far))
            first = np.minimum(first, first[first])
            if (first == before).all():
                break
        tied = np.flatnonzero(first != np.arange(len(sets)))
        node = table.column("node")
        return pa.table({"a": node.take(pa.array(tied)), "b": node.take(pa.array(first[tied]))})

    rows = cells.join(sets.select("node", "text"), "node").select("cell", "side", "node", "text")
    return rows.groupBy("cell").applyInArrow(links, "a binary, b binary")


def _texts_of(keys: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``node``, ``signature``, ``text`` of the wanted nodes; an id with several texts, or a null id, gives the one of the node."""
    hashed = texts.withColumn("hash", F.xxhash64("text"))
    rows = hashed.join(keys, (F.col("hash") == F.col("text_hash")) & F.col("id").eqNullSafe(F.col("key_rep"))).select(F.col("key_node").alias("node"), "signature", "text")

    def same(batches):
        for batch in batches:
            keep = []
            nodes = batch.column(0).to_pylist()
            at = 0
            for _, _, data, offsets in slices(batch.column(2)):
                words = find_words(data, offsets)
                for k in range(len(offsets) - 1):
                    codes = shingle_set(words.code[words.first[k] : words.first[k + 1]], width)
                    keep.append(len(codes) > 0 and hashlib.blake2b(codes.tobytes(), digest_size=16).digest() == nodes[at])
                    at += 1
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(same, rows.schema)


def near_groups(df: DataFrame, width: int = 5, threshold: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row of ``df``: ``id``, ``n_shingles``, ``node`` and ``component`` (smallest id of its group)."""
    signed = settle(signatures(df, width, BANDS * band_rows(threshold), id_column, text_column))
    first = F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("least")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(first, F.first("signature").alias("signature"))
    nodes = settle(nodes.select("node", F.col("least.id").alias("rep"), F.col("least.text_hash").alias("text_hash"), "signature"))
    texts = plain(df, id_column, text_column).toDF("id", "text")
    named = grouped(nodes, node_links(nodes, texts, width, threshold))
    known = signed.where("node IS NOT NULL").select("id", "n_shingles", "node").join(named, "node")
    bare = signed.where("node IS NULL").select("id", "n_shingles", "node", F.col("id").alias("component"))
    return known.select("id", "n_shingles", "node", "component").unionByName(bare)


def drop_near_copies(df: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """Rows of ``df`` without near copies: of each group the document with the smallest id stays; repeated rows once.

    Rows that share an id go together.  A row with a null id has no place in the order of ids and stays.
    """
    found = near_groups(df, width, threshold)
    gone = found.where("id IS NOT NULL AND id <> component").select(F.col("id").alias("doc_id")).distinct()
    kept = df.where("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])
    return kept.select(*df.columns).unionByName(df.where("doc_id IS NULL"))
