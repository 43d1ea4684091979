import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pacelane.llm import mixing
from pacelane.llm.queries import op12


def filled(sizes, weights, budget, epochs=2):
    """Deal by weight, stop at the limit, deal the rest again."""
    target, free = {}, dict(weights)
    while free:
        left = budget - sum(target.values())
        over = [s for s in free if left * free[s] / sum(free.values()) > epochs * sizes[s]]
        if not over:
            return target | {s: left * w / sum(free.values()) for s, w in free.items()}
        for s in over:
            target[s] = float(epochs * sizes[s])
            del free[s]
    return target


def test_targets_equal_resharing(spark):
    rng = random.Random(1)
    for turn in range(6):
        sizes = {f"s{k}": rng.choice([0, 1, 7, 50, 400, 10_000]) for k in range(rng.randint(1, 9))} | ({None: 30} if turn % 2 else {})
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
        rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        found = {r.source: (r.weight, r.target) for r in mixing.targets(rows).collect()}
        wanted = filled(sizes, weights, 1.5 * sum(sizes.values()))
        assert {s: w for s, (w, _) in found.items()} == weights
        for s in sizes:
            assert found[s][1] == pytest.approx(wanted[s], rel=1e-9, abs=1e-9)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 0, "x", 1.5) for i, t, s in rows], "doc_id long, text string, source string, lang string, n_chars long, copies string, target double")


def by_sort(spark, frame, seed=12):
    """Words summed in key order, row by row."""
    rows = frame.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.row_key(seed, F.col("doc_id"), F.col("text")).alias("key")).collect()
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.key):
        groups[r.source].append((r.doc_id, r.size))
    sizes = {s: sum(n for _, n in g) for s, g in groups.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = filled(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    out = []
    for s, group in groups.items():
        upto = 0
        for doc_id, n in group:
            upto += n
            taken = sum(1 for copy in range(2) if target[s] - copy * sizes[s] >= sizes[s] or 2 * upto - n <= 2 * max(target[s] - copy * sizes[s], 0))
            out.append((doc_id, s, n, taken if n else None))
    return sorted(out, key=str)


def test_thresholds_equal_a_sort(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, "w " * rng.choice([0, 1, 3, 20, 500]), rng.choice(["hot"] * 6 + ["b", "c", "d", None])) for k in range(700)]
    rows += [(3, "same text", "hot")] * 300 + [(None, None, "b"), (None, "a b", "c"), (900, "", "zero")]
    frame = frame_of(spark, rows)
    for digits, few in ((3, 10_000), (1, 0)):
        monkeypatch.setattr(mixing, "DIGITS", digits)
        monkeypatch.setattr(mixing, "FEW", few)
        found = mixing.mix(frame)
        got = sorted(((r.doc_id, r.source, r["size"], r.copies if r["size"] else None) for r in found.collect()), key=str)
        assert got == by_sort(spark, frame)


def test_targets_are_met_and_nested(spark):
    rng = random.Random(5)
    frame = frame_of(spark, [(k, "w " * rng.randint(1, 40), f"s{k % 5}") for k in range(2000)])
    small, large = (mixing.mix(frame, share=s).where("copies > 0") for s in (0.4, 0.8))
    assert small.join(large, "doc_id", "left_anti").count() == 0
    for r in large.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 40
    first, again = (sorted(map(tuple, mixing.mix(f).collect())) for f in (frame, frame.repartition(7)))
    assert first == again and first != sorted(map(tuple, mixing.mix(frame, seed=1).collect()))


def test_repeated_rows_and_columns(spark):
    frame = frame_of(spark, [(1, "a b c", "x"), (2, "d e", "y"), (3, None, None)])
    found = mixing.mix(frame, columns=("doc_id", "text", "n_chars"))
    assert found.columns == ["doc_id", "text", "n_chars", "source", "size", "source_size", "target", "copies"]
    assert mixing.repeated(found).count() == sum(r.copies for r in found.collect())


def test_empty_tables(spark):
    class Fixture:
        documents = frame_of(spark, [])

    assert op12(Fixture).count() == 0
    Fixture.documents = frame_of(spark, [(1, None, "a"), (2, "", None)])
    assert sorted(tuple(r) for r in op12(Fixture).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
