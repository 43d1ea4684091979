from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pacelane.llm import shards
from pacelane.llm.queries import op5
from pacelane.llm.shards import fisher_yates, numbered_copies, shuffled, write_shards


def rows_of(frame):
    return [(r.doc_id, r.text, r.shard, r.slot) for r in frame.collect()]


def test_counts_slots_and_columns(spark, docs):
    rows = [(k, "same text" if k % 3 else f"text {k}") for k in range(500)] + [(None, None), (None, None), (7, "again"), (7, "again"), (8, ""), (9, "long " * 50_000)]
    frame = docs(rows).withColumn("slot", F.lit("old")).withColumn("shard", F.lit("old"))
    found = shuffled(frame, 24, seed=5, bucket_bytes=4000)
    assert set(found.columns) == set(frame.columns)
    got = rows_of(found)
    assert Counter((i, t) for i, t, _, _ in got) == Counter(rows)
    sizes = Counter(s for _, _, s, _ in got)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in sizes:
        assert sorted(p for _, _, s, p in got if s == shard) == list(range(sizes[shard]))


def test_result_depends_on_rows_and_seed_only(spark, docs):
    frame = docs([(k, f"text {k}") for k in range(200)])
    first = sorted(rows_of(shuffled(frame, 5, seed=1, bucket_bytes=900)))
    assert first == sorted(rows_of(shuffled(frame.repartition(7), 5, seed=1, bucket_bytes=900)))
    assert first != sorted(rows_of(shuffled(frame, 5, seed=2, bucket_bytes=900)))


def test_order_is_random(spark, docs):
    got = sorted((p, s, i) for i, _, s, p in rows_of(shuffled(docs([(k, "") for k in range(2000)]), 1, seed=3, bucket_bytes=2000)))
    ids = np.array([i for _, _, i in got])
    assert abs(np.corrcoef(np.arange(2000), ids)[0, 1]) < 0.1


def test_fisher_yates_reaches_every_order():
    rng = np.random.default_rng(1)
    seen = Counter(tuple(fisher_yates(3, rng)) for _ in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert list(fisher_yates(0, rng)) == [] and list(fisher_yates(1, rng)) == [0]


def test_written_shards(spark, docs, tmp_path):
    write_shards(docs([(k, f"t{k}") for k in range(30)]), str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.shard, r["count"]) for r in back.groupBy("shard").count().collect()} == {(0, 10), (1, 10), (2, 10)}


def test_empty_table_and_query(spark, docs):
    assert shuffled(docs([]), 3).count() == 0

    class Fixture:
        documents = docs([(1, "é"), (2, None)])

    rows = {r.doc_id: r for r in op5(Fixture).collect()}
    assert rows[1]["size"] == 10 and rows[2]["size"] == 8 and rows[2].text_crc32 == 0 and rows[1].law == "rows"


def test_many_equal_rows_are_dealt_over_the_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(shards, "GROUP_BITS", 4)
    rows = [(1, "again and again")] * 700 + [(k, f"text {k}") for k in range(300)] + [(None, None)] * 200
    counts = []
    for frame in (docs(rows), docs(rows).repartition(7)):
        got = rows_of(shuffled(frame, 3, seed=2, bucket_bytes=1000))
        assert Counter((i, t) for i, t, _, _ in got) == Counter(rows)
        assert sorted((p, s) for _, _, s, p in got) == sorted((k // 3, k % 3) for k in range(len(rows)))
        places = sorted(p * 3 + s for i, _, s, p in got if i == 1)
        assert np.histogram(places, 6, (0, len(rows)))[0].min() > 10  # one bucket would hold them side by side, in five parts at most
        counts.append(sorted(got, key=str))
    assert counts[0] == counts[1]
    plan_rows = numbered_copies(docs(rows).withColumn("__ticket", F.xxhash64("doc_id"))).groupBy("__ticket").agg(F.count("*"), F.countDistinct("__copy"), F.max("__copy"))
    assert all(n == distinct == most + 1 for _, n, distinct, most in plan_rows.collect())
