"""The keyed-state validator against the batch rules."""

import random

import pytest

from pacelane.operators import quality
from pacelane.schema import contract
from pacelane.streaming import validator

KIND = """dataset_id string, session_id string, subject_id string, stream_id string, sample_index bigint, t_rel_ns bigint, measurement_class string, clock_id string,
    synchronization_spec_id string, coordinate_frame_id string, force_z_n double, force_z_body_weight_ratio double"""


def samples(rng, stream, many):
    rows, t = [], 0
    for i in range(many):
        t += rng.choice([1000, 1000, 1000, 0, -500])
        maybe = lambda v, odds=0.02: None if rng.random() < odds else v
        n, r = rng.choice([(1.0, None), (None, 1.0), (1.0, 1.0), (None, None)])
        index = i - 1 if rng.random() < 0.03 and i else i
        rows.append((maybe("d"), f"s{stream}" if rng.random() < 0.98 else "other", maybe("who"), f"st{stream}", maybe(index, 0.01), maybe(t), rng.choice(["RAW_MEASURED", "GUESSED", None]), maybe("c"), "sync", maybe("f"), n, r))
    return rows


def write(spark, folder, rows, name):
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{folder}/{name}")


def live(spark, folder, per_batch=1):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", True).parquet(folder)


def violations(df):
    return sorted(tuple(r) for r in df.select("stream_id", "rule", "violations").collect())


@pytest.fixture(scope="module", autouse=True)
def one_partition(spark):
    """One state store, so that a micro-batch starts one worker."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    streams = [samples(rng, 0, 400), samples(rng, 1, 37), [("d", "s2", "w", "st2", i, i * 10, "RAW_MEASURED", "c", "x", "f", 1.0, None) for i in range(120)]]
    return streams


def test_batches_restarts_and_batch_rules_agree(spark, rows, tmp_path):
    """Samples in index order, split anywhere, give what the batch rules give for all of them."""
    rng, folder = random.Random(1), str(tmp_path / "in")
    wanted = contract("force")
    # arrival follows the index, as in a live stream
    arriving = [sorted(s, key=lambda r: (r[4] is None, r[4] or 0, r[5] or 0)) for s in rows]
    queues, k = [list(s) for s in arriving], 0
    seen = []
    while any(queues):
        part = []
        for queue in queues:
            take = rng.randint(60, 300)
            while queue and (take > 0 or (part and queue[0][4] is not None and part[-1][3] == queue[0][3] and part[-1][4] == queue[0][4])):
                part.append(queue.pop(0))
                take -= 1
        if part:
            write(spark, folder, part, f"part{k}")
            k += 1
            seen += part
        if k == 1 and queues[0]:  # a run that stops, and another that goes on from its checkpoint
            first = validator.validate_live(live(spark, folder), wanted, str(tmp_path / "work"), width=50)
            assert violations(first) == violations(quality.validate(spark.createDataFrame(seen, KIND), wanted, chunk=50))
    found = validator.validate_live(live(spark, folder), wanted, str(tmp_path / "work"), width=50)
    expected = violations(quality.validate(spark.createDataFrame(seen, KIND), wanted, chunk=50))
    assert violations(found) == expected
    assert len({r for _, r, _ in expected}) >= 14 and not any(s == "st2" for s, _, _ in expected)


def test_late_samples_count_as_order_violations(spark, tmp_path):
    wanted = contract("force")
    good = [("d", "s", "w", "st", i, i * 10, "RAW_MEASURED", "c", "x", "f", 1.0, None) for i in range(10)]
    write(spark, str(tmp_path / "in"), good[:4] + good[5:], "a")
    validator.validate_live(live(spark, str(tmp_path / "in")), wanted, str(tmp_path / "work"))
    write(spark, str(tmp_path / "in"), good[4:5], "b")
    found = validator.validate_live(live(spark, str(tmp_path / "in")), wanted, str(tmp_path / "work"))
    assert [(r, n) for _, r, n in violations(found)] == [("time.contiguous", 1), ("time.monotonic:sample_index", 1), ("time.monotonic:t_rel_ns", 1)]


def test_events_without_a_time_axis(spark, tmp_path):
    rows = [("d", None, "w", "st", None, None, "RAW_MEASURED", "c", "x", None, None, None)] * 3
    write(spark, str(tmp_path / "in"), rows, "a")
    found = validator.validate_live(live(spark, str(tmp_path / "in")), contract("event"), str(tmp_path / "work"))
    assert violations(found) == violations(quality.validate(spark.createDataFrame(rows, KIND), contract("event")))


def test_narrow_chunks_share_a_state(spark, rows, tmp_path):
    wanted, folder = contract("force"), str(tmp_path / "in")
    seen = sorted(rows[0] + rows[1], key=lambda r: (r[4] is None, r[4] or 0, r[5] or 0))
    write(spark, folder, seen, "a")
    found = validator.validate_live(live(spark, folder), wanted, str(tmp_path / "work"), width=5)
    assert violations(found) == violations(quality.validate(spark.createDataFrame(seen, KIND), wanted, chunk=5))
    # 437 samples in chunks of five: two streams, each with a lot and one for samples without an index
    assert spark.read.parquet(str(tmp_path / "work" / "reports")).count() <= 4
