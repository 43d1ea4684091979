"""How the reader and lineage queries lay out what they write and shuffle."""

import os

import pytest

from pacelane import plans

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def test_one_tracking_file_for_each_match(spark):
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")  # as in a large run, where the partitions are too big to be merged into one
    try:
        files = [f for f in plans.QUERIES["possession_rows"](spark, FOLDER).inputFiles() if "match=" in f]
    finally:
        spark.conf.unset(merging)
    assert len(files) == len({f.split("match=")[1].split("/")[0] for f in files}) == 5


def test_match_information_is_not_a_file_for_each_team_element(spark):
    files = [f for f in plans.QUERIES["read_match_info"](spark, FOLDER).inputFiles() if "match=" in f]
    assert 0 < len(files) <= 5


def test_reordered_fingerprint_is_dealt_by_id(spark):
    df = plans.QUERIES["fingerprint"](spark, FOLDER)
    assert "RepartitionByExpression [lang" not in df._jdf.queryExecution().toString()
    a, b = df.drop("copy").collect()
    assert a == b
