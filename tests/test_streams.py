"""Streams into a table in buckets."""

import os

import pytest
from pyspark.sql import functions as F

from fernhill.operators.resolution import upsert_by_key
from fernhill.streaming import refresh
from fernhill.streaming.bucket_table import BucketTable


def files(root):
    return {os.path.join(d, n)[len(str(root)) :] for d, _, names in os.walk(root) for n in names if not n.endswith(".crc") and "part-" in n}


def rows_of(table):
    return sorted(map(tuple, table.read().collect()))


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    schema = spark.createDataFrame([], "product_id long, v string").schema
    table = BucketTable(spark, f"file://{tmp_path}/t", schema, "product_id", buckets=16)
    make = lambda *r: spark.createDataFrame(r, schema)
    merge = lambda old, new: upsert_by_key(old, new, "product_id")
    assert rows_of(table) == []
    table.apply(make(*((i, "a") for i in range(200)), (None, "n")), 0, merge)
    before = table.folders()
    touched = table.apply(make((3, "b"), (3, "c"), (7, "b")), 1, merge)
    after = table.folders()
    assert 1 <= len(touched) <= 2
    assert {b: f for b, f in after.items() if b not in touched} == {b: f for b, f in before.items() if b not in touched}
    assert all(after[b] != before[b] for b in touched)
    want = sorted([(i, "a") for i in range(200) if i not in (3, 7)] + [(3, "b"), (3, "c"), (7, "b")])
    assert sorted(r for r in map(tuple, table.read().collect()) if r[0] is not None) == want
    # the same batch again, and one that came before it
    seen = files(tmp_path / "t")
    assert table.apply(make((3, "z")), 1, merge) == [] == table.apply(make((4, "z")), 0, merge)
    assert files(tmp_path / "t") == seen and table.folders() == after
    # a batch without rows is a version with the same folders
    assert table.apply(make(), 2, merge) == [] and table.folders() == after
    # what no kept manifest names is gone
    table.apply(make((5, "d")), 3, merge)
    table.apply(make((5, "e")), 4, merge)
    assert table._versions() == [3, 4]
    named = {f for v in (3, 4) for f in table._manifest(v).values()}
    assert {os.path.dirname(f).lstrip("/") for f in files(tmp_path / "t")} == named


def test_a_failed_batch_leaves_the_table(spark, tmp_path):
    schema = spark.createDataFrame([], "product_id long, v string").schema
    table = BucketTable(spark, f"file://{tmp_path}/t", schema, "product_id", buckets=4)
    table.apply(spark.createDataFrame([(1, "a")], schema), 0, lambda old, new: new)
    with pytest.raises(Exception):
        table.apply(spark.createDataFrame([(1, "b")], schema), 1, lambda old, new: new.withColumn("v", F.raise_error("lost").cast("string")))
    assert rows_of(table) == [(1, "a")]
    table.apply(spark.createDataFrame([(1, "b")], schema), 1, lambda old, new: new)
    assert rows_of(table) == [(1, "b")]
    # all rows of a bucket may go
    table.apply(spark.createDataFrame([(1, "c")], schema), 2, lambda old, new: new.where("false"))
    assert rows_of(table) == [] and table.folders() == {}


def test_streams_resume_and_take_empty_feeds(spark, tmp_path):
    root = f"file://{tmp_path}"
    table = spark.createDataFrame([(1, "1999-01-02", 1), (1, "1999-01-01", 2), (2, "1999-01-01", 3)], "product_id long, refreshed_at string, image_id long")
    os.makedirs(tmp_path / "in")
    assert refresh.refresh_stream(spark, f"{root}/in", table.schema, root).read().count() == 0
    table.coalesce(1).write.mode("append").parquet(f"{root}/in")
    assert rows_of(refresh.refresh_stream(spark, f"{root}/in", table.schema, root)) == [(1, "1999-01-02", 1), (2, "1999-01-01", 3)]
    table.where("product_id = 2").withColumn("image_id", F.lit(9)).select(*[F.col(c).cast(t) for c, t in table.dtypes]).coalesce(1).write.mode("append").parquet(f"{root}/in")
    for _ in range(2):
        assert rows_of(refresh.refresh_stream(spark, f"{root}/in", table.schema, root)) == [(1, "1999-01-02", 1), (2, "1999-01-01", 9)]
    os.makedirs(tmp_path / "j")
    judged = spark.createDataFrame([], "product_id long, judgment_id long, judged_at timestamp").schema
    assert refresh.judgment_stream(spark, f"{root}/j", judged, f"{root}/judgments").read().count() == 0
