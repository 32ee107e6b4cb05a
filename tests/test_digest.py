"""Digests of parts against counting every row."""

import random

import pytest
from pyspark.sql import functions as F

from custodia.operators import digest

SCHEMA = "k int, t string, x double"


def brute(left, right):
    from collections import Counter
    a, b = Counter(left), Counter(right)
    return sorted(((*r, a[r], b[r]) for r in a.keys() | b.keys() if a[r] != b[r]), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_difference_is_the_multiset_difference(spark, rows, seed):
    rng = random.Random(seed)
    value = lambda: (rng.choice([None, 0, 1, 2]), rng.choice([None, "", "a", "b"]), rng.choice([None, 0.5]))
    left = [value() for _ in range(60)]
    right = left[5:] + [value() for _ in range(3)] + left[10:12]
    got = digest.difference(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), parts=rng.choice([1, 7, 4096]))
    assert rows(got) == brute(left, right)


def test_nulls_in_other_columns_are_other_rows(spark, rows):
    left = spark.createDataFrame([("a", None)], "p string, q string")
    right = spark.createDataFrame([(None, "a")], "p string, q string")
    assert rows(digest.difference(left, right)) == [("a", None, 1, 0), (None, "a", 0, 1)]


def test_empty_and_equal_sides(spark, rows):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a", 1.0)] * 3, SCHEMA)
    assert rows(digest.difference(none, none)) == [] and rows(digest.difference(some, some)) == []
    assert rows(digest.difference(some, none)) == [(1, "a", 1.0, 3, 0)]
    assert rows(digest.difference(some.withColumn("k", F.col("k").cast("bigint")), some)) == []


def test_only_differing_parts_are_counted(spark):
    left = spark.range(2000)
    right = left.filter("id <> 77")
    off = digest.differing_parts(left, right, ["id"], 64).collect()
    assert [r.part for r in off] == [left.filter("id = 77").select(digest.part_of(["id"], 64)).first()[0]]


def test_equal_parts_do_not_reach_the_shuffle(spark, tmp_path, capsys):
    spark.range(2000).write.parquet(str(tmp_path / "l"))
    left = spark.read.parquet(str(tmp_path / "l"))
    capsys.readouterr()
    digest.difference(left, left.filter("id <> 77"), parts=64).explain("simple")
    text = capsys.readouterr().out
    assert "BroadcastHashJoin" in text and "LeftSemi" in text and "SortMergeJoin" not in text and "CartesianProduct" not in text


def test_reconcile_sees_content_behind_equal_counts(spark, rows):
    a = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, t string")
    b = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, t string")
    none = a.limit(0)
    got = digest.reconcile({"SAME": a, "MOVED": a, "GONE": a, "EMPTY": none}, {"SAME": a.select("t", "k").repartition(3), "MOVED": b, "NEW": b, "EMPTY": none})
    assert rows(got) == [("GONE", 3, None), ("MOVED", 3, 3), ("NEW", None, 3)]
