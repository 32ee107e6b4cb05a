"""Changes that write only the partitions they touch."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from custodia.sinks import partitions, store


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def of(listing, part):
    return {k: v for k, v in listing.items() if k.startswith(part)}


@pytest.fixture
def scoped(spark, tmp_path):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y'z", 2), ("b", "x", 3), (None, "x", 4)], "d string, s string, v int").select("v", "d", "s")
    name = f"scoped_{tmp_path.name.replace('-', '_')}"
    partitions.create(df, name, ["d", "s"], str(tmp_path / "t"))
    yield name, tmp_path / "t"
    spark.sql(f"DROP TABLE {name}")


def test_replace_scope_writes_one_partition(spark, scoped, rows):
    name, folder = scoped
    before, whole = files(folder), spark.table(name).collect()
    plain = store.replace_scope(spark.createDataFrame(whole, spark.table(name).schema), spark.createDataFrame([(9, "a", "x")], "v int, d string, s string"), {"d": "a", "s": "x"})
    got = partitions.replace_scope(name, spark.createDataFrame([(9, "a", "x")], "v int, d string, s string"), {"d": "a", "s": "x"})
    assert rows(got) == rows(plain)
    after = files(folder)
    assert {k: v for k, v in before.items() if not k.startswith("d=a/s=x")} == {k: v for k, v in after.items() if not k.startswith("d=a/s=x")}
    assert of(before, "d=a/s=x").keys().isdisjoint(of(after, "d=a/s=x"))


def test_scope_without_rows_ends_up_empty(spark, scoped, rows):
    name, _ = scoped
    none = spark.createDataFrame([], "v int, d string, s string")
    assert rows(partitions.replace_scope(name, none, {"d": "a", "s": "y'z"})) == [(1, "a", "x"), (3, "b", "x"), (4, None, "x")]
    assert rows(partitions.replace_scope(name, none, {"d": None, "s": "x"})) == [(1, "a", "x"), (3, "b", "x")]


def test_rows_outside_the_scope_are_refused(spark, scoped, rows):
    name, _ = scoped
    before = rows(spark.table(name))
    with pytest.raises(Exception, match="outside the scope"):
        partitions.replace_scope(name, spark.createDataFrame([(9, "b", "x")], "v int, d string, s string"), {"d": "a", "s": "x"})
    with pytest.raises(ValueError, match="partitioned by"):
        partitions.replace_scope(name, spark.table(name), {"d": "a"})
    with pytest.raises(Exception, match="empty text"):
        partitions.overwrite(spark.createDataFrame([(9, "", "x")], "v int, d string, s string"), name)
    assert rows(spark.table(name)) == before


@pytest.fixture
def keyed(spark, tmp_path):
    df = spark.range(400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("old").alias("note"))
    name = f"keyed_{tmp_path.name.replace('-', '_')}"
    partitions.create_keyed(df, name, ["k"], 16, str(tmp_path / "t"))
    yield name, tmp_path / "t", df
    spark.sql(f"DROP TABLE {name}")


def test_upsert_equals_the_whole_one_and_touches_few_partitions(spark, keyed, rows):
    name, folder, df = keyed
    source = spark.createDataFrame([(5, -1, None), (1000, -2, "new"), (None, -3, "null key")], "k long, v long, note string")
    before = files(folder)
    got = partitions.upsert(name, source)
    assert rows(got.drop(partitions.PART)) == rows(store.upsert(df, source, ["k"]))
    after = files(folder)
    hit = {r[0] for r in source.select(partitions.part_of(["k"], 16)).collect()}
    for part in range(16):
        old, new = of(before, f"key_part={part}/"), of(after, f"key_part={part}/")
        assert old.keys().isdisjoint(new) if part in hit else old == new


def test_partial_and_conditional_upserts(spark, keyed, rows):
    name, _, df = keyed
    source = spark.createDataFrame([(5, -1), (6, -1), (1000, -2)], "k long, v long")
    want = store.upsert(df, source, ["k"], update=["v"], when=F.col("v") > 10, insert_values={"note": F.lit("in")})
    got = partitions.upsert(name, source, update=["v"], when=F.col("v") > 10, insert_values={"note": F.lit("in")})
    assert rows(got.drop(partitions.PART)) == rows(want)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


def test_upsert_reads_only_the_partitions_asked_for(spark, keyed, capsys):
    name, _, _ = keyed
    capsys.readouterr()
    spark.table(name).filter(F.col(partitions.PART).isin(3)).explain("formatted")
    assert "PartitionFilters: [isnotnull(key_part" in capsys.readouterr().out
