"""Sides that grow with the input aren't broadcast, however small Spark's estimate of them is."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docweave.operators import addresses, forms, joins, pages, wording


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastExchange" in line or "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]


@pytest.fixture
def lines(spark, tmp_path):
    """Many lines of few rows of a file, which looks small."""
    spark.range(50).write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t")).selectExpr("id AS doc", "posexplode(transform(sequence(1, 40), i -> concat('A: ', i, ', Nation-', id))) AS (line_no, line)")


def test_forms(spark, lines):
    assert not broadcasts(forms.column_values(lines, [("A", "A", True)], []))


def test_addresses(spark, lines):
    places = spark.createDataFrame([("nation 7", "Nation 7", "P")], "name string, town string, province string")
    for df in (addresses.split_addresses(lines.where("line_no = 0").select("doc", "line"), places), addresses.best_address_line(lines, places)):
        assert len(broadcasts(df)) == 2  # the dictionary and its join
        assert df.count() > 0


def test_pages(spark, lines):
    read = pages.read_pages(lines, spark.createDataFrame([("Москва",), (None,)], "word string"))
    assert len(broadcasts(read)) == 2
    assert read.count() == 50


def test_long_dictionaries_are_shuffled(spark):
    rows, listed = spark.range(100).withColumnRenamed("id", "k"), spark.range(50).selectExpr("id AS k", "id AS v")
    short, long = joins.by_list(rows, listed, "k"), joins.by_list(rows, listed, "k", limit=49)
    assert broadcasts(short) and not broadcasts(long)
    assert sorted(short.collect()) == sorted(long.collect()) and long.count() == 50


def test_pairs_of_one_flat_are_dealt_out(spark):
    left, right = (spark.range(n).selectExpr("id", "true AS house_matches", "7L AS osm_id", f"{flat} AS flat") for n, flat in ((300, "''"), (200, "CAST(NULL AS STRING)")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    pairs = wording.same_address(left, right)
    groups = [r[0] for r in pairs.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert sum(groups) == 60_000 and max(groups) < 60_000
    assert pairs.distinct().count() == 60_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_costly_rows_of_a_small_file_are_dealt_out(spark):
    for name in ("q_home_addresses", "q_mrz"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 16
