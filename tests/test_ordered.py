"""The chunked windows against plain windows, with one group holding a third of the rows."""

from __future__ import annotations

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitelode.operators.ordered import ordered_items, with_neighbours
from sitelode.operators.stages import computed_once


@pytest.fixture(scope="module")
def rows(spark):
    n = F.col("id")
    return spark.range(3000).select(
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), n % 40)).alias("key"),
        ((n * 7919) % 3001).cast("int").alias("at"),
        F.when(n % 11 == 0, n).alias("value"),
        n.alias("row"),
    )


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 64, 100000])
def test_neighbours_equal_the_plain_window(rows, size):
    w = W.partitionBy("key").orderBy("at")
    want = rows.select(
        "row",
        F.row_number().over(w).alias("position"),
        F.count("*").over(W.partitionBy("key")).alias("group_size"),
        F.lag("row").over(w).alias("p"),
        F.lead("row").over(w).alias("n"),
    )
    got = with_neighbours(rows, ["key"], F.floor(F.col("at") / size), ["at"], ["row"]).select(
        "row", "position", "group_size", F.col("previous.row").alias("p"), F.col("next.row").alias("n")
    )
    assert as_set(got) == as_set(want)


def test_a_crowded_group_is_windowed_in_many_tasks(spark, rows):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = with_neighbours(rows, ["key"], F.floor(F.col("at") / 50), ["at"], ["row"])
        tasks = {r[0] for r in out.where("key = 'hot'").select(F.spark_partition_id()).collect()}
        assert len(tasks) > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_items_are_whole_and_in_order(rows):
    numbered = rows.withColumn("pos", F.row_number().over(W.partitionBy("key").orderBy("at")) - 1)
    held = {r.key: r["items"] for r in ordered_items(numbered, ["key"], F.col("pos"), F.col("at")).collect()}
    assert len(held["hot"]) == 1000 and held["hot"] == sorted(held["hot"])


def test_a_later_filter_does_not_repeat_the_computation(spark):
    df = computed_once(spark.range(5).withColumn("x", F.sha2(F.col("id").cast("string"), 256)), {"y": F.reverse("x")})
    plan = df.where("y > '1'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1
