"""The operations and the books of the r11 queries meet by a shuffle: neither table passes through the driver."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.plans import q_fixes
from foliant.plans.world import World

FACTOR = "spark.sql.sources.fileCompressionFactor"


@pytest.fixture
def folder(spark, tmp_path):
    i = F.col("id")
    spark.range(1_200_000).select(
        i.alias("p_partkey"), F.concat(F.lit("name "), i % 50).alias("p_name"), F.concat(F.lit("Brand#"), i % 25).alias("p_brand"), F.lit("SMALL").alias("p_type"),
        (i % 50).cast("int").alias("p_size"), F.lit(1.5).alias("p_retailprice")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(2_000_000).select(
        i.alias("o_orderkey"), (i % 900_000).alias("o_custkey"), F.lit("F").alias("o_orderstatus"), F.lit(1.0).alias("o_totalprice"),
        F.lit(datetime(2020, 1, 1)).alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")).coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    was = spark.conf.get(FACTOR)
    spark.conf.unset(FACTOR)
    yield str(tmp_path)
    spark.conf.set(FACTOR, was)


def _plan(spark, folder):
    return World(spark, folder).sql(q_fixes._OPS)._jdf.queryExecution().sparkPlan().toString()


def test_books_of_a_million_operations_are_not_gathered_in_the_driver(spark, folder):
    spark.conf.set(FACTOR, "1.0001")  # by the bytes of the files, as before
    assert "BroadcastHashJoin" in _plan(spark, folder)
    spark.conf.unset(FACTOR)
    assert "BroadcastHashJoin" not in _plan(spark, folder)
