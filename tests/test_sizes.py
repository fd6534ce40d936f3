"""Tables are judged by what their rows take in memory, not by the bytes of their compressed files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.plans import q_corrections
from foliant.plans.world import World

FACTOR = "spark.sql.sources.fileCompressionFactor"


@pytest.fixture
def million(spark, tmp_path):
    rows = spark.range(1_200_000).select(
        (F.col("id") + 1).alias("p_partkey"), F.concat(F.lit("name "), F.col("id") % 50).alias("p_name"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand"),
        F.lit("SMALL").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"), F.lit(1.5).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    spark.range(10).select(F.col("id").alias("l_partkey")).write.parquet(str(tmp_path / "lineitem.parquet"))
    was = spark.conf.get(FACTOR)
    spark.conf.unset(FACTOR)
    yield str(tmp_path)
    spark.conf.set(FACTOR, was)


def _plan(spark, folder):
    part = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_size", "p_name")
    return spark.range(10**8).withColumnRenamed("id", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))._jdf.queryExecution().sparkPlan().toString()


def test_a_million_rows_in_a_small_file_do_not_go_through_the_driver(spark, million):
    assert "BroadcastHashJoin" in _plan(spark, million)
    World(spark, million)
    assert "BroadcastHashJoin" not in _plan(spark, million)


def test_small_tables_are_still_broadcast_and_a_factor_of_the_caller_stays(spark, million):
    spark.conf.set(FACTOR, "2.0")
    w = World(spark, million)
    assert spark.conf.get(FACTOR) == "2.0"
    spark.conf.unset(FACTOR)
    w = World(spark, million)
    small = w.table("part").join(w.table("lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().sparkPlan().toString()


def test_a_split_derives_the_editions_once(spark, tmp_path, monkeypatch):
    """The operations come from the written editions, so no plan joins the lines to books a second time."""
    tables = {
        "part": [(i, f"bolt {i}", f"Brand#{i % 5 + 1}", ("SMALL", "STANDARD")[i % 2], 3 * i, 1.0) for i in range(8)],
        "supplier": [(1, "s", 0, 1.0)], "lineitem": [(n, n % 8, 1, n % 3, 20.0 + n, 1.0, 0.0, 0.0, "N", "O", datetime(2020, 1, 1)) for n in range(32)]}
    types = {
        "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                    "l_returnflag string, l_linestatus string, l_shipdate timestamp"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, types[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    w = World(spark, str(tmp_path))
    works = w.sql(q_corrections.WORKS).withColumn("canonical_key", F.col("title"))
    monkeypatch.setattr(q_corrections, "live", lambda w: {"works": works, "series": w.sql(q_corrections.SERIES), "editions": w.sql(q_corrections.EDITIONS)})
    texts, sql = [], World.sql
    monkeypatch.setattr(World, "sql", lambda self, text: texts.append(text) or sql(self, text))
    after, refusals = q_corrections._split(w)
    assert sum(q_corrections.EDITIONS in x for x in texts) == 1
    for found in (after["editions"], refusals):
        assert "l_orderkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert after["editions"].count() == 32 and after["editions"].filter("work_id NOT LIKE 'OL%' AND work_id NOT LIKE 'rt-%'").count() > 0
