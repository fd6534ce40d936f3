"""Editions are dealt once and derived once, with the rows of their views."""

from datetime import datetime

import pytest

from foliant.plans import q_load, q_resolve
from foliant.plans.world import VIEWS, World, with_views

TYPES = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp"}


@pytest.fixture
def world(spark, tmp_path):
    """Books that come twice, unknown books and suppliers, null keys, lines that come twice."""
    lines = [(n, n % 9, n % 3, n % 4 or None, 20.0 + n, 1.0, 0.0, 0.0, "RN"[n % 2], "O", datetime(1995 + n % 8, 1, 1)) for n in range(40)]
    rows = {
        "part": [(i, f"bolt {i % 6}", f"Brand#{i % 3 + 1}", ("SMALL", "STANDARD", "PROMO")[i % 3], 7 * i, 1.0) for i in range(8)] + [(3, "nut", "Brand#2", None, 9, 1.0), (None, "x", "y", "SMALL", 1, 1.0)],
        "supplier": [(0, "a", 0, 1.0), (1, "b", 0, 1.0), (1, None, 0, 1.0), (None, "c", 0, 1.0)],
        "lineitem": lines + lines[:15] + [(50, None, 1, 1, 3.0, 1.0, 0.0, 0.0, None, "O", None), (51, 3, None, 1, 3.0, 1.0, 0.0, 0.0, "N", "O", None), (52, 3, 1, 1, None, 1.0, 0.0, 0.0, None, "O", None)]}
    for name, values in rows.items():
        spark.createDataFrame(values, TYPES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield World(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_the_planned_editions_are_the_rows_of_the_view(spark, world):
    for name in TYPES:
        world.table(name).createOrReplaceTempView(name)
    assert _rows(world.fx("edition")) == _rows(spark.sql(f"SELECT * FROM ({VIEWS['fx_edition']})"))


def test_distinct_editions_by_work_need_no_exchange_beyond_the_joins(spark, world):
    text = "SELECT DISTINCT work_id, edition_id, title FROM fx_edition"
    world.sql(text)
    assert _exchanges(spark.sql(with_views(text))) == 5
    assert _exchanges(world.sql(text)) == 4


def test_live_and_staged_editions_are_the_rows_of_their_sql(world):
    for made, text in ((q_load.live_editions, q_load.EDITIONS), (q_load.stage_editions, q_load.STAGE_EDITIONS)):
        assert made(world).schema.simpleString() == world.sql(text).schema.simpleString()
        assert _rows(made(world)) == _rows(world.sql(text))


def test_distinct_editions_and_their_join_share_an_exchange(world):
    """Two tables of distinct editions meet by id: each is dealt once, by the id."""
    def met(a, b):
        return a.join(b.withColumnRenamed("id", "edition_id"), "edition_id", "full")._jdf.queryExecution().executedPlan().toString()
    ids = r"hashpartitioning(edition_id"
    plan = met(q_load.live_editions(world).select("edition_id", "title"), q_load.stage_editions(world).select("id", "publisher"))
    assert plan.count(ids) == 2
    assert met(world.sql(q_load.EDITIONS).select("edition_id", "title"), world.sql(q_load.STAGE_EDITIONS).select("id", "publisher")).count(ids) > 2


def test_representatives_come_from_the_editions_that_were_written(world):
    works, editions = q_resolve._represented(world)
    assert "l_orderkey" not in works._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in editions._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(editions) == _rows(world.sql(q_resolve._RE))
    assert _rows(works.filter("representative IS NOT NULL").select("work_id", "representative").distinct()) == _rows(world.sql(q_resolve._REPS))


def test_a_repair_judges_the_editions_once(world):
    works, editions, stats = q_resolve._repaired(world)
    assert "year(" in world.sql(q_resolve._RE)._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in stats._jdf.queryExecution().optimizedPlan().toString()
    assert "year(" not in editions._jdf.queryExecution().optimizedPlan().toString()
    assert {r["metric"]: r["value"] for r in stats.collect()}["editions_detached"] > 0
