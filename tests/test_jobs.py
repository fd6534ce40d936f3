"""Sources, releases, corrections, streams and registered queries end to end."""

import gzip
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import _rows
from foliant.operators import corrections as R
from foliant.operators import quality as A
from foliant.operators import search as S
from foliant.plans.q_load import _loaded, live, stage
from foliant.plans.q_sources import release_tables
from foliant.plans.world import TABLES, World
from foliant.operators import load as C
from foliant.sources import dumps, release

SF = "/root/testdata/sf0.001"


def test_dump_lines_and_logs(spark, tmp_path):
    lines = ["/type/work\t/works/OL1W\t1\t2020\t{\"title\": \"A \\\"b\\\"\"}", "broken\tline", "/type/redirect\t/works/OL2W\t1\t2020\t{\"location\": \"/works/OL1W\"}"]
    with gzip.open(tmp_path / "works.txt.gz", "wt") as out:
        out.write("\n".join(lines))
    dump = dumps.read_entity_dump(spark, str(tmp_path / "works.txt.gz"), spread=2)
    assert sorted(r["ol_id"] for r in dump.collect()) == ["OL1W", "OL2W"]
    assert [tuple(r) for r in dumps.load_redirects(dump).collect()] == [("OL2W", "OL1W")]
    with gzip.open(tmp_path / "log.txt.gz", "wt") as out:
        out.write("/works/OL1W\t/books/OL9M\t5\t2020-01-01\n/works/OL3W\t\"q\n")
    log = dumps.read_activity_log(spark, str(tmp_path / "log.txt.gz"), "rating").collect()
    assert sorted(r["ol_id"] for r in log) == ["OL1W", "OL3W"] and {r["value"] for r in log} == {"5", None}


def test_release_is_immutable_verified_and_repeatable(spark, tmp_path):
    w = World(spark, SF)
    tables = release_tables(w)
    first = release.write_release(tables, str(tmp_path / "a"), "2026.01.1")
    with pytest.raises(release.ReleaseError):
        release.write_release(tables, str(tmp_path / "a"), "2026.01.1")
    read = release.read_release(spark, first)
    again = {n: t.repartition(3) for n, t in tables.items()}
    second = release.write_release(again, str(tmp_path / "b"), "2026.01.1")
    assert A.release_digest(read).orderBy("table").collect() == A.release_digest(release.read_release(spark, second)).orderBy("table").collect()
    folder = os.path.join(second, "series")
    victim = next(f for f in os.listdir(folder) if f.endswith(".parquet"))
    with open(os.path.join(folder, victim), "r+b") as out:
        out.seek(10)
        out.write(b"xx")
    os.chmod(folder, 0o755)
    crc = os.path.join(folder, f".{victim}.crc")
    if os.path.exists(crc):
        os.truncate(crc, 0)
    with pytest.raises(Exception):
        release.read_release(spark, second)


def test_loading_twice_changes_nothing_and_older_is_refused(spark):
    w = World(spark, SF)
    tables, stats = _loaded(w)
    genres = spark.createDataFrame([], "genre_id int, slug string, retired boolean")
    same, noop = C.load_release(tables, stage(w), "2026.01.1", w.fx("taxonomy"), genres)
    assert same is tables and [tuple(r) for r in noop.collect()] == [("noop", 1)]
    with pytest.raises(C.OlderRelease):
        C.load_release(tables, stage(w), "2024.01.1", w.fx("taxonomy"), genres)
    assert {r["metric"] for r in stats.collect()} >= {"adopted", "reslugged", "deleted_works"}
    orphans = tables["works"].filter("merged_into IS NOT NULL").join(tables["works"].select(F.col("work_id").alias("merged_into"), F.col("merged_into").alias("next")), "merged_into")
    assert orphans.filter("next IS NOT NULL").count() == 0  # chains stay one hop long


def test_a_move_and_its_undo_restore_the_snapshot(spark):
    member = "series_id string, work_id string, position double, provenance string, confidence string"
    series = "series_id string, source string, external_id string, name string, slug string, canonical_key string, kind string, provenance string, catalog_release string, merged_into string, parent_id string, dissolved boolean"
    tables = {
        "works": spark.createDataFrame([("w1", "A", "s1", None), ("w2", "B", "s1", None)], "work_id string, title string, series_id string, merged_into string"),
        "series": spark.createDataFrame([(s, "openlibrary", f"ol:{s}", s, s, s, "series", "ol_tag", None, None, None, False) for s in ("s1", "s2")], series),
        "members": spark.createDataFrame([("s1", "w1", 2.0, "ol_tag", "medium")], member),
        "threads": spark.createDataFrame([(1, "s1", "w1"), (2, "s1", None)], "thread_id bigint, series_id string, work_id string"),
    }
    ops = spark.createDataFrame([(1, "w1", "s2", None, 5.0), (2, "w2", "s1", None, None), (3, "w1", "s2", None, None)], "op_id int, work_id string, series_id string, new_name string, position double")
    moved, refusals = R.apply_set_series(ops, tables)
    assert sorted(tuple(r) for r in refusals.collect()) == [(2, "same_room"), (3, "same_room")]
    assert {tuple(r) for r in moved["threads"].collect()} == {(1, "s2", "w1"), (2, "s1", None)}
    assert [tuple(r) for r in moved["members"].collect()] == [("s2", "w1", 5.0, "override", "high")]
    snapshot = json.dumps({"old_room": "s1", "old_members": [{"series_id": "s1", "work_id": "w1", "position": 2.0, "provenance": "ol_tag", "confidence": "medium"}], "moved_threads": [1]})
    log = spark.createDataFrame([(7, "set_series", "w1", "s2", 0, 1, False, snapshot)], "correction_id bigint, op string, work_id string, series_id string, genre_id int, created_at int, reverted boolean, snapshot string")
    back, new_log, refused = R.revert(log.select("correction_id"), log, moved)
    assert refused.count() == 0 and new_log.first()["reverted"]
    for name in ("works", "members", "threads"):
        assert {tuple(r) for r in back[name].collect()} == {tuple(r) for r in tables[name].collect()}
    late = {**moved, "threads": moved["threads"].union(spark.createDataFrame([(3, "s2", "w1")], "thread_id bigint, series_id string, work_id string"))}
    assert [r["reason"] for r in R.revert(log.select("correction_id"), log, late)[2].collect()] == ["new_discussion"]


def test_golden_gate(spark):
    result = spark.createDataFrame([("a", True, True), ("b", True, False)], "name string, membership_ok boolean, order_ok boolean")
    with pytest.raises(A.GoldenGateError):
        A.golden_gate(result)
    with pytest.raises(A.GoldenGateError):
        A.golden_gate(result.limit(0))
    A.golden_gate(result.filter("name = 'a'"))


def test_ranking_prefers_titles_then_readers(spark):
    rows = [(1, "Grey Weir", "Ana Mirel", "franchise:Salt Harbour", 0), (2, "Salt Harbour", "Ola Brandt", None, 10), (3, "Salt Harbour", "Ana Mirel", None, 900), (4, "Ebb", "Ines Kor", None, 4000)]
    works = spark.createDataFrame(rows, "doc_id int, title string, author string, subjects string, readers int").withColumn("edition_count", F.lit(0)).withColumn(
        "first_publish_year", F.lit(None).cast("int")).withColumn("kind", F.lit("single")).withColumn("merged_into", F.lit(None).cast("string"))
    queries = spark.createDataFrame([(1, "salt harbour"), (2, "  ")], "query_id int, query string")
    found = S.rank_search(S.build_search_index(works), works, queries).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == [3, 2, 1]
    assert math.isclose(found[2]["score"], 0.2 * 1.0, rel_tol=1e-9)  # two adjacent C words: (2 / (5 + 5)) / 1


CHECKED = ["k02_clean_title", "k11_slugify", "g01_resolve_redirects", "n02_infer_genres", "n07_apply_genre_votes", "d07_apply_shelf_log", "e01_find_duplicates",
           "l16_assign_slugs", "q03_rank_search", "a07_suspicious_series", "r06_rename_series", "t01_stream_vote_scores"]


@pytest.mark.parametrize("name", CHECKED)
def test_registered_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = entry.queries()[name](spark, SF)
    result = con.execute(entry.oracle_sql()[name])
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in result.description], result.fetchall())


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["work_id", "title", "author", "ratings_count", "readinglog_count", "edition_count"]


def test_live_tables_open(spark):
    assert set(live(World(spark, SF))) >= {"works", "series", "threads", "shelves"}
