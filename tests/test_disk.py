"""What large jobs leave on disk: exchanges carry bare columns, each table is derived once, finished steps leave no shuffle files."""

import glob
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliant.operators import corrections as R
from foliant.operators import load as C
from foliant.operators import resolve as E
from foliant.plans import q_load, q_resolve, q_sources
from foliant.plans.world import World
from foliant.schemas import conform
from foliant.session import written
from foliant.sources import dumps as S

TYPES = {
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp"}
KINDS = ("SMALL", "STANDARD", "PROMO", "LARGE", "MEDIUM", "ECONOMY")


@pytest.fixture
def world(spark, tmp_path):
    """Books and suppliers that come twice, unknown ones, null keys, lines that come twice; nothing is broadcast."""
    lines = [(n, n % 14, n % 3, n % 4 or None, 20.0 + n, 1.0, 0.0, 0.0, "RNA"[n % 3], "O", datetime(1995 + n % 8, 1, 1)) for n in range(60)]
    rows = {
        "part": [(i, f"bolt {i % 6}", f"Brand#{i % 3 + 1}", KINDS[i % 6], 4 * i, 1.0) for i in range(12)] + [(3, "nut", "Brand#2", None, 9, 1.0), (None, "x", "y", "SMALL", 1, 1.0)],
        "supplier": [(0, "a", 0, 1.0), (1, "b", 0, 1.0), (1, None, 0, 1.0), (None, "c", 0, 1.0)],
        "lineitem": lines + lines[:15] + [(70, None, 1, 1, 3.0, 1.0, 0.0, 0.0, None, "O", None), (71, 3, None, 1, 3.0, 1.0, 0.0, 0.0, "N", "O", None), (72, 3, 1, 1, None, 1.0, 0.0, 0.0, None, "O", None)]}
    for name, values in rows.items():
        spark.createDataFrame(values, TYPES[name]).write.parquet(str(tmp_path / f"{name}.parquet"))
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield World(spark, str(tmp_path))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def _rows(df):
    return sorted(map(repr, df.collect()))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_editions_made_of_written_lines_are_the_rows_of_their_sql(world):
    lines = q_load.edition_lines(world)
    for made, text in ((q_load.live_editions, q_load.EDITIONS), (q_load.stage_editions, q_load.STAGE_EDITIONS)):
        assert made(world, lines).schema.simpleString() == world.sql(text).schema.simpleString()
        assert _rows(made(world, lines)) == _rows(world.sql(text))


def test_an_upsert_exchanges_the_lines_of_both_tables_once_and_without_texts(world):
    lines = q_load.edition_lines(world)
    both = C.upsert(q_load.live_editions(world, lines), q_load.stage_editions(world, lines).withColumnRenamed("id", "edition_id").select("edition_id", "title", "isbn_13"), ["edition_id"])
    plan = _plan(both)
    assert plan.count("Exchange hashpartitioning") == 2 and "l_shipdate" not in plan
    below = [line for line in plan.split("\n") if "FileScan" in line or "Exchange" in line]
    assert len(below) == 4 and all("l_orderkey" in line for line in below)


def test_the_catalog_upsert_reads_lines_that_were_written(world, monkeypatch):
    made = []
    monkeypatch.setattr(q_load, "live", lambda w, lines=None: {n: lines for n in ("series", "works")} | {"editions": q_load.live_editions(w, lines)})
    monkeypatch.setattr(q_load, "stage", lambda w, lines=None: {"editions": q_load.stage_editions(w, lines)})
    monkeypatch.setattr(C, "upsert_catalog", lambda live, stage, version: made.extend([live["editions"], stage["editions"]]) or live)
    q_load.c04_editions(world)
    assert made and all("l_shipdate" not in x._jdf.queryExecution().optimizedPlan().toString() for x in made)


def test_a_written_table_is_small_and_leaves_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {x for d in local for x in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = held()
    table = written(spark.range(200_000).select((F.col("id") % 100).alias("k"), F.col("id").cast("string").alias("v")).repartition(4, "v"))
    for _ in range(50):
        if not (left := held() - before):
            break
        spark.sparkContext._jvm.java.lang.Thread.sleep(100)
    assert not left
    assert table.count() == 200_000 and {os.path.basename(f).split(".")[-2] for f in table.inputFiles()} == {"zstd"}


def test_two_merges_followed_by_one_join_are_the_two_in_turn(spark):
    pairs = "loser string, survivor string"
    first = spark.createDataFrame([("a", "b"), ("c", "d"), ("e", "f"), ("e", "g")], pairs)
    second = spark.createDataFrame([("b", "x"), ("d", "y"), ("h", "z"), ("c", "never"), ("g", "x")], pairs)
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([*"abcdefghi", None, "a"])], "edition_id int, work_id string")
    turn = E._follow(E._follow(rows, "work_id", first), "work_id", second)
    once = E._follow(rows, "work_id", C._chained(first, second))
    assert _rows(once.select("edition_id", "work_id")) == _rows(turn.select("edition_id", "work_id"))


def test_faces_of_merged_works_are_the_representatives_of_their_editions(spark):
    fields = "edition_id string, work_id string, language string, cover_url string, description string, isbn_13 string, page_count int, ratings_count int"
    rows = [(f"OL{n}M" if n % 7 else None, f"w{n % 9}" if n % 5 else None, ("en", "de", None)[n % 3], "c" if n % 4 else None, "d" if n % 6 == 0 else None,
             "9780306406157" if n % 2 else None, n % 3 or None, None) for n in range(90)]
    editions = spark.createDataFrame(rows + rows[:20], fields)
    aliases = spark.createDataFrame([("w1", "w2"), ("w3", "w2"), ("w4", "new")], "loser string, survivor string")
    met = E._follow(E.ranked_faces(editions), "work_id", aliases).groupBy("work_id").agg(F.max("face").alias("face"))
    assert _rows(met.select("work_id", F.col("face.edition_id").alias("representative"))) == _rows(
        E.pick_representative(E._follow(editions, "work_id", aliases)).select("work_id", "representative"))


def test_a_load_ranks_the_editions_once_and_follows_both_merges_by_one_join(world, monkeypatch):
    ranked, followed = [], []
    rank, follow = C.ranked_faces, C._follow
    monkeypatch.setattr(C, "ranked_faces", lambda editions: ranked.append(editions) or rank(editions))
    monkeypatch.setattr(C, "_follow", lambda df, column, aliases: followed.append(df.columns) or follow(df, column, aliases))
    works = [("OL1W", "openlibrary", "OL1W", "s1", "2025.12.1", None), ("OL2W", "openlibrary", "OL2W", "s1", "2025.12.1", None), ("rt-3", "openlibrary", "OL3W", "s2", None, None)]
    spark = world.spark
    live = {
        "works": spark.createDataFrame([(*w, "t", "a", "t a", "single", None, None, 0, 0, 0, None, None, "manual", 1990) for w in works],
            "work_id string, source string, external_id string, series_id string, catalog_release string, merged_into string, title string, author string, canonical_key string, kind string, representative string, "
            "subtitle string, ol_cover_id long, ol_edition_count int, readinglog_count int, ratings_count int, subjects string, identity_provenance string, first_publish_year int"),
        "series": spark.createDataFrame([(s, "openlibrary", s, s, s, s, "series", "ol_tag", None, None, None, False) for s in ("s1", "s2")],
            "series_id string, source string, external_id string, name string, slug string, canonical_key string, kind string, provenance string, catalog_release string, merged_into string, parent_id string, dissolved boolean"),
        "editions": spark.createDataFrame([(f"e{n}", w, "en", "t", 100 + n, None) for n, (w, *_) in enumerate(works)], "edition_id string, work_id string, language string, title string, page_count int, ratings_count int").selectExpr(
            "*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("isbn_13", "cover_url", "source", "external_id", "subtitle", "author", "publisher", "description")], "1990 AS published_year"),
        "threads": spark.createDataFrame([(1, "s1", "OL2W")], "thread_id long, series_id string, work_id string"),
        "shelves": spark.createDataFrame([(1, 1, "rt-3", "read", datetime(2020, 1, 1))], "shelf_id long, user_id long, work_id string, status string, created_at timestamp"),
        "votes": spark.createDataFrame([], "user_id long, work_id string, genre_id int"), "inferences": spark.createDataFrame([], "work_id string, genre_id int, source string"),
        "vetoes": spark.createDataFrame([], "work_id string, genre_id int, reverted boolean, veto_id long"), "members": spark.createDataFrame([], "series_id string, work_id string, position double, provenance string, confidence string"),
        "aliases": spark.createDataFrame([], "ol_work_id string, work_id string"), "releases": spark.createDataFrame([("2025.12.1",)], "version string")}
    stage = {
        "works": spark.createDataFrame([(f"OL{n}W", f"OL{n}W", "t", "a", f"k{n}", 1990, "single", "s1", 0, 0, 0, None, None, None, 0) for n in (1, 3)],
            "id string, ol_work_id string, title string, author string, canonical_key string, first_publish_year int, kind string, series_id string, readinglog_count int, ol_edition_count int, ratings_count int, subjects string, "
            "representative_edition_id string, subtitle string, ol_cover_id long"),
        "series": spark.createDataFrame([("s1", "openlibrary", "s1", "s1", "s1", "s1", "series", "ol_tag", None)],
            "id string, source string, key string, name string, slug string, canonical_key string, kind string, provenance string, parent_series_id string"),
        "editions": spark.createDataFrame([("e9", "OL9M", "OL1W", "t")], "id string, ol_edition_id string, work_id string, title string").selectExpr(
            "*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("subtitle", "author", "publisher", "isbn_13", "cover_url")], "1990 AS published_year", "10 AS page_count", "'en' AS language"),
        "series_members": live["members"], "work_aliases": spark.createDataFrame([("OL2W", "OL3W")], "ol_work_id string, work_id string")}
    phrases = spark.createDataFrame([], "slug string, kind string, phrase string, parent string, position int")
    genres = spark.createDataFrame([], "genre_id int, slug string, parent_id int, retired boolean")
    after, _ = C.load_release(live, stage, "2026.01.1", phrases, genres)
    assert len(ranked) == 1 and "edition_id" in followed[-1]
    # rt-3 is adopted by OL3W, which takes the books of the absent OL2W too
    assert {r["edition_id"]: r["work_id"] for r in after["editions"].collect()} == {"e0": "OL1W", "e1": "OL3W", "e2": "OL3W", "e9": "OL1W"}
    assert {r["work_id"]: (r["merged_into"], r["representative"]) for r in after["works"].collect()}["OL3W"][1] in ("e1", "e2")
    joined = after["editions"].select("*")._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("edition_id#") and sum("Join" in line and "work_id#" in line for line in joined.split("\n")) == 1


def test_a_kept_view_is_derived_once_and_has_its_rows(world):
    before = _rows(world.fx("edition"))
    world.keep("edition_line")
    assert _rows(world.fx("edition")) == before and "l_shipdate" not in world.fx("edition")._jdf.queryExecution().optimizedPlan().toString()


def test_filtered_and_extracted_editions_read_kept_lines(world, monkeypatch):
    seen, filtered = [], S.filter_editions
    monkeypatch.setattr(S, "filter_editions", lambda dump, candidates, extra, *rest: seen.extend([dump, extra]) or filtered(dump, candidates, extra, *rest))
    q_sources.s05(world)
    q_sources.x02(World(world.spark, world.folder))
    assert len(seen) == 4 and all("l_shipdate" not in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)


def test_lines_meet_redirects_and_candidates_by_one_join(spark, monkeypatch):
    """Chains, redirected candidates, redirects onto themselves, lines without a work, repeated lines and ids."""
    works = [f"OL{n}W" for n in range(12)]
    lines = [(f"OL{n}M", f'{{"works": [{{"key": "/works/{works[n % 14]}"}}], "languages": [{{"key": "/languages/{"eng" if n % 3 else "ger"}"}}]}}' if n % 14 < 12 else "{}") for n in range(70)]
    dump = spark.createDataFrame(lines + lines[:9] + [("OL99M", None)], "ol_id string, json string")
    redirects = spark.createDataFrame([("OL0W", "OL1W"), ("OL1W", "OL2W"), ("OL3W", "OL9W"), ("OL4W", "OL4W"), ("OL5W", None), (None, "OL2W")], "from_ol string, to_ol string")
    candidates = spark.createDataFrame([(x,) for x in ("OL1W", "OL2W", "OL4W", "OL5W", "OL6W", "OL6W", None)], "ol_id string")
    extra = spark.createDataFrame([(x,) for x in ("OL3M", "OL13M", "OL12M", "OL12M", None)], "ol_id string")
    target = {"OL0W": "OL2W", "OL1W": "OL2W", "OL3W": "OL9W"}
    wanted, more = {"OL1W", "OL2W", "OL4W", "OL5W", "OL6W"}, {"OL3M", "OL12M", "OL13M"}
    expected = []
    for ol_id, json in lines + lines[:9]:
        work = json.split("/works/")[1].split('"')[0] if "/works/" in json else None
        owner = target.get(work, work)
        if ("eng" in json and owner in wanted) or ol_id in more:
            expected.append((ol_id, owner, "eng" in json))
    passes, keep = [], S.written
    monkeypatch.setattr(S, "written", lambda df: passes.append(df) or keep(df))
    for owned in (None, S.owned_editions(dump, redirects)):
        found = S.filter_editions(dump, candidates, extra, redirects, owned).select("ol_id", "work_ol_id", "is_english")
        assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, expected))
    joins = [sum("Join" in x and "OL[0-9]+W" not in x and "coalesce" in x for x in p._jdf.queryExecution().optimizedPlan().toString().split("\n")) for p in passes]
    assert joins[0] < joins[1]


def test_release_editions_are_dealt_once_for_the_distinction_and_the_order(world):
    every = world.fx("edition").select("edition_id", "work_id", "title", "isbn_raw", "page_count", "cover_url").collect()
    tables = q_sources.release_tables(world)
    ordered = conform(tables["editions"], "editions").orderBy("ol_edition_id")
    plan = _plan(ordered)
    assert plan.count("Exchange") == 1 and plan.count("Exchange rangepartitioning") == 1 and "l_shipdate" not in plan
    found = ordered.collect()
    ids = [r["ol_edition_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: (x is not None, x)) and len(set(ids)) == len(ids) and set(ids) == {r["edition_id"] for r in every}
    first = q_sources.release_editions(world).select("edition_id", "work_id", "title", "isbn_raw", "page_count", "cover_url").collect()
    assert {tuple(r) for r in first} <= {tuple(r) for r in every}


def test_a_split_is_judged_once_and_its_works_come_from_what_was_written(spark):
    works = spark.createDataFrame([(f"w{n}", None, "openlibrary", f"x{n}", f"t{n}", f"t{n}", "a", None, None, 1, 1990, None, "s") for n in range(4)],
        "work_id string, merged_into string, source string, external_id string, title string, canonical_key string, author string, catalog_release string, subjects string, readinglog_count int, first_publish_year int, "
        "representative string, series_id string")
    editions = spark.createDataFrame([(f"OL{n}M", f"w{n % 3}", "en" if n % 2 else "de", f"Face {n}", None, None, None, 10 * n, None) for n in range(12)],
        "edition_id string, work_id string, language string, title string, cover_url string, description string, isbn_13 string, page_count int, ratings_count int")
    series = spark.createDataFrame([("s", "series")], "series_id string, kind string")
    ops = spark.createDataFrame([(1, "w0", ["OL0M", "OL3M"]), (2, "w0", ["OL6M"]), (3, "w1", ["OL0M"]), (4, "w2", ["OL2M", "OL5M", "OL8M", "OL11M"]), (5, "w9", ["OL1M"]), (6, "w1", ["OL1M"])],
        "op_id int, work_id string, editions array<string>")
    after, refusals = R.apply_split(ops, {"works": works, "editions": editions, "series": series})
    assert {tuple(r) for r in refusals.collect()} == {(2, "superseded"), (3, "foreign"), (4, "all"), (5, "unknown_work")}
    assert all("explode" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (refusals, after["works"], after["editions"]))
    shown = {r["external_id"]: (r["representative"], r["title"]) for r in after["works"].collect()}
    assert shown == {"x0": ("OL9M", "t0"), "x1": ("OL7M", "t1"), "x2": (None, "t2"), "x3": (None, "t3"), "w0~OL0M": ("OL3M", "Face 3"), "w1~OL1M": ("OL1M", "Face 1")}
    moved = {r["edition_id"]: r["work_id"] for r in after["editions"].collect()}
    assert moved["OL0M"] == moved["OL3M"] != "w0" and moved["OL6M"] == "w0" and moved["OL1M"] not in ("w1", moved["OL0M"]) and moved["OL2M"] == "w2"


def test_the_steps_of_the_ladder_read_what_was_written(world, monkeypatch):
    seen, by_isbn, by_title = [], E.resolve_by_isbn, E.resolve_by_title_author
    monkeypatch.setattr(E, "resolve_by_isbn", lambda editions, docs: seen.extend([editions, docs]) or by_isbn(editions, docs))
    monkeypatch.setattr(E, "resolve_by_title_author", lambda editions, docs: seen.append(editions) or by_title(editions, docs))
    links, _ = q_resolve._laddered(world)
    assert len(seen) == 3 and all("l_shipdate" not in x._jdf.queryExecution().optimizedPlan().toString() for x in seen)
    pending = world.sql(q_resolve._RE).filter("work_id IS NULL")
    assert _rows(links.select("edition_id").distinct()) == _rows(pending.select("edition_id").distinct())
