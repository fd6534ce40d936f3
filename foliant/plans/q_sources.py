"""Readers, releases and extraction over records derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import extract as X
from foliant.plans import check_sql as Q
from foliant.plans.q_graph import RESOLVED
from foliant.plans.world import EDITION, EDITION_ID, World, query
from foliant.operators.graph import redirect_map
from foliant.session import ensure_checkpoint_dir, written
from foliant.sources import dumps as S
from foliant.sources import release as REL

_WORK_JSON = """concat('{"title": "', p_name, ' (', p_type, ' Edition)", "subtitle": "', lower(p_type),
    '", "authors": [{"author": {"key": "/authors/OL', substr(p_brand, 7), 'A"}}, {"key": "/authors/OL', p_size % 30, 'A"}], "subjects": ["',
    p_type, '", "series:', p_brand, '"], "covers": [', p_size - 10, ', ', p_size, '], "first_publish_date": "',
    CASE WHEN p_size > 20 THEN concat('May ', 1900 + p_size) ELSE 'unknown' END, '", "location": "/works/OL', p_partkey + 2, 'W"}')"""
WORK_LINES = f"""
    SELECT p_partkey, CASE WHEN p_size > 48 THEN concat('/type/work', chr(9), '/works/OL', p_partkey + 1, 'W')
      ELSE concat(CASE WHEN p_type = 'PROMO' THEN '/type/redirect' ELSE '/type/work' END, chr(9), '/works/OL', p_partkey + 1, 'W',
        chr(9), '1', chr(9), '2020-01-01', chr(9), {_WORK_JSON}) END AS value FROM part"""
EDITION_LINES = """
    SELECT edition_id AS ol_id, concat('{"works": [{"key": "/works/', work_id, '"}], "languages": [{"key": "/languages/',
      CASE WHEN is_english THEN 'eng' ELSE 'ger' END, '"}], "title": "', title, '", "subtitle": ',
      CASE WHEN subtitle IS NULL THEN 'null' ELSE concat('"', subtitle, '"') END, ', "publishers": ["', publisher, '"], "publish_date": "Jan ',
      publish_year, '", "isbn_13": ["', isbn_raw, '"], "isbn_10": [7], "number_of_pages": ', page_count, ', "covers": [', coalesce(cover_id, 0),
      '], "series": ["', series_string, '"]}') AS json FROM fx_edition"""


def work_dump(w: World) -> DataFrame:
    return S.entity_rows(w.sql(f"SELECT value FROM ({WORK_LINES})"))


def edition_dump(w: World) -> DataFrame:
    return w.sql(EDITION_LINES)


def candidates(w: World) -> DataFrame:
    return w.sql("SELECT work_id AS ol_id FROM fx_work WHERE shelf_mark <> 'MEDIUM'")


def extra_editions(w: World) -> DataFrame:
    return w.sql("SELECT edition_id AS ol_id FROM fx_edition WHERE page_count > 280")


@query("s01_read_entity_dump",
       f"SELECT CASE WHEN p_type = 'PROMO' THEN '/type/redirect' ELSE '/type/work' END AS type, "
       f"concat('OL', p_partkey + 1, 'W') AS ol_id, {_WORK_JSON} AS json FROM part WHERE p_size <= 48")
def s01(w: World) -> DataFrame:
    return work_dump(w).select("type", "ol_id", "json")


def _landed(w: World, lines: DataFrame) -> str:
    """Lines as gzip text files in the shared folder, as dumps land."""
    path = f"{ensure_checkpoint_dir(w.spark)}/landed-{uuid.uuid4().hex}"
    lines.select("value").write.option("compression", "gzip").text(path)
    return path


@query("s01_read_landed_dump",
       f"SELECT CASE WHEN p_type = 'PROMO' THEN '/type/redirect' ELSE '/type/work' END AS type, concat('/works/OL', p_partkey + 1, 'W') AS key, "
       f"concat('OL', p_partkey + 1, 'W') AS ol_id, {_WORK_JSON} AS json FROM part WHERE p_size <= 48")
def s01_landed(w: World) -> DataFrame:
    return S.read_entity_dump(w.spark, _landed(w, w.sql(f"SELECT value FROM ({WORK_LINES})")), w.spark.sparkContext.defaultParallelism)


_LOG_LINES = ("SELECT concat('/works/', work_id) AS work, CASE WHEN kind = 'rating' THEN concat('/books/', event_id) END AS edition, "
              "CAST(user_id AS STRING) AS value, CAST(NULL AS STRING) AS date, kind AS event_kind FROM fx_log")


@query("s02_read_activity_log",
       "SELECT work_id AS ol_id, kind, CASE WHEN kind = 'rating' THEN concat('/books/', event_id) END AS edition FROM fx_log")
def s02(w: World) -> DataFrame:
    return S.activity_rows(w.sql(_LOG_LINES), F.col("event_kind")).select("ol_id", "kind", "edition")


# Ratings have an edition, a value and a date; reading log lines end after the edition, which is empty.
_LOG_TEXT = ("SELECT kind, concat('/works/', work_id, chr(9), CASE WHEN kind = 'rating' THEN concat('/books/', event_id, chr(9), user_id, chr(9), \'\"2020-01-01\') ELSE '' END) AS value FROM fx_log")


@query("s02_read_landed_log",
       "SELECT work_id AS ol_id, concat('/works/', work_id) AS work, kind, CASE WHEN kind = 'rating' THEN concat('/books/', event_id) END AS edition, "
       "CASE WHEN kind = 'rating' THEN CAST(user_id AS VARCHAR) END AS value, CASE WHEN kind = 'rating' THEN '\"2020-01-01' END AS date FROM fx_log")
def s02_landed(w: World) -> DataFrame:
    """Each kind lands as files of its own; short lines are padded and a lone quote is text."""
    lines = w.sql(_LOG_TEXT)
    kinds = [S.read_activity_log(w.spark, _landed(w, lines.filter(F.col("kind") == kind)), kind, w.spark.sparkContext.defaultParallelism)
             for kind in ("rating", "reading_log")]
    return kinds[0].unionByName(kinds[1]).select("ol_id", "work", "kind", "edition", "value", "date")


@query("s03_load_entities",
       f"SELECT concat('OL', p_partkey + 1, 'W') AS ol_id, {_WORK_JSON} AS json FROM part "
       "WHERE p_size <= 48 AND p_type NOT IN ('PROMO', 'MEDIUM')")
def s03(w: World) -> DataFrame:
    return S.load_entities(work_dump(w), "/type/work", candidates(w))


@query("s04_load_redirects",
       "SELECT concat('OL', p_partkey + 1, 'W') AS from_ol, concat('OL', p_partkey + 2, 'W') AS to_ol FROM part WHERE p_size <= 48 AND p_type = 'PROMO'")
def s04(w: World) -> DataFrame:
    return S.load_redirects(work_dump(w))


_OWNED = "e JOIN fx_work w0 ON w0.work_id = e.work_id LEFT JOIN resolved r ON r.id = e.work_id LEFT JOIN fx_work c ON c.work_id = coalesce(r.target, e.work_id) AND c.shelf_mark <> 'MEDIUM'"


@query("s05_filter_editions",
       f"WITH RECURSIVE {RESOLVED} SELECT e.edition_id AS ol_id, coalesce(r.target, e.work_id) AS work_ol_id, e.is_english, e.title, e.subtitle, "
       "e.publisher AS publishers, concat('Jan ', e.publish_year) AS publish_date, e.isbn_raw AS isbn_13, '' AS isbn_10, "
       "CASE WHEN e.page_count > 0 THEN CAST(e.page_count AS BIGINT) END AS number_of_pages, "
       "CASE WHEN e.cover_id > 0 THEN CAST(e.cover_id AS VARCHAR) ELSE '' END AS covers, e.series_string AS series "
       f"FROM fx_edition {_OWNED} WHERE (e.is_english AND c.work_id IS NOT NULL) OR e.page_count > 280")
def s05(w: World) -> DataFrame:
    w.keep("edition_line")  # keys, texts and extra ids are three passes over the editions
    kept = S.filter_editions(edition_dump(w), candidates(w), extra_editions(w), w.fx("redirect"))
    for name in ("publishers", "isbn_13", "isbn_10", "covers", "series"):
        kept = kept.withColumn(name, F.array_join(F.col(name).cast("array<string>"), "|"))
    return kept


@query("s06_count_editions",
       f"WITH RECURSIVE {RESOLVED} SELECT c.work_id AS ol_id, CAST(count(*) AS INT) AS edition_count FROM fx_edition {_OWNED} "
       "WHERE c.work_id IS NOT NULL GROUP BY c.work_id")
def s06(w: World) -> DataFrame:
    return S.count_editions(edition_dump(w), candidates(w), w.fx("redirect"))


_KG_ROWS = ("SELECT concat('http://kg/', item) AS item, CASE WHEN ordinal = '1a' THEN 'OLxW' ELSE ol_id END AS olid, "
            "concat('http://kg/', series) AS series, ordinal FROM fx_kg_membership")


@query("s07_kg_memberships", "SELECT item, series, ordinal, ol_id FROM fx_kg_membership WHERE ordinal IS NULL OR ordinal <> '1a'")
def s07(w: World) -> DataFrame:
    return S.kg_memberships(w.sql(_KG_ROWS))


_KG_SERIES_ROWS = ("SELECT concat('http://kg/Q', p_size % 12) AS series, CASE WHEN p_size > 6 THEN concat('Label ', p_size % 12) END AS label, "
                   "p_brand AS alias, CASE WHEN p_size % 12 > 3 THEN concat('http://kg/Q', p_size % 3) END AS parent FROM part")


@query("s08_kg_series",
       "SELECT concat('Q', p_size % 12) AS qid, min(CASE WHEN p_size > 6 THEN concat('Label ', p_size % 12) END) AS label, "
       "string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS aliases, "
       "coalesce(string_agg(DISTINCT CASE WHEN p_size % 12 > 3 THEN concat('Q', p_size % 3) END, '|' "
       "ORDER BY CASE WHEN p_size % 12 > 3 THEN concat('Q', p_size % 3) END), '') AS parents FROM part GROUP BY p_size % 12")
def s08(w: World) -> DataFrame:
    folded = S.kg_series(w.sql(_KG_SERIES_ROWS))
    return folded.select("qid", "label", F.array_join("aliases", "|").alias("aliases"), F.array_join("parents", "|").alias("parents"))


_KG_AUTHOR_ROWS = ("SELECT concat('http://kg/Q', s_nationkey) AS item, concat('OL', s_suppkey, CASE WHEN s_acctbal > 0 THEN 'A' ELSE 'W' END) AS olid, "
                   "s_name AS name, CASE WHEN s_acctbal > 8000 THEN 'fr' WHEN s_acctbal > 4000 THEN 'en' ELSE 'ja' END AS lang FROM supplier")


@query("s09_kg_author_links", "SELECT concat('Q', s_nationkey) AS qid, concat('OL', s_suppkey, 'A') AS ol_author_id FROM supplier WHERE s_acctbal > 0")
def s09(w: World) -> DataFrame:
    return S.kg_author_links(w.sql(_KG_AUTHOR_ROWS))


@query("s09_kg_author_names", "SELECT DISTINCT concat('Q', s_nationkey) AS qid, s_name AS name FROM supplier WHERE s_acctbal <= 8000")
def s09_names(w: World) -> DataFrame:
    return S.kg_author_names(w.sql(_KG_AUTHOR_ROWS))


@query("s10_source_records")
def s10(w: World) -> DataFrame:
    return S.source_records(w.spark, [f"{w.folder}/*.parquet"]).select("name", "retrieved", "size", "sha256")


_WORK_DOCS = """
    SELECT p_partkey AS pos, concat('{"key": "/works/', CASE WHEN p_size > 45 THEN '' ELSE concat('OL', p_partkey + 1, 'W') END, '", "title": "', p_name,
      '", "author_name": ["', p_brand, '", "Other"], "first_publish_year": ', 1950 + p_size, CASE WHEN p_size > 10 THEN concat(', "edition_count": ', p_size) ELSE '' END,
      ', "isbn": ["978-', lpad(CAST(p_partkey AS STRING), 10, '0'), '", "bad", "978', lpad(CAST(p_partkey AS STRING), 10, '0'), '"], "cover_i": ', p_size,
      ', "subject": ["', p_type, '", "', p_name, '"]}') AS json FROM part"""


@query("s11_flatten_work_docs",
       "SELECT p_partkey AS pos, concat('OL', p_partkey + 1, 'W') AS key, p_name AS title, p_brand AS author, CAST(1950 + p_size AS INT) AS first_publish_year, "
       "CAST(CASE WHEN p_size > 10 THEN p_size ELSE 0 END AS INT) AS edition_count, concat('978', lpad(CAST(p_partkey AS VARCHAR), 10, '0')) AS isbn_13s, "
       "CAST(p_size AS BIGINT) AS cover_id, 0 AS readinglog_count, 0 AS ratings_count, concat(p_type, '|', p_name) AS subjects FROM part WHERE p_size <= 45")
def s11(w: World) -> DataFrame:
    rows = S.flatten_work_docs(w.sql(_WORK_DOCS))
    return rows.withColumn("isbn_13s", F.array_join("isbn_13s", "|")).withColumn("subjects", F.array_join("subjects", "|"))


_VOLUMES = """
    SELECT concat('{"id": "v', edition_id, '", "volumeInfo": {"title": "', title, '", "authors": ', CASE WHEN is_english THEN concat('["', publisher, '", "B"]') ELSE '[]' END,
      ', "publishedDate": "', publish_year, CASE WHEN page_count > 150 THEN '-05-03' WHEN page_count > 60 THEN '-05' ELSE '' END,
      '", "industryIdentifiers": [{"type": "ISBN_10", "identifier": "', isbn_raw, '"}], "pageCount": ', page_count, ', "imageLinks": {"small": "http://c/?zoom=1&edge=curl", "thumbnail": "x"}}}') AS json
    FROM fx_edition"""


@query("s12_flatten_volumes",
       f"SELECT concat('v', edition_id) AS external_id, title, CASE WHEN is_english THEN concat(publisher, ', B') ELSE 'Unknown' END AS author, "
       "CASE WHEN page_count > 150 THEN concat(publish_year, '-05-03') WHEN page_count > 60 THEN concat(publish_year, '-05-01') ELSE concat(publish_year, '-01-01') END AS published_date, "
       f"publish_year AS published_year, {Q.isbn('isbn_raw')} AS isbn_13, page_count, 'https://c/?zoom=0' AS cover_url FROM fx_edition")
def s12(w: World) -> DataFrame:
    rows = S.flatten_volumes(w.sql(_VOLUMES))
    return rows.select("external_id", "title", "author", F.col("published_date").cast("string").alias("published_date"), "published_year",
                       "isbn_13", "page_count", "cover_url")


def release_editions(w: World) -> DataFrame:
    """One row of ``fx_edition`` per id. Dealt by ranges of the id, which serve the distinction and the sink's order, as bare columns."""
    w.keep("edition_line")
    lines = w.sql("SELECT * FROM fx_edition_line").repartitionByRange(F.expr(EDITION_ID)).withColumn("edition_id", F.expr(EDITION_ID)).dropDuplicates(["edition_id"])
    return w.sql_over(f"SELECT edition_id, {EDITION.split(' AS edition_id,', 1)[1]} FROM rows_lines", lines=lines)


def release_tables(w: World) -> dict[str, DataFrame]:
    """A release straight from the tables, for the sink and the loader."""
    from foliant.functions import text as T

    work, edition = w.fx("work"), release_editions(w)
    room = F.concat(F.lit("ol:"), T.series_key(F.col("author")))
    works = work.select(
        T.work_row_id(F.col("work_id")).alias("id"), F.col("work_id").alias("ol_work_id"),
        T.canonical_key(F.col("raw_title"), F.col("author")).alias("canonical_key"), F.col("raw_title").alias("title"),
        F.lit(None).alias("subtitle"), "author", "first_publish_year", T.classify_kind(F.col("raw_title"), F.lit("")).alias("kind"),
        T.series_row_id(room).alias("series_id"), F.lit(None).alias("ol_cover_id"), F.col("edition_count").alias("ol_edition_count"),
        "readinglog_count", F.lit(0).alias("ratings_count"), F.lit(None).alias("subjects"), F.lit(None).alias("representative_edition_id"))
    editions = edition.select(
        T.edition_row_id(F.col("edition_id")).alias("id"), F.col("edition_id").alias("ol_edition_id"), T.work_row_id(F.col("work_id")).alias("work_id"),
        T.edition_title(F.col("title")).alias("title"), "subtitle", F.lit(None).alias("author"), "publisher", F.col("publish_year").alias("published_year"),
        T.normalize_isbn(F.col("isbn_raw")).alias("isbn_13"), "page_count", "cover_url", F.lit("en").alias("language"))
    series = work.select("author").distinct().select(
        T.series_row_id(room).alias("id"), room.alias("key"), F.lit("openlibrary").alias("source"), F.lit("ol_tag").alias("provenance"),
        F.col("author").alias("name"), T.slugify(F.col("author")).alias("slug"), T.series_key(F.col("author")).alias("canonical_key"),
        F.lit("series").alias("kind"), F.lit(None).alias("parent_series_id"))
    members = work.select(T.series_row_id(room).alias("series_id"), T.work_row_id(F.col("work_id")).alias("work_id"),
                          F.col("readinglog_count").alias("position"), F.lit("ol_tag").alias("provenance"), F.lit("medium").alias("confidence"))
    aliases = work.filter("merged_into IS NOT NULL").select(F.col("work_id").alias("ol_work_id"), T.work_row_id(F.col("merged_into")).alias("work_id"))
    return {"works": works, "editions": editions, "series": series, "series_members": members, "work_aliases": aliases}


_RELEASE_COUNTS = """
    SELECT 'works' AS "table", count(*) AS rows FROM fx_work UNION ALL SELECT 'editions', count(DISTINCT edition_id) FROM fx_edition
    UNION ALL SELECT 'series', count(DISTINCT author) FROM fx_work UNION ALL SELECT 'series_members', count(*) FROM fx_work
    UNION ALL SELECT 'work_aliases', count(*) FROM fx_work WHERE merged_into IS NOT NULL"""


def _publish(w: World) -> str:
    root = f"{ensure_checkpoint_dir(w.spark)}/releases-{uuid.uuid4().hex}"
    return REL.write_release(release_tables(w), root, "2026.01.1")


@query("s13_write_release", _RELEASE_COUNTS)
def s13(w: World) -> DataFrame:
    folder = _publish(w)
    return REL.release_counts({n: w.spark.read.parquet(f"{folder}/{n}") for n in REL.RELEASE})


@query("s14_release_manifest", _RELEASE_COUNTS)
def s14(w: World) -> DataFrame:
    manifest = REL.read_manifest(w.spark, _publish(w))
    return w.spark.createDataFrame(sorted(manifest["row_counts"].items()), "table string, rows bigint")


@query("s15_read_release",
       f"SELECT {Q.uuid5('''('work:ol:' || work_id)''')} AS id, work_id AS ol_work_id, raw_title AS title, {Q.uuid5('''('series:ol:' || ''' + Q.skey('author') + ')')} AS series_id FROM fx_work")
def s15(w: World) -> DataFrame:
    return REL.read_release(w.spark, _publish(w))["works"].select("id", "ol_work_id", "title", "series_id")


_VERSIONS = "SELECT DISTINCT concat(year(o_orderdate), '.', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '.', CASE WHEN o_totalprice > 450000 THEN 'x' ELSE CAST(day(o_orderdate) AS STRING) END) AS version FROM orders"


@query("s16_previous_release",
       f"SELECT version FROM ({_VERSIONS}) WHERE regexp_full_match(version, '[0-9]{{4}}\\.[0-9]{{2}}\\.[0-9]+') "
       "AND (CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT)) < (1998, 11, 12) "
       "ORDER BY CAST(split_part(version, '.', 1) AS INT) DESC, CAST(split_part(version, '.', 2) AS INT) DESC, CAST(split_part(version, '.', 3) AS INT) DESC LIMIT 1")
def s16(w: World) -> DataFrame:
    return REL.previous_release(w.sql(_VERSIONS), "1998.11.12")


def _extract_inputs(w: World):
    w.keep("edition_line")
    dump = work_dump(w)
    selected = candidates(w)
    raw_works = S.load_entities(dump, "/type/work", selected)
    moved = redirect_map(w.fx("redirect"))
    lines = edition_dump(w)
    owned = written(S.owned_editions(lines, moved))  # feeds both the filter and the counts
    raw_editions = S.filter_editions(lines, selected, extra_editions(w), moved, owned)
    editions = X.extract_editions(raw_editions, selected)
    return raw_works, editions, S.count_editions(lines, selected, moved, owned), moved


_AUTHOR_MOVES = "SELECT concat('OL', 20 + r_regionkey, 'A') AS from_ol, concat('OL', 1 + r_regionkey, 'A') AS to_ol FROM region"
_TYPED = "(p_size <= 48 AND p_type NOT IN ('PROMO', 'MEDIUM'))"
_KEPT_EDITIONS = (f"SELECT e.*, coalesce(r.target, e.work_id) AS owner FROM fx_edition {_OWNED} "
                  "WHERE e.is_english AND c.work_id IS NOT NULL")
_POPULARITY = ("SELECT coalesce(r.target, l.work_id) AS ol_id, CAST(sum(CASE WHEN kind = 'rating' THEN 1 ELSE 0 END) AS INT) AS ratings_count, "
               "CAST(sum(CASE WHEN kind = 'reading_log' THEN 1 ELSE 0 END) AS INT) AS readinglog_count "
               "FROM fx_log l LEFT JOIN resolved r ON r.id = l.work_id GROUP BY 1")


@query("x01_extract_works", f"""
    WITH RECURSIVE {RESOLVED}, moves AS ({_AUTHOR_MOVES}), pop AS ({_POPULARITY}),
    kept AS ({_KEPT_EDITIONS}),
    n AS (SELECT coalesce(r.target, e.work_id) AS ol_id, count(*) AS n FROM fx_edition e LEFT JOIN resolved r ON r.id = e.work_id GROUP BY 1),
    years AS (SELECT owner, min(publish_year) AS y FROM kept GROUP BY owner),
    base AS (SELECT *, concat('OL', p_partkey + 1, 'W') AS ol_id, concat('OL', substr(p_brand, 7), 'A') AS a1, concat('OL', p_size % 30, 'A') AS a2 FROM part WHERE {_TYPED}),
    people AS (SELECT b.*, coalesce(m1.to_ol, a1) AS r1, coalesce(m2.to_ol, a2) AS r2 FROM base b LEFT JOIN moves m1 ON m1.from_ol = a1 LEFT JOIN moves m2 ON m2.from_ol = a2),
    named AS (SELECT p.*, n1.name AS x1, CASE WHEN r2 <> r1 THEN n2.name END AS x2 FROM people p
      LEFT JOIN fx_author n1 ON n1.author_id = r1 LEFT JOIN fx_author n2 ON n2.author_id = r2)
    SELECT b.ol_id, p_name || ' (' || p_type || ' Edition)' AS raw_title, p_name AS title, lower(p_type) AS subtitle,
      coalesce(nullif(concat_ws(', ', x1, x2), ''), 'Unknown') AS author, CASE WHEN r2 <> r1 THEN r1 || '|' || r2 ELSE r1 END AS author_ids,
      CAST(CASE WHEN p_size > 20 THEN 1900 + p_size ELSE y END AS INT) AS first_publish_year, p_type || chr(10) || 'series:' || p_brand AS subjects,
      CAST(CASE WHEN p_size > 10 THEN p_size - 10 ELSE p_size END AS BIGINT) AS cover_id, coalesce(ratings_count, 0) AS ratings_count,
      coalesce(readinglog_count, 0) AS readinglog_count, CAST(coalesce(n.n, 0) AS INT) AS edition_count,
      {Q.clean('p_name')} || chr(31) || {Q.norm('coalesce(x1, x2)')} AS canonical_key, 'single' AS kind
    FROM named b LEFT JOIN years ON years.owner = b.ol_id LEFT JOIN pop ON pop.ol_id = b.ol_id LEFT JOIN n ON n.ol_id = b.ol_id""")
def x01(w: World) -> DataFrame:
    raw_works, editions, counts, moved = _extract_inputs(w)
    authors = w.fx("author").select(F.col("author_id").alias("ol_id"), "name")
    log = w.fx("log").select(F.col("work_id").alias("ol_id"), "kind")
    works = X.extract_works(raw_works, authors, w.sql(_AUTHOR_MOVES), X.popularity(log, moved), counts, editions)
    return works.withColumn("author_ids", F.array_join("author_ids", "|"))


@query("x02_extract_editions",
       f"WITH RECURSIVE {RESOLVED}, kept AS ({_KEPT_EDITIONS}) SELECT edition_id AS ol_id, owner AS work_ol_id, title, subtitle, publisher, publish_year, "
       f"{Q.isbn('isbn_raw')} AS isbn_13, CASE WHEN page_count > 0 THEN page_count END AS page_count, "
       "CASE WHEN cover_id > 0 THEN cover_id END AS cover_id, series_string AS series FROM kept")
def x02(w: World) -> DataFrame:
    _, editions, _, _ = _extract_inputs(w)
    return editions.withColumn("series", F.array_join("series", "|"))


@query("x03_popularity", f"WITH RECURSIVE {RESOLVED} {_POPULARITY}")
def x03(w: World) -> DataFrame:
    return X.popularity(w.fx("log").select(F.col("work_id").alias("ol_id"), "kind"), w.fx("redirect"))


@query("x04_alias_rows", f"WITH RECURSIVE {RESOLVED} SELECT id AS from_ol, target AS to_ol FROM resolved WHERE id <> target AND id IN (SELECT work_id FROM fx_work)")
def x04(w: World) -> DataFrame:
    return X.alias_rows(w.fx("work").select(F.col("work_id").alias("id")), w.fx("redirect"))


@query("x05_referenced_authors",
       f"WITH moves AS ({_AUTHOR_MOVES}), found AS (SELECT concat('OL', substr(p_brand, 7), 'A') AS a FROM part WHERE {_TYPED} "
       f"UNION SELECT concat('OL', p_size % 30, 'A') FROM part WHERE {_TYPED}) SELECT DISTINCT coalesce(m.to_ol, a) AS ol_id FROM found LEFT JOIN moves m ON m.from_ol = a")
def x05(w: World) -> DataFrame:
    return X.referenced_authors(S.load_entities(work_dump(w), "/type/work", candidates(w)), w.sql(_AUTHOR_MOVES))
