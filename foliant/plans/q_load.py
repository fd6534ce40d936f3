"""Catalog load and merge jobs over a live snapshot derived from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import load as C
from foliant.operators import publish as P
from foliant.plans import check_sql as Q
from foliant.plans.q_resolve import _rank_sql
from foliant.plans.world import EDITION, EDITION_ID, World, query
from foliant.session import ensure_checkpoint_dir, written

# --- the live snapshot ------------------------------------------------------------------
WORKS = """
    SELECT CASE WHEN shelf_mark IN ('SMALL', 'PROMO') THEN work_id ELSE concat('rt-', work_num) END AS work_id, CASE WHEN shelf_mark = 'MEDIUM' THEN 'heuristic' ELSE 'openlibrary' END AS source,
      CASE WHEN shelf_mark = 'MEDIUM' THEN concat('h', work_num) WHEN shelf_mark = 'LARGE' THEN concat('OLalias', work_num, 'W') ELSE work_id END AS external_id, author, raw_title AS title, first_publish_year, 'single' AS kind,
      CASE WHEN shelf_mark IN ('SMALL', 'PROMO') THEN concat('s-', author) WHEN shelf_mark = 'STANDARD' THEN concat('rt-room-', series_id) ELSE concat('sg-', work_num) END AS series_id,
      readinglog_count, CAST(NULL AS STRING) AS subjects, concat('sub ', shelf_mark) AS subtitle, work_num % 90 AS ol_cover_id, edition_count AS ol_edition_count, CAST(work_num % 11 AS INT) AS ratings_count,
      'manual' AS identity_provenance, CASE WHEN shelf_mark IN ('SMALL', 'PROMO') THEN '2025.12.1' END AS catalog_release,
      CASE WHEN shelf_mark = 'STANDARD' AND readinglog_count = 3 THEN concat('rt-', work_num - 1) END AS merged_into, CASE WHEN shelf_mark = 'SMALL' THEN concat('rep-', work_num) END AS representative, work_num FROM fx_work"""
SERIES = """
    SELECT concat('sg-', work_num) AS series_id, 'heuristic' AS source, concat('singleton:', work_num) AS external_id, raw_title AS name, concat('slug-', work_num) AS slug, raw_title AS canonical_key, 'singleton' AS kind,
      'single' AS provenance, CAST(NULL AS STRING) AS catalog_release, CAST(NULL AS STRING) AS merged_into, CAST(NULL AS STRING) AS parent_id, false AS dissolved FROM fx_work
    UNION ALL SELECT DISTINCT concat('s-', p_brand), 'openlibrary', concat('ol:', p_brand), p_brand, concat('old-', replace(lower(p_brand), '#', '-')), p_brand, 'series', 'ol_tag', '2025.12.1', CAST(NULL AS STRING), CAST(NULL AS STRING), false FROM part
    UNION ALL SELECT DISTINCT concat('rt-room-', p_size % 25), 'openlibrary', concat('franchise:', p_size % 25), concat('room ', p_size % 25),
      CASE WHEN p_size % 25 < 6 THEN concat('brand-', p_size % 25 + 1) ELSE concat('room-', p_size % 25) END, 'room', 'series', 'ol_tag', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), false FROM part"""
EDITIONS = """
    SELECT DISTINCT concat('ed-', edition_id) AS edition_id, CASE WHEN w.shelf_mark IN ('SMALL', 'PROMO') THEN w.work_id ELSE concat('rt-', w.work_num) END AS work_id, e.title, isbn_raw AS isbn_13, page_count, cover_url, language,
      'google_books' AS source, concat('g', edition_id) AS external_id, CAST(NULL AS STRING) AS subtitle, e.author, e.publisher, publish_year AS published_year, CASE WHEN page_count > 200 THEN 'text' END AS description, CAST(NULL AS INT) AS ratings_count FROM fx_edition e JOIN fx_work w ON w.work_id = e.work_id"""
THREADS = """
    SELECT thread_id, CASE WHEN thread_id % 4 = 3 THEN concat('s-Brand#', thread_id % 25 + 1) WHEN thread_id % 4 = 2 THEN concat('rt-room-', thread_id % 25) ELSE concat('sg-', thread_id % 60 + 1) END AS series_id,
      CASE WHEN thread_id % 3 = 0 THEN NULL ELSE concat('rt-', thread_id % 60 + 1) END AS work_id, CAST(NULL AS INT) AS genre_id FROM fx_thread"""
SHELVES = "SELECT DISTINCT CAST(s.shelf_id AS BIGINT) AS shelf_id, s.user_id, CASE WHEN s.status = 'read' THEN s.work_id ELSE concat('rt-', substr(s.work_id, 3, length(s.work_id) - 3)) END AS work_id, s.status, s.created_at FROM fx_shelf s"
VOTES = "SELECT DISTINCT user_id, CASE WHEN genre_id < 110 THEN work_id ELSE concat('rt-', substr(work_id, 3, length(work_id) - 3)) END AS work_id, genre_id FROM fx_genre_vote"
INFERENCES = "SELECT DISTINCT CASE WHEN genre_id < 110 THEN work_id ELSE concat('rt-', substr(work_id, 3, length(work_id) - 3)) END AS work_id, genre_id, source FROM fx_genre_inference"
VETOES = "SELECT concat('rt-', substr(work_id, 3, length(work_id) - 3)) AS work_id, genre_id, reverted, veto_id FROM fx_veto"
MEMBERS = "SELECT concat('s-', author) AS series_id, work_id, CAST(readinglog_count AS DOUBLE) AS position, 'ol_tag' AS provenance, 'medium' AS confidence FROM fx_work WHERE shelf_mark IN ('SMALL', 'PROMO') UNION ALL SELECT concat('rt-room-', series_id), concat('rt-', work_num), CAST(1 AS DOUBLE), 'ol_tag', 'low' FROM fx_work WHERE shelf_mark = 'STANDARD'"
ALIASES = "SELECT concat('OLalias', work_num, 'W') AS ol_work_id, 'nowhere' AS work_id FROM fx_work WHERE shelf_mark = 'STANDARD'"
# --- the staged release: promo works are gone, the rest is there under its release id ------
STAGE_WORKS = """
    SELECT work_id AS id, work_id AS ol_work_id, raw_title AS title, author, first_publish_year, 'single' AS kind, concat('s-', CASE WHEN author = 'Brand#2' THEN 'Brand#1' ELSE author END) AS series_id, readinglog_count,
      concat(lower(shelf_mark), chr(10), raw_title) AS subjects, CASE WHEN work_num % 2 = 0 THEN concat('up-', work_num) END AS representative_edition_id, concat('new ', shelf_mark) AS subtitle, work_num % 70 AS ol_cover_id,
      CAST(edition_count + 1 AS INT) AS ol_edition_count, CAST(work_num % 13 AS INT) AS ratings_count, work_num, shelf_mark FROM fx_work WHERE shelf_mark <> 'PROMO'"""
STAGE_SERIES = """
    SELECT DISTINCT concat('s-', p_brand) AS id, 'openlibrary' AS source, concat('ol:', p_brand) AS key, p_brand AS name, replace(lower(p_brand), '#', '-') AS slug, p_brand AS canonical_key, 'series' AS kind, 'ol_tag' AS provenance,
      CAST(NULL AS STRING) AS parent_series_id FROM part WHERE p_brand NOT IN ('Brand#2', 'Brand#3')"""
STAGE_EDITIONS = """
    SELECT DISTINCT CASE WHEN page_count > 200 THEN concat('ed-', edition_id) ELSE edition_id END AS id, edition_id AS ol_edition_id, work_id, title, subtitle, author, publisher, publish_year AS published_year, isbn_raw AS isbn_13, page_count, cover_url,
      'en' AS language FROM fx_edition WHERE is_english"""
STAGE_MEMBERS = "SELECT concat('s-', author) AS series_id, work_id, CAST(first_publish_year AS DOUBLE) AS position, 'wikidata' AS provenance, 'high' AS confidence FROM fx_work WHERE shelf_mark = 'SMALL' AND author <> 'Brand#2'"
STAGE_ALIASES = "SELECT concat('OLalias', work_num, 'W') AS ol_work_id, work_id FROM fx_work WHERE shelf_mark = 'LARGE' UNION ALL SELECT work_id, concat('OL', work_num + 1, 'W') FROM fx_work WHERE shelf_mark = 'PROMO' AND readinglog_count > 40"

_KEY = Q.ckey("title", "author")


def _by_edition(rows: DataFrame) -> DataFrame:
    """Distinct rows dealt by ``edition_id``: one exchange serves the distinction and what joins by edition."""
    return rows.repartition("edition_id").distinct()


# The same rows as EDITIONS and STAGE_EDITIONS. What one column says of another is added after the exchange.
_LIVE_ROWS = """
    SELECT concat('ed-', edition_id) AS edition_id, CASE WHEN w.shelf_mark IN ('SMALL', 'PROMO') THEN w.work_id ELSE concat('rt-', w.work_num) END AS work_id, e.title, isbn_raw AS isbn_13, page_count, cover_url, language,
      e.author, e.publisher, publish_year AS published_year FROM fx_edition e JOIN fx_work w ON w.work_id = e.work_id"""
_STAGE_ROWS = """
    SELECT CASE WHEN page_count > 200 THEN concat('ed-', edition_id) ELSE edition_id END AS edition_id, work_id, title, subtitle, author, publisher, publish_year AS published_year, isbn_raw AS isbn_13, page_count, cover_url
    FROM fx_edition WHERE is_english"""


# What both are made of, for jobs that read both: written once, and exchanged as bare columns. The texts are made after the exchange.
_LINES = "SELECT l.*, shelf_mark, work_num FROM fx_edition_line l JOIN fx_work w ON w.work_id = l.l_work"
_LIVE_ID = f"concat('ed-', {EDITION_ID})"
_STAGE_ID = f"CASE WHEN CAST(l_quantity * 6 AS INT) > 200 THEN {_LIVE_ID} ELSE {EDITION_ID} END"
_LIVE_OF_LINES = f"""
    SELECT dealt_id AS edition_id, CASE WHEN shelf_mark IN ('SMALL', 'PROMO') THEN work_id ELSE concat('rt-', work_num) END AS work_id, title, isbn_raw AS isbn_13, page_count, cover_url, language,
      author, publisher, publish_year AS published_year FROM ({EDITION}, shelf_mark, work_num, {_LIVE_ID} AS dealt_id FROM rows_dealt)"""
_STAGE_OF_LINES = f"""
    SELECT dealt_id AS edition_id, work_id, title, subtitle, author, publisher, publish_year AS published_year, isbn_raw AS isbn_13, page_count, cover_url
    FROM ({EDITION}, {_STAGE_ID} AS dealt_id FROM rows_dealt) WHERE is_english"""


def edition_lines(w: World) -> DataFrame:
    """The lines editions are made of, with their works, written once."""
    return written(w.sql(_LINES))


def _dealt(w: World, text: str, lines: DataFrame, key: str) -> DataFrame:
    """The distinct rows ``text`` makes of ``lines`` dealt by the id that ``key`` makes of them."""
    return w.sql_over(text, dealt=lines.repartition(F.expr(key))).distinct()


def live_editions(w: World, lines: DataFrame | None = None) -> DataFrame:
    rows = _by_edition(w.sql(_LIVE_ROWS)) if lines is None else _dealt(w, _LIVE_OF_LINES, lines, _LIVE_ID)
    return rows.selectExpr(
        "edition_id", "work_id", "title", "isbn_13", "page_count", "cover_url", "language", "'google_books' AS source", "concat('g', substr(edition_id, 4)) AS external_id",
        "CAST(NULL AS STRING) AS subtitle", "author", "publisher", "published_year", "CASE WHEN page_count > 200 THEN 'text' END AS description", "CAST(NULL AS INT) AS ratings_count")


def stage_editions(w: World, lines: DataFrame | None = None) -> DataFrame:
    rows = _by_edition(w.sql(_STAGE_ROWS)) if lines is None else _dealt(w, _STAGE_OF_LINES, lines, _STAGE_ID)
    return rows.selectExpr(
        "edition_id AS id", "CASE WHEN page_count > 200 THEN substr(edition_id, 4) ELSE edition_id END AS ol_edition_id", "work_id", "title", "subtitle", "author", "publisher",
        "published_year", "isbn_13", "page_count", "cover_url", "'en' AS language")


def live(w: World, lines: DataFrame | None = None) -> C.Tables:
    works = w.sql(WORKS).withColumn("canonical_key", T.canonical_key(F.col("title"), F.col("author"))).drop("work_num")
    return {"works": works, "series": w.sql(SERIES), "editions": live_editions(w, lines), "threads": w.sql(THREADS), "shelves": w.sql(SHELVES), "votes": w.sql(VOTES),
            "inferences": w.sql(INFERENCES), "vetoes": w.sql(VETOES), "members": w.sql(MEMBERS), "aliases": w.sql(ALIASES),
            "releases": w.spark.createDataFrame([("2025.12.1",)], "version string")}


def stage(w: World, lines: DataFrame | None = None) -> C.Tables:
    works = w.sql(STAGE_WORKS).withColumn("canonical_key", T.canonical_key(F.col("title"), F.col("author"))).drop("work_num", "shelf_mark")
    return {"works": works, "series": w.sql(STAGE_SERIES), "editions": stage_editions(w, lines), "series_members": w.sql(STAGE_MEMBERS), "work_aliases": w.sql(STAGE_ALIASES)}


_INFER_STAGE = f"""
    li AS (SELECT id, {Q.norm('line')} AS t FROM (SELECT id, unnest(string_split(subjects, chr(10))) AS line FROM ({STAGE_WORKS})) WHERE NOT regexp_matches(line, '(?i)^\\s*[a-z_]+\\s*:')),
    tax AS (SELECT slug, kind, {Q.norm('phrase')} AS phrase FROM fx_taxonomy),
    gs AS (SELECT DISTINCT l.id, m.slug FROM li l JOIN tax m ON m.kind = 'match' AND contains(' ' || l.t || ' ', ' ' || m.phrase || ' ')
      WHERE NOT EXISTS (SELECT 1 FROM tax x WHERE x.kind = 'exclude' AND x.slug = m.slug AND contains(' ' || l.t || ' ', ' ' || x.phrase || ' ')))"""


@query("c01_stage_release", f"WITH {_INFER_STAGE} SELECT s.id, coalesce((SELECT string_agg(slug, '|' ORDER BY slug) FROM gs WHERE gs.id = s.id), '') AS genre_slugs FROM ({STAGE_WORKS}) s")
def c01(w: World) -> DataFrame:
    works, _ = C.stage_release(stage(w), w.fx("taxonomy"))
    return works.select("id", F.array_join("genre_slugs", "|").alias("genre_slugs"))


@query("c01_stage_counts", f"""
    SELECT 'works' AS "table", count(*) AS rows FROM ({STAGE_WORKS}) UNION ALL SELECT 'series', count(*) FROM ({STAGE_SERIES}) UNION ALL SELECT 'editions', count(*) FROM ({STAGE_EDITIONS})
    UNION ALL SELECT 'series_members', count(*) FROM ({STAGE_MEMBERS}) UNION ALL SELECT 'work_aliases', count(*) FROM ({STAGE_ALIASES})""")
def c01_counts(w: World) -> DataFrame:
    return C.stage_release(stage(w), w.fx("taxonomy"))[1]


@query("c02_reslug_collisions", f"""
    WITH s AS ({SERIES}), t AS ({STAGE_SERIES}), taken AS (SELECT slug FROM s UNION SELECT slug FROM t), hit AS (SELECT s.series_id, s.slug FROM s JOIN t ON t.slug = s.slug WHERE s.series_id <> t.id),
    free AS (SELECT slug, min(n) AS n FROM (SELECT slug, unnest(range(2, 2000)) AS n FROM hit) h WHERE h.slug || '-' || n NOT IN (SELECT slug FROM taken) GROUP BY 1)
    SELECT s.series_id, CASE WHEN h.series_id IS NOT NULL THEN s.slug || '-' || f.n ELSE s.slug END AS slug FROM s LEFT JOIN hit h ON h.series_id = s.series_id LEFT JOIN free f ON f.slug = h.slug""")
def c02(w: World) -> DataFrame:
    return C.reslug_collisions(w.sql(SERIES), w.sql(STAGE_SERIES)).select("series_id", "slug")


# A release work answers to its own id before an alias does, and to a key that no other release work has.
_ADOPT = f"""
    known AS (SELECT ol_id, arg_min(id, pref) AS id FROM (SELECT ol_work_id AS ol_id, id, 1 AS pref FROM ({STAGE_WORKS}) UNION ALL SELECT ol_work_id, work_id, 2 FROM ({STAGE_ALIASES})) WHERE ol_id IS NOT NULL GROUP BY ol_id),
    keyed AS (SELECT id, {_KEY} AS k FROM ({STAGE_WORKS})), sole AS (SELECT k, any_value(id) AS id FROM keyed GROUP BY k HAVING count(id) = 1),
    own AS (SELECT work_id, source, external_id, {_KEY} AS k FROM ({WORKS}) WHERE coalesce(catalog_release, merged_into) IS NULL),
    adopt AS (SELECT work_id AS runtime, CASE source WHEN 'openlibrary' THEN known.id WHEN 'heuristic' THEN sole.id END AS target
      FROM own LEFT JOIN known ON ol_id = external_id LEFT JOIN sole USING (k) WHERE target IS NOT NULL)"""


@query("c03_adoptions", f"WITH {_ADOPT} SELECT * FROM adopt")
def c03(w: World) -> DataFrame:
    return C.adoptions(live(w)["works"], stage(w)["works"], w.sql(STAGE_ALIASES))


_C04_WORK = ("work_id", "source", "external_id", "series_id", "catalog_release", "merged_into", "representative", "subjects", "title", "subtitle", "author", "first_publish_year",
             "ol_cover_id", "ol_edition_count", "readinglog_count", "ratings_count", "identity_provenance")


@query("c04_upsert_catalog_works", f"""
    WITH lw AS ({WORKS}), sw AS ({STAGE_WORKS}), new AS (SELECT id AS work_id, 'openlibrary' AS source, ol_work_id AS external_id, series_id, '2026.01.1' AS catalog_release, NULL AS merged_into, representative_edition_id AS representative, subjects, title, subtitle,
        author, first_publish_year, ol_cover_id, ol_edition_count, readinglog_count, ratings_count, 'isbn' AS identity_provenance FROM sw)
    SELECT {", ".join(_C04_WORK)} FROM lw WHERE work_id NOT IN (SELECT id FROM sw)
    UNION ALL SELECT n.* REPLACE (coalesce(l.representative, n.representative) AS representative, coalesce(l.source, n.source) AS source, coalesce(l.identity_provenance, n.identity_provenance) AS identity_provenance)
      FROM new n LEFT JOIN lw l ON l.work_id = n.work_id""")
def c04(w: World) -> DataFrame:
    return C.upsert_catalog(live(w), stage(w), "2026.01.1")["works"].select(*_C04_WORK)


_C04_EDITION = ("edition_id", "source", "external_id", "work_id", "title", "subtitle", "author", "publisher", "published_year", "isbn_13", "page_count", "cover_url", "language")


@query("c04_upsert_catalog_editions", f"""
    WITH le AS ({EDITIONS}), new AS (SELECT id AS edition_id, 'openlibrary' AS source, ol_edition_id AS external_id, work_id, title, subtitle, author, publisher, published_year, isbn_13, page_count, cover_url, language FROM ({STAGE_EDITIONS}))
    SELECT {", ".join(_C04_EDITION)} FROM le WHERE edition_id NOT IN (SELECT edition_id FROM new)
    UNION ALL SELECT n.* REPLACE (coalesce(l.source, n.source) AS source, coalesce(l.external_id, n.external_id) AS external_id) FROM new n LEFT JOIN le l ON l.edition_id = n.edition_id""")
def c04_editions(w: World) -> DataFrame:
    lines = edition_lines(w)
    return C.upsert_catalog(live(w, lines), stage(w, lines), "2026.01.1")["editions"].select(*_C04_EDITION)


@query("c04_upsert_catalog_series", f"""
    WITH l AS ({SERIES}), s AS ({STAGE_SERIES}) SELECT coalesce(l.series_id, s.id) AS series_id, coalesce(s.slug, l.slug) AS slug, CASE WHEN s.id IS NOT NULL THEN '2026.01.1' ELSE l.catalog_release END AS catalog_release
    FROM l FULL JOIN s ON s.id = l.series_id""")
def c04_series(w: World) -> DataFrame:
    return C.upsert_catalog(live(w), stage(w), "2026.01.1")["series"].select("series_id", "slug", "catalog_release")


@query("c05_sync_members", f"""
    WITH m AS ({MEMBERS}), t AS ({STAGE_MEMBERS}), s AS ({SERIES}) SELECT * FROM t UNION ALL SELECT m.* FROM m JOIN s ON s.series_id = m.series_id WHERE s.catalog_release IS NULL""")
def c05(w: World) -> DataFrame:
    return C.sync_members(w.sql(MEMBERS), w.sql(SERIES), w.sql(STAGE_MEMBERS))


_MY_ALIASES = "SELECT concat('OLalias', work_num, 'W') AS ol_work_id, 'old' AS work_id FROM fx_work WHERE shelf_mark IN ('STANDARD', 'LARGE')"


@query("c06_upsert_aliases", f"WITH a AS ({_MY_ALIASES}), t AS ({STAGE_ALIASES}) SELECT * FROM t UNION ALL SELECT * FROM a WHERE ol_work_id NOT IN (SELECT ol_work_id FROM t)")
def c06(w: World) -> DataFrame:
    return C.upsert_aliases(w.sql(_MY_ALIASES), w.sql(STAGE_ALIASES))


_OLD_ROOMS = "SELECT work_id, concat('s-', author) AS series_id FROM fx_work"
_NEW_ROOMS = "SELECT work_id, concat('s-', CASE WHEN readinglog_count > 20 THEN 'new' ELSE author END) AS series_id FROM fx_work"
_TAGGED = "SELECT event_id AS thread_id, concat('OL', event_id % 1999 + 1, 'W') AS work_id, CASE WHEN event_type = 'view' THEN 's-other' ELSE concat('s-', p_brand) END AS series_id, event_type FROM events JOIN part ON p_partkey = event_id % 1999"


@query("c07_move_tagged_threads", f"""
    WITH o AS ({_OLD_ROOMS}), n AS ({_NEW_ROOMS}), t AS ({_TAGGED}) SELECT t.thread_id, t.work_id, CASE WHEN o.series_id <> n.series_id AND t.series_id = o.series_id THEN n.series_id ELSE t.series_id END AS series_id, t.event_type
    FROM t LEFT JOIN o ON o.work_id = t.work_id LEFT JOIN n ON n.work_id = t.work_id""")
def c07(w: World) -> DataFrame:
    return C.move_tagged_threads(w.sql(_TAGGED), w.sql(_OLD_ROOMS), w.sql(_NEW_ROOMS))[0]


_MERGES = "SELECT concat('rt-', work_num) AS loser, CASE WHEN shelf_mark = 'LARGE' THEN concat('rt-', work_num + 1) ELSE concat('OL', work_num, 'W') END AS survivor FROM fx_work WHERE shelf_mark IN ('LARGE', 'MEDIUM', 'STANDARD')"
_MERGED = f"""
    lw AS ({WORKS}), al AS (SELECT * FROM ({_MERGES}) WHERE loser IN (SELECT work_id FROM lw) AND survivor IN (SELECT work_id FROM lw)), chase AS (SELECT loser, survivor AS node, 1 AS hop FROM al UNION ALL SELECT c.loser, a.survivor, c.hop + 1 FROM chase c JOIN al a ON a.loser = c.node),
    flat AS (SELECT loser, arg_max(node, hop) AS survivor FROM chase GROUP BY 1), fl AS (SELECT f.* FROM flat f WHERE f.loser IN (SELECT work_id FROM lw) AND f.survivor IN (SELECT work_id FROM lw)),
    se AS ({SERIES}), pairs AS (SELECT f.*, a.series_id AS fr, b.series_id AS tr, s.kind FROM fl f JOIN lw a ON a.work_id = f.loser JOIN lw b ON b.work_id = f.survivor LEFT JOIN se s ON s.series_id = a.series_id),
    lv AS (SELECT * FROM pairs WHERE fr IS DISTINCT FROM tr), em AS (SELECT fr, arg_min(tr, loser) AS nr, min(loser) AS book FROM lv WHERE kind = 'singleton' GROUP BY 1),
    th AS ({THREADS}), t1 AS (SELECT th.thread_id, th.series_id, coalesce(th.work_id, em.book) AS work_id FROM th LEFT JOIN em ON em.fr = th.series_id),
    t2 AS (SELECT t1.thread_id, coalesce(lv.tr, t1.series_id) AS series_id, coalesce(fl.survivor, t1.work_id) AS work_id FROM t1 LEFT JOIN lv ON lv.loser = t1.work_id LEFT JOIN fl ON fl.loser = t1.work_id),
    sh AS ({SHELVES}), s1 AS (SELECT sh.*, coalesce(fl.survivor, sh.work_id) AS w2, fl.loser FROM sh LEFT JOIN fl ON fl.loser = sh.work_id),
    ed AS (SELECT e.* REPLACE (coalesce(fl.survivor, e.work_id) AS work_id) FROM ({EDITIONS}) e LEFT JOIN fl ON fl.loser = e.work_id),
    best AS (SELECT work_id, arg_max(edition_id, {_rank_sql()}) AS best FROM ed WHERE work_id IN (SELECT survivor FROM fl) GROUP BY 1)"""


def _merged(w: World) -> C.Tables:
    return C.merge_works(w.sql(_MERGES), live(w))


@query("c08_merge_works", f"""
    WITH RECURSIVE {_MERGED} SELECT w.work_id, coalesce(lv.tr, em.nr, w.series_id) AS series_id, coalesce(f.survivor, g.survivor, w.merged_into) AS merged_into, CASE WHEN f.loser IS NULL THEN coalesce(b.best, w.representative) END AS representative
    FROM lw w LEFT JOIN fl f ON f.loser = w.work_id LEFT JOIN fl g ON g.loser = w.merged_into LEFT JOIN lv ON lv.loser = w.work_id LEFT JOIN em ON em.fr = w.series_id LEFT JOIN best b ON b.work_id = w.work_id""")
def c08(w: World) -> DataFrame:
    return _merged(w)["works"].select("work_id", "series_id", "merged_into", "representative")


@query("c08_merge_threads", f"WITH RECURSIVE {_MERGED} SELECT * FROM t2")
def c08_threads(w: World) -> DataFrame:
    return _merged(w)["threads"].select("thread_id", "series_id", "work_id")


@query("c08_merge_shelves", f"WITH RECURSIVE {_MERGED} SELECT user_id, w2 AS work_id, shelf_id, status FROM s1 QUALIFY row_number() OVER (PARTITION BY user_id, w2 ORDER BY loser IS NOT NULL, loser, created_at, shelf_id) = 1")
def c08_shelves(w: World) -> DataFrame:
    return _merged(w)["shelves"].select("user_id", "work_id", "shelf_id", "status")


@query("c08_merge_series", f"WITH RECURSIVE {_MERGED} SELECT s.series_id, coalesce(em.nr, s.merged_into) AS merged_into FROM se s LEFT JOIN em ON em.fr = s.series_id")
def c08_series(w: World) -> DataFrame:
    return _merged(w)["series"].select("series_id", "merged_into")


_FORMER = "SELECT concat('rt-room-', series_id) AS room, work_id FROM fx_work"


def _retire_tables(w: World) -> C.Tables:
    tables = live(w)
    works = tables["works"].withColumn("merged_into", F.when(
        F.col("series_id").isin(*[f"rt-room-{i}" for i in (1, 2, 3, 5, 8, 13)]), F.lit("x")).otherwise(F.col("merged_into")))
    return {**tables, "works": works}


_RETIRED = f"""
    lw AS (SELECT * REPLACE (CASE WHEN series_id IN ('rt-room-1', 'rt-room-2', 'rt-room-3', 'rt-room-5', 'rt-room-8', 'rt-room-13') THEN 'x' ELSE merged_into END AS merged_into) FROM ({WORKS})), fm AS ({_FORMER}),
    emp AS (SELECT * FROM fm WHERE room NOT IN (SELECT series_id FROM lw WHERE merged_into IS NULL)),
    cnt AS (SELECT e.room, l.series_id, count(*) AS n FROM emp e JOIN lw l ON l.work_id = e.work_id WHERE l.series_id <> e.room GROUP BY 1, 2),
    ret AS (SELECT room, arg_min(series_id, (-n, series_id)) AS survivor FROM cnt GROUP BY 1)"""


@query("c09_retire_rooms", f"WITH {_RETIRED} SELECT l.work_id, coalesce(r.survivor, l.series_id) AS series_id FROM lw l LEFT JOIN ret r ON r.room = l.series_id")
def c09(w: World) -> DataFrame:
    return C.retire_rooms(_retire_tables(w), w.sql(_FORMER))[0]["works"].select("work_id", "series_id")


@query("c09_retired", f"WITH {_RETIRED} SELECT * FROM ret")
def c09_retired(w: World) -> DataFrame:
    return C.retire_rooms(_retire_tables(w), w.sql(_FORMER))[1].select("room", "survivor")


_FATE = f"""
    lw AS ({WORKS}), used AS (SELECT work_id FROM ({THREADS}) UNION SELECT work_id FROM ({SHELVES})),
    absent AS (SELECT work_id, external_id FROM lw ANTI JOIN (SELECT id FROM ({STAGE_WORKS})) ON id = work_id WHERE merged_into IS NULL AND nullif(catalog_release, '2026.01.1') IS NOT NULL),
    fate AS (SELECT o.work_id, min(a.work_id) AS target, CASE WHEN count(a.work_id) > 0 THEN 'merge' WHEN count(u.work_id) > 0 THEN 'keep' ELSE 'delete' END AS fate
      FROM absent o LEFT JOIN ({STAGE_ALIASES}) a ON a.ol_work_id = o.external_id LEFT JOIN used u ON u.work_id = o.work_id GROUP BY o.work_id)"""


def _settled(w: World):
    tables = live(w)
    old = tables["works"].filter("catalog_release IS NOT NULL").select("work_id", "series_id")
    return C.settle_absent(tables, stage(w), "2026.01.1", old)


@query("c10_settle_absent", f"""
    WITH RECURSIVE {_FATE}, mg AS (SELECT work_id AS loser, target AS survivor FROM fate WHERE fate = 'merge' AND target IN (SELECT work_id FROM lw)),
    ch AS (SELECT loser, survivor AS node, 1 AS hop FROM mg UNION ALL SELECT c.loser, m.survivor, c.hop + 1 FROM ch c JOIN mg m ON m.loser = c.node), fin AS (SELECT loser, arg_max(node, hop) AS survivor FROM ch GROUP BY 1),
    aft AS (SELECT w.work_id, coalesce(f.survivor, g.survivor, w.merged_into) AS merged_into FROM lw w LEFT JOIN fin f ON f.loser = w.work_id LEFT JOIN fin g ON g.loser = w.merged_into), gone AS (SELECT work_id FROM fate WHERE fate = 'delete')
    SELECT * FROM aft WHERE work_id NOT IN (SELECT work_id FROM gone) AND coalesce(merged_into, '') NOT IN (SELECT work_id FROM gone)""")
def c10(w: World) -> DataFrame:
    return _settled(w)[0]["works"].select("work_id", "merged_into")


@query("c10_settle_stats", f"""
    WITH RECURSIVE {_FATE}, th AS ({THREADS}), mg AS (SELECT work_id AS loser, target AS survivor FROM fate WHERE fate = 'merge' AND target IN (SELECT work_id FROM lw)),
    ch AS (SELECT loser, survivor AS node, 1 AS hop FROM mg UNION ALL SELECT c.loser, m.survivor, c.hop + 1 FROM ch c JOIN mg m ON m.loser = c.node), fin AS (SELECT loser, arg_max(node, hop) AS survivor FROM ch GROUP BY 1),
    now AS (SELECT w.work_id, coalesce(t.series_id, w.series_id) AS room, coalesce(f.survivor, g.survivor, w.merged_into) AS merged_into FROM lw w LEFT JOIN fin f ON f.loser = w.work_id LEFT JOIN lw t ON t.work_id = f.survivor
      LEFT JOIN fin g ON g.loser = w.merged_into),
    kept AS (SELECT * FROM now WHERE work_id NOT IN (SELECT work_id FROM fate WHERE fate = 'delete') AND coalesce(merged_into, '') NOT IN (SELECT work_id FROM fate WHERE fate = 'delete')),
    old AS (SELECT series_id FROM ({SERIES}) WHERE catalog_release <> '2026.01.1' AND merged_into IS NULL AND series_id NOT IN (SELECT id FROM ({STAGE_SERIES}))),
    held AS (SELECT room FROM kept UNION SELECT series_id FROM th),
    retired AS (SELECT DISTINCT lw.series_id AS room FROM lw JOIN kept USING (work_id) WHERE catalog_release IS NOT NULL AND lw.series_id IN (SELECT series_id FROM old) AND lw.series_id IN (SELECT room FROM held) AND kept.room <> lw.series_id)
    SELECT 'kept_works' AS metric, count(*) FILTER (WHERE fate = 'keep') AS value FROM fate UNION ALL SELECT 'deleted_works', count(*) FILTER (WHERE fate = 'delete') FROM fate
    UNION ALL SELECT 'merged_works', count(*) FILTER (WHERE fate = 'merge') FROM fate UNION ALL SELECT 'deleted_series', count(*) FROM old WHERE series_id NOT IN (SELECT room FROM held)
    UNION ALL SELECT 'retired_series', count(*) FROM retired UNION ALL SELECT 'moved_threads', count(*) FROM th WHERE series_id IN (SELECT room FROM retired)""")
def c10_stats(w: World) -> DataFrame:
    return _settled(w)[1]


def _genres(w: World) -> DataFrame:
    return w.sql("SELECT CAST(row_number() OVER (ORDER BY slug) AS INT) AS genre_id, slug, CAST(NULL AS INT) AS parent_id, false AS retired FROM (SELECT DISTINCT slug FROM fx_taxonomy)")


def _loaded(w: World):
    lines = edition_lines(w)
    return C.load_release(live(w, lines), stage(w, lines), "2026.01.1", w.fx("taxonomy"), _genres(w))


@query("c11_load_release")
def c11(w: World) -> DataFrame:
    return _loaded(w)[0]["works"].select("work_id", "external_id", "series_id", "catalog_release", "merged_into")


@query("c11_pinned_version", f"""
    SELECT 'works' AS name, count(*) AS rows FROM ({WORKS}) UNION ALL SELECT 'series', count(*) FROM ({SERIES}) UNION ALL SELECT 'threads', count(*) FROM ({THREADS})
    UNION ALL SELECT 'shelves', count(*) FROM ({SHELVES}) UNION ALL SELECT 'members', count(*) FROM ({MEMBERS})
    UNION ALL SELECT 'loaded works', count(*) FROM ({STAGE_WORKS})""")
def c11_pinned(w: World) -> DataFrame:
    """A reader that opened the tables before a load was published still reads them; the next one sees the release."""
    root = f"{ensure_checkpoint_dir(w.spark)}/live-{uuid.uuid4().hex}"
    lines = edition_lines(w)
    P.publish(w.spark, root, live(w, lines))
    pinned = P.open_live(w.spark, root)
    after, _ = P.load_and_publish(w.spark, root, stage(w, lines), "2026.01.1", w.fx("taxonomy"), _genres(w))
    counts = after.tables["works"].filter("catalog_release = '2026.01.1'").agg(F.lit("loaded works").alias("name"), F.count("*").alias("rows"))
    for name in ("works", "series", "threads", "shelves", "members"):
        counts = counts.unionByName(pinned.tables[name].agg(F.lit(name).alias("name"), F.count("*").alias("rows")))
    return counts


_PREVIEW = "SELECT concat('rt-', work_num) AS source, work_id AS target FROM fx_work WHERE shelf_mark IN ('LARGE', 'MEDIUM') UNION ALL SELECT concat('rt-', work_num), concat('rt-', work_num + 1) FROM fx_work"


@query("c12_merge_preview", f"""
    WITH lw AS ({WORKS}), se AS ({SERIES}), th AS ({THREADS}), pv AS ({_PREVIEW}),
    tg AS (SELECT work_id, count(*) AS n FROM th WHERE work_id IS NOT NULL GROUP BY 1), ut AS (SELECT series_id, count(*) AS n FROM th WHERE work_id IS NULL GROUP BY 1),
    sh AS (SELECT work_id, count(*) AS n FROM ({SHELVES}) GROUP BY 1), ed AS (SELECT work_id, count(*) AS n FROM ({EDITIONS}) GROUP BY 1), vo AS (SELECT work_id, count(*) AS n FROM ({VOTES}) GROUP BY 1),
    side AS (SELECT w.work_id, w.series_id, s.kind, coalesce(tg.n, 0) AS tg, coalesce(ut.n, 0) AS ut, coalesce(sh.n, 0) AS sh, coalesce(ed.n, 0) AS ed, coalesce(vo.n, 0) AS vo FROM lw w LEFT JOIN se s ON s.series_id = w.series_id
      LEFT JOIN tg ON tg.work_id = w.work_id LEFT JOIN ut ON ut.series_id = w.series_id LEFT JOIN sh ON sh.work_id = w.work_id LEFT JOIN ed ON ed.work_id = w.work_id LEFT JOIN vo ON vo.work_id = w.work_id)
    SELECT p.source, p.target, a.tg + CASE WHEN a.kind = 'singleton' AND a.series_id IS DISTINCT FROM b.series_id THEN a.ut ELSE 0 END AS threads, a.sh AS shelves, a.ed AS editions, a.vo AS genre_votes,
      a.tg + CASE WHEN a.kind = 'singleton' THEN a.ut ELSE 0 END AS source_threads, b.tg + CASE WHEN b.kind = 'singleton' THEN b.ut ELSE 0 END AS target_threads, b.sh AS target_shelves, b.ed AS target_editions
    FROM pv p JOIN side a ON a.work_id = p.source JOIN side b ON b.work_id = p.target WHERE p.source <> p.target""")
def c12(w: World) -> DataFrame:
    return C.merge_preview(w.sql(_PREVIEW), live(w))
