"""Release checks, report figures and the streaming counters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import quality as A
from foliant.operators import series as L
from foliant.plans import check_sql as Q
from foliant.plans.q_graph import RESOLVED
from foliant.plans.q_select import _REASONS, _selected
from foliant.plans.q_series import CANDS, _AUTHORS, _REJECTED, DECIDED, cands, rejected, solid
from foliant.plans.q_sources import _POPULARITY, _RELEASE_COUNTS, release_tables
from foliant.plans.world import World, query
from foliant.session import ensure_checkpoint_dir
from foliant.streaming import counters as ST

_MEMBERS = """
    SELECT concat('ol:', lower(p_type), ' saga') AS key, concat('OL', p_partkey + 1, 'W') AS work_id, CAST(CASE WHEN p_type = 'SMALL' THEN p_size % 7 ELSE p_size % 9 END AS DOUBLE) AS position, 1950 + p_size AS first_publish_year, p_name AS title
    FROM part WHERE p_size <= CASE WHEN p_type = 'PROMO' THEN 15 WHEN p_type = 'LARGE' THEN 17 ELSE 16 END"""
_GALIAS = "SELECT work_id AS ol_id, merged_into AS work_id FROM fx_work WHERE merged_into = 'OL0W'"
_GOLD = f"""
    m AS ({_MEMBERS}), g AS (SELECT name, work_id, row_number() OVER (PARTITION BY name ORDER BY seq) AS wanted FROM fx_golden),
    vt AS (SELECT g.name, m.key, count(*) AS n FROM g JOIN m ON m.work_id = g.work_id GROUP BY 1, 2), ch AS (SELECT name, arg_min(key, (-n, key)) AS key FROM vt GROUP BY 1),
    ac AS (SELECT ch.name, m.work_id, row_number() OVER (PARTITION BY ch.name ORDER BY position NULLS LAST, first_publish_year NULLS LAST, title, m.work_id) AS found FROM ch JOIN m ON m.key = ch.key),
    bo AS (SELECT coalesce(g.name, ac.name) AS name, coalesce(g.work_id, ac.work_id) AS work_id, g.wanted, ac.found FROM g FULL JOIN ac ON ac.name = g.name AND ac.work_id = g.work_id),
    res AS (SELECT bo.name, ch.key, count(*) FILTER (WHERE found IS NULL) AS missing, count(*) FILTER (WHERE wanted IS NULL) AS unexpected, count(*) FILTER (WHERE wanted IS DISTINCT FROM found) AS misplaced FROM bo LEFT JOIN ch ON ch.name = bo.name GROUP BY 1, 2)"""


def _golden(w: World) -> DataFrame:
    return A.golden_evaluate(w.fx("golden"), w.sql(_MEMBERS), w.sql(_GALIAS))


@query("a01_golden_evaluate", f"WITH {_GOLD} SELECT name, key, missing, unexpected, missing + unexpected = 0 AS membership_ok, misplaced = 0 AS order_ok FROM res")
def a01(w: World) -> DataFrame:
    return _golden(w)


@query("a01_golden_failures", f"WITH {_GOLD} SELECT name, work_id, CASE WHEN found IS NULL THEN 'missing' WHEN wanted IS NULL THEN 'unexpected' ELSE 'misplaced' END AS problem FROM bo WHERE wanted IS DISTINCT FROM found")
def a01_failures(w: World) -> DataFrame:
    return A.golden_failures(w.fx("golden"), w.sql(_MEMBERS), w.sql(_GALIAS))


@query("a02_golden_gate", f"WITH {_GOLD} SELECT count(*) AS total, count(*) FILTER (WHERE missing + unexpected = 0) AS membership_ok, count(*) FILTER (WHERE misplaced = 0) AS order_ok FROM res")
def a02(w: World) -> DataFrame:
    return A.golden_rates(_golden(w))


@query("a03_golden_draft", f"""
    WITH RECURSIVE {RESOLVED}, h AS (SELECT coalesce(r.target, k.ol_id) AS work_id, k.item, k.ol_id, k.ordinal, CASE WHEN regexp_full_match(coalesce(ordinal, ''), '[0-9]{{1,4}}') THEN CAST(ordinal AS DOUBLE) END AS p FROM fx_kg_membership k LEFT JOIN resolved r ON r.id = k.ol_id WHERE k.series = 'Q4')
    SELECT h.work_id, arg_min(p, (item, ol_id, ordinal)) FILTER (WHERE p IS NOT NULL) AS position, coalesce(max(w.raw_title), 'NOT IN CATALOG') AS title FROM h LEFT JOIN fx_work w ON w.work_id = h.work_id AND w.shelf_mark <> 'SMALL' GROUP BY 1""")
def a03(w: World) -> DataFrame:
    works = w.fx("work").filter("shelf_mark <> 'SMALL'").withColumnRenamed("raw_title", "title")
    return A.golden_draft(w.fx("kg_membership"), w.fx("redirect"), w.fx("edition"), works, "Q4")


@query("a04_stage_counts", _RELEASE_COUNTS)
def a04(w: World) -> DataFrame:
    return A.stage_counts(release_tables(w))


@query("a05_drop_tally", f"WITH {_REASONS} SELECT rule, count(*) AS works FROM judged WHERE rule IS NOT NULL GROUP BY 1")
def a05(w: World) -> DataFrame:
    return A.drop_tally(_selected(w)[1])


_DECISIONS = "SELECT work_id, CASE WHEN readinglog_count > 3 THEN CAST(work_num % 5 AS INT) END AS rung FROM fx_work"


@query("a06_rung_shares", f"""
    WITH t AS (SELECT d.rung FROM ({_DECISIONS}) d JOIN fx_work w ON w.work_id = d.work_id ORDER BY w.readinglog_count DESC, w.work_id LIMIT 5000)
    SELECT CASE WHEN rung IS NULL THEN 'singleton' ELSE ['override','wikidata','ol_tag','ol_edition_series','title_pattern'][rung + 1] END AS rung, count(*) AS works, count(*) / (SELECT count(*) FROM t) AS share FROM t GROUP BY 1""")
def a06(w: World) -> DataFrame:
    return A.rung_shares(w.sql(_DECISIONS), w.fx("work"))


_SUSPECT = "SELECT concat(author, '-', shelf_mark) AS key, work_id, CASE WHEN edition_count = 0 THEN NULL WHEN edition_count = 1 THEN readinglog_count + 0.5 ELSE CAST(readinglog_count AS DOUBLE) END AS position FROM fx_work"


@query("a07_suspicious_series", f"""
    WITH m AS (SELECT key, work_id, CAST(position AS DOUBLE) AS position FROM ({_SUSPECT})), b AS (SELECT key, count(*) AS members, count(DISTINCT a.author) AS authors FROM m JOIN ({_AUTHORS}) a ON a.work_id = m.work_id GROUP BY 1),
    sp AS (SELECT key, position, count(*) AS n FROM m WHERE position IS NOT NULL GROUP BY 1, 2),
    du AS (SELECT key, string_agg(CASE WHEN position = floor(position) THEN CAST(CAST(position AS INT) AS VARCHAR) ELSE CAST(position AS VARCHAR) END, ', ' ORDER BY position) AS d FROM sp WHERE n > 1 GROUP BY 1),
    wh AS (SELECT key, CAST(position AS INT) AS p FROM sp WHERE position = floor(position)), rg AS (SELECT key, unnest(range(min(p), max(p) + 1)) AS p FROM wh GROUP BY 1),
    ga AS (SELECT rg.key, string_agg(CAST(rg.p AS VARCHAR), ', ' ORDER BY rg.p) AS g FROM rg WHERE NOT EXISTS (SELECT 1 FROM wh WHERE wh.key = rg.key AND wh.p = rg.p) GROUP BY 1)
    SELECT b.key, b.members, b.authors, coalesce(d, '') AS duplicate_positions, coalesce(g, '') AS gaps FROM b LEFT JOIN du ON du.key = b.key LEFT JOIN ga ON ga.key = b.key WHERE members > 40 OR authors > 1 OR d IS NOT NULL OR g IS NOT NULL""")
def a07(w: World) -> DataFrame:
    return A.suspicious_series(w.sql(_SUSPECT), w.sql(_AUTHORS))


_NEW_ALIASES = "SELECT from_ol AS ol_id, to_ol AS work_id FROM fx_redirect"
_OLD_ALIASES = "SELECT from_ol AS ol_id, to_ol AS work_id FROM fx_redirect r JOIN fx_work w ON w.work_id = r.from_ol WHERE w.shelf_mark = 'SMALL'"
_NEW_SLUGS = "SELECT concat('k', series_id) AS key, lower(name) AS slug FROM fx_series_parent"
_OLD_SLUGS = "SELECT concat('k', series_id) AS key, CASE WHEN parent_id IS NULL THEN name ELSE lower(name) END AS slug FROM fx_series_parent"


@query("a08_release_diff", f"""
    WITH na AS ({_NEW_ALIASES}), oa AS ({_OLD_ALIASES}) SELECT 'moved' AS change, p.work_id AS id, p.room AS before, c.room AS after FROM fx_release_prev p JOIN fx_release_cur c ON c.work_id = p.work_id WHERE p.room <> c.room
    UNION ALL SELECT 'merged', ol_id, NULL, work_id FROM na WHERE ol_id NOT IN (SELECT ol_id FROM oa)
    UNION ALL SELECT 'disappeared', work_id, room, NULL FROM fx_release_prev WHERE work_id NOT IN (SELECT work_id FROM fx_release_cur) AND work_id NOT IN (SELECT ol_id FROM na)
    UNION ALL SELECT 'slug', o.key, o.slug, n.slug FROM ({_OLD_SLUGS}) o JOIN ({_NEW_SLUGS}) n ON n.key = o.key WHERE o.slug <> n.slug""")
def a08(w: World) -> DataFrame:
    return A.release_diff(w.fx("release_cur"), w.fx("release_prev"), w.sql(_NEW_ALIASES), w.sql(_OLD_ALIASES), w.sql(_NEW_SLUGS), w.sql(_OLD_SLUGS))


_ROOM = "('ol:' || " + Q.skey("author") + ")"
_RELEASED = {
    "works": ("id ol_work_id canonical_key title subtitle author first_publish_year kind series_id ol_cover_id ol_edition_count readinglog_count ratings_count subjects representative_edition_id",
              f"SELECT {Q.uuid5("('work:ol:' || work_id)")} AS id, work_id AS ol_work_id, {Q.ckey('raw_title', 'author')} AS canonical_key, raw_title AS title, NULL AS subtitle, author, first_publish_year, {Q.kind('raw_title')} AS kind, "
              f"{Q.uuid5("('series:' || " + _ROOM + ")")} AS series_id, NULL AS ol_cover_id, edition_count AS ol_edition_count, readinglog_count, 0 AS ratings_count, NULL AS subjects, NULL AS representative_edition_id FROM fx_work"),
    "editions": ("id ol_edition_id work_id title subtitle author publisher published_year isbn_13 page_count cover_url language",
                 f"SELECT DISTINCT {Q.uuid5("('edition:ol:' || edition_id)")} AS id, edition_id AS ol_edition_id, {Q.uuid5("('work:ol:' || work_id)")} AS work_id, CASE WHEN trim(title) = '' THEN 'Untitled' ELSE title END AS title, subtitle, "
                 f"NULL AS author, publisher, publish_year AS published_year, {Q.isbn('isbn_raw')} AS isbn_13, page_count, cover_url, 'en' AS language FROM fx_edition"),
    "series": ("id key source provenance name slug canonical_key kind parent_series_id",
               f"SELECT DISTINCT {Q.uuid5("('series:' || " + _ROOM + ")")} AS id, {_ROOM} AS key, 'openlibrary' AS source, 'ol_tag' AS provenance, author AS name, {Q.slug('author')} AS slug, {Q.skey('author')} AS canonical_key, 'series' AS kind, "
               "NULL AS parent_series_id FROM fx_work"),
    "series_members": ("series_id work_id position provenance confidence",
                       f"SELECT {Q.uuid5("('series:' || " + _ROOM + ")")} AS series_id, {Q.uuid5("('work:ol:' || work_id)")} AS work_id, readinglog_count AS position, 'ol_tag' AS provenance, 'medium' AS confidence FROM fx_work"),
    "work_aliases": ("ol_work_id work_id", f"SELECT work_id AS ol_work_id, {Q.uuid5("('work:ol:' || merged_into)")} AS work_id FROM fx_work WHERE merged_into IS NOT NULL"),
}


@query("a09_release_digest", " UNION ALL ".join(f"""SELECT '{name}' AS "table", * FROM ({Q.digest(columns.split(), sql)})""" for name, (columns, sql) in _RELEASED.items()))
def a09(w: World) -> DataFrame:
    return A.release_digest(release_tables(w))


@query("a10_imprint_report", f"WITH RECURSIVE {CANDS}, {_REJECTED} SELECT * FROM rej")
def a10(w: World) -> DataFrame:
    return A.imprint_report(rejected(w, cands(w)))


@query("a06_rung_shares_of_decisions", f"""
    WITH RECURSIVE {DECIDED}, t AS (SELECT d.rung FROM decided d JOIN fx_work w ON w.work_id = d.work_id ORDER BY w.readinglog_count DESC, w.work_id LIMIT 5000)
    SELECT CASE WHEN rung IS NULL THEN 'singleton' ELSE ['wikidata','ol_tag','ol_edition_series','title_pattern'][rung] END AS rung, count(*) AS works, count(*) / (SELECT count(*) FROM t) AS share FROM t GROUP BY 1""")
def a06_decided(w: World) -> DataFrame:
    return A.rung_shares(L.decided_by(w.fx("work"), solid(w)), w.fx("work"))


# --- streaming ------------------------------------------------------------------------------
def _event_stream(w: World) -> DataFrame:
    """The whole table as several files with its events out of order, one file a micro-batch."""
    events, landed = w.table("events"), f"{ensure_checkpoint_dir(w.spark)}/landed-{uuid.uuid4().hex}"
    events.repartition(4, F.xxhash64("event_id")).write.parquet(landed)
    return w.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)


def _folders(w: World) -> tuple[str, str]:
    base = f"{ensure_checkpoint_dir(w.spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


@query("t01_stream_vote_scores", """
    WITH v AS (SELECT user_id, thread_id, arg_max(value, (ts, event_id)) AS value FROM fx_vote GROUP BY 1, 2) SELECT thread_id AS target_id, CAST(sum(value) AS INT) AS score FROM v GROUP BY 1""")
def t01(w: World) -> DataFrame:
    value = F.when(F.col("event_type").isin("click", "purchase"), 1).when(F.col("event_type").isin("error", "signup"), -1).otherwise(0)
    votes = _event_stream(w).select("event_id", "ts", "user_id", (F.col("event_id") % 40).alias("target_id"), value.alias("value"))
    out, state = _folders(w)
    ST.stream_vote_scores(votes, out, state).awaitTermination()
    ST.compact_scores(w.spark, out)
    return ST.published_scores(w.spark, out)[1]


@query("t02_stream_popularity", f"WITH RECURSIVE {RESOLVED} {_POPULARITY}")
def t02(w: World) -> DataFrame:
    work = F.concat(F.lit("OL"), F.floor(F.col("value") * 7).cast("bigint") + 1, F.lit("W"))
    log = _event_stream(w).select(work.alias("ol_id"), F.when(F.col("event_type") == "purchase", "rating").otherwise("reading_log").alias("kind"))
    out, state = _folders(w)
    ST.stream_popularity(log, w.fx("redirect"), out, state).awaitTermination()
    return ST.published_popularity(w.spark, out)
