"""Selection rules and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import filters as L
from foliant.plans.q_graph import RESOLVED
from foliant.plans.world import World, query


@query("f01_read_set", f"""
    WITH RECURSIVE {RESOLVED}, seen AS (SELECT work_id AS id FROM fx_log UNION SELECT ol_id FROM fx_kg_membership WHERE ordinal IS NOT NULL)
    SELECT DISTINCT coalesce(r.target, s.id) AS ol_id FROM seen s LEFT JOIN resolved r ON r.id = s.id
    UNION SELECT work_id FROM fx_edition WHERE page_count > 294""")
def f01(w: World) -> DataFrame:
    kg = w.sql("SELECT ol_id FROM fx_kg_membership WHERE ordinal IS NOT NULL UNION ALL SELECT edition_id FROM fx_edition WHERE page_count > 294")
    logs = w.fx("log").select(F.col("work_id").alias("ol_id"))
    editions = w.fx("edition").select(F.col("edition_id").alias("ol_id"), F.col("work_id").alias("work_ol_id"))
    return L.read_set(logs, kg, w.fx("redirect"), editions)


_JUDGED = """
    SELECT concat('OL', p_partkey + 1, 'W') AS ol_id,
      CASE WHEN p_size = 50 THEN concat(p_name, ' wall Calendar') WHEN p_size = 49 THEN concat('Study guide: ', p_name)
        WHEN p_size = 48 THEN concat('My colouring  book of ', p_name) WHEN p_size = 47 THEN concat(1990 + p_size, ' diary') ELSE p_name END AS title,
      CASE WHEN p_size = 46 THEN 'Dissertations, Academic' WHEN p_size = 45 THEN 'Government publications of X' ELSE p_type END AS subject,
      CASE WHEN p_size = 44 THEN NULL ELSE concat('OL', substr(p_brand, 7), 'A') END AS author_id FROM part"""
_JUDGED_EDITIONS = """
    SELECT work_id AS work_ol_id, is_english, CASE WHEN page_count > 30 THEN page_count END AS number_of_pages,
      CASE WHEN title LIKE 'blue%' THEN 'G.P.O.' WHEN title LIKE 'red%' AND subtitle IS NULL THEN 'ProQuest LLC' ELSE publisher END AS publisher FROM fx_edition"""
_REASONS = f"""
    ev AS (SELECT work_ol_id, max(number_of_pages) AS pages, bool_and(lower(publisher) = 'g.p.o.') AS gpo, bool_and(contains(lower(publisher), 'proquest')) AS pq
      FROM ({_JUDGED_EDITIONS}) WHERE is_english GROUP BY work_ol_id),
    judged AS (SELECT w.ol_id, CASE WHEN e.work_ol_id IS NULL THEN 'not_english' WHEN author_id IS NULL THEN 'no_author' WHEN pages < 40 THEN 'short'
      WHEN contains(lower(title), ' calendar') OR regexp_matches(title, '^20[0-9][0-9] diary') THEN 'calendar' WHEN contains(lower(title), 'colouring') THEN 'colouring_book'
      WHEN subject = 'Dissertations, Academic' OR pq THEN 'thesis' WHEN subject LIKE 'Government publications%' OR gpo THEN 'government_document'
      WHEN lower(title) LIKE 'study guide%' THEN 'study_guide' END AS rule FROM ({_JUDGED}) w LEFT JOIN ev e ON e.work_ol_id = w.ol_id)"""


def _selected(w: World):
    works = w.sql(_JUDGED).select(
        "ol_id", "title", F.array("subject").alias("subjects"), F.array_compact(F.array("author_id")).alias("author_ids"))
    editions = w.sql(_JUDGED_EDITIONS).withColumn("publishers", F.array("publisher"))
    return L.select_works(works, editions)


@query("f02_select_works", f"WITH {_REASONS} SELECT ol_id FROM judged WHERE rule IS NULL")
def f02(w: World) -> DataFrame:
    return _selected(w)[0]


@query("f03_junk_reason", f"WITH {_REASONS} SELECT ol_id, rule FROM judged WHERE rule IS NOT NULL")
def f03(w: World) -> DataFrame:
    return _selected(w)[1]


@query("f04_live_works",
       "SELECT work_id FROM fx_work WHERE merged_into IS NULL AND NOT contains(raw_title, 'Box Set')")
def f04(w: World) -> DataFrame:
    works = w.fx("work").withColumn("kind", T.classify_kind(F.col("raw_title"), F.lit("")))
    return L.live_works(works).select("work_id")


@query("f05_search_filters", """
    SELECT work_id FROM fx_work WHERE author = 'Brand#5' AND first_publish_year BETWEEN 1955 AND 1990
      AND work_id IN (SELECT work_id FROM fx_genre_inference WHERE genre_id = 104)
      AND work_id IN (SELECT work_id FROM fx_genre_vote WHERE genre_id = 104 UNION SELECT work_id FROM fx_genre_inference WHERE genre_id = 104)
    UNION ALL SELECT work_id FROM fx_work WHERE first_publish_year >= 1990 AND work_id IN (SELECT work_id FROM fx_genre_vote WHERE genre_id = 101)
      AND work_id IN (SELECT work_id FROM fx_genre_vote WHERE genre_id = 102)""")
def f05(w: World) -> DataFrame:
    works = w.fx("work").select("work_id", "author", "first_publish_year")
    tagged = w.fx("genre_inference").select("work_id", "genre_id")
    voted = w.fx("genre_vote").select("work_id", "genre_id")
    one = L.search_filters(works, tagged, [104], "brand 5", 1955, 1990)
    two = L.search_filters(works, voted, [101, 102], None, 1990, None)
    return one.select("work_id").unionAll(two.select("work_id"))


_REQUESTS = "SELECT o_orderkey AS filter_id, lower(replace(o_orderpriority, ' ', '-')) AS a, concat('nation-', o_custkey % 30) AS b, year(o_orderdate) AS year_from, 1996 AS year_to FROM orders"


@query("f06_validate_filters", f"""
    WITH req AS ({_REQUESTS}) SELECT filter_id, 'genre' AS param, 'Unknown genre: ' || b || '.' AS message FROM req
      WHERE b NOT IN (SELECT slug FROM fx_genre WHERE NOT retired)
    UNION ALL SELECT filter_id, 'genre', 'Unknown genre: ' || a || '.' FROM req WHERE a NOT IN (SELECT slug FROM fx_genre WHERE NOT retired)
    UNION ALL SELECT filter_id, 'year_to', 'year_to is before year_from.' FROM req WHERE year_from > year_to""")
def f06(w: World) -> DataFrame:
    filters = w.sql(_REQUESTS).select("filter_id", F.array("a", "b").alias("genres"), "year_from", "year_to")
    return L.validate_filters(filters, w.fx("genre"))


@query("f07_real_covers",
       "SELECT url FROM fx_cover_check WHERE status = 200 AND content_type LIKE 'image/%' AND NOT (content_type = 'image/png' AND content_length = 9103)")
def f07(w: World) -> DataFrame:
    return L.real_covers(w.fx("cover_check"))


_V_THREADS = ("SELECT thread_id, CASE WHEN deleted THEN NULL ELSE series_id END AS series_id, CASE WHEN thread_id % 3 = 0 THEN genre_id END AS genre_id, "
              "work_id FROM fx_thread")
_V_VOTES = ("SELECT event_id AS vote_id, user_id, value, CASE WHEN value <> 0 THEN thread_id END AS thread_id, "
            "CASE WHEN value < 0 AND user_id > 100 THEN event_id % 9 END AS post_id FROM fx_vote")
_V_CORRECTIONS = ("SELECT correction_id, CASE WHEN exportable THEN op END AS override, CASE WHEN reverted THEN 'why' END AS runtime_only_reason FROM fx_correction")


@query("v01_check_constraints", f"""
    WITH t AS ({_V_THREADS}), v AS ({_V_VOTES}), c AS ({_V_CORRECTIONS})
    SELECT 'thread_one_home' AS rule, CAST(thread_id AS VARCHAR) AS key FROM t WHERE (series_id IS NOT NULL) = (genre_id IS NOT NULL)
    UNION ALL SELECT 'thread_tag_needs_series', CAST(thread_id AS VARCHAR) FROM t WHERE work_id IS NOT NULL AND series_id IS NULL
    UNION ALL SELECT 'vote_value', CAST(vote_id AS VARCHAR) FROM v WHERE value NOT IN (-1, 1)
    UNION ALL SELECT 'vote_one_target', CAST(vote_id AS VARCHAR) FROM v WHERE (thread_id IS NOT NULL) = (post_id IS NOT NULL)
    UNION ALL SELECT 'vote_user_thread', user_id || '/' || thread_id FROM v WHERE thread_id IS NOT NULL GROUP BY user_id, thread_id HAVING count(*) > 1
    UNION ALL SELECT 'vote_user_post', user_id || '/' || post_id FROM v WHERE post_id IS NOT NULL GROUP BY user_id, post_id HAVING count(*) > 1
    UNION ALL SELECT 'shelf_user_work', user_id || '/' || work_id FROM fx_shelf GROUP BY user_id, work_id HAVING count(*) > 1
    UNION ALL SELECT 'inference_source', work_id || '/' || genre_id FROM fx_genre_inference WHERE source NOT IN ('catalog', 'open_library', 'google')
    UNION ALL SELECT 'correction_export_state', CAST(correction_id AS VARCHAR) FROM c WHERE (override IS NULL) <> (runtime_only_reason IS NOT NULL)""")
def v01(w: World) -> DataFrame:
    return L.check_constraints(w.sql(_V_THREADS), w.sql(_V_VOTES), w.fx("shelf"), w.fx("genre_inference"), w.sql(_V_CORRECTIONS))


_ENTRIES = """
    SELECT 'fixes' AS file, o_orderkey AS idx, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'set_series' WHEN '2' THEN 'remove_from_series'
        WHEN '3' THEN 'rename_series' WHEN '4' THEN CASE WHEN o_totalprice > 400000 THEN 'promote' ELSE 'split_work' END ELSE 'merge_works' END AS kind,
      concat('OL', o_custkey + 900, 'W') AS w1, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('OL', o_custkey + 1, 'W') END AS w2,
      concat('OLe', o_custkey, 'M') AS edition,
      CASE WHEN o_orderstatus = 'P' THEN 'nothing' WHEN o_orderstatus = 'F' THEN concat('ol: Brand#', o_custkey % 40) ELSE concat('wd:Q', o_custkey % 40) END AS series,
      CASE WHEN o_totalprice > 200000 THEN 'New' END AS name FROM orders"""
_OWNERS = "SELECT concat('OLe', c_custkey, 'M') AS edition, concat('OL', c_custkey + 900 + CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END, 'W') AS work FROM customer"
_KNOWN = "SELECT DISTINCT concat('ol:', lower(replace(p_brand, '#', ' '))) AS key FROM part UNION ALL SELECT concat('wd:Q', n_nationkey) FROM nation"
_FOLDED = "SELECT concat('ol:brand ', r_regionkey + 1) AS key, concat('wd:Q', r_regionkey) AS target FROM region"
_MEMBERS = "SELECT DISTINCT concat('OL', o_custkey + 900, 'W') AS work_id, concat('wd:Q', o_custkey % 40) AS key FROM orders WHERE o_totalprice > 250000"


@query("v02_validate_overrides", f"""
    WITH e AS (SELECT *, CASE WHEN NOT contains(series, ':') THEN NULL WHEN series LIKE 'wd:%' THEN series ELSE 'ol:' || lower(replace(substr(series, 5), '#', ' ')) END AS key FROM ({_ENTRIES})),
    known AS ({_KNOWN}), folded AS ({_FOLDED}), members AS ({_MEMBERS}), owners AS ({_OWNERS}), works AS (SELECT work_id FROM fx_work),
    naming AS (SELECT * FROM e WHERE kind IN ('set_series', 'remove_from_series', 'rename_series')),
    ids AS (SELECT file, idx, kind, w1 AS work_id FROM e WHERE kind IN ('set_series', 'remove_from_series', 'split_work', 'merge_works')
      UNION SELECT file, idx, kind, w2 FROM e WHERE kind = 'merge_works' AND w2 IS NOT NULL),
    live AS (SELECT * FROM naming WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM folded))
    SELECT file, idx, 'unknown override ' || kind AS problem FROM e WHERE kind = 'promote'
    UNION ALL SELECT file, idx, 'needs two works' FROM e WHERE kind = 'merge_works' AND w2 IS NULL
    UNION ALL SELECT file, idx, 'malformed series' FROM naming WHERE key IS NULL
    UNION ALL SELECT file, idx, 'unknown work ' || work_id FROM ids WHERE work_id NOT IN (SELECT work_id FROM works)
    UNION ALL SELECT file, idx, 'foreign edition ' || edition FROM e WHERE kind = 'split_work' AND NOT EXISTS (SELECT 1 FROM owners o WHERE o.edition = e.edition AND o.work = e.w1)
    UNION ALL SELECT n.file, n.idx, 'folded into ' || f.target FROM naming n JOIN folded f ON f.key = n.key
    UNION ALL SELECT file, idx, 'no series ' || key FROM live WHERE key NOT IN (SELECT key FROM known) AND NOT (kind = 'set_series' AND key LIKE 'ol:%' AND name IS NOT NULL)
    UNION ALL SELECT file, idx, w1 || ' is not a member of ' || key FROM live l WHERE kind = 'remove_from_series' AND key IN (SELECT key FROM known)
      AND NOT EXISTS (SELECT 1 FROM members m WHERE m.work_id = l.w1 AND m.key = l.key)""")
def v02(w: World) -> DataFrame:
    entries = w.sql(_ENTRIES)
    works = F.when(F.col("kind") == "merge_works", F.array_compact(F.array("w1", "w2"))).when(
        F.col("kind").isin("set_series", "remove_from_series", "split_work"), F.array("w1"))
    overrides = entries.withColumn("works", works).withColumn("editions", F.when(F.col("kind") == "split_work", F.array("edition")))
    return L.validate_overrides(overrides, w.fx("work"), w.sql(_OWNERS), w.sql(_KNOWN), w.sql(_FOLDED), w.sql(_MEMBERS))


_RULES = """
    SELECT CASE WHEN p_size = 50 THEN concat(p_brand, '-x') ELSE concat('g', p_partkey) END AS slug, CASE WHEN p_size = 49 THEN ' ' ELSE p_name END AS name,
      CASE WHEN p_type = 'SMALL' THEN NULL ELSE concat('g', CAST(floor(p_partkey / 3) AS BIGINT)) END AS parent,
      CASE WHEN p_size = 48 THEN 'colour' ELSE 'match' END AS extra, CASE WHEN p_size = 47 THEN '--' ELSE p_type END AS phrase FROM part"""


@query("v03_validate_taxonomy", f"""
    WITH r AS ({_RULES}) SELECT slug, 'bad slug' AS problem FROM r WHERE contains(slug, '#')
    UNION ALL SELECT slug, 'duplicate slug' FROM r GROUP BY slug HAVING count(*) > 1
    UNION ALL SELECT slug, 'empty name' FROM r WHERE name = ' ' UNION ALL SELECT slug, 'unknown key' FROM r WHERE extra = 'colour'
    UNION ALL SELECT slug, 'empty phrase' FROM r WHERE phrase = '--'
    UNION ALL SELECT slug, 'third level' FROM r WHERE parent IN (SELECT slug FROM r WHERE parent IS NOT NULL)""")
def v03(w: World) -> DataFrame:
    rules = w.sql(_RULES).select("slug", "name", "parent", F.array(F.lit("slug"), F.lit("name"), F.col("extra")).alias("keys"),
                                 F.array("phrase").alias("phrases"))
    return L.validate_taxonomy(rules)


@query("v04_stale_subjects",
       "SELECT work_id FROM (SELECT work_id, CASE WHEN work_id LIKE '%7W' THEN string_agg(subject, chr(10) ORDER BY line) ELSE string_agg(subject, ' ' ORDER BY line) END AS s "
       "FROM fx_subject GROUP BY work_id) WHERE NOT contains(s, chr(10)) AND (contains(lower(s), 'series:') OR contains(lower(s), 'franchise:'))")
def v04(w: World) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("line", "subject")))["subject"]
    grouped = w.fx("subject").groupBy("work_id").agg(lines.alias("lines"))
    works = grouped.select("work_id", F.lit("openlibrary").alias("source"), F.when(
        F.col("work_id").like("%7W"), F.array_join("lines", "\n")).otherwise(F.array_join("lines", " ")).alias("subjects"))
    return L.stale_subjects(works)
