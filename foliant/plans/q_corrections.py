"""Correction-log jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import corrections as R
from foliant.plans import check_sql as Q
from foliant.plans.q_load import EDITIONS, MEMBERS, SERIES, THREADS, WORKS, edition_lines, live, live_editions
from foliant.plans.q_resolve import _rank_sql
from foliant.plans.world import World, query
from foliant.session import written

_W = "SELECT work_id, raw_title AS title, series_id, merged_into, CASE WHEN shelf_mark = 'SMALL' THEN 'heuristic' ELSE 'openlibrary' END AS source, work_id AS external_id FROM fx_work"
_S = ("SELECT series_id, name, concat('slug-', series_id) AS slug, CASE WHEN series_id % 9 = 8 THEN 0 END AS merged_into, CASE WHEN series_id % 5 = 4 THEN 'singleton' ELSE 'series' END AS kind, "
      "CASE WHEN series_id % 3 = 0 THEN concat('wd:Q', series_id) ELSE concat('franchise:', name) END AS external_id, lower(name) AS canonical_key, CASE WHEN series_id % 2 = 0 THEN '2026.01.1' END AS catalog_release FROM fx_series_parent")
_LATEST = """
    subj AS (SELECT *, CASE WHEN op = 'rename_series' THEN 'series/' || series_id WHEN op = 'veto_genre' THEN 'veto/' || work_id || '/' || genre_id ELSE 'work/' || work_id END AS subject FROM fx_correction),
    lat AS (SELECT subject, correction_id FROM subj WHERE NOT reverted QUALIFY row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, correction_id DESC) = 1)"""
_UNDO = f"""
    {_LATEST}, w AS ({_W}), s AS ({_S}), undo AS (SELECT c.correction_id FROM fx_correction c JOIN lat USING (correction_id) WHERE
      (op = 'rename_series' AND series_id IN (SELECT series_id FROM s WHERE merged_into IS NULL)) OR (op IN ('set_series', 'veto_genre', 'remove_from_series') AND work_id IN (SELECT work_id FROM w WHERE merged_into IS NULL)))"""


@query("r01_corrections_listing", f"""
    WITH {_UNDO}, page AS (SELECT * FROM fx_correction WHERE NOT exportable ORDER BY created_at DESC, correction_id DESC LIMIT 100 OFFSET 10)
    SELECT c.correction_id, c.op, u.username AS user, c.exportable, c.reverted, c.correction_id IN (SELECT correction_id FROM undo) AS undoable, coalesce(l.title, s.name) AS subject, coalesce(ls.slug, s.slug) AS room_slug
    FROM page c LEFT JOIN fx_user u ON u.user_id = c.user_id LEFT JOIN w ON w.work_id = c.work_id LEFT JOIN w l ON l.work_id = coalesce(w.merged_into, w.work_id) LEFT JOIN s ls ON ls.series_id = l.series_id LEFT JOIN s ON s.series_id = c.series_id""")
def r01(w: World) -> DataFrame:
    return R.corrections_listing(w.fx("correction"), w.sql(_W), w.sql(_S), w.fx("user"), True, None, None, 100, 10)


@query("r02_latest_per_subject", f"WITH {_LATEST} SELECT * FROM lat")
def r02(w: World) -> DataFrame:
    return R.latest_per_subject(w.fx("correction"))


@query("r02_undoable", f"WITH {_UNDO} SELECT * FROM undo")
def r02_undoable(w: World) -> DataFrame:
    return R.undoable(w.fx("correction"), w.sql(_W), w.sql(_S))


_PAYLOAD = "SELECT *, concat('name ', correction_id) AS name, CAST(correction_id % 7 AS DOUBLE) AS position FROM fx_correction"
_EXPORT = f"""
    w AS ({_W}), s AS ({_S}), j AS (SELECT c.*, CASE WHEN w.source = 'openlibrary' THEN w.external_id END AS wk, w.title, s.name AS sname, s.catalog_release AS rel,
      CASE WHEN s.kind = 'singleton' THEN NULL WHEN regexp_matches(s.external_id, '^(wd|ol):') THEN s.external_id ELSE 'ol:' || s.canonical_key END AS sk
      FROM ({_PAYLOAD}) c LEFT JOIN w ON w.work_id = c.work_id LEFT JOIN s ON s.series_id = c.series_id WHERE NOT c.reverted),
    v AS (SELECT *, CASE WHEN op = 'veto_genre' THEN 'the pipeline has no genre overrides' WHEN op IN ('set_series', 'remove_from_series', 'merge_works') AND wk IS NULL THEN title || ' has no Open Library id (heuristic work)'
      WHEN op IN ('rename_series', 'remove_from_series') AND rel IS NULL THEN sname || ' is not in a catalog release'
      WHEN op IN ('set_series', 'remove_from_series', 'rename_series') AND sk IS NULL THEN sname || ' is a single book''s page, not a series' END AS reason FROM j)"""


def _exported(w: World):
    return R.export_entries(w.sql(_PAYLOAD), w.sql(_W), w.sql(_S))


@query("r03_export_entries", f"""
    WITH {_EXPORT} SELECT correction_id, op AS kind, CASE WHEN op <> 'rename_series' THEN wk END AS work_key, CASE WHEN op <> 'merge_works' THEN sk END AS series_key,
      CASE WHEN op = 'rename_series' THEN name WHEN op = 'set_series' AND rel IS NULL THEN sname END AS name, CASE WHEN op = 'set_series' THEN position END AS position FROM v WHERE reason IS NULL""")
def r03(w: World) -> DataFrame:
    return _exported(w)[0].drop("created_at")


@query("r03_runtime_only", f"WITH {_EXPORT} SELECT correction_id, reason FROM v WHERE reason IS NOT NULL")
def r03_runtime(w: World) -> DataFrame:
    return _exported(w)[1]


# --- operations on the live snapshot of the load jobs ---------------------------------------
_SET_OPS = """
    SELECT p_partkey AS op_id, CASE WHEN p_type IN ('SMALL', 'PROMO') THEN concat('OL', p_partkey + 1, 'W') ELSE concat('rt-', p_partkey + 1) END AS work_id,
      CASE WHEN p_size <= 15 THEN concat('s-Brand#', p_size) WHEN p_size <= 20 THEN concat('sg-', p_partkey) WHEN p_size <= 30 THEN concat('rt-room-', p_size - 10) END AS series_id,
      CASE WHEN p_size > 45 THEN ' ' WHEN p_size > 40 THEN p_brand WHEN p_size > 30 THEN concat('Fresh ', p_size) END AS new_name, CAST(p_size AS DOUBLE) AS position FROM part"""
_SET = f"""
    lw AS ({WORKS}), se AS ({SERIES}), ops AS ({_SET_OPS}), byname AS (SELECT canonical_key, arg_min(series_id, (catalog_release IS NULL, series_id)) AS id FROM se WHERE kind = 'series' AND merged_into IS NULL AND parent_id IS NULL AND NOT dissolved GROUP BY 1),
    j AS (SELECT o.*, w.series_id AS room, w.merged_into AS wm, w.work_id AS known, {Q.skey('new_name')} AS nk, CASE WHEN o.series_id IS NOT NULL THEN o.series_id ELSE coalesce(b.id, {Q.uuid5("('series:ol:' || " + Q.skey('new_name') + ")")}) END AS target
      FROM ops o LEFT JOIN lw w ON w.work_id = o.work_id LEFT JOIN byname b ON b.canonical_key = {Q.skey('new_name')} AND o.series_id IS NULL),
    v AS (SELECT j.*, CASE WHEN known IS NULL THEN 'unknown_work' WHEN wm IS NOT NULL THEN 'merged_work' WHEN (j.series_id IS NOT NULL) = (new_name IS NOT NULL) THEN 'pick_one' WHEN j.series_id IS NULL AND nk = '' THEN 'no_name'
      WHEN j.series_id IS NOT NULL AND s.series_id IS NULL THEN 'unknown_series' WHEN s.kind = 'singleton' THEN 'singleton' WHEN target = room THEN 'same_room' END AS reason FROM j LEFT JOIN se s ON s.series_id = j.target),
    ok AS (SELECT * FROM v WHERE reason IS NULL)"""


def _set(w: World):
    return R.apply_set_series(w.sql(_SET_OPS), live(w))


@query("r04_set_series_works", f"WITH {_SET} SELECT w.work_id, coalesce(o.target, t.target, w.series_id) AS series_id FROM lw w LEFT JOIN ok o ON o.work_id = w.work_id LEFT JOIN (SELECT room, arg_max(target, op_id) AS target FROM ok WHERE room NOT IN "
       "(SELECT coalesce(o2.target, w2.series_id) FROM lw w2 LEFT JOIN ok o2 ON o2.work_id = w2.work_id WHERE w2.merged_into IS NULL) GROUP BY 1) t ON t.room = w.series_id")
def r04(w: World) -> DataFrame:
    return _set(w)[0]["works"].select("work_id", "series_id")


@query("r04_set_series_members", f"""
    WITH {_SET}, m AS ({MEMBERS}) SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.work_id = m.work_id AND m.series_id IN (ok.room, ok.target))
    UNION ALL SELECT target, work_id, position, 'override', 'high' FROM ok""")
def r04_members(w: World) -> DataFrame:
    return _set(w)[0]["members"]


@query("r04_set_series_refusals", f"WITH {_SET} SELECT op_id, reason FROM v WHERE reason IS NOT NULL")
def r04_refusals(w: World) -> DataFrame:
    return _set(w)[1]


_POSITIONS = "SELECT o_orderkey AS op_id, CASE WHEN o_orderstatus = 'F' THEN concat('rt-', o_custkey + 1) ELSE concat('OL', o_custkey + 1, 'W') END AS work_id, concat('s-', p_brand) AS series_id, CAST(o_orderkey % 11 AS DOUBLE) AS position FROM orders JOIN part ON p_partkey = o_custkey"
_POSITIONED = f"""
    lw AS ({WORKS}), se AS ({SERIES}), m AS ({MEMBERS}), ops AS ({_POSITIONS}), v AS (SELECT o.*, CASE WHEN w.work_id IS NULL THEN 'unknown_work' WHEN w.merged_into IS NOT NULL THEN 'merged_work' WHEN w.series_id <> o.series_id THEN 'not_in_series' END AS reason
      FROM ops o LEFT JOIN lw w ON w.work_id = o.work_id), ch AS (SELECT work_id, series_id, arg_max(position, op_id) AS position FROM v WHERE reason IS NULL GROUP BY 1, 2)"""


@query("r05_set_position", f"WITH {_POSITIONED} SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.work_id = m.work_id AND ch.series_id = m.series_id) UNION ALL SELECT series_id, work_id, position, 'override', 'high' FROM ch")
def r05(w: World) -> DataFrame:
    return R.apply_set_position(w.sql(_POSITIONS), live(w))[0]


@query("r05_set_position_refusals", f"WITH {_POSITIONED} SELECT op_id, reason FROM v WHERE reason IS NOT NULL")
def r05_refusals(w: World) -> DataFrame:
    return R.apply_set_position(w.sql(_POSITIONS), live(w))[1]


_RENAMES = "SELECT o_orderkey AS op_id, CASE WHEN o_orderstatus = 'P' THEN concat('sg-', o_custkey + 1) ELSE concat('s-Brand#', o_custkey % 30) END AS series_id, CASE WHEN o_orderpriority LIKE '1%' THEN '  ' ELSE concat('N', o_orderkey % 3) END AS name FROM orders"
_RENAMED = f"""
    se AS ({SERIES}), ops AS ({_RENAMES}), v AS (SELECT o.*, s.name AS start, CASE WHEN s.series_id IS NULL THEN 'unknown' WHEN s.kind = 'singleton' THEN 'singleton' WHEN trim(o.name) = '' THEN 'empty' END AS reason FROM ops o LEFT JOIN se s ON s.series_id = o.series_id),
    u AS (SELECT *, coalesce(lag(name) OVER (PARTITION BY series_id ORDER BY op_id), start) AS now FROM v WHERE reason IS NULL)"""


@query("r06_rename_series", f"WITH {_RENAMED}, l AS (SELECT series_id, arg_max(name, op_id) AS n FROM u GROUP BY 1) SELECT s.series_id, coalesce(l.n, s.name) AS name, s.slug FROM se s LEFT JOIN l ON l.series_id = s.series_id")
def r06(w: World) -> DataFrame:
    return R.apply_rename(w.sql(_RENAMES), w.sql(SERIES))[0].select("series_id", "name", "slug")


@query("r06_rename_refusals", f"WITH {_RENAMED} SELECT op_id, reason FROM v WHERE reason IS NOT NULL UNION ALL SELECT op_id, 'same' FROM u WHERE name = now")
def r06_refusals(w: World) -> DataFrame:
    return R.apply_rename(w.sql(_RENAMES), w.sql(SERIES))[1]


_REMOVALS = "SELECT p_partkey AS op_id, CASE WHEN p_type = 'SMALL' THEN concat('OL', p_partkey + 1, 'W') ELSE concat('rt-', p_partkey + 1) END AS work_id, CASE WHEN p_type = 'STANDARD' THEN concat('rt-room-', p_size % 25) WHEN p_size > 40 THEN 's-nowhere' ELSE concat('s-', p_brand) END AS series_id FROM part"
_REMOVED = f"""
    lw AS ({WORKS}), se AS ({SERIES}), ops AS ({_REMOVALS}), v AS (SELECT o.*, w.title, CASE WHEN w.work_id IS NULL THEN 'unknown_work' WHEN w.merged_into IS NOT NULL THEN 'merged_work' WHEN s.series_id IS NULL THEN 'unknown_series' WHEN w.series_id <> o.series_id THEN 'not_in_series' END AS reason
      FROM ops o LEFT JOIN lw w ON w.work_id = o.work_id LEFT JOIN se s ON s.series_id = o.series_id), ok AS (SELECT * FROM v WHERE reason IS NULL)"""


def _removed(w: World):
    return R.apply_remove(w.sql(_REMOVALS), live(w))


@query("r07_remove_works", f"WITH {_REMOVED} SELECT w.work_id, CASE WHEN o.work_id IS NOT NULL THEN {Q.uuid5("('series:singleton:' || w.work_id)")} ELSE w.series_id END AS series_id FROM lw w LEFT JOIN ok o ON o.work_id = w.work_id")
def r07(w: World) -> DataFrame:
    return _removed(w)[0]["works"].select("work_id", "series_id")


@query("r07_remove_series", f"""
    WITH {_REMOVED} SELECT series_id, name, kind FROM se UNION ALL SELECT {Q.uuid5("('series:singleton:' || work_id)")}, title, 'singleton' FROM ok""")
def r07_series(w: World) -> DataFrame:
    return _removed(w)[0]["series"].select("series_id", "name", "kind")


@query("r07_remove_refusals", f"WITH {_REMOVED} SELECT op_id, reason FROM v WHERE reason IS NOT NULL")
def r07_refusals(w: World) -> DataFrame:
    return _removed(w)[1]


_DISSOLVES = "SELECT s_suppkey AS op_id, CASE WHEN s_acctbal > 5000 THEN concat('rt-room-', s_suppkey % 30) ELSE concat('sg-', s_suppkey + 1) END AS series_id FROM supplier"
_DISSOLVED = f"""
    lw AS ({WORKS}), se AS ({SERIES}), ops AS ({_DISSOLVES}), v AS (SELECT o.*, CASE WHEN s.series_id IS NULL THEN 'unknown_series' WHEN s.kind = 'singleton' THEN 'singleton' END AS reason FROM ops o LEFT JOIN se s ON s.series_id = o.series_id),
    ok AS (SELECT series_id, min(op_id) AS op_id FROM v WHERE reason IS NULL GROUP BY 1)"""


def _dissolved(w: World):
    return R.apply_dissolve(w.sql(_DISSOLVES), live(w))


@query("r08_dissolve_works", f"WITH {_DISSOLVED} SELECT w.work_id, CASE WHEN o.series_id IS NOT NULL AND w.merged_into IS NULL THEN {Q.uuid5("('series:singleton:' || w.work_id)")} ELSE w.series_id END AS series_id FROM lw w LEFT JOIN ok o ON o.series_id = w.series_id")
def r08(w: World) -> DataFrame:
    return _dissolved(w)[0]["works"].select("work_id", "series_id")


@query("r08_dissolve_threads", f"""
    WITH {_DISSOLVED}, th AS ({THREADS}) SELECT t.thread_id, CASE WHEN o.series_id IS NOT NULL AND w.merged_into IS NULL AND w.series_id = t.series_id THEN {Q.uuid5("('series:singleton:' || t.work_id)")} ELSE t.series_id END AS series_id
    FROM th t LEFT JOIN lw w ON w.work_id = t.work_id LEFT JOIN ok o ON o.series_id = w.series_id""")
def r08_threads(w: World) -> DataFrame:
    return _dissolved(w)[0]["threads"].select("thread_id", "series_id")


@query("r08_dissolve_refusals", f"WITH {_DISSOLVED} SELECT op_id, reason FROM v WHERE reason IS NOT NULL UNION ALL SELECT op_id, 'dissolved' FROM v WHERE reason IS NULL AND op_id NOT IN (SELECT op_id FROM ok)")
def r08_refusals(w: World) -> DataFrame:
    return _dissolved(w)[1]


_SPLITS = f"SELECT DISTINCT p_partkey AS op_id, e.work_id, CASE WHEN p_size > 45 THEN 'ed-none' WHEN p_size > 40 AND e.work_id LIKE 'rt%' THEN 'ed-x' ELSE e.edition_id END AS edition_id FROM ({EDITIONS}) e JOIN (SELECT *, concat('rt-', p_partkey + 1) AS wk FROM part UNION ALL SELECT *, concat('OL', p_partkey + 1, 'W') FROM part) p ON wk = e.work_id WHERE page_count > 200 OR p_size < 3"
_SPLIT = f"""
    lw AS ({WORKS}), se AS ({SERIES}), ed AS ({EDITIONS}), ops AS (SELECT DISTINCT op_id, work_id, edition_id FROM ({_SPLITS})), tot AS (SELECT work_id, count(*) AS total FROM ed GROUP BY 1),
    a AS (SELECT o.op_id, o.work_id, count(*) AS n, count(*) FILTER (WHERE e.edition_id IS NULL) AS unknown, min(o.edition_id) AS least FROM ops o LEFT JOIN ed e ON e.edition_id = o.edition_id GROUP BY 1, 2),
    v AS (SELECT a.*, CASE WHEN w.work_id IS NULL THEN 'unknown_work' WHEN w.merged_into IS NOT NULL THEN 'merged_work' WHEN unknown > 0 THEN 'unknown_edition' WHEN n = total THEN 'all' END AS reason FROM a LEFT JOIN lw w ON w.work_id = a.work_id LEFT JOIN tot ON tot.work_id = a.work_id),
    ok AS (SELECT *, {Q.uuid5("('work:ol:' || work_id || '~' || least)")} AS new_work FROM v WHERE reason IS NULL),
    own AS (SELECT e.* REPLACE (coalesce(k.new_work, e.work_id) AS work_id) FROM ed e LEFT JOIN ops o ON o.edition_id = e.edition_id AND o.op_id IN (SELECT op_id FROM ok) LEFT JOIN ok k ON k.op_id = o.op_id),
    best AS (SELECT work_id, arg_max(edition_id, {_rank_sql()}) AS best FROM own WHERE work_id IN (SELECT work_id FROM ok UNION SELECT new_work FROM ok) GROUP BY 1)"""


def _split(w: World):
    """The operations and the editions they are applied to; the editions are derived and written once."""
    tables = live(w)
    tables["editions"] = written(live_editions(w, edition_lines(w)))
    view = f"editions_{uuid.uuid4().hex}"
    tables["editions"].createOrReplaceTempView(view)
    ops = written(w.sql(_SPLITS.replace(f"({EDITIONS})", view)).groupBy("op_id", "work_id").agg(F.collect_set("edition_id").alias("editions")))
    w.spark.catalog.dropTempView(view)
    return R.apply_split(ops, tables)


@query("r09_split_works", f"""
    WITH {_SPLIT} SELECT w.work_id, w.external_id, coalesce(b.best, w.representative) AS representative, w.title FROM lw w LEFT JOIN best b ON b.work_id = w.work_id
    UNION ALL SELECT k.new_work, k.work_id || '~' || k.least, b.best, e.title FROM ok k JOIN best b ON b.work_id = k.new_work JOIN ed e ON e.edition_id = b.best""")
def r09(w: World) -> DataFrame:
    return _split(w)[0]["works"].select("work_id", "external_id", "representative", "title")


@query("r09_split_editions", f"WITH {_SPLIT} SELECT edition_id, work_id FROM own")
def r09_editions(w: World) -> DataFrame:
    return _split(w)[0]["editions"].select("edition_id", "work_id")


@query("r09_split_refusals", f"WITH {_SPLIT} SELECT op_id, reason FROM v WHERE reason IS NOT NULL")
def r09_refusals(w: World) -> DataFrame:
    return _split(w)[1]


_VETO_LOG = "SELECT correction_id, created_at, work_id, genre_id, reverted FROM fx_correction"
_VETOED = f"""
    v AS (SELECT c.*, CASE WHEN w.work_id IS NULL THEN 'unknown_work' WHEN w.merged_into IS NOT NULL THEN 'merged' WHEN coalesce(g.retired, true) THEN 'retired_genre' END AS reason
      FROM ({_VETO_LOG}) c LEFT JOIN fx_work w ON w.work_id = c.work_id LEFT JOIN fx_genre g ON g.genre_id = c.genre_id),
    ok AS (SELECT work_id, genre_id, arg_min(correction_id, (created_at, correction_id)) AS correction_id FROM v WHERE reason IS NULL AND NOT reverted GROUP BY 1, 2)"""


@query("r10_apply_vetoes", f"WITH {_VETOED} SELECT * FROM ok")
def r10(w: World) -> DataFrame:
    return R.apply_vetoes(w.sql(_VETO_LOG), w.fx("work"), w.fx("genre"))[0]


@query("r10_veto_refusals", f"WITH {_VETOED} SELECT correction_id, reason FROM v WHERE reason IS NOT NULL UNION ALL SELECT correction_id, 'already_vetoed' FROM v WHERE reason IS NULL AND NOT reverted AND correction_id NOT IN (SELECT correction_id FROM ok)")
def r10_refusals(w: World) -> DataFrame:
    return R.apply_vetoes(w.sql(_VETO_LOG), w.fx("work"), w.fx("genre"))[1]


_UNDO_LOG = """
    SELECT o_orderkey AS correction_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'merge_works' WHEN '2' THEN 'rename_series' WHEN '3' THEN 'rename_series' ELSE 'veto_genre' END AS op,
      CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN NULL ELSE concat('OL', o_custkey + 1, 'W') END AS work_id, concat('s-Brand#', o_custkey % 25 + 1) AS series_id, CAST(100 + o_custkey % 25 AS INT) AS genre_id, o_orderdate AS created_at, o_orderstatus = 'F' AS reverted,
      CASE WHEN substr(o_orderpriority, 1, 1) IN ('2', '3') THEN concat('{"old_name":"before ', o_orderkey, '","name":"', CASE WHEN o_totalprice > 50000 THEN concat('Brand#', o_custkey % 25 + 1) ELSE 'x' END, '"}') ELSE '{}' END AS snapshot FROM orders"""
_REVERTED = f"""
    lg AS ({_UNDO_LOG}), lw AS ({WORKS}), se AS ({SERIES}), subj AS (SELECT *, CASE WHEN op = 'rename_series' THEN 'series/' || series_id WHEN op = 'veto_genre' THEN 'veto/' || work_id || '/' || genre_id ELSE 'work/' || work_id END AS subject FROM lg),
    lat AS (SELECT correction_id FROM subj WHERE NOT reverted QUALIFY row_number() OVER (PARTITION BY subject ORDER BY created_at DESC, correction_id DESC) = 1),
    v AS (SELECT g.*, CASE WHEN op = 'merge_works' THEN 'not_undoable' WHEN reverted THEN 'already_undone' WHEN correction_id NOT IN (SELECT correction_id FROM lat) THEN 'later_fix'
      WHEN op = 'rename_series' AND NOT coalesce(s.merged_into IS NULL AND contains(snapshot, '"name":"' || s.name || '"'), false) THEN 'stale'
      WHEN op = 'veto_genre' AND (w.work_id IS NULL OR w.merged_into IS NOT NULL) THEN 'stale' END AS reason FROM lg g LEFT JOIN se s ON s.series_id = g.series_id LEFT JOIN lw w ON w.work_id = g.work_id)"""


def _reverted(w: World):
    log = w.sql(_UNDO_LOG)
    return R.revert(log.select("correction_id"), log, live(w))


@query("r11_revert_refusals", f"WITH {_REVERTED} SELECT correction_id, reason FROM v WHERE reason IS NOT NULL")
def r11(w: World) -> DataFrame:
    return _reverted(w)[2]


@query("r11_revert_series", f"WITH {_REVERTED} SELECT s.series_id, coalesce('before ' || v.correction_id, s.name) AS name FROM se s LEFT JOIN v ON v.series_id = s.series_id AND v.reason IS NULL AND v.op = 'rename_series'")
def r11_series(w: World) -> DataFrame:
    return _reverted(w)[0]["series"].select("series_id", "name")


_EXPORTED_LOG = """
    SELECT correction_id, reverted, CASE WHEN exportable THEN concat('[{"remove_from_series":{"work":"w","series":"s"}},{"set_series":{"work":"', work_id, '","series":"ol:', series_id, '","position":2}}]') END AS override FROM fx_correction"""


@query("r12_exported_memberships", "SELECT DISTINCT work_id AS work_key, 'ol:' || series_id AS series_key FROM fx_correction WHERE exportable AND NOT reverted")
def r12(w: World) -> DataFrame:
    return R.exported_memberships(w.sql(_EXPORTED_LOG))


@query("r13_edition_listing", "SELECT edition_id, title, publish_year FROM fx_edition WHERE work_id = 'OL77W'")
def r13(w: World) -> DataFrame:
    return R.edition_listing(w.fx("edition"), "OL77W").select("edition_id", "title", "publish_year")
