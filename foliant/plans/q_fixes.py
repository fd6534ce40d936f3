"""Fixes of all kinds applied to the live snapshot, logged, and undone.

Every order is one operation on the book of its customer's number, or on a series. The six
kinds run one after the other; then an undo of every log row is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import corrections as R
from foliant.operators import fixes as X
from foliant.plans import check_sql as Q
from foliant.plans.q_load import MEMBERS, SERIES, THREADS, WORKS, live
from foliant.plans.world import World, query
from foliant.session import written

_OPS = f"""
    SELECT o_orderkey AS op_id, work_id, series_id AS room, CASE WHEN work_num % 5 = 0 THEN 'set_series' WHEN work_num % 5 = 1 THEN 'remove_from_series' WHEN work_num % 5 = 2 THEN 'set_position'
        WHEN work_num % 5 = 3 THEN 'veto_genre' WHEN o_orderstatus = 'F' THEN 'rename_series' ELSE 'reject_series' END AS op,
      CASE WHEN o_orderkey % 7 < 5 THEN concat('s-Brand#', o_orderkey % 4 + 1) END AS target, CASE WHEN o_orderkey % 7 >= 5 THEN concat('Fresh ', o_orderkey % 3) END AS new_name,
      CAST(o_orderkey % 11 AS DOUBLE) AS position, concat('s-Brand#', 9 + o_orderkey % 7) AS renamed, concat('N', o_orderkey % 3) AS name,
      CASE WHEN o_orderkey % 2 = 0 THEN concat('s-Brand#', 16 + o_custkey % 10) ELSE concat('rt-room-', o_custkey % 5) END AS rejected, CAST(100 + o_custkey % 25 AS INT) AS genre_id
    FROM orders JOIN ({WORKS}) w ON w.work_num = o_custkey + 1"""


def _fixed(w: World) -> tuple:
    """The tables after all fixes, the log and the before-images, each written once."""
    tables = live(w)
    names = ("works", "series", "members", "threads")
    tables = {k: written(v) if k in names else v for k, v in tables.items()}
    ops = written(w.sql(_OPS))
    of = lambda op, *columns: ops.filter(F.col("op") == op).select("op_id", *columns)
    log, images, refusals = [], [], []

    def after(done: X.Recorded) -> dict:
        log.append(done.log)
        images.append(done.images)
        refusals.append(done.refusals)
        return {k: written(v) if k in names else v for k, v in done.tables.items()}

    tables = after(X.set_series(of("set_series", "work_id", F.col("target").alias("series_id"), "new_name", "position"), tables))
    tables = after(X.set_position(of("set_position", "work_id", F.col("room").alias("series_id"), "position"), tables))
    tables = after(X.rename(of("rename_series", F.col("renamed").alias("series_id"), "name"), tables))
    tables = after(X.remove(of("remove_from_series", "work_id", F.col("room").alias("series_id")), tables))
    tables = after(X.reject(of("reject_series", F.col("rejected").alias("series_id")), tables))
    tables = after(X.veto(of("veto_genre", "work_id", "genre_id"), tables, w.fx("genre")))
    return tables, written(X._union(log)), written(X._union(images)), X._union(refusals)


def _undone(w: World) -> tuple:
    tables, log, images, _ = _fixed(w)
    return R.revert(log.select("correction_id"), log, tables, images)


_PAGE = Q.uuid5("('series:singleton:' || work_id)")
_STEPS = f"""
    lw AS ({WORKS}), se AS ({SERIES}), mb AS ({MEMBERS}), th AS ({THREADS}), ops AS ({_OPS}),
    alive AS (SELECT work_id FROM lw WHERE merged_into IS NULL),
    u AS (SELECT *, coalesce(lag(goal) OVER (PARTITION BY work_id ORDER BY op_id), room) AS at_room FROM (
      SELECT *, coalesce(target, {Q.uuid5("('series:ol:' || " + Q.skey('new_name') + ")")}) AS goal FROM ops WHERE op = 'set_series' AND work_id IN (SELECT work_id FROM alive))),
    ac AS (SELECT op_id, work_id, at_room AS room, goal, position, new_name, lead(op_id) OVER (PARTITION BY work_id ORDER BY op_id) AS later,
      lag(struct_pack(goal := goal, position := position)) OVER (PARTITION BY work_id ORDER BY op_id) AS before FROM u WHERE goal <> at_room),
    la AS (SELECT * FROM ac WHERE later IS NULL),
    j AS (SELECT t.thread_id, a.work_id, min(a.op_id) AS since FROM th t JOIN ac a ON a.work_id = t.work_id AND a.room = t.series_id GROUP BY 1, 2),
    w1 AS (SELECT lw.work_id, merged_into, series_id, coalesce(la.goal, series_id) AS s1 FROM lw LEFT JOIN la ON la.work_id = lw.work_id),
    t0 AS (SELECT t.thread_id, t.work_id, t.series_id AS start, coalesce(la.goal, t.series_id) AS s0 FROM th t LEFT JOIN j ON j.thread_id = t.thread_id LEFT JOIN la ON la.work_id = j.work_id),
    fresh AS (SELECT goal AS series_id, min(op_id) AS op_id, any_value(new_name) AS name FROM ac WHERE new_name IS NOT NULL GROUP BY 1),
    rooms AS (SELECT series_id, kind FROM se UNION ALL SELECT series_id, 'series' FROM fresh),
    em AS (SELECT a.room, max(op_id) AS op_id, arg_max(goal, op_id) AS goal, arg_max(CASE WHEN r.kind = 'singleton' THEN work_id ELSE '' END, op_id) AS book
      FROM ac a JOIN rooms r ON r.series_id = a.room WHERE a.room NOT IN (SELECT s1 FROM w1 WHERE merged_into IS NULL) GROUP BY 1),
    ends AS (SELECT room, goal AS node FROM em UNION ALL SELECT e.room, em.goal FROM ends e JOIN em ON em.room = e.node),
    fin AS (SELECT room, node AS survivor FROM ends WHERE node NOT IN (SELECT room FROM em)),
    thru AS (SELECT room, room AS via FROM em UNION ALL SELECT room, node FROM ends WHERE node IN (SELECT room FROM em)),
    t1 AS (SELECT t0.thread_id, CASE WHEN work_id IS NULL AND book <> '' THEN book ELSE work_id END AS tag, s0, coalesce(survivor, s0) AS s1
      FROM t0 LEFT JOIN em ON em.room = s0 LEFT JOIN fin ON fin.room = s0),
    rj AS (SELECT rejected AS series_id, min(op_id) AS op_id FROM ops JOIN rooms ON series_id = rejected WHERE op = 'reject_series' AND kind = 'series' AND rejected NOT IN (SELECT room FROM em) GROUP BY 1),
    rm AS (SELECT work_id, room, min(op_id) AS op_id FROM ops JOIN rooms ON series_id = room WHERE op = 'remove_from_series' AND kind = 'series' AND work_id IN (SELECT work_id FROM alive) GROUP BY 1, 2),
    pg AS (SELECT work_id, room, op_id, room NOT IN (SELECT series_id FROM rj) AS back, {_PAGE} AS page FROM rm
      UNION ALL SELECT work_id, s1, rj.op_id, true, {_PAGE} FROM w1 JOIN rj ON rj.series_id = s1 WHERE merged_into IS NULL AND work_id NOT IN (SELECT work_id FROM rm)),
    t2 AS (SELECT t1.*, coalesce(pg.page, s1) AS s2, pg.back, pg.room AS left_room FROM t1 LEFT JOIN pg ON pg.work_id = tag AND pg.room = s1),
    ct AS (SELECT t1.thread_id, em.op_id, em.goal, via, s0 FROM t1 JOIN thru ON thru.room = s0 JOIN em ON em.room = via),
    bad AS (SELECT op_id, 'new_discussion' AS reason FROM la JOIN t2 ON tag = la.work_id AND s2 = la.goal WHERE thread_id NOT IN (SELECT thread_id FROM j)
        AND NOT EXISTS (SELECT 1 FROM ct WHERE ct.op_id = la.op_id AND ct.thread_id = t2.thread_id)
      UNION ALL SELECT op_id, 'stale' FROM ct JOIN t2 USING (thread_id) WHERE s2 <> goal
      UNION ALL SELECT op_id, 'stale' FROM la WHERE room IN (SELECT series_id FROM rj) OR room IN (SELECT em.room FROM em WHERE em.op_id <> la.op_id)),
    su AS (SELECT * FROM la WHERE op_id NOT IN (SELECT op_id FROM bad)),
    back AS (SELECT em.* FROM em JOIN su ON su.op_id = em.op_id),
    sp AS (SELECT o.*, lead(op_id) OVER (PARTITION BY work_id ORDER BY op_id) AS later, lag(position) OVER (PARTITION BY work_id ORDER BY op_id) AS earlier, lag(op_id) OVER (PARTITION BY work_id ORDER BY op_id) AS prior_op,
      room NOT IN (SELECT series_id FROM rj) AS back FROM ops o JOIN rooms ON series_id = room WHERE op = 'set_position' AND kind = 'series' AND work_id IN (SELECT work_id FROM alive)),
    ru AS (SELECT op_id, renamed, ops.name, coalesce(lag(ops.name) OVER (PARTITION BY renamed ORDER BY op_id), se.name) AS now FROM ops JOIN se ON se.series_id = renamed WHERE op = 'rename_series' AND renamed NOT IN (SELECT room FROM em)),
    rn AS (SELECT *, lead(op_id) OVER (PARTITION BY renamed ORDER BY op_id) AS later FROM ru WHERE name <> now),
    vt AS (SELECT o.work_id, o.genre_id, min(op_id) AS op_id FROM ops o JOIN fx_genre g ON g.genre_id = o.genre_id WHERE op = 'veto_genre' AND NOT retired AND work_id IN (SELECT work_id FROM alive) GROUP BY 1, 2),
    wk AS (SELECT work_id, CASE WHEN source = 'openlibrary' THEN external_id END AS key, title || ' has no Open Library id (heuristic work)' AS no_key FROM lw),
    sk AS (SELECT series_id, name, catalog_release IS NOT NULL AS released, CASE WHEN kind = 'singleton' THEN NULL WHEN regexp_matches(external_id, '^(wd|ol):') THEN external_id ELSE 'ol:' || canonical_key END AS key, kind, external_id FROM se
      UNION ALL SELECT series_id, name, false, 'ol:' || {Q.skey('name')}, 'series', 'ol:' || {Q.skey('name')} FROM fresh),
    gone AS (SELECT series_id, work_id, min(op_id) AS op_id, arg_min(prior, (op_id, prior)) AS prior FROM (SELECT m.series_id, m.work_id, op_id, false AS prior FROM mb m JOIN ac ON ac.work_id = m.work_id AND ac.room = m.series_id
      UNION ALL SELECT m.series_id, m.work_id, op_id, true FROM mb m JOIN ac ON ac.work_id = m.work_id AND ac.goal = m.series_id) GROUP BY 1, 2)"""


def _json(kind: str, body: str) -> str:
    return f"'{{\"{kind}\":{{' || {body} || '}}}}'"


_SET = _json("set_series", "'\"work\":\"' || wk.key || '\",\"series\":\"' || sk.key || '\"' || coalesce(',\"position\":' || printf('%.1f', l.position), '') || CASE WHEN sk.released THEN '' ELSE ',\"name\":\"' || sk.name || '\"' END")
_LOG = f"""
    leaving AS (SELECT op_id, work_id, series_id FROM gone WHERE NOT prior UNION ALL SELECT op_id, work_id, before.goal FROM ac WHERE before IS NOT NULL),
    takes AS (SELECT op_id, string_agg({_json('remove_from_series', "'\"work\":\"' || wk.key || '\",\"series\":\"' || sk.key || '\"'")}, ',' ORDER BY sk.external_id) AS removes
      FROM (SELECT * FROM leaving UNION ALL SELECT rm.op_id, rm.work_id, m.series_id FROM rm JOIN mb m ON m.work_id = rm.work_id AND m.series_id = rm.room) x JOIN sk USING (series_id) JOIN wk USING (work_id) WHERE sk.released GROUP BY 1),
    lg AS (
      SELECT l.op_id, 'set_series' AS op, l.work_id, l.goal AS series_id, l.position, CASE WHEN wk.key IS NOT NULL THEN '[' || coalesce(removes || ',', '') || {_SET} || ']' END AS override, CASE WHEN wk.key IS NULL THEN no_key END AS missing
        FROM ac l JOIN wk ON wk.work_id = l.work_id JOIN sk ON sk.series_id = l.goal LEFT JOIN takes USING (op_id)
      UNION ALL SELECT l.op_id, 'set_position', l.work_id, l.room, l.position, CASE WHEN wk.key IS NOT NULL THEN '[' || {_SET} || ']' END, CASE WHEN wk.key IS NULL THEN no_key END
        FROM sp l JOIN wk ON wk.work_id = l.work_id JOIN sk ON sk.series_id = l.room
      UNION ALL SELECT op_id, 'rename_series', NULL, renamed, NULL, CASE WHEN sk.released THEN '[' || {_json('rename_series', "'\"series\":\"' || sk.key || '\",\"name\":\"' || rn.name || '\"'")} || ']' END,
        CASE WHEN NOT sk.released THEN rn.now || ' is not in a catalog release' END FROM rn JOIN sk ON sk.series_id = renamed
      UNION ALL SELECT rm.op_id, 'remove_from_series', rm.work_id, rm.room, NULL, CASE WHEN wk.key IS NOT NULL AND sk.released THEN '[' || removes || ']' END,
        CASE WHEN wk.key IS NULL THEN no_key WHEN NOT sk.released THEN coalesce(x.name, sk.name) || ' is not in a catalog release' END
        FROM rm JOIN wk ON wk.work_id = rm.work_id JOIN sk ON sk.series_id = rm.room LEFT JOIN takes USING (op_id) LEFT JOIN (SELECT renamed, arg_max(name, op_id) AS name FROM rn GROUP BY 1) x ON x.renamed = rm.room
      UNION ALL SELECT rj.op_id, 'reject_series', NULL, rj.series_id, NULL, CASE WHEN sk.released THEN '[{{\"reject_series\":\"' || sk.key || '\"}}]' END, CASE WHEN NOT sk.released THEN sk.name || ' is not in a catalog release' END
        FROM rj JOIN sk USING (series_id)
      UNION ALL SELECT op_id, 'veto_genre', work_id, NULL, NULL, NULL, 'the pipeline has no genre overrides' FROM vt),
    undo AS (SELECT op_id FROM su UNION ALL SELECT op_id FROM sp WHERE later IS NULL AND back UNION ALL SELECT op_id FROM rn WHERE later IS NULL UNION ALL SELECT op_id FROM rm WHERE room NOT IN (SELECT series_id FROM rj)
      UNION ALL SELECT op_id FROM rj UNION ALL SELECT op_id FROM vt)"""


@query("r11_fixes_log", f"WITH RECURSIVE {_STEPS}, {_LOG} SELECT op_id AS correction_id, op, work_id, series_id, position, override, missing AS runtime_only_reason, op_id IN (SELECT op_id FROM undo) AS reverted FROM lg")
def fixes_log(w: World) -> DataFrame:
    return _undone(w)[1].select("correction_id", "op", "work_id", "series_id", "position", "override", "runtime_only_reason", "reverted")


@query("r11_fixes_images", f"""
    WITH RECURSIVE {_STEPS} SELECT op_id AS correction_id, 'book' AS kind, work_id, room AS series_id, CAST(NULL AS BIGINT) AS thread_id, CAST(NULL AS DOUBLE) AS position, goal AS expected, CAST(NULL AS VARCHAR) AS name FROM ac
    UNION ALL SELECT op_id, 'book', work_id, room, NULL, NULL, page, NULL FROM pg
    UNION ALL SELECT g.op_id, 'member', g.work_id, g.series_id, NULL, m.position, NULL, NULL FROM gone g JOIN mb m USING (series_id, work_id)
    UNION ALL SELECT op_id, 'member', work_id, before.goal, NULL, before.position, NULL, NULL FROM ac WHERE before IS NOT NULL
    UNION ALL SELECT pg.op_id, 'member', m.work_id, m.series_id, NULL, coalesce(l.position, m.position), NULL, NULL FROM pg JOIN mb m ON m.work_id = pg.work_id AND m.series_id = pg.room LEFT JOIN sp l ON l.work_id = pg.work_id AND l.later IS NULL
    UNION ALL SELECT sp.op_id, 'member', m.work_id, m.series_id, NULL, coalesce(earlier, m.position), NULL, NULL FROM sp JOIN mb m ON m.work_id = sp.work_id AND m.series_id = sp.room
    UNION ALL SELECT op_id, 'placed', work_id, room, NULL, position, NULL, NULL FROM sp
    UNION ALL SELECT a.op_id, 'thread', a.work_id, NULL, thread_id, NULL, NULL, NULL FROM j JOIN ac a ON a.work_id = j.work_id AND a.op_id >= since
    UNION ALL SELECT pg.op_id, 'thread', pg.work_id, NULL, thread_id, NULL, NULL, NULL FROM t2 JOIN pg ON pg.work_id = tag AND pg.room = s1
    UNION ALL SELECT op_id, 'name', NULL, renamed, NULL, NULL, name, now FROM rn
    UNION ALL SELECT f.op_id, 'created', NULL, f.series_id, NULL, NULL, ac.room, NULL FROM fresh f JOIN ac USING (op_id)
    UNION ALL SELECT op_id, 'retired', NULL, room, NULL, NULL, goal, NULL FROM em
    UNION ALL SELECT op_id, 'retired_thread', NULL, NULL, thread_id, NULL, NULL, via FROM ct
    UNION ALL SELECT ct.op_id, 'retired_tag', NULL, NULL, ct.thread_id, NULL, NULL, via FROM ct JOIN t0 USING (thread_id) JOIN em ON em.room = via WHERE via = ct.s0 AND t0.work_id IS NULL AND book <> ''
    UNION ALL SELECT em.op_id, 'retired_work', w1.work_id, NULL, NULL, NULL, NULL, via FROM w1 JOIN thru ON thru.room = s1 JOIN em ON em.room = via
    UNION ALL SELECT em.op_id, 'retired_pointer', NULL, thru.room, NULL, NULL, NULL, via FROM thru JOIN em ON em.room = via WHERE thru.room <> via""")
def fixes_images(w: World) -> DataFrame:
    return _fixed(w)[2].select("correction_id", "kind", "work_id", "series_id", "thread_id", "position", "expected", "name")


@query("r11_undo_refusals", f"""
    WITH RECURSIVE {_STEPS}, {_LOG} SELECT op_id AS correction_id, CASE WHEN op_id IN (SELECT op_id FROM ac WHERE later IS NOT NULL UNION ALL SELECT op_id FROM sp WHERE later IS NOT NULL UNION ALL SELECT op_id FROM rn WHERE later IS NOT NULL) THEN 'later_fix'
      ELSE coalesce((SELECT max(reason) FROM bad WHERE bad.op_id = lg.op_id), 'stale') END AS reason FROM lg WHERE op_id NOT IN (SELECT op_id FROM undo)""")
def undo_refusals(w: World) -> DataFrame:
    return _undone(w)[2]


_DEAD = "(SELECT min(via) FROM thru JOIN back ON back.room = via WHERE thru.room = {0})"


@query("r11_undo_works", f"""
    WITH RECURSIVE {_STEPS} SELECT w1.work_id, CASE WHEN su.work_id IS NOT NULL THEN su.room WHEN pg.back THEN pg.room ELSE coalesce(pg.page, {_DEAD.format('s1')}, survivor, s1) END AS series_id
    FROM w1 LEFT JOIN su USING (work_id) LEFT JOIN pg USING (work_id) LEFT JOIN fin ON fin.room = s1""")
def undo_works(w: World) -> DataFrame:
    return _undone(w)[0]["works"].select("work_id", "series_id")


@query("r11_undo_members", f"""
    WITH RECURSIVE {_STEPS}
    SELECT m.series_id, m.work_id, CASE WHEN l.back AND l.earlier IS NULL OR l.op_id IS NULL THEN m.position WHEN l.back THEN l.earlier ELSE l.position END AS position,
      CASE WHEN l.op_id IS NULL OR (l.back AND l.prior_op IS NULL) THEN m.provenance ELSE 'override' END AS provenance FROM mb m
      LEFT JOIN gone g USING (series_id, work_id) LEFT JOIN pg ON pg.work_id = m.work_id AND pg.room = m.series_id LEFT JOIN sp l ON l.work_id = m.work_id AND l.room = m.series_id AND l.later IS NULL
      WHERE (g.op_id IS NULL OR g.op_id IN (SELECT op_id FROM su)) AND coalesce(pg.back, true)
    UNION ALL SELECT before.goal, work_id, before.position, 'override' FROM su WHERE before IS NOT NULL
    UNION ALL SELECT goal, work_id, position, 'override' FROM la WHERE op_id NOT IN (SELECT op_id FROM su)""")
def undo_members(w: World) -> DataFrame:
    return _undone(w)[0]["members"].select("series_id", "work_id", "position", "provenance")


@query("r11_undo_threads", f"""
    WITH RECURSIVE {_STEPS}, cb AS (SELECT thread_id, min(via) AS via FROM ct WHERE op_id IN (SELECT op_id FROM su) GROUP BY 1),
    untag AS (SELECT thread_id FROM t0 JOIN back ON back.room = s0 WHERE work_id IS NULL AND book <> '')
    SELECT t2.thread_id, CASE WHEN t2.back THEN left_room ELSE coalesce(su.room, cb.via, s2) END AS series_id, CASE WHEN t2.thread_id NOT IN (SELECT thread_id FROM untag) THEN tag END AS work_id
    FROM t2 LEFT JOIN cb USING (thread_id) LEFT JOIN j USING (thread_id) LEFT JOIN su ON su.work_id = j.work_id""")
def undo_threads(w: World) -> DataFrame:
    return _undone(w)[0]["threads"].select("thread_id", "series_id", "work_id")


@query("r11_undo_series", f"""
    WITH RECURSIVE {_STEPS}, {_LOG}, {{final}},
    held AS (SELECT wf.series_id FROM wf JOIN alive USING (work_id) UNION ALL SELECT tf.series_id FROM tf)
    SELECT s.series_id, coalesce(r.now, s.name) AS name, coalesce({_DEAD.format('s.series_id')}, CASE WHEN s.series_id NOT IN (SELECT room FROM back) THEN survivor END) AS merged_into, false AS dissolved FROM se s
      LEFT JOIN fin ON fin.room = s.series_id LEFT JOIN rn r ON r.renamed = s.series_id AND r.later IS NULL WHERE s.series_id NOT IN (SELECT room FROM back)
    UNION ALL SELECT s.series_id, coalesce(r.now, s.name), NULL, false FROM se s LEFT JOIN rn r ON r.renamed = s.series_id AND r.later IS NULL WHERE s.series_id IN (SELECT room FROM back)
    UNION ALL SELECT page, title, CASE WHEN pg.back THEN room END, false FROM pg JOIN lw USING (work_id)
    UNION ALL SELECT f.series_id, f.name, CASE WHEN f.op_id IN (SELECT op_id FROM su) AND f.series_id NOT IN (SELECT series_id FROM held) THEN (SELECT room FROM su WHERE su.op_id = f.op_id)
      WHEN f.series_id NOT IN (SELECT room FROM back) THEN coalesce({_DEAD.format('f.series_id')}, survivor) END, false FROM fresh f LEFT JOIN fin ON fin.room = f.series_id""".replace("{final}", f"""
    wf AS (SELECT w1.work_id, CASE WHEN su.work_id IS NOT NULL THEN su.room WHEN pg.back THEN pg.room ELSE coalesce(pg.page, s1) END AS series_id FROM w1 LEFT JOIN su USING (work_id) LEFT JOIN pg USING (work_id)),
    tf AS (SELECT CASE WHEN t2.back THEN left_room ELSE coalesce(su.room, s2) END AS series_id FROM t2 LEFT JOIN j USING (thread_id) LEFT JOIN su ON su.work_id = j.work_id)"""))
def undo_series(w: World) -> DataFrame:
    return _undone(w)[0]["series"].select("series_id", "name", "merged_into", "dissolved")
