"""Discussion and shelf jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import discussion as D
from foliant.plans.q_genres import SUMMARY, summary
from foliant.plans.world import World, query

_VOTES = "votes AS (SELECT user_id, thread_id AS target_id, arg_max(value, (ts, event_id)) AS value FROM fx_vote GROUP BY 1, 2)"
_SCORES = f"{_VOTES}, scores AS (SELECT target_id, CAST(sum(value) AS INT) AS score FROM votes GROUP BY 1)"


def votes(w: World) -> tuple[DataFrame, DataFrame]:
    return D.vote_scores(w.fx("vote").withColumnRenamed("thread_id", "target_id"))


@query("d01_thread_summaries", f"""
    WITH {_SCORES} SELECT t.thread_id, t.title, coalesce(s.score, 0) AS score, t.work_id, u.username AS author, g.slug AS genre_slug,
      (SELECT count(*) FROM fx_post p WHERE p.thread_id = t.thread_id AND NOT p.deleted) AS post_count, coalesce(v.value, 0) AS my_vote
    FROM fx_thread t JOIN fx_user u ON u.user_id = t.user_id LEFT JOIN fx_genre g ON g.genre_id = t.genre_id LEFT JOIN scores s ON s.target_id = t.thread_id
    LEFT JOIN votes v ON v.target_id = t.thread_id AND v.user_id = 11 AND v.value <> 0 WHERE NOT t.deleted ORDER BY 3 DESC, 1 LIMIT 30 OFFSET 5""")
def d01(w: World) -> DataFrame:
    ballots, scores = votes(w)
    threads = w.fx("thread").join(scores.withColumnRenamed("target_id", "thread_id"), "thread_id", "left").withColumn(
        "score", F.coalesce("score", F.lit(0)))
    return D.thread_summaries(threads, w.fx("user"), w.fx("genre"), w.fx("post"), ballots, user=11, limit=30, offset=5)


@query("d02_vote_scores", f"WITH {_SCORES} SELECT * FROM scores")
def d02(w: World) -> DataFrame:
    return votes(w)[1]


@query("d02_votes", f"WITH {_SCORES} SELECT user_id, target_id, CAST(value AS INT) AS value FROM votes WHERE value <> 0")
def d02_votes(w: World) -> DataFrame:
    return votes(w)[0]


_POST_VOTES = "SELECT user_id, event_id % 9900 AS target_id, value FROM fx_vote WHERE value <> 0 AND user_id = 5"


@query("d03_reply_tree", f"""
    WITH placed AS (SELECT p.*, q.post_id AS held, q.seq AS pseq FROM fx_post p LEFT JOIN fx_post q ON q.post_id = p.parent_id AND q.thread_id = p.thread_id),
    shown AS (SELECT * FROM placed p WHERE (held IS NOT NULL AND NOT deleted) OR (held IS NULL AND (NOT deleted OR EXISTS (SELECT 1 FROM placed r WHERE r.held = p.post_id AND NOT r.deleted)))),
    mv AS (SELECT target_id, max(value) AS value FROM ({_POST_VOTES}) GROUP BY 1)
    SELECT s.thread_id, coalesce(held, s.post_id) AS root_id, s.post_id, CASE WHEN held IS NULL THEN 0 ELSE 1 END AS depth, coalesce(pseq, s.seq) AS root_seq, s.seq,
      CASE WHEN NOT s.deleted THEN s.user_id END AS user_id, CASE WHEN s.deleted THEN '' ELSE s.content END AS content, s.deleted,
      CASE WHEN NOT s.deleted THEN u.username END AS author, coalesce(mv.value, 0) AS my_vote
    FROM shown s LEFT JOIN fx_user u ON u.user_id = s.user_id LEFT JOIN mv ON mv.target_id = s.post_id""")
def d03(w: World) -> DataFrame:
    ballots = w.sql(_POST_VOTES).groupBy("user_id", "target_id").agg(F.max("value").alias("value"))
    return D.reply_tree(w.fx("post"), w.fx("user"), ballots, 5)


@query("d04_mask_deleted",
       "SELECT post_id, CASE WHEN deleted THEN '' ELSE content END AS content, CASE WHEN NOT deleted THEN user_id END AS user_id, deleted FROM fx_post")
def d04(w: World) -> DataFrame:
    return D.mask_deleted(w.fx("post").select("post_id", "content", "user_id", "deleted"))


_ACTIONS = """
    SELECT conv_id * 1000 + turn * 10 + k AS event_id, turn * 3 + k AS ts, (conv_id + CASE WHEN turn % 4 = 3 THEN 1 ELSE turn END * CASE WHEN k = 2 THEN 0 ELSE 1 END) % 150 AS user_id,
      CASE k WHEN 0 THEN 'edit_post' WHEN 1 THEN CASE WHEN turn % 3 = 1 THEN 'delete_post' ELSE 'edit_post' END ELSE 'delete_thread' END AS action,
      CASE WHEN k = 2 THEN conv_id ELSE conv_id * 100 + turn END AS target_id, concat('edit ', role, k) AS content
    FROM (SELECT *, 0 AS k FROM conversations UNION ALL SELECT *, 1 FROM conversations UNION ALL SELECT *, 2 FROM conversations WHERE turn = 1)"""
_DELETED = f"""
    ops AS ({_ACTIONS}),
    tdel AS (SELECT o.target_id AS thread_id, min((o.ts, o.event_id)) AS g FROM ops o JOIN fx_thread t ON t.thread_id = o.target_id
      WHERE o.action = 'delete_thread' AND o.user_id = t.user_id AND NOT t.deleted GROUP BY 1),
    opener AS (SELECT thread_id, arg_min(post_id, (seq, post_id)) AS post_id FROM fx_post WHERE parent_id IS NULL GROUP BY 1),
    dels AS (SELECT o.target_id AS post_id, (o.ts, o.event_id) AS g FROM ops o JOIN fx_post p ON p.post_id = o.target_id WHERE o.action = 'delete_post' AND o.user_id = p.user_id AND NOT p.deleted
      UNION ALL SELECT p.post_id, d.g FROM tdel d JOIN opener o ON o.thread_id = d.thread_id JOIN fx_post p ON p.post_id = o.post_id JOIN fx_thread t ON t.thread_id = d.thread_id
        WHERE p.user_id = t.user_id AND NOT p.deleted),
    dead AS (SELECT post_id, min(g) AS g FROM dels GROUP BY 1),
    edits AS (SELECT o.*, p.deleted OR coalesce(d.g < (o.ts, o.event_id), false) AS late FROM ops o JOIN fx_post p ON p.post_id = o.target_id LEFT JOIN dead d ON d.post_id = p.post_id
      WHERE o.action = 'edit_post' AND o.user_id = p.user_id),
    lastedit AS (SELECT target_id, arg_max(content, (ts, event_id)) AS content FROM edits WHERE NOT late GROUP BY 1)"""


def _applied(w: World):
    return D.apply_deletes(w.sql(_ACTIONS), w.fx("thread"), w.fx("post"))


@query("d05_apply_deletes_posts", f"""
    WITH {_DELETED} SELECT p.post_id, CASE WHEN d.post_id IS NOT NULL THEN '' ELSE coalesce(e.content, p.content) END AS content, p.deleted OR d.post_id IS NOT NULL AS deleted
    FROM fx_post p LEFT JOIN dead d ON d.post_id = p.post_id LEFT JOIN lastedit e ON e.target_id = p.post_id""")
def d05_posts(w: World) -> DataFrame:
    return _applied(w)[1].select("post_id", "content", "deleted")


@query("d05_apply_deletes_threads", f"""
    WITH {_DELETED} SELECT t.thread_id, CASE WHEN d.thread_id IS NOT NULL THEN '' ELSE t.title END AS title, t.deleted OR d.thread_id IS NOT NULL AS deleted
    FROM fx_thread t LEFT JOIN tdel d ON d.thread_id = t.thread_id""")
def d05_threads(w: World) -> DataFrame:
    return _applied(w)[0].select("thread_id", "title", "deleted")


@query("d05_apply_deletes_refusals", f"""
    WITH {_DELETED} SELECT o.event_id, 'not_author' AS reason FROM ops o JOIN fx_thread t ON t.thread_id = o.target_id WHERE o.action = 'delete_thread' AND o.user_id <> t.user_id
    UNION ALL SELECT o.event_id, 'not_author' FROM ops o JOIN fx_post p ON p.post_id = o.target_id WHERE o.action <> 'delete_thread' AND o.user_id <> p.user_id
    UNION ALL SELECT event_id, 'already_deleted' FROM edits WHERE late""")
def d05_refusals(w: World) -> DataFrame:
    return _applied(w)[2]


_REQUESTS = """
    SELECT o_orderkey AS event_id, o_custkey AS user_id, concat('t', o_orderkey) AS title,
      CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN concat('OL', o_custkey + 1, 'W') END AS work_id,
      CASE WHEN o_orderpriority LIKE '2%' OR o_orderpriority LIKE '5%' THEN CAST(o_custkey % 27 AS INT) END AS series_id,
      CASE WHEN o_orderpriority LIKE '3%' THEN concat('nation-', o_custkey % 30) WHEN o_orderpriority LIKE '4%' THEN CASE WHEN o_orderstatus = 'F' THEN 'asia' ELSE 'europe' END END AS genre_slug FROM orders"""
_DISSOLVED = "SELECT series_id, parent_id IS NULL AS dissolved FROM fx_series_parent"
_GENRES = "SELECT genre_id, slug, parent_id, retired OR slug = 'europe' AS retired FROM fx_genre"
_PLACED = f"""
    req AS ({_REQUESTS}), ser AS ({_DISSOLVED}), gen AS ({_GENRES}),
    j AS (SELECT r.*, w.work_id AS known, coalesce(w.merged_into, w.work_id) AS live_id, l.series_id AS room, s.dissolved, s.series_id AS sid, g.genre_id, g.parent_id AS gp, g.retired
      FROM req r LEFT JOIN fx_work w ON w.work_id = r.work_id LEFT JOIN fx_work l ON l.work_id = coalesce(w.merged_into, w.work_id)
      LEFT JOIN ser s ON s.series_id = r.series_id LEFT JOIN gen g ON g.slug = r.genre_slug),
    v AS (SELECT *, CASE WHEN series_id IS NOT NULL THEN CASE WHEN sid IS NULL THEN 'unknown_series' WHEN dissolved THEN 'dissolved'
        WHEN work_id IS NOT NULL AND room IS DISTINCT FROM series_id THEN 'not_in_series' END
      WHEN genre_slug IS NOT NULL AND genre_id IS NULL THEN 'unknown_genre' WHEN gp IS NOT NULL THEN 'subgenre' WHEN retired THEN 'retired_genre'
      WHEN work_id IS NOT NULL AND known IS NULL THEN 'unknown_work' END AS reason FROM j)"""


def _placed(w: World):
    return D.place_threads(w.sql(_REQUESTS), w.fx("work"), w.sql(_DISSOLVED), w.sql(_GENRES))


@query("d06_place_threads",
       f"WITH {_PLACED} SELECT event_id, user_id, title, coalesce(series_id, room) AS series_id, live_id AS work_id, CASE WHEN series_id IS NULL THEN genre_id END AS genre_id FROM v WHERE reason IS NULL")
def d06(w: World) -> DataFrame:
    return _placed(w)[0]


@query("d06_place_threads_refusals", f"WITH {_PLACED} SELECT event_id, reason FROM v WHERE reason IS NOT NULL")
def d06_refusals(w: World) -> DataFrame:
    return _placed(w)[1]


_REPLIES = "SELECT event_id, event_id % 120 AS thread_id, CASE WHEN event_type = 'view' THEN NULL ELSE (event_id % 120) * 100 + event_id % 9 END AS parent_id FROM events"


@query("d06_place_replies", f"""
    WITH req AS ({_REPLIES}), j AS (SELECT r.event_id, CASE WHEN t.thread_id IS NULL THEN 'unknown_thread' WHEN t.deleted THEN 'thread_deleted'
      WHEN r.parent_id IS NOT NULL AND p.post_id IS NULL THEN 'unknown_parent' WHEN p.deleted THEN 'parent_deleted' WHEN p.parent_id IS NOT NULL THEN 'too_deep' ELSE 'placed' END AS reason
      FROM req r LEFT JOIN fx_thread t ON t.thread_id = r.thread_id LEFT JOIN fx_post p ON p.post_id = r.parent_id) SELECT event_id, reason FROM j""")
def d06_replies(w: World) -> DataFrame:
    rows, refusals = D.place_replies(w.sql(_REPLIES), w.fx("thread"), w.fx("post"))
    return rows.select("event_id", F.lit("placed").alias("reason")).unionByName(refusals)


_SHELF_LOG = """
    SELECT event_id, ts, user_id, concat('OL', event_id % 7 + 1, 'W') AS work_id, CASE event_type WHEN 'view' THEN 'update' WHEN 'error' THEN 'remove' WHEN 'click' THEN 'remove' ELSE 'add' END AS action,
      CASE WHEN value > 20 THEN 'read' WHEN value > 10 THEN 'reading' ELSE 'want_to_read' END AS status FROM events"""
_SHELVED = f"""
    ops AS (SELECT o.event_id, o.ts, o.user_id, coalesce(w.merged_into, w.work_id) AS work_id, o.action, o.status FROM ({_SHELF_LOG}) o JOIN fx_work w ON w.work_id = o.work_id),
    seen AS (SELECT *, coalesce(last_value(CASE WHEN action <> 'update' THEN action END IGNORE NULLS) OVER (PARTITION BY user_id, work_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'add', false) AS present FROM ops),
    judged AS (SELECT *, CASE WHEN action = 'add' AND present THEN 'conflict' WHEN action <> 'add' AND NOT present THEN 'missing' END AS reason FROM seen)"""


def _shelved(w: World):
    none = w.spark.createDataFrame([], "user_id bigint, work_id string, status string")
    return D.apply_shelf_log(w.sql(_SHELF_LOG), none, w.fx("work"))


@query("d07_apply_shelf_log",
       f"WITH {_SHELVED} SELECT user_id, work_id, arg_max(status, (ts, event_id)) AS status FROM judged WHERE reason IS NULL GROUP BY 1, 2 HAVING arg_max(action, (ts, event_id)) <> 'remove'")
def d07(w: World) -> DataFrame:
    return _shelved(w)[0]


@query("d07_shelf_refusals", f"WITH {_SHELVED} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL")
def d07_refusals(w: World) -> DataFrame:
    return _shelved(w)[1]


# What stood on the shelves before the log: the oldest row of each reader and live work.
_STOOD = "SELECT s.user_id, coalesce(w.merged_into, w.work_id) AS work_id, min_by(s.status, (s.created_at, s.shelf_id)) AS status FROM fx_shelf s JOIN fx_work w ON w.work_id = s.work_id GROUP BY 1, 2"
_RESHELVED = f"""
    rows AS (SELECT 0 AS phase, NULL AS event_id, NULL AS ts, user_id, work_id, 'add' AS action, status FROM ({_STOOD})
      UNION ALL SELECT 1, o.event_id, o.ts, o.user_id, coalesce(w.merged_into, w.work_id), o.action, o.status FROM ({_SHELF_LOG}) o JOIN fx_work w ON w.work_id = o.work_id),
    ops AS (SELECT *, row_number() OVER (PARTITION BY user_id, work_id ORDER BY phase, ts, event_id) AS rn FROM rows),
    seen AS (SELECT *, coalesce(last_value(CASE WHEN action <> 'update' THEN action END IGNORE NULLS) OVER (PARTITION BY user_id, work_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'add', false) AS present FROM ops),
    judged AS (SELECT *, CASE WHEN action = 'add' AND present THEN 'conflict' WHEN action <> 'add' AND NOT present THEN 'missing' END AS reason FROM seen)"""


def _reshelved(w: World):
    return D.apply_shelf_log(w.sql(_SHELF_LOG), w.sql(_STOOD), w.fx("work"))


@query("d07_reapply_shelf_log",
       f"WITH {_RESHELVED} SELECT user_id, work_id, arg_max(status, rn) AS status FROM judged WHERE reason IS NULL GROUP BY 1, 2 HAVING arg_max(action, rn) <> 'remove'")
def d07_stood(w: World) -> DataFrame:
    return _reshelved(w)[0]


@query("d07_reapplied_refusals", f"WITH {_RESHELVED} SELECT event_id, reason FROM judged WHERE reason IS NOT NULL")
def d07_stood_refusals(w: World) -> DataFrame:
    return _reshelved(w)[1]


@query("d08_profile_shelves", """
    SELECT s.user_id, s.status, CAST(row_number() OVER (PARTITION BY s.user_id, s.status ORDER BY s.created_at DESC, s.shelf_id DESC) AS INT) AS rank, s.work_id, w.raw_title AS title
    FROM fx_shelf s JOIN fx_work w ON w.work_id = s.work_id""")
def d08(w: World) -> DataFrame:
    return D.profile_shelves(w.fx("shelf"), w.fx("work").withColumnRenamed("raw_title", "title"))


@query("d09_collapse_shelves",
       "SELECT user_id, work_id, shelf_id, status FROM fx_shelf QUALIFY row_number() OVER (PARTITION BY user_id, work_id ORDER BY created_at, shelf_id) = 1")
def d09(w: World) -> DataFrame:
    return D.collapse_shelves(w.fx("shelf")).select("user_id", "work_id", "shelf_id", "status")


_LINKS = "SELECT l_orderkey AS link_id, CASE WHEN l_linenumber = 1 THEN concat('OL', l_partkey + 1, 'W') END AS work_id, CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('b', l_partkey) END AS edition_id FROM lineitem"
_OWNED = "SELECT concat('b', p_partkey) AS edition_id, CASE WHEN p_size > 45 THEN NULL ELSE concat('OL', p_partkey + 1, 'W') END AS work_id FROM part"


@query("d10_carry_links",
       f"WITH m AS (SELECT l.link_id, l.edition_id, coalesce(l.work_id, o.work_id) AS work_id FROM ({_LINKS}) l LEFT JOIN ({_OWNED}) o ON o.edition_id = l.edition_id) "
       "SELECT link_id, edition_id, work_id, edition_id IS NOT NULL AND work_id IS NULL AS stranded FROM m")
def d10(w: World) -> DataFrame:
    rows, stranded = D.carry_links(w.sql(_LINKS), w.sql(_OWNED))
    fine = rows.filter("edition_id IS NULL OR work_id IS NOT NULL").withColumn("stranded", F.lit(False))
    return fine.unionByName(stranded.withColumn("stranded", F.lit(True)))


_GENRED = "SELECT work_id, CASE WHEN page_count > 100 THEN CAST(100 + page_count % 25 AS INT) END AS genre_id FROM fx_edition"


@query("d11_first_genre_per_work", f"SELECT work_id, min(genre_id) AS genre_id FROM ({_GENRED}) WHERE genre_id IS NOT NULL GROUP BY work_id")
def d11(w: World) -> DataFrame:
    return D.first_genre_per_work(w.sql(_GENRED))


_LEGACY = "SELECT work_id, merged_into, CASE WHEN shelf_mark <> 'MEDIUM' THEN CAST(100 + series_id AS INT) END AS genre_id FROM fx_work"


@query("d12_legacy_genre_inferences",
       f"SELECT work_id, genre_id, source FROM fx_genre_inference UNION SELECT work_id, genre_id, 'open_library' FROM ({_LEGACY}) WHERE genre_id IS NOT NULL")
def d12(w: World) -> DataFrame:
    return D.legacy_genre_rows(w.sql(_LEGACY), w.fx("genre_inference"), summary(w))[0]


@query("d12_legacy_genre_summary", f"""
    WITH {SUMMARY}, leg AS ({_LEGACY}), marks AS (SELECT work_id, genre_id FROM leg WHERE genre_id IS NOT NULL AND merged_into IS NULL)
    SELECT coalesce(s.work_id, m.work_id) AS work_id, coalesce(s.genre_id, m.genre_id) AS genre_id, coalesce(s.direct_votes, 0) AS direct_votes, coalesce(s.score, 0) AS score,
      coalesce(s.inferred, false) OR m.work_id IS NOT NULL AS inferred, coalesce(s.vetoed, false) AS vetoed FROM summary s FULL JOIN marks m ON m.work_id = s.work_id AND m.genre_id = s.genre_id""")
def d12_summary(w: World) -> DataFrame:
    return D.legacy_genre_rows(w.sql(_LEGACY), w.fx("genre_inference"), summary(w))[1]
