"""Pointer chases, components and closures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import graph as G
from foliant.plans import check_sql as Q
from foliant.plans.world import World, query

CHASE = """
    SELECT from_ol AS id, from_ol AS node, [from_ol] AS path, 0 AS hop FROM (SELECT DISTINCT from_ol FROM fx_redirect)
    UNION ALL SELECT c.id, e.to_ol, list_append(c.path, e.to_ol), c.hop + 1 FROM chase c JOIN fx_redirect e ON e.from_ol = c.node
    WHERE c.hop < 5 AND NOT list_contains(c.path, e.to_ol)"""
RESOLVED = f"chase AS ({CHASE}), resolved AS (SELECT id, arg_max(node, hop) AS target FROM chase GROUP BY id)"


@query("g01_resolve_redirects",
       f"WITH RECURSIVE {RESOLVED} SELECT w.work_id AS id, coalesce(r.target, w.work_id) AS resolved "
       "FROM fx_work w LEFT JOIN resolved r ON r.id = w.work_id")
def g01(w: World) -> DataFrame:
    return G.resolve_redirects(w.fx("work").select(F.col("work_id").alias("id")), w.fx("redirect"))


_COMPONENTS = f"""
    keyed AS (SELECT DISTINCT author_id, {Q.norm('name')} AS k FROM fx_author),
    shared AS (SELECT k FROM keyed WHERE k LIKE '% %' GROUP BY k HAVING count(*) BETWEEN 2 AND 3),
    links AS (SELECT DISTINCT qid, author_id FROM fx_author_kg WHERE author_id IN (SELECT author_id FROM fx_author)),
    edges AS (SELECT a.author_id AS x, b.author_id AS y FROM keyed a JOIN keyed b ON a.k = b.k WHERE a.k IN (SELECT k FROM shared)
      UNION SELECT a.author_id, b.author_id FROM links a JOIN links b ON a.qid = b.qid),
    reach AS (SELECT author_id AS id, author_id AS other FROM fx_author UNION SELECT r.id, e.y FROM reach r JOIN edges e ON e.x = r.other),
    clusters AS (SELECT id, min(other) AS cluster FROM reach GROUP BY id)"""


def author_records(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    authors = w.fx("author").select(
        F.col("author_id").alias("id"), "name", F.array().cast("array<string>").alias("alternate_names"),
        F.lit(None).cast("string").alias("wikidata"))
    links = w.fx("author_kg").select("qid", F.col("author_id").alias("id"))
    names = w.spark.createDataFrame([], "qid string, name string")
    return authors, links, names


@query("g02_cluster_authors", f"WITH RECURSIVE {_COMPONENTS} SELECT id, cluster FROM clusters")
def g02(w: World) -> DataFrame:
    return G.cluster_authors(*author_records(w))


@query("g03_climb_parents", """
    WITH RECURSIVE up AS (SELECT DISTINCT series AS node, 0 AS level FROM fx_kg_membership
      UNION SELECT s.parent, u.level + 1 FROM up u JOIN fx_kg_series s ON s.qid = u.node WHERE s.parent IS NOT NULL AND u.level < 5)
    SELECT node, CAST(min(level) AS INT) AS level FROM up GROUP BY node""")
def g03(w: World) -> DataFrame:
    seed = w.fx("kg_membership").select(F.col("series").alias("node"))
    return G.climb_parents(seed, w.fx("kg_series").select(F.col("qid").alias("child"), "parent"))


ROOM_WORLD = "SELECT DISTINCT work_id, series_id AS key FROM fx_work"
ROOM_PARENTS = "SELECT series_id AS child, parent_id AS parent FROM fx_series_parent WHERE parent_id IS NOT NULL"
_ROOMS = f"""
    member AS ({ROOM_WORLD}), par AS ({ROOM_PARENTS}),
    rel AS (SELECT DISTINCT key FROM member UNION SELECT p.parent FROM rel r JOIN par p ON p.child = r.key),
    direct AS (SELECT key, count(*) AS n FROM member GROUP BY key),
    kids AS (SELECT parent AS key, count(DISTINCT child) AS n FROM par WHERE child IN (SELECT key FROM rel) GROUP BY parent),
    qual AS (SELECT r.key FROM rel r LEFT JOIN direct d ON d.key = r.key LEFT JOIN kids k ON k.key = r.key
      WHERE coalesce(d.n, 0) >= 2 OR coalesce(k.n, 0) >= 2),
    chain AS (SELECT key, key AS top, [key] AS path, 0 AS hop FROM direct
      UNION ALL SELECT c.key, p.parent, list_append(c.path, p.parent), c.hop + 1 FROM chain c JOIN par p ON p.child = c.top
      WHERE p.parent IN (SELECT key FROM qual) AND NOT list_contains(c.path, p.parent)),
    tops AS (SELECT key, arg_max(top, hop) AS top FROM chain GROUP BY key),
    wt AS (SELECT DISTINCT m.work_id, t.top FROM member m JOIN tops t ON t.key = m.key),
    sz AS (SELECT top, count(*) AS n FROM wt GROUP BY top)"""


@query("g04_series_rooms",
       f"WITH RECURSIVE {_ROOMS} SELECT work_id, arg_min(wt.top, (-n, wt.top)) AS room FROM wt JOIN sz ON sz.top = wt.top GROUP BY work_id")
def g04(w: World) -> DataFrame:
    return G.series_rooms(w.sql(ROOM_WORLD), w.sql(ROOM_PARENTS))[0]


@query("g04_series_room_parents",
       f"WITH RECURSIVE {_ROOMS}, outp AS (SELECT DISTINCT top AS key FROM chain) "
       "SELECT o.key, CASE WHEN p.parent IN (SELECT key FROM outp) THEN p.parent END AS parent FROM outp o LEFT JOIN par p ON p.child = o.key")
def g04_parents(w: World) -> DataFrame:
    return G.series_rooms(w.sql(ROOM_WORLD), w.sql(ROOM_PARENTS))[1]


@query("g05_follow_aliases", """
    WITH RECURSIVE chase AS (
      SELECT from_ol AS loser, to_ol AS node, [from_ol, to_ol] AS path, 1 AS hop FROM fx_redirect
      UNION ALL SELECT c.loser, e.to_ol, list_append(c.path, e.to_ol), c.hop + 1 FROM chase c JOIN fx_redirect e ON e.from_ol = c.node
      WHERE NOT list_contains(c.path, e.to_ol))
    SELECT loser, arg_max(node, hop) AS survivor FROM chase GROUP BY loser""")
def g05(w: World) -> DataFrame:
    return G.follow_aliases(w.fx("redirect").select(F.col("from_ol").alias("loser"), F.col("to_ol").alias("survivor")))


SERIES_ROWS = """
    SELECT series_id, concat('slug-', series_id) AS slug,
      CASE WHEN series_id % 6 = 5 THEN series_id - 1 WHEN series_id % 6 = 4 THEN series_id - 2 END AS merged_into,
      CASE WHEN series_id % 6 IN (4, 5) THEN NULL ELSE parent_id END AS parent_id, name FROM fx_series_parent"""


@query("g06_canonical_series", f"""
    WITH RECURSIVE s AS ({SERIES_ROWS}),
    dead AS (SELECT series_id AS id, series_id AS node, 0 AS hop FROM s
      UNION ALL SELECT d.id, s.merged_into, d.hop + 1 FROM dead d JOIN s ON s.series_id = d.node WHERE s.merged_into IS NOT NULL AND d.hop < 10),
    canon AS (SELECT id, arg_max(node, hop) AS target FROM dead GROUP BY id),
    up AS (SELECT s.slug, c.target AS node, 0 AS hop FROM s JOIN canon c ON c.id = s.series_id
      UNION ALL SELECT u.slug, c.target, u.hop + 1 FROM up u JOIN s ON s.series_id = u.node JOIN canon c ON c.id = s.parent_id WHERE u.hop < 5)
    SELECT slug, arg_max(node, hop) AS room FROM up GROUP BY slug""")
def g06(w: World) -> DataFrame:
    return G.canonical_series(w.sql(SERIES_ROWS))


@query("g07_room_tree", f"""
    WITH RECURSIVE s AS ({SERIES_ROWS}),
    tree AS (SELECT series_id AS room, series_id, 0 AS depth FROM s
      UNION SELECT t.room, s.series_id, t.depth + 1 FROM tree t JOIN s ON s.parent_id = t.series_id WHERE s.merged_into IS NULL AND t.depth < 5)
    SELECT room, series_id, CAST(min(depth) AS INT) AS depth FROM tree GROUP BY room, series_id""")
def g07(w: World) -> DataFrame:
    series = w.sql(SERIES_ROWS)
    return G.room_tree(series, series.select(F.col("series_id").alias("room")))


@query("g08_canonical_works",
       "SELECT w.work_id, coalesce(t.work_id, w.work_id) AS canonical FROM fx_work w LEFT JOIN fx_work t ON t.work_id = w.merged_into")
def g08(w: World) -> DataFrame:
    return G.canonical_works(w.fx("work"))


_CHAINED = ("SELECT work_id, CASE WHEN shelf_mark IN ('SMALL', 'PROMO', 'LARGE') THEN concat('OL', work_num + 1, 'W') END AS merged_into FROM fx_work")


@query("g08_flatten_tombstones", f"""
    WITH RECURSIVE c AS ({_CHAINED}),
    chase AS (SELECT work_id, merged_into AS node, 1 AS hop FROM c WHERE merged_into IS NOT NULL
      UNION ALL SELECT k.work_id, c.merged_into, k.hop + 1 FROM chase k JOIN c ON c.work_id = k.node WHERE c.merged_into IS NOT NULL)
    SELECT c.work_id, e.node AS merged_into FROM c LEFT JOIN (SELECT work_id, arg_max(node, hop) AS node FROM chase GROUP BY work_id) e ON e.work_id = c.work_id""")
def g08_flatten(w: World) -> DataFrame:
    return G.flatten_tombstones(w.sql(_CHAINED))
