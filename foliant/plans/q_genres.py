"""Genre jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import genres as N
from foliant.plans import check_sql as Q
from foliant.plans.world import World, query

_NESTED = "SELECT p_type, p_brand, min(p_size) AS lo, max(p_name) AS phrase FROM part GROUP BY p_type, p_brand"


@query("n01_flatten_taxonomy", f"""
    WITH c AS ({_NESTED})
    SELECT lower(p_type) AS slug, p_type AS name, NULL AS parent, CAST(length(p_type) AS INT) AS position, {Q.norm('p_type')} AS match, '' AS exclude
      FROM c GROUP BY p_type
    UNION ALL SELECT lower(p_type) || '-' || lower(replace(p_brand, '#', '')), p_brand, lower(p_type),
      CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_brand) - 1 AS INT), {Q.norm('phrase')}, {Q.norm('p_brand')} FROM c""")
def n01(w: World) -> DataFrame:
    child = F.struct(
        "p_brand", F.concat(F.lower("p_type"), F.lit("-"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("slug"),
        F.concat(F.lit(" "), F.col("p_brand")).alias("name"), F.array("phrase").alias("match"), F.array("p_brand").alias("exclude"))
    nested = w.sql(_NESTED).groupBy("p_type").agg(F.array_sort(F.collect_list(child)).alias("children")).select(
        F.lower("p_type").alias("slug"), F.col("p_type").alias("name"), F.length("p_type").alias("position"),
        F.array("p_type").alias("match"), F.array().cast("array<string>").alias("exclude"), "children")
    flat = N.flatten_taxonomy(nested)
    return flat.withColumn("match", F.array_join("match", "|")).withColumn("exclude", F.array_join("exclude", "|"))


_INFERRED = f"""
    lines AS (SELECT work_id, CASE WHEN regexp_matches(subject, '(?i)^\\s*genre\\s*:') THEN 1 WHEN NOT regexp_matches(subject, '(?i)^\\s*[a-z_]+\\s*:') THEN 2 END AS tier,
      {Q.norm('''regexp_replace(subject, '(?i)^\\s*genre\\s*:', '')''')} AS t FROM fx_subject),
    tax AS (SELECT slug, kind, {Q.norm('phrase')} AS phrase FROM fx_taxonomy),
    found AS (SELECT DISTINCT l.work_id, l.tier, m.slug FROM lines l JOIN tax m ON m.kind = 'match' AND contains(' ' || l.t || ' ', ' ' || m.phrase || ' ')
      WHERE l.tier IS NOT NULL AND NOT EXISTS (SELECT 1 FROM tax x WHERE x.kind = 'exclude' AND x.slug = m.slug AND contains(' ' || l.t || ' ', ' ' || x.phrase || ' '))),
    inferred AS (SELECT f.work_id, f.slug FROM found f JOIN (SELECT work_id, min(tier) AS tier FROM found GROUP BY work_id) b ON b.work_id = f.work_id AND b.tier = f.tier)"""


@query("n02_infer_genres", f"WITH {_INFERRED} SELECT work_id, slug FROM inferred")
def n02(w: World) -> DataFrame:
    return N.infer_genres(w.fx("subject"), w.fx("taxonomy"))


_OLD = ("SELECT g.slug, g.name, p.slug AS parent, g.position, g.retired FROM fx_genre g LEFT JOIN fx_genre p ON p.genre_id = g.parent_id")
_NEW = """
    SELECT lower(replace(r_name, ' ', '-')) AS slug, r_name AS name, CASE WHEN r_name = 'ASIA' THEN 'africa' END AS parent, r_regionkey AS position FROM region
    UNION ALL SELECT lower(replace(n_name, '_', CASE WHEN n_nationkey % 5 = 4 THEN '--' ELSE '-' END)), CASE WHEN n_nationkey % 5 = 3 THEN concat(n_name, ' new') ELSE n_name END,
      CASE WHEN n_nationkey % 7 = 6 THEN NULL ELSE lower(replace(r_name, ' ', '-')) END, CASE WHEN n_nationkey % 5 = 2 THEN 99 ELSE n_nationkey END
    FROM nation JOIN region ON n_regionkey = r_regionkey"""
_THREADED = "SELECT g.slug FROM fx_thread t JOIN fx_genre g ON g.genre_id = t.genre_id"
_BOTH = f"""
    o AS ({_OLD}), n AS ({_NEW}),
    j AS (SELECT coalesce(o.slug, n.slug) AS slug, o.slug AS os, n.slug AS ns, o.name AS oname, n.name AS nname, o.parent AS op, n.parent AS np, o.position AS opos, n.position AS npos, o.retired
      FROM o FULL JOIN n ON o.slug = n.slug)"""


def _synced(w: World):
    return N.sync_taxonomy(w.sql(_OLD), w.sql(_NEW), w.sql(_THREADED))


@query("n03_sync_taxonomy_changes", f"""
    WITH {_BOTH}, d AS (SELECT *, concat_ws(', ', CASE WHEN oname <> nname THEN 'name' END, CASE WHEN op IS DISTINCT FROM np THEN 'parent_id' END,
      CASE WHEN opos <> npos THEN 'position' END, CASE WHEN retired THEN 'unretired' END) AS diff FROM j)
    SELECT slug, CASE WHEN os IS NULL THEN '+ ' || slug WHEN ns IS NULL THEN '- retired ' || slug ELSE '~ ' || slug || ' (' || diff || ')' END AS change
    FROM d WHERE os IS NULL OR (ns IS NULL AND NOT retired) OR (os IS NOT NULL AND ns IS NOT NULL AND diff <> '')""")
def n03(w: World) -> DataFrame:
    return _synced(w)[1]


@query("n03_sync_taxonomy", f"""
    WITH {_BOTH} SELECT slug, CASE WHEN ns IS NULL THEN oname ELSE nname END AS name, CASE WHEN ns IS NULL THEN op ELSE np END AS parent,
      CASE WHEN ns IS NULL THEN opos ELSE npos END AS position, ns IS NULL AS retired FROM j""")
def n03_genres(w: World) -> DataFrame:
    return _synced(w)[0]


@query("n03_sync_taxonomy_violations", f"""
    WITH {_BOTH} SELECT slug, 'has discussion threads and cannot become a subgenre' AS problem FROM j
    WHERE os IS NOT NULL AND op IS NULL AND np IS NOT NULL AND slug IN ({_THREADED})""")
def n03_violations(w: World) -> DataFrame:
    return _synced(w)[2]


_SLUGGED = "SELECT work_id, CASE WHEN genre_id % 4 = 0 THEN 'unknown' ELSE concat('nation-', (genre_id + 3) % 25) END AS slug FROM fx_genre_inference"
_SCOPE = "SELECT work_id FROM fx_work WHERE shelf_mark IN ('SMALL', 'ECONOMY')"


@query("n04_replace_inferences", f"""
    WITH scope AS ({_SCOPE}), fresh AS ({_SLUGGED}) SELECT work_id, genre_id, source FROM fx_genre_inference WHERE NOT (source = 'google' AND work_id IN (SELECT work_id FROM scope))
    UNION SELECT f.work_id, g.genre_id, 'google' FROM fresh f JOIN fx_genre g ON g.slug = f.slug AND NOT g.retired WHERE f.work_id IN (SELECT work_id FROM scope)""")
def n04(w: World) -> DataFrame:
    return N.replace_inferences(w.fx("genre_inference"), w.sql(_SLUGGED), w.sql(_SCOPE), w.fx("genre"), "google")


_SLUG_GENRES = "SELECT CAST(row_number() OVER (ORDER BY slug) AS INT) AS genre_id, slug, CAST(NULL AS INT) AS parent_id, position, slug = 'promo' AS retired FROM (SELECT slug, min(position) AS position FROM fx_taxonomy GROUP BY slug)"


@query("n05_category_inferences", f"""
    WITH {_INFERRED}, g AS ({_SLUG_GENRES}), strong AS (SELECT work_id FROM fx_genre_inference WHERE source <> 'google')
    SELECT work_id, genre_id, source FROM fx_genre_inference WHERE source <> 'google' OR work_id IN (SELECT work_id FROM strong)
    UNION SELECT i.work_id, g.genre_id, 'google' FROM inferred i JOIN g ON g.slug = i.slug AND NOT g.retired WHERE i.work_id NOT IN (SELECT work_id FROM strong)""")
def n05(w: World) -> DataFrame:
    return N.category_inferences(w.fx("genre_inference"), w.fx("subject").withColumnRenamed("subject", "category"), w.fx("taxonomy"), w.sql(_SLUG_GENRES))


def summary_sql(votes: str = "fx_genre_vote", inferences: str = "fx_genre_inference", vetoes: str = "fx_veto", works: str = "fx_work", genres: str = "fx_genre") -> str:
    """All evidence as flagged rows; each row stands for its genre and, unless struck, for the parent; one grouping."""
    return f"""
    evidence AS (SELECT work_id, genre_id, user_id AS voter, 'vote' AS kind FROM {votes} UNION ALL SELECT work_id, genre_id, NULL, 'hint' FROM {inferences}
      UNION ALL SELECT work_id, genre_id, NULL, 'strike' FROM {vetoes} WHERE NOT reverted),
    marked AS (SELECT *, bool_or(kind = 'strike') OVER (PARTITION BY work_id, genre_id) AS struck FROM evidence),
    rolled AS (SELECT m.work_id, m.voter, m.kind, unnest(list_filter([{{'genre': m.genre_id, 'own': true}}, {{'genre': CASE WHEN NOT struck THEN parent_id END, 'own': false}}], lambda x: x.genre IS NOT NULL)) AS place
      FROM marked m LEFT JOIN (SELECT genre_id, parent_id FROM {genres}) USING (genre_id)),
    summary AS (SELECT work_id, place.genre AS genre_id, CAST(count(*) FILTER (kind = 'vote' AND place.own) AS INT) AS direct_votes, CAST(count(DISTINCT voter) AS INT) AS score,
      bool_or(kind = 'hint') AS inferred, bool_or(kind = 'strike') AS vetoed FROM rolled SEMI JOIN (SELECT work_id FROM {works} WHERE merged_into IS NULL) USING (work_id) GROUP BY ALL),
    shown AS (SELECT *, bool_or(score > 0) OVER (PARTITION BY work_id) AS by_readers FROM summary SEMI JOIN (SELECT genre_id FROM {genres} WHERE NOT retired) USING (genre_id) WHERE NOT vetoed),
    effective AS (SELECT work_id, genre_id, score, CASE WHEN by_readers THEN 'readers' ELSE 'inferred' END AS source FROM shown WHERE CASE WHEN by_readers THEN score > 0 ELSE inferred END)"""


SUMMARY = summary_sql()


def summary(w: World, ids: DataFrame | None = None) -> DataFrame:
    return N.genre_summary(w.fx("genre_vote"), w.fx("genre_inference"), w.fx("genre"), N.live_vetoes(w.fx("veto")), w.fx("work"), ids)


def effective(w: World) -> DataFrame:
    return N.effective_genres(summary(w), w.fx("genre"))


@query("n06_genre_summary", f"WITH {SUMMARY} SELECT * FROM summary")
def n06(w: World) -> DataFrame:
    return summary(w)


@query("n06_genre_summary_scoped", f"WITH {SUMMARY} SELECT * FROM summary WHERE work_id IN ({_SCOPE})")
def n06_scoped(w: World) -> DataFrame:
    return summary(w, w.sql(_SCOPE))


def _voted(w: World):
    works = w.fx("work").withColumn("kind", T.classify_kind(F.col("raw_title"), F.lit("")))
    return N.apply_genre_votes(w.fx("genre_action"), works, w.fx("genre"), N.live_vetoes(w.fx("veto")))


_JUDGED = f"""
    pl AS (SELECT a.event_id, a.ts, a.user_id, coalesce(w.merged_into, w.work_id) AS work_id, a.genre_id, a.action FROM fx_genre_action a JOIN fx_work w ON w.work_id = a.work_id),
    jd AS (SELECT p.*, CASE WHEN action = 'vote' THEN CASE WHEN {Q.kind('l.raw_title')} = 'collection' THEN 'collection' WHEN g.retired THEN 'retired' WHEN EXISTS (SELECT 1 FROM fx_veto v WHERE NOT v.reverted AND v.work_id = p.work_id AND v.genre_id = p.genre_id) THEN 'vetoed' END END AS reason
      FROM pl p JOIN fx_work l ON l.work_id = p.work_id JOIN fx_genre g ON g.genre_id = p.genre_id),
    ops AS (SELECT *, row_number() OVER (PARTITION BY user_id, work_id ORDER BY ts, event_id) AS rn FROM jd WHERE reason IS NULL)"""
_BALLOTS = f"""{_JUDGED},
    fold AS (SELECT DISTINCT user_id, work_id, CAST(0 AS BIGINT) AS rn, CAST([] AS INT[]) AS st, CAST(NULL AS BIGINT) AS refused FROM ops
      UNION ALL SELECT f.user_id, f.work_id, o.rn, CASE WHEN o.action = 'unvote' THEN list_filter(f.st, lambda x: x <> o.genre_id) WHEN list_contains(f.st, o.genre_id) OR len(f.st) >= 5 THEN f.st ELSE list_append(f.st, o.genre_id) END,
        CASE WHEN o.action = 'vote' AND NOT list_contains(f.st, o.genre_id) AND len(f.st) >= 5 THEN o.event_id END FROM fold f JOIN ops o ON o.user_id = f.user_id AND o.work_id = f.work_id AND o.rn = f.rn + 1)"""


@query("n07_apply_genre_votes", f"WITH RECURSIVE {_BALLOTS} SELECT user_id, work_id, unnest(arg_max(st, rn)) AS genre_id FROM fold GROUP BY user_id, work_id")
def n07(w: World) -> DataFrame:
    return _voted(w)[0]


@query("n07_genre_vote_refusals", f"WITH RECURSIVE {_BALLOTS} SELECT event_id, reason FROM jd WHERE reason IS NOT NULL UNION ALL SELECT refused, 'cap' FROM fold WHERE refused IS NOT NULL")
def n07_refusals(w: World) -> DataFrame:
    return _voted(w)[1]


# Votes cast before the log, on the books they count for now.
_CAST = "SELECT DISTINCT v.user_id, coalesce(w.merged_into, w.work_id) AS work_id, v.genre_id FROM fx_genre_vote v JOIN fx_work w ON w.work_id = v.work_id"
# st: votes under the cap; sx: votes on retired or vetoed genres, which stay but don't count.
_RECAST = f"""{_JUDGED},
    hv AS (SELECT c.*, NOT g.retired AND NOT EXISTS (SELECT 1 FROM fx_veto v WHERE NOT v.reverted AND v.work_id = c.work_id AND v.genre_id = c.genre_id) AS counts FROM ({_CAST}) c JOIN fx_genre g ON g.genre_id = c.genre_id),
    ky AS (SELECT user_id, work_id FROM ops UNION SELECT user_id, work_id FROM hv),
    fold AS (SELECT k.user_id, k.work_id, CAST(0 AS BIGINT) AS rn, coalesce(list(h.genre_id) FILTER (WHERE h.counts), CAST([] AS INT[])) AS st, coalesce(list(h.genre_id) FILTER (WHERE NOT h.counts), CAST([] AS INT[])) AS sx, CAST(NULL AS BIGINT) AS refused
        FROM ky k LEFT JOIN hv h ON h.user_id = k.user_id AND h.work_id = k.work_id GROUP BY k.user_id, k.work_id
      UNION ALL SELECT f.user_id, f.work_id, o.rn, CASE WHEN o.action = 'unvote' THEN list_filter(f.st, lambda x: x <> o.genre_id) WHEN list_contains(f.st, o.genre_id) OR len(f.st) >= 5 THEN f.st ELSE list_append(f.st, o.genre_id) END,
        CASE WHEN o.action = 'unvote' THEN list_filter(f.sx, lambda x: x <> o.genre_id) ELSE f.sx END,
        CASE WHEN o.action = 'vote' AND NOT list_contains(f.st, o.genre_id) AND len(f.st) >= 5 THEN o.event_id END FROM fold f JOIN ops o ON o.user_id = f.user_id AND o.work_id = f.work_id AND o.rn = f.rn + 1)"""


def _recast(w: World):
    works = w.fx("work").withColumn("kind", T.classify_kind(F.col("raw_title"), F.lit("")))
    return N.apply_genre_votes(w.fx("genre_action"), works, w.fx("genre"), N.live_vetoes(w.fx("veto")), w.sql(_CAST))


@query("n07_reapply_genre_votes", f"""
    WITH RECURSIVE {_RECAST}, fin AS (SELECT user_id, work_id, arg_max(st, rn) AS st, arg_max(sx, rn) AS sx FROM fold GROUP BY user_id, work_id)
    SELECT user_id, work_id, unnest(list_concat(st, sx)) AS genre_id FROM fin""")
def n07_cast(w: World) -> DataFrame:
    return _recast(w)[0]


@query("n07_reapplied_refusals", f"WITH RECURSIVE {_RECAST} SELECT event_id, reason FROM jd WHERE reason IS NOT NULL UNION ALL SELECT refused, 'cap' FROM fold WHERE refused IS NOT NULL")
def n07_cast_refusals(w: World) -> DataFrame:
    return _recast(w)[1]


@query("n08_effective_genres", f"WITH {SUMMARY} SELECT * FROM effective")
def n08(w: World) -> DataFrame:
    return effective(w)


@query("n09_top_genres", f"""
    WITH {SUMMARY} SELECT work_id, rank, slug, name FROM (SELECT e.work_id, g.slug, g.name,
      CAST(row_number() OVER (PARTITION BY e.work_id ORDER BY e.score DESC, g.position, g.slug) AS INT) AS rank FROM effective e JOIN fx_genre g ON g.genre_id = e.genre_id) WHERE rank <= 3""")
def n09(w: World) -> DataFrame:
    return N.top_genres(effective(w), w.fx("genre"))


@query("n10_genre_cards", f"""
    WITH {SUMMARY}, mine AS (SELECT DISTINCT v.work_id, v.genre_id FROM fx_genre_vote v JOIN fx_genre g ON g.genre_id = v.genre_id AND NOT g.retired
      JOIN summary s ON s.work_id = v.work_id AND s.genre_id = v.genre_id AND NOT s.vetoed WHERE v.user_id = 7),
    cnt AS (SELECT work_id, count(*) AS n FROM mine GROUP BY work_id),
    cards AS (SELECT e.work_id, e.genre_id, e.score, e.source, s.direct_votes, false AS vetoed, NULL AS veto_id FROM effective e JOIN summary s ON s.work_id = e.work_id AND s.genre_id = e.genre_id
      UNION ALL SELECT s.work_id, s.genre_id, s.score, NULL, s.direct_votes, true, v.veto_id FROM summary s JOIN fx_veto v ON v.work_id = s.work_id AND v.genre_id = s.genre_id AND NOT v.reverted WHERE s.vetoed)
    SELECT c.work_id, g.slug, g.name, p.slug AS parent_slug, c.score, c.source, c.direct_votes, c.vetoed, c.veto_id,
      CASE WHEN NOT c.vetoed THEN m.work_id IS NOT NULL END AS my_vote, CAST(coalesce(cnt.n, 0) AS INT) AS my_vote_count
    FROM cards c JOIN fx_genre g ON g.genre_id = c.genre_id LEFT JOIN fx_genre p ON p.genre_id = g.parent_id
    LEFT JOIN mine m ON m.work_id = c.work_id AND m.genre_id = c.genre_id LEFT JOIN cnt ON cnt.work_id = c.work_id""")
def n10(w: World) -> DataFrame:
    totals = summary(w)
    return N.genre_cards(N.effective_genres(totals, w.fx("genre")), totals, w.fx("genre"), w.fx("genre_vote"), 7, w.fx("veto"))


_ALIASES = "SELECT work_id AS loser, merged_into AS survivor FROM fx_work WHERE merged_into IS NOT NULL"


@query("n11_merge_genre_evidence", f"""
    WITH a AS ({_ALIASES}) SELECT 'vote' AS what, CAST(v.user_id AS VARCHAR) AS who, coalesce(a.survivor, v.work_id) AS work_id, v.genre_id FROM fx_genre_vote v LEFT JOIN a ON a.loser = v.work_id GROUP BY ALL
    UNION ALL SELECT 'inference', i.source, coalesce(a.survivor, i.work_id) AS work_id, i.genre_id FROM fx_genre_inference i LEFT JOIN a ON a.loser = i.work_id GROUP BY ALL
    UNION ALL SELECT 'veto', CAST(x.veto_id AS VARCHAR), CASE WHEN x.reverted THEN x.work_id ELSE coalesce(a.survivor, x.work_id) END, x.genre_id FROM fx_veto x LEFT JOIN a ON a.loser = x.work_id""")
def n11(w: World) -> DataFrame:
    votes, inferences, vetoes = N.merge_genre_evidence(w.sql(_ALIASES), w.fx("genre_vote"), w.fx("genre_inference"), w.fx("veto"))
    parts = [votes.select(F.lit("vote").alias("what"), F.col("user_id").cast("string").alias("who"), "work_id", "genre_id"),
             inferences.select(F.lit("inference").alias("what"), F.col("source").alias("who"), "work_id", "genre_id"),
             vetoes.select(F.lit("veto").alias("what"), F.col("veto_id").cast("string").alias("who"), "work_id", "genre_id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("n12_genre_tree", """
    SELECT p.genre_id, p.slug, p.name, p.position, string_agg(c.slug || '=' || c.name, '|' ORDER BY c.position, c.name) AS children
    FROM fx_genre p LEFT JOIN fx_genre c ON c.parent_id = p.genre_id AND NOT c.retired WHERE p.parent_id IS NULL AND NOT p.retired GROUP BY ALL""")
def n12(w: World) -> DataFrame:
    tree = N.genre_tree(w.fx("genre"))
    pairs = F.transform("children", lambda c: F.concat_ws("=", c["slug"], c["name"]))
    return tree.withColumn("children", F.array_join(pairs, "|"))


_LISTED = f"SELECT work_id, {Q.kind('raw_title')} AS kind, merged_into, raw_title AS title, readinglog_count FROM fx_work"


def _works(w: World) -> DataFrame:
    return w.fx("work").withColumn("kind", T.classify_kind(F.col("raw_title"), F.lit(""))).withColumnRenamed("raw_title", "title")


@query("n13_genre_page", f"""
    WITH {SUMMARY}, listed AS ({_LISTED}), books AS (SELECT e.genre_id, count(*) AS n FROM effective e JOIN listed l ON l.work_id = e.work_id WHERE l.kind = 'single' AND l.merged_into IS NULL GROUP BY 1)
    SELECT g.slug, coalesce(p.slug, g.slug) AS room_slug, g.retired, c.slug AS child_slug, CASE WHEN c.slug IS NOT NULL THEN coalesce(b.n, 0) END AS book_count
    FROM fx_genre g LEFT JOIN fx_genre p ON p.genre_id = g.parent_id LEFT JOIN fx_genre c ON c.parent_id = g.genre_id AND NOT c.retired LEFT JOIN books b ON b.genre_id = c.genre_id""")
def n13(w: World) -> DataFrame:
    return N.genre_page(w.fx("genre"), effective(w), _works(w))


def _page(order: str) -> str:
    return (f"WITH {SUMMARY}, listed AS ({_LISTED}) SELECT l.work_id, l.title, e.score, l.readinglog_count, e.source = 'inferred' AS inferred FROM effective e "
            f"JOIN listed l ON l.work_id = e.work_id WHERE e.genre_id = 2 AND l.kind = 'single' AND l.merged_into IS NULL ORDER BY {order} LIMIT 20 OFFSET 10")


@query("n14_genre_works_top", _page("e.score DESC, l.readinglog_count DESC, l.title, l.work_id"))
def n14(w: World) -> DataFrame:
    return N.genre_works(2, effective(w), _works(w), "top", 20, 10)


@query("n14_genre_works_title", _page("l.title, l.work_id"))
def n14_title(w: World) -> DataFrame:
    return N.genre_works(2, effective(w), _works(w), "title", 20, 10)


_RELEASED = "SELECT work_id, merged_into, CASE WHEN shelf_mark IN ('SMALL', 'LARGE') THEN '2026.01.1' END AS catalog_release FROM fx_work"
_REBUILT = f"""rel AS ({_RELEASED}), tg AS ({_SLUG_GENRES}),
    fresh AS (SELECT i.work_id, g.genre_id, CASE WHEN r.catalog_release IS NULL THEN 'open_library' ELSE 'catalog' END AS source
      FROM inferred i JOIN rel r ON r.work_id = i.work_id AND r.merged_into IS NULL JOIN tg g ON g.slug = i.slug AND NOT g.retired),
    redone AS (SELECT i.work_id, i.genre_id, i.source FROM fx_genre_inference i JOIN rel r ON r.work_id = i.work_id
      WHERE NOT (r.merged_into IS NULL AND i.source = CASE WHEN r.catalog_release IS NULL THEN 'open_library' ELSE 'catalog' END)
      UNION SELECT work_id, genre_id, source FROM fresh)"""


@query("n15_rebuild_genres", f"WITH {_INFERRED}, {_REBUILT}, {summary_sql(inferences='redone', genres='tg')} SELECT * FROM summary")
def n15(w: World) -> DataFrame:
    return N.rebuild_genres(w.sql(_RELEASED), w.fx("subject"), w.fx("taxonomy"), w.fx("genre_vote"), w.fx("genre_inference"),
                            w.sql(_SLUG_GENRES), N.live_vetoes(w.fx("veto")))[1]
