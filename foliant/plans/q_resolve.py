"""Entity resolution jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import resolve as E
from foliant.plans import check_sql as Q
from foliant.plans.q_genres import SUMMARY, effective
from foliant.plans.q_graph import RESOLVED, _COMPONENTS, author_records
from foliant.plans.q_sources import _POPULARITY
from foliant.plans.world import World, query
from foliant.operators import genres as N
from foliant.operators.extract import popularity
from foliant.operators.graph import cluster_authors as _clusters
from foliant.session import written


def dup_inputs(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    works = w.fx("work").select(
        "work_id", F.col("author_id").alias("author"), T.clean_title(F.col("raw_title")).alias("title_key"),
        T.classify_kind(F.col("raw_title"), F.lit("")).alias("kind"), (F.col("readinglog_count") + F.col("edition_count")).alias("popularity"))
    links = w.fx("kg_membership").select(F.col("ol_id").alias("work_id"), F.col("series").alias("item"))
    titles = w.fx("edition").filter("is_english").select("work_id", "title", "subtitle").distinct()
    keys = titles.select("work_id", T.edition_title_key(F.col("title"), F.col("subtitle")).alias("tkey"))
    return works, links, keys


_DUPLICATES = f"""
    dw AS (SELECT work_id, work_num, author_id, {Q.clean('raw_title')} AS tk, readinglog_count + edition_count AS pop FROM fx_work WHERE {Q.kind('raw_title')} <> 'collection'),
    it AS (SELECT ol_id AS work_id, list(DISTINCT series) AS items FROM fx_kg_membership GROUP BY 1),
    ti AS (SELECT work_id, list(DISTINCT {Q.clean('t')}) AS titles FROM (SELECT DISTINCT work_id, concat_ws(' ', nullif(title, ''), nullif(subtitle, '')) AS t FROM fx_edition WHERE is_english) GROUP BY 1),
    dr AS (SELECT d.*, coalesce(items, []) AS items, coalesce(titles, []) AS titles, row_number() OVER (PARTITION BY author_id, tk ORDER BY items IS NULL, -pop, work_num) AS rn FROM dw d LEFT JOIN it USING (work_id) LEFT JOIN ti USING (work_id) WHERE tk <> ''),
    inc AS (SELECT a.work_id, list(b.rn) AS bad FROM dr a JOIN dr b ON b.author_id = a.author_id AND b.tk = a.tk AND b.rn < a.rn
      WHERE (len(a.items) > 0 AND len(b.items) > 0 AND NOT list_has_any(a.items, b.items)) OR (len(a.titles) > 0 AND len(b.titles) > 0 AND NOT list_has_any(a.titles, b.titles)) GROUP BY 1),
    rows AS (SELECT dr.*, coalesce(inc.bad, []) AS bad FROM dr LEFT JOIN inc USING (work_id)),
    greedy AS (SELECT author_id, tk, CAST(1 AS BIGINT) AS rn, [[CAST(1 AS BIGINT)]] AS st FROM rows WHERE rn = 1
      UNION ALL SELECT g.author_id, g.tk, r.rn, CASE WHEN coalesce(list_position(list_transform(g.st, lambda c: NOT list_has_any(c, r.bad)), true), 0) = 0 THEN list_append(g.st, [r.rn])
        ELSE list_transform(g.st, lambda c, i: CASE WHEN i = list_position(list_transform(g.st, lambda d: NOT list_has_any(d, r.bad)), true) THEN list_append(c, r.rn) ELSE c END) END
        FROM greedy g JOIN rows r ON r.author_id = g.author_id AND r.tk = g.tk AND r.rn = g.rn + 1),
    cl AS (SELECT author_id, tk, unnest(arg_max(st, rn)) AS c FROM greedy GROUP BY 1, 2), mem AS (SELECT author_id, tk, c[1] AS head, unnest(c) AS rn FROM cl),
    dup AS (SELECT l.work_id AS loser, s.work_id AS survivor FROM mem m JOIN rows l ON l.author_id = m.author_id AND l.tk = m.tk AND l.rn = m.rn JOIN rows s ON s.author_id = m.author_id AND s.tk = m.tk AND s.rn = m.head WHERE m.rn <> m.head)"""


@query("e01_find_duplicates", f"WITH RECURSIVE {_DUPLICATES} SELECT * FROM dup")
def e01(w: World) -> DataFrame:
    return E.find_duplicates(*dup_inputs(w))


_ALIASES = "SELECT work_id AS loser, merged_into AS survivor FROM fx_work WHERE merged_into IS NOT NULL"
_COUNTED = "SELECT work_id, raw_title AS title, CAST(work_num % 7 AS INT) AS ratings_count, readinglog_count, edition_count FROM fx_work"


def _folded(w: World):
    return E.fold_duplicates(w.sql(_COUNTED), w.fx("edition").select("edition_id", "work_id"),
                             w.fx("kg_membership").select(F.col("ol_id").alias("work_id"), "item"), w.sql(_ALIASES))


@query("e02_fold_duplicates", f"""
    WITH a AS ({_ALIASES}), c AS ({_COUNTED}) SELECT k.work_id, k.title, CAST(sum(s.ratings_count) AS INT) AS ratings_count, CAST(sum(s.readinglog_count) AS INT) AS readinglog_count,
      CAST(sum(s.edition_count) AS INT) AS edition_count FROM c k JOIN (SELECT coalesce(a.survivor, c.work_id) AS id, c.* FROM c LEFT JOIN a ON a.loser = c.work_id) s ON s.id = k.work_id
    WHERE k.work_id NOT IN (SELECT loser FROM a) GROUP BY 1, 2""")
def e02(w: World) -> DataFrame:
    return _folded(w)[0]


@query("e02_fold_duplicate_links", f"""
    WITH a AS ({_ALIASES}) SELECT 'edition' AS what, edition_id AS id, coalesce(a.survivor, e.work_id) AS work_id FROM fx_edition e LEFT JOIN a ON a.loser = e.work_id
    UNION ALL SELECT DISTINCT 'item', item, coalesce(a.survivor, ol_id) FROM fx_kg_membership k LEFT JOIN a ON a.loser = k.ol_id""")
def e02_links(w: World) -> DataFrame:
    _, editions, links = _folded(w)
    return editions.select(F.lit("edition").alias("what"), F.col("edition_id").alias("id"), "work_id").unionByName(
        links.select(F.lit("item").alias("what"), F.col("item").alias("id"), "work_id"))


_MERGES = """
    SELECT p_partkey AS seq, concat('OL', p_partkey + 1, 'W') AS survivor, concat('OL', p_partkey + 2, 'W') AS l1, concat('OL', p_partkey + 30, 'W') AS l2
    FROM part WHERE p_type = 'PROMO'"""


# The state maps every loser to its root; a step renames the losing root everywhere and adds it.
_REPLAY = f"""
    al AS ({_ALIASES}), chase AS (SELECT loser, survivor AS node, 1 AS hop FROM al UNION ALL SELECT c.loser, a.survivor, c.hop + 1 FROM chase c JOIN al a ON a.loser = c.node),
    flat AS (SELECT loser, arg_max(node, hop) AS root FROM chase GROUP BY loser),
    said AS (SELECT seq, survivor, unnest([l1, l2]) AS loser, unnest([0, 1]) AS sub FROM ({_MERGES})),
    steps AS (SELECT row_number() OVER (ORDER BY seq, sub, loser) AS n, survivor, loser FROM said WHERE loser IS NOT NULL),
    fold AS (SELECT CAST(0 AS BIGINT) AS n, list({{'k': loser, 'r': root}}) AS state FROM flat
      UNION ALL SELECT n, CASE WHEN a = b THEN state ELSE list_append(list_transform(state, lambda x: CASE WHEN x.r = b THEN {{'k': x.k, 'r': a}} ELSE x END), {{'k': b, 'r': a}}) END
        FROM (SELECT t.n, f.state, coalesce(list_filter(f.state, lambda x: x.k = t.survivor)[1].r, t.survivor) AS a, coalesce(list_filter(f.state, lambda x: x.k = t.loser)[1].r, t.loser) AS b
          FROM fold f JOIN steps t ON t.n = f.n + 1)),
    merged AS (SELECT unnest(arg_max(state, n)) AS m FROM fold)"""


@query("e03_apply_merges", f"WITH RECURSIVE {_REPLAY} SELECT m.k AS loser, m.r AS survivor FROM merged")
def e03(w: World) -> DataFrame:
    entries = w.sql(_MERGES).select("seq", "survivor", F.array("l1", "l2").alias("losers"))
    return E.apply_merges(entries, w.sql(_ALIASES))


_SPLITTING = ("SELECT work_id, edition_id FROM fx_edition WHERE page_count > 270 AND publisher <> 'Supplier#000000003'")
_FULL_WORKS = ("SELECT work_id, raw_title, raw_title AS title, CAST(NULL AS STRING) AS subtitle, CAST(NULL AS BIGINT) AS cover_id, shelf_mark AS subjects, "
               "1 AS ratings_count, readinglog_count, edition_count, author FROM fx_work")
_SPLIT_SQL = f"""
    WITH s AS (SELECT work_id, min(edition_id) AS first, count(DISTINCT edition_id) AS n FROM ({_SPLITTING}) GROUP BY 1), a AS ({_ALIASES}),
    listed AS (SELECT DISTINCT edition_id FROM ({_SPLITTING})), ed AS (SELECT DISTINCT edition_id, work_id, title, subtitle, cover_id FROM fx_edition),
    moved AS (SELECT e.edition_id, coalesce(a.survivor, e.work_id) AS work_id, e.title, e.subtitle, e.cover_id, e.work_id AS was FROM ed e LEFT JOIN a ON a.loser = e.work_id)"""


def _split(w: World):
    editions = w.sql("SELECT DISTINCT edition_id, work_id, title, subtitle, cover_id FROM fx_edition")
    aliases = w.sql(_ALIASES)
    _, moved, _ = E.fold_duplicates(w.sql(_COUNTED), editions, w.fx("kg_membership").select(F.col("ol_id").alias("work_id"), "item"), aliases)
    splits = w.sql(_SPLITTING).groupBy("work_id").agg(F.collect_set("edition_id").alias("editions"))
    return E.apply_splits(splits, w.sql(_FULL_WORKS), moved.select(*editions.columns), aliases)


@query("e04_apply_splits", _SPLIT_SQL + f""", f AS ({_FULL_WORKS})
    SELECT * FROM f UNION ALL SELECT s.work_id || '~' || s.first, e.title, e.title, e.subtitle, e.cover_id, NULL, 0, 0, CAST(s.n AS INT), f.author
    FROM s LEFT JOIN a ON a.loser = s.work_id JOIN f ON f.work_id = coalesce(a.survivor, s.work_id) JOIN ed e ON e.edition_id = s.first""")
def e04(w: World) -> DataFrame:
    return _split(w)[0]


@query("e04_apply_split_editions", _SPLIT_SQL + """
    SELECT m.edition_id, CASE WHEN l.edition_id IS NOT NULL THEN s.work_id || '~' || s.first ELSE m.work_id END AS work_id
    FROM moved m LEFT JOIN listed l ON l.edition_id = m.edition_id LEFT JOIN s ON s.work_id = m.was""")
def e04_editions(w: World) -> DataFrame:
    return _split(w)[1].select("edition_id", "work_id")


@query("e05_primary_author", f"WITH RECURSIVE {_COMPONENTS} SELECT w.work_id, c.cluster AS author FROM fx_work w LEFT JOIN clusters c ON c.id = w.author_id")
def e05(w: World) -> DataFrame:
    works = w.fx("work").select("work_id", F.array("author_id").alias("author_ids"))
    return E.primary_author(works, _clusters(*author_records(w)))


@query("e06_link_kg_items", f"""
    WITH RECURSIVE {RESOLVED} SELECT DISTINCT coalesce(r.target, k.ol_id) AS work_id, k.item FROM fx_kg_membership k LEFT JOIN resolved r ON r.id = k.ol_id
    UNION SELECT work_id, publisher FROM fx_edition WHERE page_count > 280""")
def e06(w: World) -> DataFrame:
    kg = w.sql("SELECT ol_id, item FROM fx_kg_membership UNION ALL SELECT edition_id, publisher FROM fx_edition WHERE page_count > 280")
    return E.link_kg_items(kg, w.fx("redirect"), w.fx("edition"))


_REP_WORKS = "SELECT work_id, CAST(work_num % 100 AS BIGINT) AS cover_id FROM fx_work"
_REP_EDITIONS = "SELECT edition_id, work_id, cover_id, CASE WHEN isbn_raw <> 'n/a' THEN isbn_raw END AS isbn_13, CASE WHEN page_count > 60 THEN page_count END AS page_count FROM fx_edition"


@query("e07_representative_edition", f"""
    SELECT work_id, representative_edition FROM (SELECT e.work_id, e.edition_id AS representative_edition, row_number() OVER (PARTITION BY e.work_id ORDER BY
      CASE WHEN e.cover_id = w.cover_id THEN 0 ELSE 1 END, e.cover_id IS NULL, isbn_13 IS NULL, page_count IS NULL, CAST(regexp_extract(edition_id, '[0-9]+') AS BIGINT), edition_id) AS rn
      FROM ({_REP_EDITIONS}) e JOIN ({_REP_WORKS}) w ON w.work_id = e.work_id) WHERE rn = 1""")
def e07(w: World) -> DataFrame:
    return E.representative_edition(w.sql(_REP_EDITIONS), w.sql(_REP_WORKS))


# --- runtime works, editions and documents --------------------------------------------
_RW = """
    SELECT work_id, CASE WHEN shelf_mark IN ('SMALL', 'MEDIUM') THEN 'heuristic' ELSE 'openlibrary' END AS source,
      CASE WHEN shelf_mark IN ('SMALL', 'MEDIUM') THEN concat('h', work_num) ELSE work_id END AS external_id, merged_into,
      CASE WHEN shelf_mark = 'LARGE' THEN '2026.01.1' END AS catalog_release, raw_title AS title, author, first_publish_year, readinglog_count,
      series_id, shelf_mark = 'PROMO' AS stale, CASE WHEN shelf_mark = 'SMALL' THEN 'text 3' END AS description,
      CAST(work_num % 50 AS BIGINT) AS ol_cover_id, CAST(edition_count AS INT) AS ol_edition_count, 0 AS ratings_count, shelf_mark AS subjects FROM fx_work"""
_STORED = f"CASE WHEN stale THEN {Q.ckey('''author || ' old' ''', 'author')} ELSE {Q.ckey('title', 'author')} END"
_RW_SQL = f"rw AS (SELECT *, {_STORED} AS canonical_key, {Q.ckey('title', 'author')} AS fresh_key FROM ({_RW}))"
_RE = f"""
    SELECT DISTINCT edition_id, CASE WHEN is_english THEN work_id END AS work_id, work_id AS asked_by, publish_year AS pos, author,
      CASE WHEN page_count > 150 THEN title ELSE concat(title, ' (', 'Deluxe) Vol. 2') END AS title, subtitle, isbn_raw AS isbn_13, publish_year AS published_year, language, cover_url,
      CASE WHEN page_count > 200 THEN concat('text ', page_count % 5) END AS description, page_count, CASE WHEN page_count > 250 THEN 1 END AS ratings_count FROM fx_edition"""
_DOC = "SELECT p_partkey AS pos, concat('OL', p_partkey + 1, 'W') AS key, p_name AS title, p_brand AS author, p_size AS edition_count, CAST(1950 + p_size AS INT) AS first_publish_year, CAST(p_size % 6 AS BIGINT) AS cover_id FROM part"
_DOC_ISBN = ("SELECT CAST(substr(work_id, 3, length(work_id) - 3) AS BIGINT) - 1 AS pos, isbn_raw FROM fx_edition "
             "UNION ALL SELECT CAST(substr(work_id, 3, length(work_id) - 3) AS BIGINT) - 2, isbn_raw FROM fx_edition WHERE publish_year > 1998")
_OFFERED = f"""
    di AS (SELECT DISTINCT pos, {Q.isbn('isbn_raw')} AS isbn FROM ({_DOC_ISBN})), doc AS ({_DOC}), re AS ({_RE}),
    by_isbn AS (SELECT isbn, arg_min(doc.key, doc.pos) AS key FROM di JOIN doc ON doc.pos = di.pos WHERE isbn IS NOT NULL GROUP BY isbn),
    by_title AS (SELECT t, a, arg_max(key, (edition_count, -pos)) AS key FROM (SELECT *, {Q.clean('title')} AS t, {Q.norm('author')} AS a FROM doc) GROUP BY 1, 2)"""


def runtime_works(w: World) -> DataFrame:
    stored = F.when(F.col("stale"), T.canonical_key(F.concat(F.col("author"), F.lit(" old")), F.col("author"))).otherwise(
        T.canonical_key(F.col("title"), F.col("author")))
    return w.sql(_RW).withColumn("canonical_key", stored)


def runtime_docs(w: World) -> DataFrame:
    isbns = w.sql(_DOC_ISBN).select("pos", T.normalize_isbn(F.col("isbn_raw")).alias("i")).filter("i IS NOT NULL").groupBy("pos").agg(
        F.collect_set("i").alias("isbn_13s"))
    return w.sql(_DOC).join(isbns, "pos", "left").withColumn("isbn_13s", F.coalesce("isbn_13s", F.array().cast("array<string>")))


@query("e08_resolve_by_isbn", f"WITH {_OFFERED} SELECT re.edition_id, b.key FROM re JOIN by_isbn b ON b.isbn = {Q.isbn('re.isbn_13')}")
def e08(w: World) -> DataFrame:
    return E.resolve_by_isbn(w.sql(_RE), runtime_docs(w))


@query("e09_resolve_by_title_author",
       f"WITH {_OFFERED}, k AS (SELECT edition_id, {Q.clean('title')} AS t, {Q.norm('author')} AS a FROM re) SELECT k.edition_id, b.key FROM k JOIN by_title b ON b.t = k.t AND b.a = k.a")
def e09(w: World) -> DataFrame:
    return E.resolve_by_title_author(w.sql(_RE), runtime_docs(w))


_CLAIM = f"""
    offered AS (SELECT canonical_key AS key, 0 AS loose, work_id FROM rw WHERE source = 'openlibrary' AND merged_into IS NULL
      UNION ALL SELECT fresh_key, 1, work_id FROM rw WHERE source = 'openlibrary' AND merged_into IS NULL AND fresh_key <> canonical_key
        AND split_part(fresh_key, chr(31), 2) = split_part(canonical_key, chr(31), 2)),
    claim AS (SELECT key, arg_min(work_id, (loose, work_id)) AS work_id FROM offered GROUP BY key)"""
_LADDER = f"""
    {_OFFERED}, {_RW_SQL}, {_CLAIM},
    pend AS (SELECT *, {Q.isbn('isbn_13')} AS i, {Q.clean('title')} AS t, {Q.norm('author')} AS a FROM re WHERE work_id IS NULL),
    tier AS (SELECT p.*, p.t || chr(31) || p.a AS ckey, coalesce(x.key, y.key) AS doc_key,
      CASE WHEN x.key IS NOT NULL THEN 'isbn' WHEN y.key IS NOT NULL THEN 'title_author' ELSE 'heuristic' END AS provenance
      FROM pend p LEFT JOIN by_isbn x ON x.isbn = p.i LEFT JOIN by_title y ON y.t = p.t AND y.a = p.a),
    ext AS (SELECT *, coalesce(doc_key, sha1(ckey)) AS external_id, CASE WHEN doc_key IS NULL THEN 'heuristic' ELSE 'openlibrary' END AS source FROM tier),
    link AS (SELECT e.*, coalesce(coalesce(k.merged_into, k.work_id), CASE WHEN e.source = 'heuristic' THEN c.work_id END) AS found
      FROM ext e LEFT JOIN rw k ON k.source = e.source AND k.external_id = e.external_id LEFT JOIN claim c ON c.key = e.ckey)"""


def _laddered(w: World):
    w.keep("edition_line")  # the editions and both lists of ISBNs are made of it
    return E.resolve_ladder(w.sql(_RE), runtime_docs(w), runtime_works(w))


@query("e10_resolve_ladder", f"WITH {_LADDER} SELECT edition_id, external_id, source, provenance, found AS work_id FROM link")
def e10(w: World) -> DataFrame:
    return _laddered(w)[0]


@query("e10_resolve_ladder_new_works", f"""
    WITH {_LADDER}, f AS (SELECT * FROM link WHERE found IS NULL QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY edition_id) = 1)
    SELECT f.source, f.external_id, f.ckey AS canonical_key, coalesce(d.title, regexp_replace(f.title, ' \\(Deluxe\\) Vol. 2', '')) AS title, f.subtitle, coalesce(d.author, f.author) AS author,
      coalesce(d.first_publish_year, f.published_year) AS first_publish_year, 'single' AS kind, f.provenance AS identity_provenance FROM f LEFT JOIN doc d ON d.key = f.external_id""")
def e10_new(w: World) -> DataFrame:
    return _laddered(w)[1]


@query("e11_claim_existing",
       f"WITH {_RW_SQL}, {_CLAIM}, re AS (SELECT *, {Q.ckey('title', 'author')} AS ckey FROM ({_RE})) SELECT re.edition_id, c.work_id FROM re JOIN claim c ON c.key = re.ckey")
def e11(w: World) -> DataFrame:
    return E.claim_existing(w.sql(_RE), runtime_works(w))


@query("e12_absorb_twins", f"""
    WITH {_RW_SQL}, up AS (SELECT key, min(work_id) AS survivor FROM (SELECT canonical_key AS key, work_id FROM rw WHERE source = 'openlibrary' AND merged_into IS NULL
      UNION ALL SELECT fresh_key, work_id FROM rw WHERE source = 'openlibrary' AND merged_into IS NULL) GROUP BY key)
    SELECT h.work_id AS loser, up.survivor FROM rw h JOIN up ON up.key = h.canonical_key WHERE h.source = 'heuristic' AND h.merged_into IS NULL""")
def e12(w: World) -> DataFrame:
    return E.absorb_twins(runtime_works(w))


_UPGRADE_EDITIONS = "SELECT DISTINCT edition_id, work_id, CASE WHEN publish_year < 1996 OR publish_year > 2000 THEN isbn_raw END AS isbn_13 FROM fx_edition"


@query("e13_upgrade_heuristic", f"""
    WITH {_OFFERED}, {_RW_SQL}, ue AS (SELECT * FROM ({_UPGRADE_EDITIONS}) WHERE isbn_13 IS NOT NULL), h AS (SELECT *, {Q.clean('title')} AS t, {Q.norm('author')} AS a FROM rw WHERE source = 'heuristic' AND merged_into IS NULL),
    hit AS (SELECT u.work_id, count(DISTINCT b.key) AS n, min(b.key) AS key FROM ue u JOIN h ON h.work_id = u.work_id JOIN by_isbn b ON b.isbn = {Q.isbn('u.isbn_13')} GROUP BY 1),
    fin AS (SELECT work_id, key FROM hit WHERE n = 1 UNION ALL SELECT h.work_id, b.key FROM h JOIN by_title b ON b.t = h.t AND b.a = h.a WHERE h.work_id NOT IN (SELECT work_id FROM hit))
    SELECT f.work_id, f.key, CASE WHEN f.work_id IN (SELECT work_id FROM ue) THEN 'isbn' ELSE 'title_author' END AS provenance, u.work_id AS target
    FROM fin f LEFT JOIN rw u ON u.source = 'openlibrary' AND u.external_id = f.key""")
def e13(w: World) -> DataFrame:
    return E.upgrade_heuristic(runtime_works(w), w.sql(_UPGRADE_EDITIONS), runtime_docs(w))


_OLD_ED = "SELECT DISTINCT 'google_books' AS source, edition_id AS external_id, title, subtitle, page_count, language FROM fx_edition WHERE is_english"
_NEW_ED = ("SELECT DISTINCT 'google_books' AS source, edition_id AS external_id, CASE WHEN page_count > 100 THEN concat(title, '!') ELSE '' END AS title, CAST(NULL AS STRING) AS subtitle, "
           "CASE WHEN page_count > 200 THEN 0 ELSE page_count + 1 END AS page_count, 'xx' AS language FROM fx_edition WHERE publish_year > 1996")


@query("e14_upsert_editions", f"""
    WITH o AS ({_OLD_ED}), n AS ({_NEW_ED}) SELECT coalesce(o.source, n.source) AS source, coalesce(o.external_id, n.external_id) AS external_id,
      CASE WHEN o.source IS NULL OR n.title <> '' THEN n.title ELSE o.title END AS title, CASE WHEN o.source IS NULL OR n.subtitle <> '' THEN n.subtitle ELSE o.subtitle END AS subtitle,
      CASE WHEN o.source IS NULL OR n.page_count <> 0 THEN n.page_count ELSE o.page_count END AS page_count, CASE WHEN o.source IS NULL OR n.language <> '' THEN n.language ELSE o.language END AS language
    FROM o FULL JOIN n ON n.external_id = o.external_id""")
def e14(w: World) -> DataFrame:
    return E.upsert_editions(w.sql(_OLD_ED), w.sql(_NEW_ED))


_INGEST = "SELECT p_partkey AS pos, concat('OL', p_partkey + 300, 'W') AS key, concat(p_name, ' new') AS title, p_brand AS author, p_size AS edition_count, CAST(1950 + p_size AS INT) AS first_publish_year, CAST(p_size % 6 AS BIGINT) AS cover_id, p_size AS readinglog_count, 3 AS ratings_count, p_type FROM part"
_INGEST_ALIAS = "SELECT concat('OL', p_partkey + 2100, 'W') AS ol_work_id, concat('OL', p_partkey + 5, 'W') AS work_id FROM part WHERE p_type IN ('SMALL', 'ECONOMY')"
_RW_COLUMNS = "work_id, source, external_id, merged_into, catalog_release, title, author, first_publish_year, canonical_key, kind, ol_cover_id, ol_edition_count, readinglog_count, ratings_count, subjects"


def _ingest_works(w: World) -> DataFrame:
    return runtime_works(w).withColumn("kind", F.lit("single")).select(*_RW_COLUMNS.split(", "))


@query("e15_upsert_works_from_docs", f"""
    WITH {_RW_SQL}, ing AS ({_INGEST}), al AS ({_INGEST_ALIAS}),
    hit AS (SELECT i.*, coalesce(o.work_id, al.work_id) AS h FROM ing i LEFT JOIN rw o ON o.source = 'openlibrary' AND o.external_id = i.key LEFT JOIN al ON al.ol_work_id = i.key),
    land AS (SELECT h.*, coalesce(t.merged_into, t.work_id) AS target FROM hit h LEFT JOIN rw t ON t.work_id = h.h),
    lastd AS (SELECT target, arg_max(edition_count, pos) AS ec, arg_max(readinglog_count, pos) AS rl, arg_max(ratings_count, pos) AS rc, arg_max(p_type, pos) AS su,
      arg_max(cover_id, pos) FILTER (WHERE cover_id > 0) AS cv FROM land WHERE target IS NOT NULL GROUP BY 1)
    SELECT r.work_id, source, external_id, merged_into, catalog_release, title, author, first_publish_year, canonical_key, 'single' AS kind,
      CASE WHEN l.target IS NOT NULL AND catalog_release IS NULL THEN coalesce(cv, ol_cover_id) ELSE ol_cover_id END AS ol_cover_id,
      CASE WHEN l.target IS NOT NULL AND catalog_release IS NULL THEN ec ELSE ol_edition_count END AS ol_edition_count,
      CASE WHEN l.target IS NOT NULL AND catalog_release IS NULL THEN rl ELSE readinglog_count END AS readinglog_count,
      CASE WHEN l.target IS NOT NULL AND catalog_release IS NULL THEN rc ELSE ratings_count END AS ratings_count,
      CASE WHEN l.target IS NOT NULL AND catalog_release IS NULL THEN su ELSE subjects END AS subjects FROM rw r LEFT JOIN lastd l ON l.target = r.work_id
    UNION ALL SELECT NULL, 'openlibrary', key, NULL, NULL, title, author, first_publish_year, {Q.ckey('title', 'author')}, 'single', cover_id, edition_count, readinglog_count, ratings_count, p_type FROM land WHERE target IS NULL""")
def e15(w: World) -> DataFrame:
    docs = w.sql(_INGEST).withColumn("subjects", F.array("p_type"))
    return E.upsert_works_from_docs(_ingest_works(w), w.sql(_INGEST_ALIAS), docs)


_ATTACH = f"""
    {_RW_SQL}, re AS (SELECT *, {Q.ckey('title', 'author')} AS ckey FROM ({_RE})),
    att AS (SELECT e.*, coalesce(e.work_id, CASE WHEN e.ckey = r.canonical_key OR e.ckey = r.fresh_key THEN e.asked_by END) AS owner FROM re e JOIN rw r ON r.work_id = e.asked_by),
    real AS (SELECT url FROM fx_cover_check WHERE status = 200 AND content_type LIKE 'image/%' AND NOT (content_type = 'image/png' AND content_length = 9103))"""


def _attached(w: World):
    return E.attach_editions(w.sql(_RE), runtime_works(w), w.fx("cover_check"))


@query("e16_attach_editions",
       f"WITH {_ATTACH} SELECT edition_id, owner AS work_id, CASE WHEN owner IS NULL OR owner <> asked_by OR cover_url IN (SELECT url FROM real) THEN cover_url END AS cover_url FROM att")
def e16(w: World) -> DataFrame:
    return _attached(w)[0].select("edition_id", "work_id", "cover_url")


@query("e16_attach_descriptions", f"""
    WITH {_ATTACH}, b AS (SELECT owner, arg_min(description, (pos, edition_id)) AS d FROM att WHERE owner = asked_by AND description <> '' GROUP BY 1)
    SELECT r.work_id, coalesce(nullif(r.description, ''), b.d) AS description FROM rw r LEFT JOIN b ON b.owner = r.work_id""")
def e16_works(w: World) -> DataFrame:
    return _attached(w)[1].select("work_id", "description")


_TITLE_HITS = "SELECT o_custkey AS query_id, o_orderkey AS pos, concat('v', o_orderkey % 40) AS external_id FROM orders WHERE o_orderpriority LIKE '1%'"
_BROAD_HITS = "SELECT o_custkey AS query_id, o_orderkey AS pos, concat('v', o_orderkey % 40) AS external_id FROM orders WHERE o_orderstatus = 'F'"


@query("e17_two_pass_results", f"""
    WITH t AS ({_TITLE_HITS}), b AS ({_BROAD_HITS}), n AS (SELECT query_id FROM t GROUP BY 1 HAVING count(*) >= 3)
    SELECT query_id, 1 AS phase, pos, external_id FROM t UNION ALL SELECT query_id, 2, pos, external_id FROM b
    WHERE query_id NOT IN (SELECT query_id FROM n) AND NOT EXISTS (SELECT 1 FROM t WHERE t.query_id = b.query_id AND t.external_id = b.external_id)""")
def e17(w: World) -> DataFrame:
    return E.two_pass_results(w.sql(_TITLE_HITS), w.sql(_BROAD_HITS))


def _rank_sql(cover: str = "cover_url") -> str:
    return (f"(CASE WHEN coalesce(language, '') = '' THEN 1 WHEN language = 'en' THEN 2 ELSE 0 END, CASE WHEN {cover} IS NULL THEN 0 ELSE 1 END, "
            f"CASE WHEN description IS NULL THEN 0 ELSE 1 END, CASE WHEN {cover} IS NULL THEN 0 ELSE 4 END + CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN isbn_13 = '' THEN 0 ELSE 1 END "
            "+ CASE WHEN page_count = 0 THEN 0 ELSE 1 END + CASE WHEN ratings_count IS NULL THEN 0 ELSE 1 END, -CAST(regexp_extract(edition_id, '[0-9]+') AS BIGINT), edition_id)")


@query("e18_pick_representative", f"SELECT work_id, arg_max(edition_id, {_rank_sql()}) AS representative FROM ({_RE}) WHERE work_id IS NOT NULL GROUP BY 1")
def e18(w: World) -> DataFrame:
    return E.pick_representative(w.sql(_RE))


_REPS = "SELECT work_id, CASE WHEN min(page_count) > 20 THEN max(edition_id) ELSE min(edition_id) END AS representative FROM fx_edition GROUP BY work_id"
_REPAIR = f"""
    {_RW_SQL}, reps AS ({_REPS}), re AS (SELECT *, {Q.ckey('title', 'author')} AS ckey FROM ({_RE})),
    j AS (SELECT e.*, r.description AS wtext, coalesce(e.ckey NOT IN (r.canonical_key, r.fresh_key), false) AS wrong FROM re e LEFT JOIN rw r ON r.work_id = e.work_id),
    fx AS (SELECT * REPLACE (CASE WHEN NOT wrong THEN work_id END AS work_id) FROM j),
    copied AS (SELECT DISTINCT work_id FROM j WHERE wrong AND wtext <> '' AND wtext = description),
    best AS (SELECT work_id, arg_max(edition_id, {_rank_sql()}) AS best FROM fx WHERE work_id IS NOT NULL GROUP BY 1),
    d AS (SELECT r.work_id, p.representative AS before, p.representative IS NOT NULL AND coalesce(o.work_id <> r.work_id, true) AS foreign_rep, b.best, r.description, c.work_id IS NOT NULL AS cop
      FROM rw r LEFT JOIN reps p ON p.work_id = r.work_id LEFT JOIN fx o ON o.edition_id = p.representative LEFT JOIN best b ON b.work_id = r.work_id LEFT JOIN copied c ON c.work_id = r.work_id),
    fin AS (SELECT *, coalesce(best, CASE WHEN NOT foreign_rep THEN before END) AS after FROM d)"""


def _represented(w: World) -> tuple[DataFrame, DataFrame]:
    """The works with the representatives of _REPS, and the editions; the editions are derived once and written."""
    editions = written(w.sql(_RE))
    reps = editions.groupBy(F.col("asked_by").alias("work_id")).agg(
        F.when(F.min("page_count") > 20, F.max("edition_id")).otherwise(F.min("edition_id")).alias("representative"))
    return runtime_works(w).join(reps, "work_id", "left"), editions


def _repaired(w: World):
    works = runtime_works(w).join(w.sql(_REPS), "work_id", "left")
    return E.repair_presentation(works, w.sql(_RE))


@query("e19_repair_presentation", f"WITH {_REPAIR} SELECT work_id, after AS representative, CASE WHEN NOT cop THEN description END AS description FROM fin")
def e19(w: World) -> DataFrame:
    return _repaired(w)[0].select("work_id", "representative", "description")


@query("e19_repair_stats", f"""
    WITH {_REPAIR} SELECT 'descriptions_cleared' AS metric, count(*) FILTER (WHERE cop) AS value FROM fin UNION ALL SELECT 'representatives_repointed', count(*) FILTER (WHERE foreign_rep) FROM fin
    UNION ALL SELECT 'representatives_changed', count(*) FILTER (WHERE after IS DISTINCT FROM before) FROM fin UNION ALL SELECT 'editions_detached', count(*) FILTER (WHERE wrong) FROM j""")
def e19_stats(w: World) -> DataFrame:
    return _repaired(w)[2]


@query("e20_work_presentation", f"""
    WITH {SUMMARY}, {_RW_SQL}, reps AS ({_REPS}), re AS ({_RE}), n AS (SELECT work_id, count(*) AS n FROM re WHERE work_id IS NOT NULL GROUP BY 1),
    tops AS (SELECT e.work_id, g.slug, row_number() OVER (PARTITION BY e.work_id ORDER BY e.score DESC, g.position, g.slug) AS rn FROM effective e JOIN fx_genre g ON g.genre_id = e.genre_id)
    SELECT r.work_id, coalesce(e.cover_url, CASE WHEN r.ol_cover_id <> 0 THEN concat('https://covers.openlibrary.org/b/id/', r.ol_cover_id, '-L.jpg') END) AS cover_url,
      coalesce(e.description, r.description) AS description, CAST(coalesce(nullif(r.ol_edition_count, 0), n.n, 0) AS INT) AS edition_count, concat('s', s.series_id) AS series_slug, s.name AS series_name,
      (SELECT string_agg(t.slug, '|' ORDER BY rn) FROM tops t WHERE t.work_id = r.work_id AND rn <= 3) AS top_genres
    FROM rw r LEFT JOIN reps p ON p.work_id = r.work_id LEFT JOIN re e ON e.edition_id = p.representative LEFT JOIN n ON n.work_id = r.work_id LEFT JOIN fx_series_parent s ON s.series_id = r.series_id""")
def e20(w: World) -> DataFrame:
    series = w.fx("series_parent").select("series_id", F.concat(F.lit("s"), F.col("series_id")).alias("slug"), "name", F.lit("series").alias("kind"))
    works, editions = _represented(w)
    shown = E.work_presentation(works, editions, series, N.top_genres(effective(w), w.fx("genre")))
    return shown.drop("series_kind").withColumn("top_genres", F.array_join(F.col("top_genres.slug"), "|"))


_REFRESH = f"""
    {_RW_SQL}, reps AS ({_REPS}), re AS ({_RE}), doc AS ({_INGEST}),
    real AS (SELECT url FROM fx_cover_check WHERE status = 200 AND content_type LIKE 'image/%' AND NOT (content_type = 'image/png' AND content_length = 9103)),
    ce AS (SELECT * REPLACE (CASE WHEN cover_url IN (SELECT url FROM real) THEN cover_url END AS cover_url), cover_url AS was FROM re),
    lost AS (SELECT edition_id, work_id FROM ce WHERE was IS NOT NULL AND cover_url IS NULL), touched AS (SELECT DISTINCT work_id FROM lost WHERE work_id IS NOT NULL),
    best AS (SELECT work_id, arg_max(edition_id, {_rank_sql()}) AS best FROM ce WHERE work_id IN (SELECT work_id FROM touched) GROUP BY 1),
    j AS (SELECT r.*, d.key AS dk, d.cover_id AS dc, d.edition_count AS de, d.readinglog_count AS dr, d.ratings_count AS dt, d.p_type AS ds, source = 'openlibrary' AND merged_into IS NULL AS live
      FROM rw r LEFT JOIN doc d ON d.key = r.external_id AND r.source = 'openlibrary' AND r.merged_into IS NULL)"""


def _refreshed(w: World):
    works, editions = _represented(w)
    return E.refresh_popularity_covers(works, w.sql(_INGEST).withColumn("subjects", F.array("p_type")), editions, w.fx("cover_check"))


@query("e21_refresh_popularity_covers", f"""
    WITH {_REFRESH} SELECT j.work_id, CASE WHEN dk IS NOT NULL THEN coalesce(nullif(dc, 0), ol_cover_id) ELSE ol_cover_id END AS ol_cover_id, CASE WHEN dk IS NOT NULL THEN de ELSE ol_edition_count END AS ol_edition_count,
      CASE WHEN dk IS NOT NULL THEN dr ELSE readinglog_count END AS readinglog_count, CASE WHEN dk IS NOT NULL THEN dt ELSE ratings_count END AS ratings_count, coalesce(ds, subjects) AS subjects,
      coalesce(b.best, p.representative) AS representative FROM j LEFT JOIN best b ON b.work_id = j.work_id LEFT JOIN reps p ON p.work_id = j.work_id""")
def e21(w: World) -> DataFrame:
    return _refreshed(w)[0].select("work_id", "ol_cover_id", "ol_edition_count", "readinglog_count", "ratings_count", "subjects", "representative")


@query("e21_refresh_stats", f"""
    WITH {_REFRESH} SELECT 'works_scanned' AS metric, count(*) FILTER (WHERE live) AS value FROM j UNION ALL SELECT 'works_updated', count(dk) FROM j UNION ALL SELECT 'covers_scanned', count(was) FROM ce
    UNION ALL SELECT 'covers_nulled', count(*) FROM lost UNION ALL SELECT 'representatives_repicked', count(*) FROM touched""")
def e21_stats(w: World) -> DataFrame:
    return _refreshed(w)[2]


@query("flagship_most_read_works", f"""
    WITH RECURSIVE {_DUPLICATES}, {RESOLVED}, pop AS ({_POPULARITY}), base AS (SELECT w.work_id, trim(regexp_replace({Q.unmarked(Q.plain('raw_title'))}, '\\s+', ' ', 'g'), ' ,:-') AS title, w.author,
      coalesce(p.ratings_count, 0) AS ratings_count, coalesce(p.readinglog_count, 0) AS readinglog_count, w.edition_count FROM fx_work w LEFT JOIN pop p ON p.ol_id = w.work_id),
    folded AS (SELECT coalesce(d.survivor, b.work_id) AS id, sum(ratings_count) AS ratings_count, sum(readinglog_count) AS readinglog_count, sum(edition_count) AS edition_count FROM base b LEFT JOIN dup d ON d.loser = b.work_id GROUP BY 1)
    SELECT b.work_id, b.title, b.author, CAST(f.ratings_count AS INT) AS ratings_count, CAST(f.readinglog_count AS INT) AS readinglog_count, CAST(f.edition_count AS INT) AS edition_count
    FROM folded f JOIN base b ON b.work_id = f.id ORDER BY f.readinglog_count DESC, f.ratings_count DESC, b.work_id LIMIT 20""")
def flagship(w: World) -> DataFrame:
    """Popularity, keys, duplicates and the fold, then the twenty most read works."""
    log = w.fx("log").select(F.col("work_id").alias("ol_id"), "kind")
    counts = popularity(log, w.fx("redirect")).withColumnRenamed("ol_id", "work_id")
    works = w.fx("work").select("work_id", T.display_title(F.col("raw_title")).alias("title"), "author", "edition_count").join(
        counts, "work_id", "left").select(
        "work_id", "title", "author", F.coalesce("ratings_count", F.lit(0)).alias("ratings_count"),
        F.coalesce("readinglog_count", F.lit(0)).alias("readinglog_count"), "edition_count")
    aliases = E.find_duplicates(*dup_inputs(w))
    folded, _, _ = E.fold_duplicates(works, w.fx("edition").select("edition_id", "work_id"),
                                     w.fx("kg_membership").select(F.col("ol_id").alias("work_id"), "item"), aliases)
    return folded.orderBy(F.desc("readinglog_count"), F.desc("ratings_count"), "work_id").limit(20)
