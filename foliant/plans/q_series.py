"""Series decision jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import resolve as E
from foliant.operators import series as L
from foliant.operators.group import group_catalog
from foliant.plans import check_sql as Q
from foliant.plans.q_graph import RESOLVED
from foliant.plans.world import World, query
from foliant.session import materialize

# --- inputs ----------------------------------------------------------------------------
_KG_SERIES = "SELECT qid, label, parent, concat('Alias ', qid) AS alias FROM fx_kg_series"
_AUTHORS = "SELECT work_id, CASE WHEN shelf_mark IN ('SMALL', 'PROMO') THEN author_id ELSE concat('A', series_id % 2) END AS author FROM fx_work"
_TITLES = ("SELECT work_id, '' AS voter, raw_title AS title FROM fx_work UNION ALL SELECT DISTINCT work_id, edition_id, CASE WHEN publish_year > 1999 "
           "THEN concat(title, ' (', author, ' Chronicles, #', page_count % 9 + 1, ')') ELSE title END FROM fx_edition")


def blobs(w: World) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("line", "subject")))["subject"]
    return w.fx("subject").groupBy("work_id").agg(T.join_subjects(lines).alias("subjects"))


def kg_series(w: World) -> DataFrame:
    return w.sql(_KG_SERIES).select("qid", "label", F.array("alias").alias("aliases"), F.array_compact(F.array("parent")).alias("parents"))


def _no_editions(w: World) -> DataFrame:
    return w.fx("edition").select("edition_id", "work_id")


def items(w: World) -> DataFrame:
    return E.link_kg_items(w.fx("kg_membership"), w.fx("redirect"), _no_editions(w))


def edition_series(w: World) -> DataFrame:
    return w.sql("SELECT DISTINCT work_id, edition_id, series_string FROM fx_edition").select("work_id", "edition_id", F.array("series_string").alias("series"))


def all_rungs(w: World) -> list[DataFrame]:
    works = blobs(w)
    return [L.rung1(items(w), w.fx("kg_membership"), kg_series(w)), L.rung2(works, L.tag_counts(works)), L.rung3(edition_series(w)), L.rung4(w.sql(_TITLES))]


def cands(w: World) -> DataFrame:
    """All rungs, written once: the guards and folds read them several times."""
    return materialize(L.candidates(*all_rungs(w)))


def _tag_rows(prefix: str) -> str:
    n = len(prefix) + 2
    return (f"SELECT DISTINCT work_id, '{prefix}:' || trim(regexp_replace(replace(substr(subject, {n}), '_', ' '), '\\s+', ' ', 'g')) AS tag "
            f"FROM fx_subject WHERE lower(subject) LIKE '{prefix}:%'")


_SN, _SP = Q.series_ref("series_string")
_TN, _TP = Q.title_ref("title")
_OKEY = Q.skey("name")


def _vote_sql(prefix: str, refs: str, rung: int) -> str:
    return f"""
    {prefix}r AS (SELECT *, 'ol:' || {_OKEY} AS key FROM ({refs}) WHERE name IS NOT NULL AND {_OKEY} <> ''),
    {prefix}v AS (SELECT work_id, key, count(*) AS n FROM {prefix}r GROUP BY 1, 2),
    {prefix}w AS (SELECT work_id, arg_min(key, (-n, key)) AS key FROM {prefix}v GROUP BY 1),
    {prefix}n AS (SELECT work_id, key, arg_min(name, (-n, name)) AS name FROM (SELECT work_id, key, name, count(*) AS n FROM {prefix}r GROUP BY 1, 2, 3) GROUP BY 1, 2),
    {prefix}p AS (SELECT work_id, key, arg_min(position, (-n, position)) AS position FROM (SELECT work_id, key, position, count(*) AS n FROM {prefix}r WHERE position IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    r{rung} AS (SELECT w.work_id, w.key, n.name, p.position, {rung} AS rung FROM {prefix}w w JOIN {prefix}n n ON n.work_id = w.work_id AND n.key = w.key
      LEFT JOIN {prefix}p p ON p.work_id = w.work_id AND p.key = w.key)"""


_R1 = f"""
    wi AS (SELECT DISTINCT coalesce(r.target, k.ol_id) AS work_id, k.item FROM fx_kg_membership k LEFT JOIN resolved r ON r.id = k.ol_id),
    st AS (SELECT wi.work_id, 'wd:' || k.series AS key, k.series, wi.item, k.ordinal, {Q.ordinal('k.ordinal')} AS position FROM wi JOIN fx_kg_membership k ON k.item = wi.item),
    r1 AS (SELECT st.work_id, st.key, coalesce(nullif(s.label, ''), 'Alias ' || s.qid, st.series) AS name, arg_min(st.position, (st.item, st.ordinal)) FILTER (WHERE st.position IS NOT NULL) AS position, 1 AS rung
      FROM st LEFT JOIN fx_kg_series s ON s.qid = st.series GROUP BY 1, 2, 3)"""
_R2 = f"""
    ft AS ({_tag_rows('franchise')}), sg AS ({_tag_rows('series')}), tc AS (SELECT tag, count(*) AS n FROM sg GROUP BY 1),
    ch AS (SELECT work_id, min(tag) AS tag FROM ft GROUP BY 1 UNION ALL SELECT sg.work_id, arg_min(sg.tag, (-tc.n, sg.tag)) FROM sg JOIN tc ON tc.tag = sg.tag WHERE sg.work_id NOT IN (SELECT work_id FROM ft) GROUP BY 1),
    r2 AS (SELECT work_id, 'ol:' || {_OKEY} AS key, name, CAST(NULL AS DOUBLE) AS position, 2 AS rung FROM (SELECT work_id, regexp_replace(tag, '^[^:]*:', '') AS name FROM ch))"""
_R3 = _vote_sql("c", f"SELECT e.work_id, e.edition_id AS voter, p.name, p.position FROM (SELECT DISTINCT work_id, edition_id, series_string FROM fx_edition) e JOIN "
                f"(SELECT series_string, {_SN} AS name, {_SP} AS position FROM (SELECT DISTINCT series_string FROM fx_edition)) p ON p.series_string = e.series_string", 3)
_R4 = _vote_sql("d", f"SELECT work_id, voter, {_TN} AS name, {_TP} AS position FROM ({_TITLES})", 4)
CANDS = f"{RESOLVED}, {_R1}, {_R2}, {_R3}, {_R4}, cands AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)"


@query("l01_rung1", f"WITH RECURSIVE {RESOLVED}, {_R1} SELECT * FROM r1")
def l01(w: World) -> DataFrame:
    return L.rung1(items(w), w.fx("kg_membership"), kg_series(w))


@query("l02_tag_counts", f"WITH sg AS ({_tag_rows('series')}) SELECT tag, count(*) AS n FROM sg GROUP BY 1")
def l02(w: World) -> DataFrame:
    return L.tag_counts(blobs(w))


@query("l03_rung2", f"WITH {_R2} SELECT * FROM r2")
def l03(w: World) -> DataFrame:
    works = blobs(w)
    return L.rung2(works, L.tag_counts(works))


@query("l04_rung3", f"WITH {_R3} SELECT * FROM r3")
def l04(w: World) -> DataFrame:
    return L.rung3(edition_series(w))


@query("l05_rung4", f"WITH {_R4} SELECT * FROM r4")
def l05(w: World) -> DataFrame:
    return L.rung4(w.sql(_TITLES))


@query("l06_candidates", f"WITH RECURSIVE {CANDS} SELECT * FROM cands")
def l06(w: World) -> DataFrame:
    return cands(w)


_NAMES = """nm AS (SELECT key, arg_min(name, (-n, name)) AS name FROM (SELECT key, name, count(*) AS n FROM cands WHERE rung > 1 GROUP BY 1, 2) GROUP BY 1
      UNION ALL SELECT 'wd:' || qid, coalesce(nullif(label, ''), 'Alias ' || qid) FROM fx_kg_series)"""


@query("l07_series_names", f"WITH RECURSIVE {CANDS}, {_NAMES} SELECT * FROM nm")
def l07(w: World) -> DataFrame:
    return L.series_names(cands(w), kg_series(w))


_REJECTS = "SELECT DISTINCT concat('ol:', lower(split_part(p_name, ' ', 1)), ' cycle') AS key FROM part WHERE p_name LIKE 'red%' UNION ALL SELECT DISTINCT 'ol:brand 7 world' FROM part"
_REJECTED = f"""
    au AS ({_AUTHORS}), held AS (SELECT c.key, a.author, count(*) AS n FROM cands c JOIN au a ON a.work_id = c.work_id WHERE c.rung > 1 GROUP BY 1, 2),
    pk AS (SELECT key, count(*) AS authors, max(n) AS most, sum(n) AS total FROM held GROUP BY 1),
    rej AS (SELECT key, CAST(authors AS INT) AS author_clusters FROM pk WHERE (authors > 3 AND 2 * most < total) OR key IN ({_REJECTS}))"""


def rejected(w: World, c: DataFrame) -> DataFrame:
    return L.imprint_rejections(c, w.sql(_AUTHORS), L.blocked_keys(c, rejects=w.sql(_REJECTS)))


@query("l08_imprint_rejections", f"WITH RECURSIVE {CANDS}, {_REJECTED} SELECT * FROM rej")
def l08(w: World) -> DataFrame:
    return rejected(w, cands(w))


@query("l09_fold_series")
def l09(w: World) -> DataFrame:
    c = cands(w)
    return L.fold_series(c, kg_series(w), rejected(w, c))


# Folds by name only, so that the later steps can be checked in SQL.
_NAME_FOLD = "SELECT key, target FROM (SELECT 'ol:brand 2 chronicles' AS key, qid, concat('wd:', qid) AS target, label FROM fx_kg_series UNION ALL SELECT 'ol:brand 3 chronicles', qid, concat('wd:', qid), label FROM fx_kg_series) WHERE label = 'Brand#2 Chronicles' AND key LIKE '%2 %' OR label = 'Brand 3: Chronicles' AND key LIKE '%3 %'"
_KINDS = f"SELECT work_id, {Q.kind('raw_title')} AS kind FROM fx_work"
_CHOSEN = f"""
    nf AS ({_NAME_FOLD}), kd AS ({_KINDS}),
    kept AS (SELECT c.work_id, coalesce(f.target, c.key) AS key, CASE WHEN k.kind IS DISTINCT FROM 'collection' THEN c.position END AS position, c.rung FROM cands c
      LEFT JOIN nf f ON f.key = c.key LEFT JOIN kd k ON k.work_id = c.work_id WHERE c.key NOT IN (SELECT key FROM rej)),
    mb AS (SELECT work_id, key, min(rung) AS rung, arg_min(position, rung) FILTER (WHERE position IS NOT NULL) AS position FROM kept GROUP BY 1, 2),
    chosen AS (SELECT m.work_id, m.key, m.position, m.rung FROM mb m JOIN (SELECT work_id, min(rung) AS rung FROM kept GROUP BY 1) b ON b.work_id = m.work_id AND b.rung = m.rung)"""
_ADAPTED = """
    dom AS (SELECT key, arg_min(author, (-n, author)) AS author FROM (SELECT c.key, a.author, count(*) AS n FROM chosen c JOIN au a ON a.work_id = c.work_id GROUP BY 1, 2) GROUP BY 1),
    faithful AS (SELECT c.* FROM chosen c LEFT JOIN dom d ON d.key = c.key LEFT JOIN au a ON a.work_id = c.work_id WHERE c.rung = 1 OR d.author IS NULL OR a.author = d.author),
    solid AS (SELECT * FROM faithful WHERE key NOT IN (SELECT key FROM faithful GROUP BY 1 HAVING count(*) = 1 AND min(rung) = 4)),
    decided AS (SELECT w.work_id, CAST(min(s.rung) AS INT) AS rung FROM fx_work w LEFT JOIN solid s ON s.work_id = w.work_id GROUP BY 1)"""
DECIDED = f"{CANDS}, {_REJECTED}, {_CHOSEN}, {_ADAPTED}"


def _chosen(w: World) -> tuple[DataFrame, DataFrame]:
    c = cands(w)
    kinds = w.fx("work").select("work_id", T.classify_kind(F.col("raw_title"), F.lit("")).alias("kind"))
    return c, L.choose_memberships(c, w.sql(_NAME_FOLD), rejected(w, c), kinds)


def solid(w: World) -> DataFrame:
    return L.drop_lonely(L.drop_adaptations(_chosen(w)[1], w.sql(_AUTHORS)))


@query("l10_choose_memberships", f"WITH RECURSIVE {DECIDED} SELECT * FROM chosen")
def l10(w: World) -> DataFrame:
    return _chosen(w)[1]


@query("l11_drop_adaptations", f"WITH RECURSIVE {DECIDED} SELECT * FROM faithful")
def l11(w: World) -> DataFrame:
    return L.drop_adaptations(_chosen(w)[1], w.sql(_AUTHORS))


_LONELY = "SELECT work_id, concat('ol:', title_key) AS key, CAST(1 AS DOUBLE) AS position, rung FROM (SELECT work_id, raw_title AS title_key, CASE WHEN readinglog_count > 25 THEN 4 ELSE 3 END AS rung FROM fx_work)"


@query("l12_drop_lonely", f"WITH m AS ({_LONELY}) SELECT * FROM m WHERE key NOT IN (SELECT key FROM m GROUP BY 1 HAVING count(*) = 1 AND min(rung) = 4)")
def l12(w: World) -> DataFrame:
    return L.drop_lonely(w.sql(_LONELY))


@query("l13_decided_by", f"WITH RECURSIVE {DECIDED} SELECT * FROM decided")
def l13(w: World) -> DataFrame:
    return L.decided_by(w.fx("work"), solid(w))


_MEMBERS = "SELECT work_id, concat(CASE WHEN series_id % 2 = 0 THEN 'wd:Q' ELSE 'ol:k' END, series_id) AS key, CAST(readinglog_count % 9 AS DOUBLE) AS position, CAST(readinglog_count % 4 + 1 AS INT) AS rung FROM fx_work"
_OPS = """
    SELECT o_orderkey AS seq, CASE WHEN o_orderpriority LIKE '1%' THEN 'set_series' WHEN o_orderpriority LIKE '5%' THEN 'rename_series' ELSE 'remove_from_series' END AS kind,
      concat('OL', o_custkey + 1, 'W') AS work_id, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'wd:Q' ELSE 'ol:k' END, o_orderkey % 30) AS key, CAST(o_orderkey % 7 AS DOUBLE) AS position,
      CASE WHEN o_totalprice > 100000 THEN concat('name ', o_orderkey) END AS name FROM orders"""
_MEMBER_NAMES = "SELECT DISTINCT key, concat('n ', key) AS name FROM (" + _MEMBERS + ")"
_OVERRIDDEN = f"""
    m AS ({_MEMBERS}), ops AS ({_OPS}), pl AS (SELECT * FROM ops WHERE kind <> 'rename_series'),
    lo AS (SELECT work_id, key, arg_max(kind, seq) AS kind, arg_max(position, seq) AS position FROM (SELECT * REPLACE (coalesce(position, -1) AS position) FROM pl) GROUP BY 1, 2),
    res AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM lo WHERE lo.work_id = m.work_id AND lo.key = m.key) UNION ALL SELECT work_id, key, position, 0 FROM lo WHERE kind = 'set_series')"""


def _overridden(w: World):
    members = w.sql(_MEMBERS)
    known = members.select("key").distinct()
    return L.apply_series_overrides(w.sql(_OPS), members, w.sql(_MEMBER_NAMES), L.decided_by(w.fx("work"), members), known)


@query("l14_apply_series_overrides", f"WITH {_OVERRIDDEN} SELECT * FROM res")
def l14(w: World) -> DataFrame:
    return _overridden(w)[0]


@query("l14_override_names", f"""
    WITH {_OVERRIDDEN}, known AS ({_MEMBER_NAMES}), made AS (SELECT key, arg_min(name, seq) AS name FROM ops WHERE kind = 'set_series' AND name IS NOT NULL AND key NOT IN (SELECT key FROM known) GROUP BY 1),
    ren AS (SELECT key, arg_max(name, seq) AS name FROM ops WHERE kind = 'rename_series' AND name IS NOT NULL GROUP BY 1), ks AS (SELECT key FROM known UNION SELECT key FROM made UNION SELECT key FROM ren)
    SELECT ks.key, coalesce(r.name, m.name, k.name) AS name FROM ks LEFT JOIN known k ON k.key = ks.key LEFT JOIN made m ON m.key = ks.key LEFT JOIN ren r ON r.key = ks.key""")
def l14_names(w: World) -> DataFrame:
    return _overridden(w)[1]


@query("l14_override_decisions", f"""
    WITH {_OVERRIDDEN}, d AS (SELECT w.work_id, min(m.rung) AS rung FROM fx_work w LEFT JOIN m ON m.work_id = w.work_id GROUP BY 1)
    SELECT d.work_id, CAST(CASE WHEN d.work_id NOT IN (SELECT work_id FROM pl) THEN d.rung WHEN d.work_id NOT IN (SELECT work_id FROM res) THEN NULL
      WHEN d.work_id IN (SELECT work_id FROM pl WHERE kind = 'set_series') THEN 0 ELSE d.rung END AS INT) AS rung FROM d""")
def l14_decisions(w: World) -> DataFrame:
    return _overridden(w)[2]


_PARENT_KEYS = f"SELECT DISTINCT key, CASE WHEN key LIKE 'wd:%' AND key <> 'wd:Q0' THEN 'wd:Q0' END AS parent FROM ({_MEMBERS})"
_SERIES_ROWS = f"""
    m AS ({_MEMBERS}), p AS ({_PARENT_KEYS}), srows AS (
      SELECT p.key, 'n ' || p.key AS name, CASE WHEN p.key LIKE 'wd:%' THEN 'wikidata' ELSE 'openlibrary' END AS source,
        CASE WHEN p.key LIKE 'wd:%' THEN 'wikidata' ELSE ['wikidata','ol_tag','ol_edition_series','title_pattern'][min(m.rung)] END AS provenance, 'series' AS kind, p.parent AS parent_key
      FROM p JOIN m ON m.key = p.key GROUP BY p.key, p.parent
      UNION ALL SELECT 'single:' || work_id, raw_title, 'heuristic', 'single', 'singleton', NULL FROM fx_work WHERE work_id NOT IN (SELECT work_id FROM m))"""


def _series_rows(w: World):
    members = w.sql(_MEMBERS)
    return L.series_rows(members, members.select("work_id", F.col("key").alias("room")), w.sql(_PARENT_KEYS), w.sql(_MEMBER_NAMES),
                         w.fx("work").withColumnRenamed("raw_title", "title"))


@query("l15_series_rows", f"WITH {_SERIES_ROWS} SELECT * FROM srows")
def l15(w: World) -> DataFrame:
    return _series_rows(w)[0]


_SLUG_ROWS = "SELECT concat('series:', work_id) AS identity, CASE WHEN shelf_mark = 'SMALL' THEN concat(raw_title, ' ', readinglog_count % 5 + 1) ELSE raw_title END AS name FROM fx_work"
_SLUGS = f"""
    b AS (SELECT identity, {Q.slug('name')} AS base FROM slug_in), rk AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY identity) AS r, count(*) OVER (PARTITION BY base) AS cnt FROM b),
    ex AS (SELECT DISTINCT regexp_extract(base, '^(.*)-([1-9][0-9]*)$', 1) AS base, CAST(regexp_extract(base, '^(.*)-([1-9][0-9]*)$', 2) AS BIGINT) AS n FROM b WHERE regexp_matches(base, '^(.*)-([1-9][0-9]*)$')),
    free AS (SELECT base, n, row_number() OVER (PARTITION BY base ORDER BY n) AS k FROM (SELECT base, unnest(range(2, CAST(cnt + (SELECT count(*) FROM ex) + 2 AS BIGINT))) AS n FROM (SELECT DISTINCT base, cnt FROM rk WHERE cnt > 1)) g
      WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.base = g.base AND ex.n = g.n)),
    slugs AS (SELECT rk.identity, CASE WHEN r = 1 THEN rk.base ELSE rk.base || '-' || f.n END AS slug FROM rk LEFT JOIN free f ON f.base = rk.base AND f.k = rk.r - 1)"""


@query("l16_assign_slugs", f"WITH slug_in AS ({_SLUG_ROWS}), {_SLUGS} SELECT * FROM slugs")
def l16(w: World) -> DataFrame:
    return L.assign_slugs(w.sql(_SLUG_ROWS))


_ALIASES = "SELECT work_id AS loser, merged_into AS survivor FROM fx_work WHERE merged_into IS NOT NULL"
_MOVED = "SELECT from_ol, to_ol FROM fx_redirect"
_FINAL = "SELECT work_id FROM fx_work WHERE merged_into IS NULL AND shelf_mark <> 'PROMO'"


@query("l17_alias_table", f"""
    WITH a AS ({_ALIASES}), f AS ({_FINAL}), u AS (SELECT from_ol AS ol_id, coalesce(a.survivor, to_ol) AS work_id FROM ({_MOVED}) LEFT JOIN a ON a.loser = to_ol),
    ok AS (SELECT * FROM u WHERE work_id IN (SELECT work_id FROM f) AND ol_id NOT IN (SELECT work_id FROM f))
    SELECT * FROM ok UNION ALL SELECT loser, survivor FROM a WHERE loser NOT IN (SELECT ol_id FROM ok)""")
def l17(w: World) -> DataFrame:
    return L.alias_table(w.sql(_ALIASES), w.sql(_MOVED), w.sql(_FINAL))


def _group_tables(w: World) -> dict[str, DataFrame]:
    series, rooms = _series_rows(w)
    works = w.fx("work").withColumnRenamed("raw_title", "title").join(rooms, "work_id").select(
        "work_id", "title", F.lit(None).cast("string").alias("subtitle"), "author", "first_publish_year", F.lit("single").alias("kind"), "room",
        F.col("work_num").alias("cover_id"), "edition_count", "readinglog_count", F.lit(0).alias("ratings_count"), F.col("shelf_mark").alias("subjects"),
        T.canonical_key(F.col("title"), F.col("author")).alias("canonical_key"), F.lit(None).cast("string").alias("representative_edition"))
    editions = w.sql("SELECT DISTINCT edition_id, work_id, title, subtitle, publisher, publish_year, isbn_raw, page_count, cover_id FROM fx_edition").withColumn(
        "isbn_13", T.normalize_isbn(F.col("isbn_raw")))
    members = w.sql(_MEMBERS).select(F.col("key").alias("series_key"), "work_id", "position", T.provenance_label(F.col("rung")).alias("provenance"),
                                     T.confidence_label(F.col("rung")).alias("confidence"))
    aliases = w.sql(_ALIASES).select(F.col("loser").alias("ol_id"), F.col("survivor").alias("work_id"))
    return {"works": works, "editions": editions, "series": series, "members": members, "aliases": aliases}


@query("l18_build_release_series", f"""
    WITH {_SERIES_ROWS}, slug_in AS (SELECT 'series:' || key AS identity, name FROM srows), {_SLUGS}
    SELECT {Q.uuid5("('series:' || s.key)")} AS id, s.key, source, provenance, name, slug, {Q.skey('name')} AS canonical_key, kind,
      CASE WHEN parent_key IS NOT NULL THEN {Q.uuid5("('series:' || s.parent_key)")} END AS parent_series_id FROM srows s JOIN slugs g ON g.identity = 'series:' || s.key""")
def l18(w: World) -> DataFrame:
    return L.build_release(_group_tables(w))["series"]


@query("l18_build_release_editions", f"""
    SELECT {Q.uuid5("('edition:ol:' || e.edition_id)")} AS id, e.edition_id AS ol_edition_id, {Q.uuid5("('work:ol:' || e.work_id)")} AS work_id, e.title, e.subtitle, w.author, e.publisher, e.publish_year AS published_year,
      {Q.isbn('e.isbn_raw')} AS isbn_13, e.page_count, CASE WHEN e.cover_id <> 0 THEN concat('https://covers.openlibrary.org/b/id/', e.cover_id, '-L.jpg') END AS cover_url, 'en' AS language
    FROM (SELECT DISTINCT edition_id, work_id, title, subtitle, publisher, publish_year, isbn_raw, page_count, cover_id FROM fx_edition) e JOIN fx_work w ON w.work_id = e.work_id""")
def l18_editions(w: World) -> DataFrame:
    return L.build_release(_group_tables(w))["editions"]


def grouped(w: World) -> dict[str, DataFrame]:
    """The grouping stage over the whole synthetic catalog."""
    works = w.fx("work").join(blobs(w), "work_id", "left").select(
        "work_id", "raw_title", T.display_title(F.col("raw_title")).alias("title"), F.lit(None).cast("string").alias("subtitle"), "author",
        F.array("author_id").alias("author_ids"), "first_publish_year", "subjects", F.lit(None).cast("bigint").alias("cover_id"),
        F.lit(0).alias("ratings_count"), "readinglog_count", "edition_count", T.canonical_key(F.col("raw_title"), F.col("author")).alias("canonical_key"),
        T.classify_kind(F.col("raw_title"), F.lit("")).alias("kind"))
    editions = w.sql("SELECT DISTINCT edition_id, work_id, title, subtitle, publisher, publish_year, isbn_raw, page_count, cover_id, series_string FROM fx_edition WHERE is_english")
    editions = editions.withColumn("isbn_13", T.normalize_isbn(F.col("isbn_raw"))).withColumn("series", F.array("series_string")).drop("isbn_raw", "series_string")
    authors = w.fx("author").select(F.col("author_id").alias("ol_id"), "name", F.array().cast("array<string>").alias("alternate_names"), F.lit(None).cast("string").alias("wikidata"))
    links = w.fx("author_kg").select("qid", F.col("author_id").alias("ol_author_id"))
    names = w.spark.createDataFrame([], "qid string, name string")
    redirects = w.sql("SELECT from_ol, to_ol FROM fx_redirect")
    owner = editions.select("edition_id", "work_id")
    return group_catalog(works, editions, authors, w.fx("kg_membership"), kg_series(w), links, names, redirects, owner, w.sql("SELECT from_ol, to_ol FROM fx_redirect"))


@query("l19_group_catalog")
def l19(w: World) -> DataFrame:
    g = grouped(w)
    return g["works"].select("work_id", "title", "author", "room", "primary_author", "readinglog_count", "edition_count", "representative_edition")


# --- runtime rooms ------------------------------------------------------------------------
RUNTIME_ROOMS = """
    SELECT work_id, merged_into, raw_title AS title, CASE shelf_mark WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN 'rel-1' WHEN 'PROMO' THEN concat('tag-', author) ELSE concat('sg-', work_num) END AS series_id FROM fx_work"""
RUNTIME_SERIES = """
    SELECT concat('sg-', work_num) AS series_id, 'heuristic' AS source, concat('singleton:', work_id) AS external_id, 'singleton' AS kind, CAST(NULL AS STRING) AS catalog_release, false AS dissolved,
      CAST(NULL AS STRING) AS merged_into, raw_title AS name FROM fx_work
    UNION ALL SELECT DISTINCT 'rel-1', 'wikidata', 'wd:Q1', 'series', '2026.01.1', false, CAST(NULL AS STRING), 'Rel' FROM region
    UNION ALL SELECT DISTINCT concat('tag-', p_brand), 'openlibrary', concat('series:', lower(replace(p_brand, '#', ' ')), ' chronicles'), 'series', CAST(NULL AS STRING), p_brand = 'Brand#3',
      CASE WHEN p_brand = 'Brand#4' THEN 'tag-Brand#5' END, p_brand FROM part"""
_PLACED = "SELECT DISTINCT work_id FROM fx_correction WHERE op IN ('set_series', 'remove_from_series') AND NOT reverted"
_ASSIGNED = f"""
    rw AS ({RUNTIME_ROOMS}), rs AS ({RUNTIME_SERIES}), pl AS ({_PLACED}), lv AS (SELECT * FROM rw WHERE merged_into IS NULL),
    ft AS (SELECT * FROM ({_tag_rows('franchise')}) WHERE work_id IN (SELECT work_id FROM lv)), sg AS (SELECT * FROM ({_tag_rows('series')}) WHERE work_id IN (SELECT work_id FROM lv)),
    tc AS (SELECT lower(tag) AS lt, count(DISTINCT work_id) AS n FROM sg GROUP BY 1),
    ch AS (SELECT work_id, min(tag) AS tag FROM ft GROUP BY 1 UNION ALL SELECT sg.work_id, arg_min(sg.tag, (-tc.n, sg.tag)) FROM sg JOIN tc ON tc.lt = lower(sg.tag) WHERE sg.work_id NOT IN (SELECT work_id FROM ft) GROUP BY 1),
    want AS (SELECT work_id, tag, split_part(tag, ':', 1) || ':' || {Q.skey('''regexp_replace(tag, '^[^:]*:', '')''')} AS ext FROM ch),
    hit AS (SELECT s.external_id, coalesce(s.merged_into, s.series_id) AS target FROM rs s WHERE s.source = 'openlibrary'),
    j AS (SELECT l.*, w.tag, w.ext, h.target, t.dissolved AS tdis, n.kind AS nkind, n.catalog_release AS nrel, CASE WHEN w.ext IS NOT NULL AND NOT coalesce(t.dissolved, false) THEN coalesce(h.target, {Q.uuid5("('series:' || w.ext)")}) END AS goal
      FROM lv l LEFT JOIN want w ON w.work_id = l.work_id LEFT JOIN hit h ON h.external_id = w.ext LEFT JOIN rs t ON t.series_id = h.target LEFT JOIN rs n ON n.series_id = l.series_id),
    act AS (SELECT *, CASE WHEN series_id IS NOT NULL AND (nrel IS NOT NULL OR work_id IN (SELECT work_id FROM pl)) THEN 'keep' WHEN goal IS NULL THEN CASE WHEN series_id IS NOT NULL THEN 'keep' ELSE 'singleton' END
      WHEN series_id IS NULL THEN 'assign' WHEN series_id = goal OR nkind = 'series' THEN 'keep' ELSE 'promote' END AS action FROM j),
    asg AS (SELECT work_id, CASE action WHEN 'keep' THEN series_id WHEN 'singleton' THEN {Q.uuid5("('series:singleton:' || work_id)")} ELSE goal END AS series_id, action, series_id AS from_series FROM act)"""


def _runtime(w: World) -> tuple[DataFrame, DataFrame, DataFrame]:
    return w.sql(RUNTIME_ROOMS).join(blobs(w), "work_id", "left"), w.sql(RUNTIME_SERIES), w.sql(_PLACED)


@query("l20_assign_tag_series", f"WITH {_ASSIGNED} SELECT * FROM asg")
def l20(w: World) -> DataFrame:
    return L.assign_tag_series(*_runtime(w))[0]


@query("l20_new_tag_series", f"""
    WITH {_ASSIGNED} SELECT goal AS series_id, min(ext) AS external_id, min(regexp_replace(tag, '^[^:]*:', '')) AS name, 'openlibrary' AS source, 'series' AS kind, 'ol_tag' AS provenance FROM act
      WHERE action IN ('assign', 'promote') AND target IS NULL GROUP BY 1
    UNION ALL SELECT {Q.uuid5("('series:singleton:' || work_id)")}, 'singleton:' || work_id, title, 'heuristic', 'singleton', 'single' FROM act WHERE action = 'singleton'""")
def l20_new(w: World) -> DataFrame:
    return L.assign_tag_series(*_runtime(w))[1]


THREADS = "SELECT thread_id, title, CASE WHEN thread_id % 4 = 0 THEN NULL ELSE concat('sg-', thread_id % 60 + 1) END AS series_id, CASE WHEN thread_id % 3 = 0 THEN NULL ELSE work_id END AS work_id, CASE WHEN thread_id % 8 = 4 THEN genre_id END AS genre_id FROM fx_thread"
_PROMOTIONS = "SELECT work_id, concat('sg-', work_num) AS singleton, concat('tag-', author) AS target FROM fx_work WHERE shelf_mark IN ('ECONOMY', 'STANDARD')"


def _promoted(w: World):
    return L.promote_singletons(w.sql(_PROMOTIONS), w.sql(THREADS), w.sql(RUNTIME_ROOMS), w.sql(RUNTIME_SERIES))


@query("l21_promote_singleton_threads", f"WITH p AS ({_PROMOTIONS}), t AS ({THREADS}) SELECT t.thread_id, t.title, coalesce(p.target, t.series_id) AS series_id, coalesce(t.work_id, p.work_id) AS work_id, t.genre_id FROM t LEFT JOIN p ON p.singleton = t.series_id")
def l21(w: World) -> DataFrame:
    return _promoted(w)[0]


@query("l21_promote_singleton_series", f"WITH p AS ({_PROMOTIONS}), s AS ({RUNTIME_SERIES}) SELECT s.series_id, coalesce(p.target, s.merged_into) AS merged_into FROM s LEFT JOIN p ON p.singleton = s.series_id")
def l21_series(w: World) -> DataFrame:
    return _promoted(w)[2].select("series_id", "merged_into")


_ORDERED = "SELECT CAST(series_id AS STRING) AS key, work_id, CASE WHEN readinglog_count % 5 <> 0 THEN CAST(readinglog_count % 9 AS DOUBLE) END AS position, CASE WHEN edition_count <> 2 THEN first_publish_year END AS first_publish_year, raw_title AS title FROM fx_work"


@query("l22_reading_order", f"SELECT key, work_id, CAST(row_number() OVER (PARTITION BY key ORDER BY position NULLS LAST, first_publish_year NULLS LAST, title, work_id) AS INT) AS rank FROM ({_ORDERED})")
def l22(w: World) -> DataFrame:
    return L.reading_order(w.sql(_ORDERED)).select("key", "work_id", "rank")


_TREE_SERIES = "SELECT series_id, parent_id, CAST(NULL AS INT) AS merged_into, name FROM fx_series_parent"
_TREE_MEMBERS = """
    SELECT DISTINCT work_id, series_id, CASE WHEN readinglog_count % 5 <> 0 THEN CAST(readinglog_count % 9 AS DOUBLE) END AS position, 'ol_tag' AS provenance FROM fx_work
    UNION ALL SELECT work_id, parent_id, CAST(9 AS DOUBLE), 'override' FROM fx_work w JOIN fx_series_parent s ON s.series_id = w.series_id WHERE parent_id IS NOT NULL"""
_ROOM_WORKS = "SELECT w.work_id, w.raw_title AS title, CASE WHEN edition_count <> 2 THEN first_publish_year END AS first_publish_year, w.merged_into, w.series_id - w.series_id % 8 AS series_id FROM fx_work w"
_PLACED_SQL = f"""
    s AS ({_TREE_SERIES}), m AS ({_TREE_MEMBERS}), rm AS (SELECT DISTINCT series_id AS room FROM ({_ROOM_WORKS}) WHERE merged_into IS NULL),
    tree AS (SELECT room, room AS series_id, 0 AS depth FROM rm UNION SELECT t.room, s.series_id, t.depth + 1 FROM tree t JOIN s ON s.parent_id = t.series_id WHERE t.depth < 5),
    dt AS (SELECT room, series_id, min(depth) AS depth FROM tree GROUP BY 1, 2),
    placed AS (SELECT * FROM (SELECT d.room, m.work_id, m.series_id, m.position, m.provenance, s.name, row_number() OVER (PARTITION BY d.room, m.work_id ORDER BY d.depth DESC, s.name DESC, m.series_id DESC) AS rn
      FROM m JOIN dt d ON d.series_id = m.series_id JOIN s ON s.series_id = m.series_id) WHERE rn = 1)"""


@query("l23_placed_membership", f"WITH RECURSIVE {_PLACED_SQL} SELECT room, work_id, series_id, position, provenance FROM placed")
def l23(w: World) -> DataFrame:
    from foliant.operators.graph import room_tree

    series = w.sql(_TREE_SERIES)
    rooms = w.sql(_ROOM_WORKS).filter("merged_into IS NULL").select(F.col("series_id").alias("room")).distinct()
    return L.placed_membership(w.sql(_TREE_MEMBERS), room_tree(series, rooms), series)


@query("l24_room_listing", f"""
    WITH RECURSIVE {_PLACED_SQL}, li AS (SELECT w.work_id, w.title, w.first_publish_year, w.series_id AS room, p.position, p.provenance, CASE WHEN p.series_id <> w.series_id THEN p.series_id END AS sub,
      CASE WHEN p.series_id <> w.series_id THEN p.name END AS subseries FROM ({_ROOM_WORKS}) w LEFT JOIN placed p ON p.room = w.series_id AND p.work_id = w.work_id WHERE w.merged_into IS NULL),
    ea AS (SELECT room, sub, min(coalesce(first_publish_year, 9999)) AS e FROM li WHERE sub IS NOT NULL GROUP BY 1, 2)
    SELECT li.room, CAST(row_number() OVER (PARTITION BY li.room ORDER BY li.sub IS NOT NULL, coalesce(ea.e, 0), coalesce(subseries, ''), position IS NULL, coalesce(position, 0), first_publish_year IS NULL,
      coalesce(first_publish_year, 0), title, work_id) AS INT) AS rank, work_id, title, position, subseries, provenance FROM li LEFT JOIN ea ON ea.room = li.room AND ea.sub = li.sub""")
def l24(w: World) -> DataFrame:
    return L.room_listing(w.sql(_ROOM_WORKS), w.sql(_TREE_MEMBERS), w.sql(_TREE_SERIES))


_BACKFILL = f"""{_ASSIGNED}, t AS ({THREADS}), pr AS (SELECT from_series, min(work_id) AS book, arg_min(series_id, work_id) AS target FROM asg WHERE action = 'promote' GROUP BY 1),
    mt AS (SELECT t.thread_id, coalesce(pr.target, t.series_id) AS series_id, coalesce(t.work_id, pr.book) AS work_id, t.genre_id FROM t LEFT JOIN pr ON pr.from_series = t.series_id),
    dd AS (SELECT r.work_id, r.merged_into, coalesce(pr.target, r.series_id) AS series_id FROM rw r LEFT JOIN pr ON pr.from_series = r.series_id WHERE r.merged_into IS NOT NULL),
    aw AS (SELECT work_id, series_id, false AS was_empty FROM asg UNION ALL SELECT d.work_id, coalesce(d.series_id, a.series_id), d.series_id IS NULL FROM dd d LEFT JOIN asg a ON a.work_id = d.merged_into),
    fl AS (SELECT mt.thread_id, coalesce(mt.series_id, aw.series_id) AS series_id, mt.work_id, mt.genre_id, mt.series_id IS NULL AND mt.work_id IS NOT NULL AS follows FROM mt LEFT JOIN aw ON aw.work_id = mt.work_id)"""


def _backfilled(w: World):
    works, series, placed = _runtime(w)
    return L.backfill_rooms(works, series, placed, w.sql(THREADS))


@query("l25_backfill_rooms", f"WITH {_BACKFILL} SELECT work_id, series_id FROM aw")
def l25(w: World) -> DataFrame:
    return _backfilled(w)[0].select("work_id", "series_id")


@query("l25_backfill_threads", f"WITH {_BACKFILL} SELECT thread_id, series_id, work_id FROM fl")
def l25_threads(w: World) -> DataFrame:
    return _backfilled(w)[1].select("thread_id", "series_id", "work_id")


@query("l25_backfill_stats", f"""
    WITH {_BACKFILL}, kd AS (SELECT series_id, kind FROM rs UNION SELECT goal, 'series' FROM act WHERE action IN ('assign', 'promote') AND target IS NULL)
    SELECT 'series' AS metric, count(*) FILTER (WHERE k.kind = 'series') AS value FROM asg a LEFT JOIN kd k ON k.series_id = a.series_id
    UNION ALL SELECT 'singletons', count(*) FILTER (WHERE coalesce(k.kind, 'singleton') <> 'series') FROM asg a LEFT JOIN kd k ON k.series_id = a.series_id
    UNION ALL SELECT 'tombstones', count(*) FILTER (WHERE was_empty) FROM aw UNION ALL SELECT 'threads', count(*) FILTER (WHERE follows) FROM fl
    UNION ALL SELECT 'orphans', count(*) FILTER (WHERE series_id IS NULL AND genre_id IS NULL) FROM fl""")
def l25_stats(w: World) -> DataFrame:
    return _backfilled(w)[2]
