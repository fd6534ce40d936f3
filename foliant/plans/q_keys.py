"""Key-building rules over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import records as R
from foliant.functions import text as T
from foliant.plans import check_sql as Q
from foliant.plans.world import World, query

_TEXTS = (
    "SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'p', page_id, html FROM pages "
    "UNION ALL SELECT 'b', item_id, text FROM benchmark UNION ALL SELECT 'c', conv_id * 100 + turn, text FROM conversations"
)


@query("k01_normalize_text", f"SELECT kind, id, {Q.norm('text')} AS normalized FROM ({_TEXTS})")
def k01(w: World) -> DataFrame:
    return w.sql(_TEXTS).select("kind", "id", T.normalize_text(F.col("text")).alias("normalized"))


@query("k02_clean_title",
       f"SELECT work_id, {Q.norm('(' + Q.unmarked('p') + ')')} AS cleaned "
       f"FROM (SELECT work_id, {Q.plain('raw_title')} AS p FROM fx_work)")
def k02(w: World) -> DataFrame:
    return w.fx("work").select("work_id", T.clean_title(F.col("raw_title")).alias("cleaned"))


@query("k03_display_title",
       f"SELECT work_id, trim(regexp_replace({Q.unmarked('p')}, '\\s+', ' ', 'g'), ' ,:-') AS shown "
       f"FROM (SELECT work_id, {Q.plain('raw_title')} AS p FROM fx_work)")
def k03(w: World) -> DataFrame:
    return w.fx("work").select("work_id", T.display_title(F.col("raw_title")).alias("shown"))


@query("k04_canonical_key", f"SELECT work_id, {Q.ckey('raw_title', 'author')} AS ckey FROM fx_work")
def k04(w: World) -> DataFrame:
    return w.fx("work").select("work_id", T.canonical_key(F.col("raw_title"), F.col("author")).alias("ckey"))


@query("k05_heuristic_id", f"SELECT work_id, sha1({Q.ckey('raw_title', 'author')}) AS hid FROM fx_work")
def k05(w: World) -> DataFrame:
    key = T.canonical_key(F.col("raw_title"), F.col("author"))
    return w.fx("work").select("work_id", T.heuristic_id(key).alias("hid"))


@query("k06_normalize_isbn", f"SELECT edition_id, {Q.isbn('isbn_raw')} AS isbn_13 FROM fx_edition")
def k06(w: World) -> DataFrame:
    return w.fx("edition").select("edition_id", T.normalize_isbn(F.col("isbn_raw")).alias("isbn_13"))


@query("k07_classify_kind", f"SELECT work_id, {Q.kind('raw_title', 'shelf_mark')} AS kind FROM fx_work")
def k07(w: World) -> DataFrame:
    return w.fx("work").select("work_id", T.classify_kind(F.col("raw_title"), F.col("shelf_mark")).alias("kind"))


@query("k08_join_subjects",
       "SELECT work_id, string_agg(subject, chr(10) ORDER BY line) AS subjects, "
       "CAST(count(subject) AS INT) AS n FROM fx_subject GROUP BY work_id")
def k08(w: World) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("line", "subject")))
    grouped = w.fx("subject").groupBy("work_id").agg(T.join_subjects(lines["subject"]).alias("subjects"))
    return grouped.withColumn("n", F.size(T.split_subjects(F.col("subjects"))))


def _tag_check(prefix: str) -> str:
    return (f"SELECT work_id, string_agg(tag, '|' ORDER BY tag) AS tags FROM (SELECT DISTINCT work_id, "
            f"'{prefix}:' || trim(regexp_replace(replace(substr(subject, {len(prefix) + 2}), '_', ' '), '\\s+', ' ', 'g')) AS tag "
            f"FROM fx_subject WHERE lower(subject) LIKE '{prefix}:%' AND NOT contains(substr(subject, {len(prefix) + 2}), ':')) "
            "GROUP BY work_id")


@query("k09_parse_tags",
       f"SELECT coalesce(f.work_id, s.work_id) AS work_id, coalesce(f.tags, '') AS franchises, coalesce(s.tags, '') AS series "
       f"FROM ({_tag_check('franchise')}) f FULL JOIN ({_tag_check('series')}) s ON f.work_id = s.work_id")
def k09(w: World) -> DataFrame:
    blobs = k08(w)
    tags = blobs.select(
        "work_id",
        F.array_join(F.array_sort(T.franchise_tags(F.col("subjects"))), "|").alias("franchises"),
        F.array_join(F.array_sort(T.series_tags(F.col("subjects"))), "|").alias("series"))
    return tags.filter((F.col("franchises") != "") | (F.col("series") != ""))


@query("k10_series_key",
       f"SELECT work_id, line, {Q.skey('subject')} AS skey, CASE WHEN {Q.skey('subject')} <> '' THEN 'ol:' || {Q.skey('subject')} END AS okey, "
       f"split_part(subject, ':', 1) || ':' || {Q.skey('''regexp_replace(subject, '^[^:]*:', '')''')} AS external_id FROM fx_subject")
def k10(w: World) -> DataFrame:
    s = F.col("subject")
    return w.fx("subject").select("work_id", "line", T.series_key(s).alias("skey"), T.ol_key(s).alias("okey"),
                                  T.tag_external_id(s).alias("external_id"))


@query("k11_slugify", f"SELECT kind, id, {Q.slug('text')} AS slug FROM ({_TEXTS})")
def k11(w: World) -> DataFrame:
    return w.sql(_TEXTS).select("kind", "id", T.slugify(F.col("text")).alias("slug"))


@query("k12_row_id", f"SELECT work_id, {Q.uuid5('''('work:ol:' || work_id)''')} AS row_id FROM fx_work")
def k12(w: World) -> DataFrame:
    return w.fx("work").select("work_id", T.work_row_id(F.col("work_id")).alias("row_id"))


_SN, _SP = Q.series_ref("series_string")


@query("k13_parse_series_string",
       f"SELECT series_string, {_SN} AS name, {_SP} AS position FROM (SELECT DISTINCT series_string FROM fx_edition)")
def k13(w: World) -> DataFrame:
    strings = w.fx("edition").select("series_string").distinct()
    parsed = strings.select("series_string", T.parse_series_string(F.col("series_string")).alias("ref"))
    return parsed.select("series_string", "ref.name", "ref.position")


_TN, _TP = Q.title_ref("raw_title")


@query("k14_parse_title_series", f"SELECT work_id, {_TN} AS name, {_TP} AS position FROM fx_work")
def k14(w: World) -> DataFrame:
    parsed = w.fx("work").select("work_id", T.parse_title_series(F.col("raw_title")).alias("ref"))
    return parsed.select("work_id", "ref.name", "ref.position")


@query("k15_parse_ordinal", f"SELECT item, series, {Q.ordinal('ordinal')} AS position FROM fx_kg_membership")
def k15(w: World) -> DataFrame:
    return w.fx("kg_membership").select("item", "series", T.parse_ordinal(F.col("ordinal")).alias("position"))


@query("k16_year_of",
       r"""SELECT kind, id, TRY_CAST(regexp_extract(text, '(?:^|[^\pL\pN_])(1[0-9]{3}|20[0-9]{2})(?:[^\pL\pN_]|$)', 1) AS INT) AS year,
       TRY_CAST(regexp_extract(text, '^([0-9]{4})', 1) AS INT) AS leading FROM (""" + _TEXTS
       + " UNION ALL SELECT 'o', o_orderkey, concat('dated ', CAST(CAST(o_orderdate AS DATE) AS VARCHAR)) FROM orders"
       + " UNION ALL SELECT 'y', o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) FROM orders)")
def k16(w: World) -> DataFrame:
    texts = w.sql(_TEXTS + " UNION ALL SELECT 'o', o_orderkey, concat('dated ', CAST(CAST(o_orderdate AS DATE) AS STRING)) FROM orders"
                  " UNION ALL SELECT 'y', o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) FROM orders")
    return texts.select("kind", "id", T.year_of(F.col("text")).alias("year"), T.leading_year(F.col("text")).alias("leading"))


_AUTHOR_JSON = """
    SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0
      THEN concat('{"authors":[{"author":{"key":"/authors/OL', substr(p_brand, 7), 'A"}},{"author":{"key":"/authors/OL7A"}},{"type":"x"}]}')
      ELSE concat('{"authors":[{"key":"/authors/OL', substr(p_brand, 7), 'A"},{"key":"bad"}]}') END AS json,
      p_size % 2 = 0 AS nested, substr(p_brand, 7) AS num FROM part"""


@query("k17_author_ids",
       f"SELECT id, CASE WHEN nested AND num <> '7' THEN concat('OL', num, 'A,OL7A') ELSE concat('OL', num, 'A') END AS author_ids FROM ({_AUTHOR_JSON})")
def k17(w: World) -> DataFrame:
    return w.sql(_AUTHOR_JSON).select("id", F.array_join(R.author_ids(R.document(F.col("json"))), ",").alias("author_ids"))


_FIELD_JSON = """
    SELECT p_partkey AS id, p_size, p_name, concat('{"title":"  ', p_name, ' ","covers":[0,-1,', p_size, ',"x",2.5],"number_of_pages":',
      CASE WHEN p_size > 25 THEN concat('"', p_size, '"') ELSE CAST(p_size - 5 AS STRING) END,
      ',"subjects":["', p_type, '",7,null,{"a":1},"', p_brand, '"],"subtitle":"   "}') AS json, p_type, p_brand FROM part"""


@query("k18_coerce_fields",
       f"SELECT id, p_name AS title, CAST(NULL AS VARCHAR) AS subtitle, p_type || '|' || p_brand AS subjects, CAST(p_size AS VARCHAR) AS covers, "
       f"CASE WHEN p_size <= 25 AND p_size > 5 THEN CAST(p_size - 5 AS BIGINT) END AS pages FROM ({_FIELD_JSON})")
def k18(w: World) -> DataFrame:
    json = F.col("doc")
    return w.sql(_FIELD_JSON).withColumn("doc", R.document(F.col("json"))).select(
        "id", R.text_field(json, "title").alias("title"), R.text_field(json, "subtitle").alias("subtitle"),
        F.array_join(R.string_list(json, "subjects"), "|").alias("subjects"),
        F.array_join(R.positive_ints(json, "covers").cast("array<string>"), "|").alias("covers"),
        R.positive_int(json, "number_of_pages").alias("pages"))


@query("k19_cover_url",
       "SELECT edition_id, CASE WHEN coalesce(cover_id, 0) <> 0 THEN concat('https://covers.openlibrary.org/b/id/', cover_id, '-L.jpg') END AS url, "
       "replace(replace(regexp_replace(concat('http://b/?zoom=1&edge=curl&u=', cover_url), '^http://', 'https://'), '&edge=curl', ''), 'zoom=1', 'zoom=0') AS upgraded "
       "FROM fx_edition")
def k19(w: World) -> DataFrame:
    raw = F.concat(F.lit("http://b/?zoom=1&edge=curl&u="), F.coalesce("cover_url", F.lit("")))
    return w.fx("edition").select("edition_id", T.cover_url(F.col("cover_id")).alias("url"),
                                  T.upgrade_cover_url(raw).alias("upgraded"))


@query("k20_clip_text",
       f"SELECT kind, id, substr(text, 1, 500) AS clipped, coalesce(nullif(substr(text, 1, 500), ''), 'Untitled') AS title FROM ({_TEXTS})")
def k20(w: World) -> DataFrame:
    text = F.col("text")
    return w.sql(_TEXTS).select("kind", "id", T.clip_text(text).alias("clipped"), T.edition_title(text).alias("title"))


@query("k21_edition_rank",
       "SELECT edition_id, tier, cover AS has_cover, descr AS has_description, 4 * cover + descr + isbn + pages + rated AS completeness FROM ("
       "SELECT edition_id, CASE WHEN coalesce(language, '') = '' THEN 1 WHEN split_part(lower(language), '-', 1) = 'en' THEN 2 ELSE 0 END AS tier, "
       "CASE WHEN cover_url IS NULL THEN 0 ELSE 1 END AS cover, CASE WHEN subtitle IS NULL THEN 0 ELSE 1 END AS descr, "
       "CASE WHEN isbn_raw = '' THEN 0 ELSE 1 END AS isbn, CASE WHEN page_count = 0 THEN 0 ELSE 1 END AS pages, "
       "CASE WHEN cover_id IS NULL OR cover_id = 0 THEN 0 ELSE 1 END AS rated FROM fx_edition)")
def k21(w: World) -> DataFrame:
    rank = T.edition_rank(F.col("language"), F.col("cover_url"), F.col("subtitle"), F.col("isbn_raw"),
                          F.col("page_count"), F.col("cover_id"))
    return w.fx("edition").select("edition_id", rank.alias("rank")).select("edition_id", "rank.*")


@query("k22_identity_keys",
       f"SELECT work_id, CASE WHEN stored = fresh THEN fresh ELSE stored || '|' || fresh END AS keys FROM ("
       f"SELECT work_id, {Q.norm('raw_title')} || chr(31) || {Q.norm('author')} AS stored, {Q.ckey('raw_title', 'author')} AS fresh FROM fx_work)")
def k22(w: World) -> DataFrame:
    stored = F.concat(T.normalize_text(F.col("raw_title")), F.lit(T.KEY_SEPARATOR), T.normalize_text(F.col("author")))
    keys = T.identity_keys(stored, F.col("raw_title"), F.col("author"))
    return w.fx("work").select("work_id", F.array_join(keys, "|").alias("keys"))


@query("k23_edition_title_key",
       f"SELECT edition_id, {Q.norm('(' + Q.unmarked('p') + ')')} AS tkey FROM (SELECT edition_id, "
       f"{Q.plain('''concat_ws(' ', nullif(title, ''), nullif(subtitle, ''))''')} AS p FROM fx_edition)")
def k23(w: World) -> DataFrame:
    return w.fx("edition").select("edition_id", T.edition_title_key(F.col("title"), F.col("subtitle")).alias("tkey"))


@query("k24_provenance_labels",
       "SELECT rung, ['override','wikidata','ol_tag','ol_edition_series','title_pattern'][rung + 1] AS provenance, "
       "['high','high','medium','medium','low'][rung + 1] AS confidence, count(*) AS n "
       "FROM (SELECT CAST(l_linenumber % 5 AS INT) AS rung FROM lineitem) GROUP BY rung")
def k24(w: World) -> DataFrame:
    rung = F.col("rung")
    counted = w.table("lineitem").select((F.col("l_linenumber") % 5).cast("int").alias("rung")).groupBy("rung").agg(F.count("*").alias("n"))
    return counted.select("rung", T.provenance_label(rung).alias("provenance"), T.confidence_label(rung).alias("confidence"), "n")


_AUTHOR_ROWS = """
    SELECT concat('OL', s_suppkey, 'A') AS ol_id, concat('{"name":" ', s_name, ' ","alternate_names":["S', s_nationkey, '",5],"remote_ids":',
      CASE WHEN s_acctbal > 5000 THEN concat('{"wikidata":"Q', s_suppkey, '"}') ELSE '"none"' END, '}') AS json,
      s_name, s_nationkey, s_acctbal, s_suppkey FROM supplier"""


@query("k25_extract_authors",
       f"SELECT ol_id, s_name AS name, concat('S', s_nationkey) AS alternate_names, CASE WHEN s_acctbal > 5000 THEN concat('Q', s_suppkey) END AS wikidata "
       f"FROM ({_AUTHOR_ROWS}) WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem)")
def k25(w: World) -> DataFrame:
    used = w.sql("SELECT concat('OL', l_suppkey, 'A') AS ol_id FROM lineitem").distinct()
    authors = R.extract_authors(w.sql(_AUTHOR_ROWS), used)
    return authors.withColumn("alternate_names", F.array_join("alternate_names", "|"))
