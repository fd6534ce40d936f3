"""Search and browse jobs over whole documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import ranked_index as RI
from foliant.operators import search as S
from foliant.plans import check_sql as Q
from foliant.plans.q_genres import SUMMARY, effective
from foliant.plans.world import World, query
from foliant.session import ensure_checkpoint_dir

_STOPS = ", ".join(f"'{w}'" for w in S.STOP_WORDS)


def _stem_sql(x: str) -> str:
    for pattern, replacement in S.STEM_RULES:
        x = f"regexp_replace({x}, '{pattern}', '{replacement.replace('$', chr(92))}')"
    return x


def _words_sql(x: str) -> str:
    spaced = rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\pL\pN]+', ' ', 'g'))"
    return f"CASE WHEN {spaced} = '' THEN [] ELSE string_split({spaced}, ' ') END"


_INDEX = f"""
    fields AS (SELECT doc_id, {_words_sql('title')} AS a, {_words_sql('author')} AS b, {_words_sql('subjects')} AS c FROM fx_search_doc),
    toks AS (SELECT doc_id, unnest(list_concat(list_concat(a, b), c)) AS word, generate_subscripts(list_concat(list_concat(a, b), c), 1) AS pos, len(a) AS la, len(b) AS lb FROM fields),
    idx AS (SELECT doc_id, {_stem_sql('word')} AS term, CAST(pos AS INT) AS pos, CASE WHEN pos <= la THEN 'A' WHEN pos <= la + lb THEN 'B' ELSE 'C' END AS weight FROM toks WHERE word NOT IN ({_STOPS}))"""
# What a reader typed: one to four words, some with stop words, one that matches nothing, one that repeats a word.
QUERIES = [(1, "er tion"), (2, "Ing the erin, in"), (3, "re ly"), (4, "src5 en"), (5, "zzzz en"), (6, "des la"), (7, "er ed, tion of ly"), (8, "Tion"), (9, "er er ly")]


def queries(w: World) -> DataFrame:
    return w.spark.createDataFrame(QUERIES, "query_id int, query string")


_ASKED_FOR = ", ".join(f"({i}, '{q}')" for i, q in QUERIES)
_TERMS = f"""
    words AS (SELECT query_id, unnest({_words_sql('query')}) AS word FROM (VALUES {_ASKED_FOR}) t(query_id, query)),
    qt AS (SELECT query_id, list_sort(list_distinct(list({_stem_sql('word')}))) AS terms FROM words WHERE word NOT IN ({_STOPS}) GROUP BY query_id)"""


@query("q01_build_search_index", f"WITH {_INDEX} SELECT * FROM idx")
def q01(w: World) -> DataFrame:
    return S.build_search_index(w.fx("search_doc"))


@query("q01_author_tokens", f"SELECT DISTINCT doc_id, unnest({_words_sql('author')}) AS term FROM fx_search_doc")
def q01_author(w: World) -> DataFrame:
    return S.author_tokens(w.fx("search_doc"))


@query("q02_match_query", f"""
    WITH {_INDEX}, {_TERMS}, wanted AS (SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM qt)
    SELECT query_id, doc_id FROM wanted JOIN idx USING (term) GROUP BY query_id, doc_id, n HAVING count(DISTINCT term) = n""")
def q02(w: World) -> DataFrame:
    return S.match_query(S.build_search_index(w.fx("search_doc")), S.query_terms(queries(w)))


def _works(w: World) -> DataFrame:
    return w.fx("search_doc").select(
        "doc_id", "readers", F.lit(0).alias("edition_count"), F.lit(None).cast("int").alias("first_publish_year"), F.lit("single").alias("kind"),
        F.when(F.col("author") == "src7", 1).alias("merged_into"))


_RANKED = f"""
    WITH {_INDEX}, {_TERMS}, en AS (SELECT q.query_id, i.doc_id, i.pos, list_position(q.terms, i.term) AS t, len(q.terms) AS n, CASE weight WHEN 'A' THEN 1.0 WHEN 'B' THEN 1 / 0.4 ELSE 1 / 0.2 END AS inv,
      row_number() OVER (PARTITION BY q.query_id, i.doc_id ORDER BY pos) AS i FROM (SELECT *, unnest(terms) AS term FROM qt) q JOIN idx i USING (term)),
    cu AS (SELECT *, sum(inv) OVER w AS upto, {", ".join(f"CASE WHEN n < {k} THEN i ELSE max(CASE WHEN t = {k} THEN i END) OVER w END AS l{k}" for k in (1, 2, 3, 4))} FROM en WINDOW w AS (PARTITION BY query_id, doc_id ORDER BY i)),
    st AS (SELECT *, CASE WHEN coalesce(l1 + l2 + l3 + l4, 0) > 0 THEN least(l1, l2, l3, l4) END AS s FROM cu), pv AS (SELECT *, lag(s) OVER (PARTITION BY query_id, doc_id ORDER BY i) AS ps FROM st),
    sc AS (SELECT e.query_id, e.doc_id, sum(((e.i - e.s + 1) / (e.upto - b.upto + b.inv)) / (1 + greatest(e.pos - b.pos - (e.i - e.s), 0))) AS density
      FROM pv e JOIN pv b ON b.query_id = e.query_id AND b.doc_id = e.doc_id AND b.i = e.s WHERE e.s IS NOT NULL AND (e.ps IS NULL OR e.s > e.ps) GROUP BY 1, 2),
    rk AS (SELECT sc.query_id, sc.doc_id, round(density * (1 + ln(1 + CAST(readers AS DOUBLE))), 6) AS score FROM sc JOIN fx_search_doc d ON d.doc_id = sc.doc_id WHERE d.author <> 'src7')
    SELECT query_id, CAST(rank AS INT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM rk) WHERE rank <= 20"""


@query("q03_rank_search", _RANKED)
def q03(w: World) -> DataFrame:
    ranked = S.rank_search(S.build_search_index(w.fx("search_doc")), _works(w), queries(w))
    return ranked.select("query_id", "rank", F.round("score", 6).alias("score"))


def store_index(w: World) -> str:
    path = f"{ensure_checkpoint_dir(w.spark)}/index-{uuid.uuid4().hex}"
    S.write_index(S.build_search_index(w.fx("search_doc")), path, 64)
    return path


def rank_stored(w: World, path: str) -> DataFrame:
    ranked = S.rank_search(S.read_index(w.spark, path, queries(w), 64), _works(w), queries(w))
    return ranked.select("query_id", "rank", F.round("score", 6).alias("score"))


@query("q03_rank_stored_index", _RANKED)
def q03_stored(w: World) -> DataFrame:
    return rank_stored(w, store_index(w))


def store_ranked(w: World) -> str:
    path = f"{ensure_checkpoint_dir(w.spark)}/ranked-{uuid.uuid4().hex}"
    texts = w.fx("search_doc").select("doc_id", "title", "author", "subjects")
    RI.write_ranked_index(texts.join(_works(w), "doc_id"), path, 64)
    return path


def search_stored(w: World, path: str) -> DataFrame:
    hits = RI.search_ranked(w.spark, path, QUERIES, buckets=64)
    return hits.select("query_id", "rank", F.round("score", 6).alias("score"))


@query("q03_search_ranked_index", _RANKED)
def q03_ranked(w: World) -> DataFrame:
    return search_stored(w, store_ranked(w))


@query("q04_browse", f"""
    WITH {SUMMARY}, k AS (SELECT work_id, raw_title AS title, readinglog_count, first_publish_year, merged_into, {Q.kind('raw_title')} AS kind FROM fx_work)
    SELECT k.work_id, k.title, sum(e.score) AS genre_score, k.readinglog_count FROM k JOIN effective e ON e.work_id = k.work_id AND e.genre_id IN (1, 2)
    WHERE kind = 'single' AND merged_into IS NULL AND first_publish_year >= 1955 GROUP BY ALL HAVING count(DISTINCT e.genre_id) = 2
    ORDER BY genre_score DESC, k.readinglog_count DESC, k.title, k.work_id LIMIT 20""")
def q04(w: World) -> DataFrame:
    works = w.fx("work").withColumn("kind", T.classify_kind(F.col("raw_title"), F.lit(""))).withColumnRenamed("raw_title", "title")
    return S.browse(works, effective(w), [1, 2], None, 1955, None)


_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT 100000 + p_partkey, concat('  ', p_name, '!') FROM part"
_RESOLVED_LOG = "SELECT lower(p_name) AS normalized_query, max(o_orderdate) AS resolved_at, CAST(1 AS INT) AS result_count FROM part JOIN orders ON o_custkey = p_partkey GROUP BY lower(p_name)"


@query("q05_query_freshness", f"""
    WITH l AS ({_RESOLVED_LOG}), a AS (SELECT query_id, {Q.norm('query')} AS normalized_query FROM ({_ASKED}))
    SELECT a.query_id, a.normalized_query, coalesce(l.resolved_at > (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY, false) AS fresh FROM a LEFT JOIN l ON l.normalized_query = a.normalized_query""")
def q05(w: World) -> DataFrame:
    now = w.table("orders").agg(F.max("o_orderdate").alias("now")).first()["now"]
    return S.query_freshness(w.sql(_ASKED), w.sql(_RESOLVED_LOG), F.lit(now))


_ANSWERS = "SELECT concat(p_name, CASE WHEN p_size > 30 THEN ' more' ELSE '' END) AS query, o_orderdate AS resolved_at, CAST(o_orderkey % 5 AS INT) AS result_count, o_orderstatus = 'P' AS degraded FROM part JOIN orders ON o_custkey = p_partkey"


@query("q05_record_resolutions", f"""
    WITH l AS ({_RESOLVED_LOG}), n AS (SELECT {Q.norm('query')} AS normalized_query, max((resolved_at, result_count)) AS r FROM ({_ANSWERS}) WHERE NOT degraded AND result_count > 0 GROUP BY 1)
    SELECT normalized_query, result_count FROM l WHERE normalized_query NOT IN (SELECT normalized_query FROM n) UNION ALL SELECT normalized_query, r[2] FROM n""")
def q05_record(w: World) -> DataFrame:
    return S.record_resolutions(w.sql(_RESOLVED_LOG), w.sql(_ANSWERS)).select("normalized_query", "result_count")


_FIND_SERIES = "SELECT series_id, concat('s-', series_id) AS slug, name, CAST(NULL AS INT) AS parent_id, CAST(NULL AS INT) AS merged_into, series_id = 12 AS dissolved, CASE WHEN series_id = 3 THEN 'singleton' ELSE 'series' END AS kind FROM fx_series_parent"


@query("q06_find_series", f"""
    SELECT s.series_id, s.slug, s.name, (SELECT count(*) FROM fx_work w WHERE w.series_id = s.series_id AND w.merged_into IS NULL) AS book_count
    FROM ({_FIND_SERIES}) s WHERE kind = 'series' AND NOT dissolved AND contains(lower(name), 'tion_1') ORDER BY name, series_id LIMIT 10""")
def q06(w: World) -> DataFrame:
    return S.find_series(w.sql(_FIND_SERIES), w.fx("work"), " TION_1 ")
