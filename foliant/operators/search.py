"""Ranked search and browsing over a postings table (Q01-Q06).

The stemmer is a light suffix rule, not a dictionary; ranking is by cover
density with the usual weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.filters import search_filters
from foliant.session import materialize, written

# --- fixed values ----------------------------------------------------------------
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2}
DEFAULT_LIMIT = 20
QUERY_DAYS = 30
SERIES_HITS = 10
STOP_WORDS = tuple("""
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now
""".split())
STEM_RULES = ((r"^(.{3,})ies$", "$1y"), (r"^(.{2,}[^s])s$", "$1"), (r"^(.{3,})(?:ing|ed)$", "$1"))
# -----------------------------------------------------------------------------------


def words(text: Column) -> Column:
    """Lower-case words in order; no text gives no words."""
    spaced = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.array_remove(F.split(spaced, " "), "")


def stem(word: Column) -> Column:
    """The rules in turn, for letters and digits only; a word without any of their endings is its own stem."""
    term = word
    for pattern, replacement in STEM_RULES:
        term = F.regexp_replace(term, pattern, replacement)
    return F.when(word.endswith("s") | word.endswith("ing") | word.endswith("ed"), term).otherwise(word)


def build_search_index(works: DataFrame) -> DataFrame:
    """Q01: ``works(doc_id, title, author, subjects)`` to postings ``(doc_id, term, pos, weight)``.

    Titles weigh A, authors B, subjects C; positions run through the three fields, stop words take one but are not kept.
    """
    fields = works.select("doc_id", *[words(F.col(field)).alias(label) for label, field in zip(WEIGHTS, ("title", "author", "subjects"))])
    sized = fields.select("doc_id", F.size("A").alias("a"), (F.size("A") + F.size("B")).alias("b"), F.concat(*WEIGHTS).alias("all"))
    rows = sized.select("doc_id", "a", "b", F.posexplode("all").alias("pos", "word")).filter(~F.col("word").isin(*STOP_WORDS))
    label = F.when(F.col("pos") < F.col("a"), "A").when(F.col("pos") < F.col("b"), "B").otherwise("C")
    return rows.select("doc_id", stem(F.col("word")).alias("term"), (F.col("pos") + 1).alias("pos"), label.alias("weight"))


def author_tokens(works: DataFrame) -> DataFrame:
    """Q01, author half: distinct unstemmed author words."""
    return works.select("doc_id", F.explode(F.array_distinct(words(F.col("author")))).alias("term"))


def write_index(postings: DataFrame, path: str, buckets: int = 256) -> None:
    """Store postings by a hash of the term, so that a query reads only its terms' folders.

    Tasks take ranges of (bucket, document hash): a frequent term is written by as many tasks as it fills.
    """
    placed = postings.withColumn("bucket", term_bucket(F.col("term"), buckets))
    placed.repartitionByRange("bucket", F.xxhash64("doc_id")).sortWithinPartitions("bucket", "term", "doc_id", "pos").write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str, queries: DataFrame, buckets: int = 256) -> DataFrame:
    """The stored postings of the queries' terms; folders of other buckets are pruned at run time."""
    asked = written(query_terms(queries).select("term", term_bucket(F.col("term"), buckets).alias("bucket")).distinct())
    return spark.read.parquet(path).join(asked, ["bucket", "term"], "left_semi").drop("bucket")


def term_bucket(term: Column, buckets: int = 256) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def query_terms(queries: DataFrame) -> DataFrame:
    """``queries(query_id, query)`` to distinct numbered terms ``(query_id, term, idx, n_terms)``; stop words drop out."""
    kept = F.filter(words(F.col("query")), lambda w: ~w.isin(*STOP_WORDS))
    terms = F.array_sort(F.array_distinct(F.transform(kept, stem)))
    return queries.select("query_id", F.size(terms).alias("n_terms"), F.posexplode(terms).alias("idx", "term"))


def match_query(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Q02: ``(query_id, doc_id)`` of documents that hold every term."""
    hits = index.join(terms, "term").groupBy("query_id", "doc_id", "n_terms").agg(F.countDistinct("term").alias("found"))
    return hits.filter("found = n_terms").select("query_id", "doc_id")


def _cover_score(entries: Column, n_terms: Column) -> Column:
    """Sum over all minimal covers of (entries / sum of 1/weight) / (1 + noise words).

    One pass keeps, per term, its latest entry with the running sum of 1/weight before it. A cover ends where the
    earliest of these moves on.
    """
    latest = "array<struct<i:int,pos:int,before:double>>"
    start = F.struct(
        F.transform(F.sequence(F.lit(1), n_terms), lambda _: F.lit(None).cast("struct<i:int,pos:int,before:double>")).cast(latest).alias("latest"),
        F.lit(-1).alias("open"), F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("score"))

    def step(acc: Column, e: Column) -> Column:
        here = F.struct(acc["i"].alias("i"), e["pos"].alias("pos"), acc["sum"].alias("before"))
        seen = F.transform(acc["latest"], lambda held, k: F.when(k == e["idx"], here).otherwise(held))
        total = acc["sum"] + e["inverse"]

        def close(held: Column) -> Column:
            whole = ~F.exists(held, lambda h: h.isNull())
            first = F.array_min(held)
            ends = whole & (first["i"] > acc["open"])
            count = acc["i"] - first["i"] + 1
            noise = F.greatest(e["pos"] - first["pos"] - (count - 1), F.lit(0))
            gain = (count / (total - first["before"])) / (1 + noise)
            return F.struct(
                held.alias("latest"), F.when(ends, first["i"]).otherwise(acc["open"]).alias("open"), (acc["i"] + 1).alias("i"),
                total.alias("sum"), (acc["score"] + F.when(ends, gain).otherwise(0.0)).alias("score"))

        return T.bind(seen, close)

    return F.aggregate(entries, start, step, lambda acc: acc["score"])


def rank_search(index: DataFrame, works: DataFrame, queries: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Q03: per query the best live single works by cover density x (1 + ln(1 + readers)).

    ``works(doc_id, readers, edition_count, first_publish_year, kind, merged_into)``, already narrowed by F05 if filters
    apply. The query terms' postings are read once; only documents that hold every term reach the scoring pass. The
    terms are written, so the planner knows that they are few and other postings are left out before any exchange.
    """
    terms = written(query_terms(queries))
    listed = works.filter("kind = 'single' AND merged_into IS NULL")
    postings = materialize(index.join(terms, "term"))  # a semi-join with the works here would move below this join, to all postings
    found = postings.groupBy("query_id", "doc_id", "n_terms").agg(F.countDistinct("term").alias("found")).filter("found = n_terms")
    matched = found.join(listed.select("doc_id"), "doc_id", "left_semi")
    inverse = F.element_at(F.create_map(*[F.lit(v) for pair in ((k, 1.0 / w) for k, w in WEIGHTS.items()) for v in pair]), F.col("weight"))
    entries = postings.join(matched, ["query_id", "doc_id"], "left_semi").groupBy("query_id", "doc_id", "n_terms").agg(
        F.array_sort(F.collect_list(F.struct("pos", "idx", inverse.alias("inverse")))).alias("entries"))
    scored = entries.select("query_id", "doc_id", _cover_score(F.col("entries"), F.col("n_terms")).alias("density"))
    joined = scored.join(listed, "doc_id").withColumn("score", F.col("density") * (1 + F.log(1 + F.col("readers").cast("double"))))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("edition_count"), F.asc_nulls_last("first_publish_year"), "doc_id")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("query_id", "rank", "doc_id", "score")


def browse(works: DataFrame, effective: DataFrame, genres: list[int] | None = None, author: str | None = None, year_from: int | None = None,
           year_to: int | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Q04: filters without text, by the summed score of the requested genres, readers, title, id; no filter gives nothing."""
    active = bool(genres or author or year_from is not None or year_to is not None)
    listed = works.filter("kind = 'single' AND merged_into IS NULL" if active else "false")
    kept = search_filters(listed, effective, genres, author, year_from, year_to)
    if genres:
        sums = effective.filter(F.col("genre_id").isin(sorted(set(genres)))).groupBy("work_id").agg(F.sum("score").alias("genre_score"))
        kept = kept.join(sums, "work_id", "left")
    else:
        kept = kept.withColumn("genre_score", F.lit(0).cast("bigint"))
    return kept.select("work_id", "title", F.coalesce("genre_score", F.lit(0)).alias("genre_score"), "readinglog_count").orderBy(
        F.desc("genre_score"), F.desc("readinglog_count"), "title", "work_id").limit(limit)


def query_freshness(queries: DataFrame, log: DataFrame, now: Column) -> DataFrame:
    """Q05: is each query's normalized text resolved less than thirty days before ``now``?"""
    asked = queries.select("query_id", T.normalize_text(F.col("query")).alias("normalized_query")).filter("normalized_query <> ''")
    return asked.join(log, "normalized_query", "left").select(
        "query_id", "normalized_query", F.coalesce(F.col("resolved_at") > now - F.expr(f"INTERVAL {QUERY_DAYS} DAYS"), F.lit(False)).alias("fresh"))


def record_resolutions(log: DataFrame, results: DataFrame) -> DataFrame:
    """Q05, write half: ``results(query, resolved_at, result_count, degraded)``; degraded or empty answers are never recorded."""
    fresh = results.filter("NOT degraded AND result_count > 0").groupBy(T.normalize_text(F.col("query")).alias("normalized_query")).agg(
        F.max(F.struct("resolved_at", "result_count")).alias("r")).filter("normalized_query <> ''").select(
        "normalized_query", "r.resolved_at", "r.result_count")
    return log.join(fresh.select("normalized_query"), "normalized_query", "left_anti").select(
        "normalized_query", "resolved_at", "result_count").unionByName(fresh)


def find_series(series: DataFrame, works: DataFrame, q: str, limit: int = SERIES_HITS) -> DataFrame:
    """Q06: live top-level series whose name holds ``q``, with their live books, first by name."""
    hits = series.filter("kind = 'series' AND NOT dissolved AND merged_into IS NULL AND parent_id IS NULL").filter(
        F.lower("name").contains(q.strip().lower())).orderBy("name", "series_id").limit(limit)
    books = works.filter("merged_into IS NULL").join(hits.select("series_id"), "series_id", "left_semi").groupBy("series_id").agg(F.count("*").alias("book_count"))
    return hits.join(books, "series_id", "left").select("series_id", "slug", "name", F.coalesce("book_count", F.lit(0)).alias("book_count"))
