"""Raw records to catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import records as R
from foliant.functions import text as T
from foliant.operators.graph import resolve_column, resolve_redirects


def popularity(log: DataFrame, redirects: DataFrame) -> DataFrame:
    """``log(ol_id, kind)`` counted per raw id first, then summed on the survivor.

    The first aggregation combines map-side, so only one row per raw id meets
    the redirect join and the second aggregation.
    """
    raw = log.filter("ol_id <> ''").groupBy("ol_id").agg(
        F.count_if(F.col("kind") == "rating").alias("r"), F.count_if(F.col("kind") == "reading_log").alias("l"))
    return resolve_column(raw, "ol_id", redirects).groupBy("ol_id").agg(
        F.sum("r").cast("int").alias("ratings_count"), F.sum("l").cast("int").alias("readinglog_count"))


def alias_rows(ids: DataFrame, redirects: DataFrame) -> DataFrame:
    """Ids the redirects move, ``(from_ol, to_ol)``."""
    pairs = resolve_redirects(ids.select("id").distinct(), redirects)
    return pairs.filter("id <> resolved").select(F.col("id").alias("from_ol"), F.col("resolved").alias("to_ol"))


def referenced_authors(raw_works: DataFrame, redirects: DataFrame) -> DataFrame:
    """Every author id written anywhere in the kept records."""
    found = raw_works.select(F.explode(F.array_distinct(
        F.regexp_extract_all("json", F.lit("(OL[0-9]+A)"), F.lit(1)))).alias("ol_id")).distinct()
    return resolve_column(found, "ol_id", redirects).distinct()


def extract_editions(raw_editions: DataFrame, selected: DataFrame) -> DataFrame:
    """English editions of selected works, one value per field."""
    kept = raw_editions.filter("is_english").join(
        selected.select(F.col("ol_id").alias("work_ol_id")), "work_ol_id", "left_semi")
    isbns = F.filter(F.transform(F.concat("isbn_13", "isbn_10"), T.normalize_isbn), lambda i: i.isNotNull())
    return kept.select(
        "ol_id", "work_ol_id", F.coalesce("title", F.lit("")).alias("title"), "subtitle",
        F.get("publishers", 0).alias("publisher"), T.year_of(F.col("publish_date")).alias("publish_year"),
        F.get(isbns, 0).alias("isbn_13"), F.col("number_of_pages").cast("int").alias("page_count"),
        F.get("covers", 0).alias("cover_id"), "series")


def extract_works(raw_works: DataFrame, authors: DataFrame, author_redirects: DataFrame, counts: DataFrame,
                  edition_counts: DataFrame, editions: DataFrame) -> DataFrame:
    """``raw_works(ol_id, json)`` of the selected works.

    ``authors(ol_id, name)``, ``counts`` from X03, ``edition_counts`` from S06, ``editions`` from X02.
    """
    doc = F.col("doc")
    base = raw_works.select("ol_id", R.document(F.col("json")).alias("doc")).select(
        "ol_id", F.coalesce(R.text_field(doc, "title"), F.lit("")).alias("raw_title"),
        R.text_field(doc, "subtitle").alias("subtitle"), R.author_ids(doc).alias("listed"),
        T.year_of(R.raw_text_field(doc, "first_publish_date")).alias("own_year"),
        T.join_subjects(R.string_list(doc, "subjects")).alias("subjects"),
        F.get(R.positive_ints(doc, "covers"), 0).alias("cover_id"))
    listed = base.select("ol_id", F.posexplode("listed").alias("pos", "author_id"))
    named = resolve_column(listed, "author_id", author_redirects).join(
        authors.select(F.col("ol_id").alias("author_id"), "name"), "author_id", "left")
    by_work = named.groupBy("ol_id", "author_id").agg(F.min("pos").alias("pos"), F.max("name").alias("name")).groupBy(
        "ol_id").agg(F.array_sort(F.collect_list(F.struct("pos", "author_id", "name"))).alias("people"))
    names = F.filter(F.transform("people", lambda p: p["name"]), lambda n: n != "")
    years = editions.filter("publish_year > 0").groupBy(F.col("work_ol_id").alias("ol_id")).agg(
        F.min("publish_year").alias("edition_year"))
    shown = T.display_title(F.col("raw_title"))
    joined = (
        base.join(by_work, "ol_id", "left").join(years, "ol_id", "left").join(counts, "ol_id", "left")
        .join(edition_counts, "ol_id", "left")
        .withColumn("names", F.coalesce(names, F.array().cast("array<string>")))
        .withColumn("title", F.when(shown != "", shown).when(F.col("raw_title") != "", F.col("raw_title")).otherwise("Untitled")))
    return joined.select(
        "ol_id", "raw_title", "title", "subtitle",
        F.when(F.size("names") > 0, F.array_join("names", ", ")).otherwise("Unknown").alias("author"),
        F.coalesce(F.transform("people", lambda p: p["author_id"]), F.array().cast("array<string>")).alias("author_ids"),
        F.coalesce("own_year", "edition_year").alias("first_publish_year"), "subjects", "cover_id",
        F.coalesce("ratings_count", F.lit(0)).alias("ratings_count"),
        F.coalesce("readinglog_count", F.lit(0)).alias("readinglog_count"),
        F.coalesce("edition_count", F.lit(0)).alias("edition_count"),
        T.canonical_key(F.col("title"), F.get("names", 0)).alias("canonical_key"),
        T.classify_kind(F.col("raw_title"), F.col("subtitle")).alias("kind"))
