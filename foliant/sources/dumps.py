"""Readers of landed inputs.

Entity dumps are gzip text, which one task must read from start to end; pass
``spread`` to redistribute the lines right after decompression, or stage them
to Parquet once and work from there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import records as R
from foliant.functions import text as T
from foliant.operators.graph import resolved_redirects
from foliant.schemas import ACTIVITY
from foliant.session import join_sparse, written

# --- fixed values ---------------------------------------------------------------
NAME_LANGUAGES = ("en", "mul", "zh", "ja", "ko", "ru")
COVER_SIZES = ("extraLarge", "large", "medium", "small", "thumbnail", "smallThumbnail")
FIRST_WORK_KEY = r'"works":\s*\[\s*\{\s*"key":\s*"/works/(OL[0-9]+W)"'
ENGLISH_MARK = '"/languages/eng"'
HASH_CHUNK = 1 << 20
# ----------------------------------------------------------------------------------


def entity_rows(lines: DataFrame) -> DataFrame:
    """S01 on a ``value`` text column: lines with fewer than five fields are skipped."""
    parts = F.split("value", "\t", 5)
    return lines.select(parts.alias("p")).filter(F.size("p") >= 5).select(
        F.col("p")[0].alias("type"), F.col("p")[1].alias("key"),
        F.element_at(F.split(F.col("p")[1], "/"), -1).alias("ol_id"), F.col("p")[4].alias("json"))


def read_entity_dump(spark: SparkSession, path: str, spread: int | None = None) -> DataFrame:
    """Typed JSON records of a tab-separated dump."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return entity_rows(lines.repartition(spread) if spread else lines)


def activity_rows(rows: DataFrame, kind: str | Column) -> DataFrame:
    """S02 on already split columns; the work id is found anywhere in the key."""
    return rows.withColumn("ol_id", F.regexp_extract(F.coalesce("work", F.lit("")), "(OL[0-9]+W)", 1)).withColumn(
        "kind", F.lit(kind) if isinstance(kind, str) else kind)


def read_activity_log(spark: SparkSession, path: str, kind: str, spread: int | None = None) -> DataFrame:
    """Short rows are padded with nulls; nothing is quoted."""
    rows = spark.read.schema(ACTIVITY).csv(path, sep="\t", quote="", escape="", mode="PERMISSIVE")
    return activity_rows(rows.repartition(spread) if spread else rows, kind)


def load_entities(dump: DataFrame, type_: str, ids: DataFrame, suffix: str = "W") -> DataFrame:
    """Records of one type whose id is wanted."""
    wanted = dump.filter(F.col("type") == type_).select(
        F.regexp_extract("key", f"(OL[0-9]+{suffix})", 1).alias("ol_id"), "json")
    return wanted.join(ids.select("ol_id").distinct(), "ol_id", "left_semi")


def load_redirects(dump: DataFrame, suffix: str = "W") -> DataFrame:
    """S04."""
    pattern = f"(OL[0-9]+{suffix})"
    pairs = dump.filter("type = '/type/redirect'").select(
        F.regexp_extract("key", pattern, 1).alias("from_ol"),
        F.regexp_extract(F.coalesce(F.get_json_object("json", "$.location"), F.lit("")), pattern, 1).alias("to_ol"))
    return pairs.filter("from_ol <> '' AND to_ol <> ''")


def _edition_keys(dump: DataFrame) -> list[Column]:
    """What names an edition line, found in its text without parsing it."""
    return [F.col("ol_id"), F.regexp_extract("json", FIRST_WORK_KEY, 1).alias("work_key"), F.col("json").contains(ENGLISH_MARK).alias("is_english")]


def owned_editions(dump: DataFrame, redirects: DataFrame) -> DataFrame:
    """``(ol_id, work_key, is_english, work_ol_id)`` of every edition line, in one pass that leaves the JSON behind."""
    return _owned(dump, resolved_redirects(redirects))


def _owned(dump: DataFrame, keys: DataFrame, *more: str) -> DataFrame:
    """Edition lines with what ``keys(from_ol, resolved, ...)`` says of their work.

    Lines without a work join under keys of their own, as they would be one hot key.
    """
    lines = dump.select(*_edition_keys(dump)).withColumn("from_ol", F.when(F.col("work_key") != "", F.col("work_key")))
    placed = join_sparse(lines, keys, "from_ol", "ol_id")
    return placed.select("ol_id", "work_key", "is_english", F.coalesce("resolved", "from_ol").alias("work_ol_id"), *more)


def _judged_keys(moved: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(from_ol, resolved, wanted)``: redirected keys with their survivor, and wanted ones that stay, so lines meet both by one join."""
    moved = moved.select("from_ol", F.coalesce("resolved", "from_ol").alias("resolved"))
    survivors = moved.join(wanted.withColumnRenamed("work_ol_id", "resolved"), "resolved", "left").select("from_ol", "resolved", "wanted")
    staying = wanted.join(moved.select(F.col("from_ol").alias("work_ol_id")), "work_ol_id", "left_anti")
    return survivors.unionByName(staying.select(F.col("work_ol_id").alias("from_ol"), F.col("work_ol_id").alias("resolved"), "wanted"))


def filter_editions(dump: DataFrame, candidates: DataFrame, extra_ids: DataFrame, redirects: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """English editions of candidate works and every edition in ``extra_ids``.

    One pass over the keys (``owned``, computed here unless given) flags what is wanted; the JSON is joined to it once,
    after the shuffle files of that pass are gone.
    """
    names = ["ol_id", "work_key", "is_english"]
    wanted = candidates.select(F.col("ol_id").alias("work_ol_id"), F.lit(True).alias("wanted")).distinct()
    extra = extra_ids.select("ol_id", F.lit(True).alias("extra")).distinct()
    if owned is None:
        flagged = _owned(dump, _judged_keys(resolved_redirects(redirects), wanted), "wanted")
    else:
        flagged = join_sparse(owned, wanted, "work_ol_id", "ol_id")
    chosen = written(flagged.join(extra, "ol_id", "left").filter(
        (F.col("is_english") & F.col("wanted")) | F.col("extra")).select(*names, "work_ol_id").distinct())
    kept = dump.select(*_edition_keys(dump), "json").join(chosen, names)
    doc = F.col("doc")
    parsed = kept.select("ol_id", "work_ol_id", "is_english", R.document(F.col("json")).alias("doc"))
    return parsed.filter("doc IS NOT NULL").select(
        "ol_id", "work_ol_id", "is_english",
        R.raw_text_field(doc, "title").alias("title"), R.raw_text_field(doc, "subtitle").alias("subtitle"),
        R.string_list(doc, "publishers").alias("publishers"),
        R.raw_text_field(doc, "publish_date").alias("publish_date"),
        R.string_list(doc, "isbn_13").alias("isbn_13"), R.string_list(doc, "isbn_10").alias("isbn_10"),
        R.positive_int(doc, "number_of_pages").alias("number_of_pages"),
        R.positive_ints(doc, "covers").alias("covers"), R.string_list(doc, "series").alias("series"))


def count_editions(dump: DataFrame, candidates: DataFrame, redirects: DataFrame, owned: DataFrame | None = None) -> DataFrame:
    """Editions per candidate work, whatever their language."""
    owned = owned_editions(dump, redirects) if owned is None else owned
    counted = owned.filter("work_ol_id IS NOT NULL").groupBy(F.col("work_ol_id").alias("ol_id")).agg(F.count("*").cast("int").alias("edition_count"))
    return counted.join(candidates.select("ol_id"), "ol_id", "left_semi")


def _tail(uri: str) -> Column:
    return F.substring_index(F.col(uri), "/", -1)


def kg_memberships(rows: DataFrame) -> DataFrame:
    """Query-result rows (item, olid, series, ordinal)."""
    return rows.filter(F.col("olid").rlike("^OL[0-9]+[WM]$")).select(
        _tail("item").alias("item"), _tail("series").alias("series"), "ordinal", F.col("olid").alias("ol_id"))


def kg_series(rows: DataFrame) -> DataFrame:
    """One row per series with its label, distinct aliases and parents."""
    def present(column: Column) -> Column:
        return F.when(column != "", column)

    return rows.groupBy(_tail("series").alias("qid")).agg(
        F.min(present(F.col("label"))).alias("label"),
        F.array_sort(F.collect_set(present(F.col("alias")))).alias("aliases"),
        F.array_sort(F.collect_set(present(_tail("parent")))).alias("parents"))


def kg_author_links(rows: DataFrame) -> DataFrame:
    """(item, olid) pairs of authors."""
    return rows.filter(F.col("olid").rlike("^OL[0-9]+A$")).select(_tail("item").alias("qid"), F.col("olid").alias("ol_author_id"))


def kg_author_names(rows: DataFrame, languages: tuple[str, ...] = NAME_LANGUAGES) -> DataFrame:
    """Distinct names in the wanted languages."""
    return rows.filter(F.col("lang").isin(*languages)).select(_tail("item").alias("qid"), "name").distinct()


def source_records(spark: SparkSession, paths: list[str], chunk_bytes: int = HASH_CHUNK) -> DataFrame:
    """Name, path, date in the file name, size and SHA-256 of each input file.

    The reader lists the files; their contents are not loaded. One task streams a file
    through the hash in chunks, so memory doesn't depend on the file's size.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for uri in batch.column(0).to_pylist():
                store, path = pyarrow.fs.FileSystem.from_uri(uri)
                digest = hashlib.sha256()
                with store.open_input_stream(path) as stream:
                    while chunk := stream.read(chunk_bytes):
                        digest.update(chunk)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], ["path", "size", "sha256"])

    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    name = F.substring_index("path", "/", -1)
    return files.mapInArrow(hashed, "path string, size long, sha256 string").select(
        name.alias("name"), "path", F.regexp_extract(name, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("retrieved"), "size", "sha256")


_WORK_DOC = ("key string, title string, author_name array<string>, first_publish_year int, edition_count int, "
             "isbn array<string>, cover_i bigint, readinglog_count int, ratings_count int, subject array<string>")


def flatten_work_docs(docs: DataFrame, json: str = "json") -> DataFrame:
    """Search documents to work rows; other columns (input order) are kept."""
    parsed = docs.withColumn("doc", F.from_json(json, _WORK_DOC)).withColumn(
        "key", F.element_at(F.split(F.coalesce("doc.key", F.lit("")), "/"), -1))
    isbns = F.array_distinct(F.filter(F.transform("doc.isbn", T.normalize_isbn), lambda i: i.isNotNull()))
    return parsed.filter((F.col("key") != "") & (F.coalesce("doc.title", F.lit("")) != "")).select(
        *[c for c in docs.columns if c != json], "key", F.col("doc.title").alias("title"),
        F.get("doc.author_name", 0).alias("author"), F.col("doc.first_publish_year").alias("first_publish_year"),
        F.coalesce("doc.edition_count", F.lit(0)).alias("edition_count"),
        F.coalesce(isbns, F.array().cast("array<string>")).alias("isbn_13s"), F.col("doc.cover_i").alias("cover_id"),
        F.coalesce("doc.readinglog_count", F.lit(0)).alias("readinglog_count"),
        F.coalesce("doc.ratings_count", F.lit(0)).alias("ratings_count"),
        F.coalesce("doc.subject", F.array().cast("array<string>")).alias("subjects"))


_VOLUME = ("id string, volumeInfo struct<title:string,subtitle:string,authors:array<string>,publisher:string,"
           "publishedDate:string,description:string,industryIdentifiers:array<struct<type:string,identifier:string>>,"
           "pageCount:int,averageRating:decimal(2,1),ratingsCount:int,language:string,categories:array<string>,"
           "maturityRating:string,infoLink:string,previewLink:string,imageLinks:map<string,string>>")


def _first_date(text: Column) -> Column:
    return F.coalesce(*[F.when(text.rlike(shape), F.to_date(F.try_to_timestamp(text, F.lit(fmt)))) for shape, fmt in (
        ("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", "yyyy-M-d"), ("^[0-9]{4}-[0-9]{1,2}$", "yyyy-M"), ("^[0-9]{4}$", "yyyy"))])


def flatten_volumes(volumes: DataFrame, json: str = "json") -> DataFrame:
    """Volume documents to edition rows."""
    info = F.col("doc.volumeInfo")
    links = info["imageLinks"]
    cover = F.coalesce(*[F.when(F.element_at(links, size) != "", F.element_at(links, size)) for size in COVER_SIZES])

    def identifier(kind: str) -> Column:
        same = F.filter(info["industryIdentifiers"], lambda i: i["type"] == kind)
        return T.normalize_isbn(F.get(F.reverse(same), 0)["identifier"])

    parsed = volumes.withColumn("doc", F.from_json(json, _VOLUME)).filter(F.coalesce("doc.id", F.lit("")) != "")
    return parsed.select(
        *[c for c in volumes.columns if c != json], F.col("doc.id").alias("external_id"), F.lit("google_books").alias("source"),
        info["title"].alias("title"), info["subtitle"].alias("subtitle"),
        F.when(F.size(info["authors"]) > 0, F.array_join(info["authors"], ", ")).otherwise("Unknown").alias("author"),
        info["publisher"].alias("publisher"), _first_date(info["publishedDate"]).alias("published_date"),
        T.leading_year(info["publishedDate"]).alias("published_year"), info["description"].alias("description"),
        F.coalesce(identifier("ISBN_13"), identifier("ISBN_10")).alias("isbn_13"), info["pageCount"].alias("page_count"),
        info["averageRating"].alias("average_rating"), info["ratingsCount"].alias("ratings_count"),
        info["language"].alias("language"), info["categories"].alias("categories"),
        info["maturityRating"].alias("maturity_rating"), info["infoLink"].alias("info_link"),
        info["previewLink"].alias("preview_link"), T.upgrade_cover_url(cover).alias("cover_url"))
