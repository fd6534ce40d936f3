"""Fixed schemas: landed inputs, extract tables and the release contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the release contract ------------------------------------------
SCHEMA_VERSION = 1
RELEASE = {
    "works": "id string, ol_work_id string, canonical_key string, title string, subtitle string, author string, "
             "first_publish_year int, kind string, series_id string, ol_cover_id bigint, ol_edition_count int, "
             "readinglog_count int, ratings_count int, subjects string, representative_edition_id string",
    "editions": "id string, ol_edition_id string, work_id string, title string, subtitle string, author string, "
                "publisher string, published_year int, isbn_13 string, page_count int, cover_url string, language string",
    "series": "id string, key string, source string, provenance string, name string, slug string, "
              "canonical_key string, kind string, parent_series_id string",
    "series_members": "series_id string, work_id string, position double, provenance string, confidence string",
    "work_aliases": "ol_work_id string, work_id string",
}
RELEASE_IDENTITY = {
    "works": ["ol_work_id"], "editions": ["ol_edition_id"], "series": ["key"],
    "series_members": ["series_id", "work_id"], "work_aliases": ["ol_work_id"],
}
# -----------------------------------------------------------------------------------

ENTITY = "type string, key string, ol_id string, json string"
ACTIVITY = "work string, edition string, value string, date string"
EDITION = ("ol_id string, work_ol_id string, is_english boolean, title string, subtitle string, publishers array<string>, "
           "publish_date string, isbn_13 array<string>, isbn_10 array<string>, number_of_pages bigint, "
           "covers array<bigint>, series array<string>")


def column_names(schema: str) -> list[str]:
    depth, names, word = 0, [], ""
    for char in schema + ",":
        depth += (char == "<") - (char == ">")
        if char == "," and depth == 0:
            names.append(word.split()[0])
            word = ""
        else:
            word += char
    return names


def column_types(schema: str) -> list[tuple[str, str]]:
    return [tuple(part.strip().split(" ", 1)) for part in schema.split(", ")]


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project to the contract's columns, in order, with its types."""
    return df.select(*[F.col(name).cast(kind).alias(name) for name, kind in column_types(RELEASE[table])])
