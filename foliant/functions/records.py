"""Defensive typed reads out of drifting JSON records.

A field is first taken out as JSON text, so one badly typed field never costs
the rest of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import collapse_edges


def document(json: Column) -> Column:
    """A record parsed once; null when it is not JSON. Put it in a column and read fields from that."""
    return F.try_parse_json(json)


def _raw(doc: Column, field: str) -> Column:
    """A field of a parsed record with its type kept."""
    return F.variant_get(doc, f"$.{field}", "variant")


def _items(value: Column) -> Column:
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text_field(doc: Column, field: str) -> Column:
    """The trimmed text of a string field; anything else, or blank, is null."""
    value = _raw(doc, field)
    text = collapse_edges(F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")))
    return F.when(text != "", text)


def raw_text_field(doc: Column, field: str) -> Column:
    """A string field exactly as it stands; other types are null."""
    value = _raw(doc, field)
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def string_list(doc: Column, field: str) -> Column:
    """Only the strings of a list, in order; a non-list is empty."""
    strings = F.filter(_items(_raw(doc, field)), lambda v: _kind(v) == "STRING")
    return F.transform(strings, lambda v: F.try_variant_get(v, "$", "string"))


def positive_ints(doc: Column, field: str) -> Column:
    """Only the whole numbers above zero of a list, in order."""
    whole = F.filter(_items(_raw(doc, field)), lambda v: _kind(v) == "BIGINT")
    return F.filter(F.transform(whole, lambda v: F.try_variant_get(v, "$", "bigint")), lambda n: n > 0)


def positive_int(doc: Column, field: str) -> Column:
    value = _raw(doc, field)
    number = F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))
    return F.when(number > 0, number)


def author_ids(doc: Column) -> Column:
    """Distinct author ids in listed order, from either shape of an entry."""
    def key(entry: Column) -> Column:
        nested = F.try_variant_get(entry, "$.author", "variant")
        path = F.when(nested.isNotNull(), F.try_variant_get(nested, "$.key", "string")).otherwise(
            F.try_variant_get(entry, "$.key", "string"))
        return F.regexp_extract(F.coalesce(path, F.lit("")), "(OL[0-9]+A)", 1)

    return F.array_distinct(F.filter(F.transform(_items(_raw(doc, "authors")), key), lambda k: k != ""))


def extract_authors(raw_authors: DataFrame, used: DataFrame) -> DataFrame:
    """Name, alternate names and knowledge-graph id of every author some work lists."""
    doc = F.col("doc")
    wanted = raw_authors.join(used.select("ol_id"), "ol_id", "left_semi").select("ol_id", document(F.col("json")).alias("doc"))
    return wanted.select(
        "ol_id",
        F.coalesce(text_field(doc, "name"), F.lit("")).alias("name"),
        string_list(doc, "alternate_names").alias("alternate_names"),
        text_field(doc, "remote_ids.wikidata").alias("wikidata"))
