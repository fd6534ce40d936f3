"""Ranked search on a stored index that is read from its best documents on (Q03).

Documents fall into tiers by the most any term could earn in them. A tier holds whole documents, so conjunctions are
decided inside it, and each (term, tier) keeps a ceiling. A search reads tiers in order and leaves out those whose
ceiling the last hit already beats, so the answer equals that of the full ranking.
"""

from __future__ import annotations

from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.search import DEFAULT_LIMIT, WEIGHTS, _cover_score, build_search_index, query_terms, term_bucket
from foliant.session import written

TIER_SHARES = (1 / 64, 1 / 16, 1 / 4)   # documents above each cut; the last tier takes the rest
ROUNDING = 1 + 1e-9                     # ceilings are sums in another order than scores
_POSTINGS = ("doc_id bigint, term string, entries array<int>, factor double, edition_count int, "
             "first_publish_year int, tier int, bucket int")
_CEILINGS = "term string, tier int, mass double, peak double, weight double, bucket int"


def _numbered(column: Column, values: list) -> Column:
    """The value of the field with a number; fields are numbered in the order of WEIGHTS."""
    result = F.lit(values[-1])
    for number in range(len(values) - 2, -1, -1):
        result = F.when(column == number, F.lit(values[number])).otherwise(result)
    return result


def write_ranked_index(works: DataFrame, path: str, buckets: int = 256, shares: tuple[float, ...] = TIER_SHARES) -> None:
    """Store the live single works for :func:`search_ranked`.

    ``works(doc_id, title, author, subjects, readers, edition_count, first_publish_year, kind, merged_into)``; ids are
    unique, no readers count as 0. ``path/postings`` holds one row per (document, term) by tier and hash of the term;
    ``path/ceilings`` holds the ceilings by hash of the term, with a row without term in every folder. Readers are those
    of the index's version.
    """
    listed = works.filter("kind = 'single' AND merged_into IS NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "title", "author", "subjects", (1 + F.log(1 + F.coalesce("readers", F.lit(0)).cast("double"))).alias("factor"),
        F.col("edition_count").cast("int").alias("edition_count"), F.col("first_publish_year").cast("int").alias("first_publish_year"))
    # An entry is its place times four plus the field's number. One exchange by document serves the grouping, the peak and the join.
    number = F.lit(len(WEIGHTS) - 1)
    for k, label in list(enumerate(WEIGHTS))[:-1]:
        number = F.when(F.col("weight") == label, F.lit(k)).otherwise(number)
    coded = build_search_index(listed).select("doc_id", "term", (F.col("pos") * 4 + number).alias("entry"), _numbered(number, list(WEIGHTS.values())).alias("w"))
    weighed = coded.repartition("doc_id").groupBy("doc_id", "term").agg(
        F.sort_array(F.collect_list("entry")).alias("entries"), F.sum("w").alias("mass"), F.max("w").alias("heaviest"))
    peaked = weighed.withColumn("most", F.max("mass").over(W.partitionBy("doc_id")))
    attributes = listed.select("doc_id", "factor", "edition_count", "first_publish_year")
    postings = written(peaked.join(attributes, "doc_id").withColumn("impact", F.col("factor") * F.col("most")).drop("most"))

    per_document = postings.groupBy("doc_id").agg(F.max("impact").alias("impact"))
    cuts = per_document.agg(F.percentile_approx("impact", [1 - share for share in shares], 10_000).alias("cuts")).first()["cuts"] or []
    tier = F.lit(0)
    for cut in cuts:
        tier = tier + (F.col("impact") < cut).cast("int")
    placed = postings.withColumn("tier", tier).withColumn("bucket", term_bucket(F.col("term"), buckets)).drop("impact")
    placed.drop("mass", "heaviest").repartitionByRange("tier", "bucket", F.xxhash64("doc_id")).sortWithinPartitions("tier", "bucket", "term", "doc_id").write.partitionBy(
        "tier", "bucket").parquet(f"{path}/postings")

    ceilings = placed.groupBy("term", "tier", "bucket").agg(
        F.max(F.col("factor") * F.col("mass")).alias("mass"), F.max(F.col("factor") * F.size("entries")).alias("peak"), F.max("heaviest").alias("weight"))
    every = works.sparkSession.range(buckets).select(
        F.lit(None).cast("string").alias("term"), F.lit(None).cast("int").alias("tier"), F.col("id").cast("int").alias("bucket"),
        *[F.lit(None).cast("double").alias(c) for c in ("mass", "peak")], F.lit(None).cast("double").alias("weight"))
    ceilings.unionByName(every).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/ceilings")


def ceiling(held: list[tuple[float, float, float]]) -> float:
    """The most a document of a tier can score, from each term's (mass, peak, weight): the largest factor x summed
    weights, the largest factor x count, the heaviest field.

    An entry lies in at most as many minimal covers as there are terms, since a cover starts at the last entry of its
    first term. A cover has at least one entry a term and earns at most the mean of its weights, so all covers together
    earn at most the sum of all weights. There are also at most as many covers as terms for each entry of the rarest
    term; with two terms a cover is one entry of each and earns at most twice the lighter one.
    """
    n = len(held)
    masses, peaks, weights = zip(*held)
    by_rarest = 4 * min(masses) if n == 2 else n * min(peaks) * max(weights)
    return min(sum(masses), by_rarest) * ROUNDING


def _folders(spark: SparkSession, schema: str, base: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/{f}" for f in folders])


def _local(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=schema))


_QUERY = pa.schema([("query_id", pa.int32()), ("query", pa.string())])
_TERM = pa.schema([("query_id", pa.int32()), ("n_terms", pa.int32()), ("idx", pa.int32()), ("term", pa.string())])
_HIT = pa.schema([("query_id", pa.int32()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.float64())])


def _tier_hits(postings: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """The best documents of one tier that hold every term of a query."""
    matched = postings.join(terms, "term").groupBy("query_id", "n_terms", "doc_id", "factor", "edition_count", "first_publish_year").agg(
        F.collect_list(F.struct("idx", "entries")).alias("found")).filter(F.size("found") == F.col("n_terms"))
    spread = F.flatten(F.transform("found", lambda f: F.transform(f["entries"], lambda e: F.struct(
        F.shiftright(e, 2).alias("pos"), f["idx"].alias("idx"), _numbered(e.bitwiseAND(3), [1 / w for w in WEIGHTS.values()]).alias("inverse")))))
    scored = matched.withColumn("score", _cover_score(F.array_sort(spread), F.col("n_terms")) * F.col("factor"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("edition_count"), F.asc_nulls_last("first_publish_year"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        "query_id", "doc_id", "score", "edition_count", "first_publish_year")


def _order(hit) -> tuple:
    year, editions = hit["first_publish_year"], hit["edition_count"]
    return (-hit["score"], editions is None, -(editions or 0), year is None, year or 0, hit["doc_id"])


def search_ranked(spark: SparkSession, path: str, queries: list[tuple[int, str]], limit: int = DEFAULT_LIMIT, buckets: int = 256,
                  allowed: DataFrame | None = None, tiers_read: list[tuple[int, int]] | None = None) -> DataFrame:
    """Q03 for the queries a caller holds: ``(query_id, rank, doc_id, score)``, at most ``limit`` rows a query.

    ``allowed(doc_id)`` narrows the answer (F05). ``tiers_read`` takes (query, tier) of what was read. A query without
    terms or with an unknown term has no rows. A table of queries goes through ``rank_search`` and ``read_index``.
    """
    if not queries:
        return _local(spark, [], _HIT)
    terms = query_terms(_local(spark, queries, _QUERY)).withColumn("bucket", term_bucket(F.col("term"), buckets)).collect()
    by_query: dict[int, list] = {}
    for row in terms:
        by_query.setdefault(row["query_id"], []).append(row)
    asked = sorted({row["bucket"] for row in terms})
    stored = {}
    if asked:
        known = _folders(spark, _CEILINGS, f"{path}/ceilings", [f"bucket={b}" for b in asked]).filter(F.col("term").isin(sorted({r["term"] for r in terms})))
        stored = {(row["term"], row["tier"]): (row["mass"], row["peak"], row["weight"]) for row in known.collect()}

    best: dict[int, list] = {query: [] for query in by_query}
    for tier in sorted({tier for _, tier in stored}):
        open_terms = []
        for query, rows in by_query.items():
            held = [stored.get((row["term"], tier)) for row in rows]
            if None in held:
                continue
            full = len(best[query]) == limit
            if not full or best[query][-1]["score"] <= ceiling(held):
                open_terms += rows
                if tiers_read is not None:
                    tiers_read.append((query, tier))
        if not open_terms:
            continue
        postings = _folders(spark, _POSTINGS, f"{path}/postings", [f"tier={tier}/bucket={b}" for b in sorted({r["bucket"] for r in open_terms})])
        if allowed is not None:
            postings = postings.join(allowed.select("doc_id"), "doc_id", "left_semi")
        wanted = _local(spark, [(r["query_id"], r["n_terms"], r["idx"], r["term"]) for r in open_terms], _TERM)
        for hit in _tier_hits(postings, wanted, limit).collect():
            best[hit["query_id"]].append(hit)
        best = {query: nsmallest(limit, hits, key=_order) for query, hits in best.items()}
    return _local(spark, [(query, rank, hit["doc_id"], hit["score"]) for query, hits in best.items() for rank, hit in enumerate(hits, 1)], _HIT)
