"""The whole grouping stage, from extract tables to the group tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import resolve as E
from foliant.operators import series as L
from foliant.operators.graph import cluster_authors, series_rooms
from foliant.session import materialize


def group_catalog(works: DataFrame, editions: DataFrame, authors: DataFrame, kg_memberships: DataFrame, kg_series: DataFrame,
                  kg_author_links: DataFrame, kg_author_names: DataFrame, redirects: DataFrame, edition_owner: DataFrame,
                  redirect_aliases: DataFrame, merges: DataFrame | None = None, splits: DataFrame | None = None,
                  series_ops: DataFrame | None = None) -> dict[str, DataFrame]:
    """Duplicates, splits, the evidence ladder with its guards, overrides and rooms.

    ``works``/``editions``/``authors`` are X01, X02 and K25 with ``work_id``/``edition_id`` as ids; the override tables
    were validated by V02. The three steps every later one reads are written once (clusters, duplicates, memberships).
    """
    clusters = materialize(cluster_authors(authors.withColumnRenamed("ol_id", "id"), kg_author_links.select(
        "qid", F.col("ol_author_id").alias("id")), kg_author_names))
    items = E.link_kg_items(kg_memberships, redirects, edition_owner).join(works.select("work_id"), "work_id", "left_semi")
    primary = E.primary_author(works, clusters)
    keys = editions.select("work_id", "title", "subtitle").distinct().select(
        "work_id", T.edition_title_key(F.col("title"), F.col("subtitle")).alias("tkey")).distinct()
    dup_works = works.drop("author").join(primary, "work_id").select(
        "work_id", "author", "kind", T.clean_title(F.col("title")).alias("title_key"),
        (F.col("readinglog_count") + F.col("edition_count")).alias("popularity"))
    aliases = E.find_duplicates(dup_works, items, keys)
    if merges is not None:
        aliases = E.apply_merges(merges, aliases)
    aliases = materialize(aliases)
    final, owned, items = E.fold_duplicates(works, editions, items, aliases)
    if splits is not None:
        direct = kg_memberships.filter("ol_id LIKE '%M'").select(F.col("ol_id").alias("edition_id"), "item")
        final, owned = E.apply_splits(splits, final, owned, aliases)
        fresh = owned.filter("work_id LIKE '%~%'").select("edition_id", "work_id").join(direct, "edition_id").select("work_id", "item")
        items = items.unionByName(fresh).distinct()
    final, owned = materialize(final), materialize(owned)
    author = E.primary_author(final, clusters)

    titles = final.select("work_id", F.lit("").alias("voter"), F.col("raw_title").alias("title")).unionByName(
        owned.select("work_id", F.col("edition_id").alias("voter"), "title"))
    cands = materialize(L.candidates(
        L.rung1(items, kg_memberships, kg_series), L.rung2(final, L.tag_counts(final)),
        L.rung3(owned.select("work_id", "edition_id", "series")), L.rung4(titles)))
    rejects = series_ops.filter("kind = 'reject_series'").select("key") if series_ops is not None else None
    imprints = materialize(L.imprint_rejections(cands, author, L.blocked_keys(cands, rejects=rejects)))
    fold = materialize(L.fold_series(cands, kg_series, imprints))
    chosen = L.choose_memberships(cands, fold, imprints, final.select("work_id", "kind"))
    memberships = materialize(L.drop_lonely(L.drop_adaptations(chosen, author)))
    names, decided = L.series_names(cands, kg_series), L.decided_by(final, memberships)
    if series_ops is not None:
        memberships, names, decided = L.apply_series_overrides(
            series_ops, memberships, names, decided, L.known_series(cands, fold, kg_series), aliases)
    parents = kg_series.filter(F.size("parents") > 0).select(
        F.concat(F.lit("wd:"), F.col("qid")).alias("child"), F.concat(F.lit("wd:"), F.array_min("parents")).alias("parent"))
    rooms, series_parents = series_rooms(memberships, parents)
    series, all_rooms = L.series_rows(memberships, rooms, series_parents, names, final)
    best = E.representative_edition(owned, final)
    g_works = final.join(author.withColumnRenamed("author", "primary_author"), "work_id").join(all_rooms, "work_id").join(best, "work_id", "left")
    return {
        "works": g_works, "editions": owned, "series": series,
        "members": memberships.select(F.col("key").alias("series_key"), "work_id", "position", T.provenance_label(F.col("rung")).alias("provenance"),
                                      T.confidence_label(F.col("rung")).alias("confidence")),
        "aliases": L.alias_table(aliases, redirect_aliases, final), "decisions": decided, "imprints": imprints, "author_clusters": clusters,
    }
