"""Pointer chases, components and closures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.session import materialize

# --- fixed values --------------------------------------------------------------
MAX_REDIRECT_HOPS = 5
MAX_TOMBSTONE_HOPS = 10
MAX_PARENT_HOPS = 5
MAX_NAME_SHARERS = 3
# -------------------------------------------------------------------------------


def _walk(pointers: DataFrame, max_hops: int) -> DataFrame:
    """``(node, target)`` of a functional pointer table after up to ``max_hops`` hops.

    Only pointer rows walk, so the wide side of a resolution is joined once.
    """
    edge = pointers.groupBy("node").agg(F.min("next").alias("next"))
    state = edge.select("node", F.col("node").alias("at"), F.array("node").alias("seen"))
    hop = edge.select(F.col("node").alias("at"), "next")
    for _ in range(max_hops):
        fresh = F.col("next").isNotNull() & ~F.array_contains("seen", F.col("next"))
        state = state.join(hop, "at", "left").select(
            "node",
            F.when(fresh, F.col("next")).otherwise(F.col("at")).alias("at"),
            F.when(fresh, F.array_append("seen", F.col("next"))).otherwise(F.col("seen")).alias("seen"))
    return state.select("node", F.col("at").alias("target"))


def resolved_redirects(redirects: DataFrame, max_hops: int = MAX_REDIRECT_HOPS,
                       source: str = "from_ol", target: str = "to_ol") -> DataFrame:
    """``(from_ol, resolved)`` for every redirect record; a table that is resolved already is taken as it is."""
    if "resolved" in redirects.columns:
        return redirects.select("from_ol", "resolved")
    edges = redirects.select(F.col(source).alias("node"), F.col(target).alias("next"))
    return _walk(edges, max_hops).select(F.col("node").alias("from_ol"), F.col("target").alias("resolved"))


def redirect_map(redirects: DataFrame, max_hops: int = MAX_REDIRECT_HOPS) -> DataFrame:
    """The walk done once and written; every operator that takes redirects takes this too."""
    return materialize(resolved_redirects(redirects, max_hops))


def resolve_column(rows: DataFrame, column: str, redirects: DataFrame, out: str | None = None) -> DataFrame:
    """Replace an id column by its redirect survivor."""
    mapped = resolved_redirects(redirects)
    joined = rows.join(mapped, rows[column] == mapped["from_ol"], "left")
    value = F.coalesce(F.col("resolved"), rows[column])
    return joined.withColumn(out or column, value).drop("from_ol", "resolved")


def resolve_redirects(ids: DataFrame, redirects: DataFrame, max_hops: int = MAX_REDIRECT_HOPS) -> DataFrame:
    """Follow at most ``max_hops`` pointers, stopping before a node is seen twice."""
    mapped = resolved_redirects(redirects, max_hops)
    joined = ids.select("id").join(mapped, ids["id"] == mapped["from_ol"], "left")
    return joined.select("id", F.coalesce("resolved", "id").alias("resolved"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """``(id, cluster)``: the smallest id of each component, by alternating star contractions.

    Each half round is one aggregation and one equi-join per edge, so a hub with
    a third of all edges is combined map-side and never gathered in one task.
    """
    links = materialize(
        edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = _fingerprint(links)
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        parent = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(parent, "b").select(F.explode(F.array(
            F.struct(F.col("m").alias("a"), F.col("b").alias("b")),
            F.struct(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")))).alias("e")).select("e.*")
        following = materialize(small.filter("a <> b").distinct())
        following_mark = _fingerprint(following)
        links = following
        if following_mark == mark:
            break
        mark = following_mark
    label = links.groupBy("b").agg(F.min("a").alias("cluster"))
    return nodes.select(F.col(node).alias("id")).distinct().join(label, F.col("id") == label["b"], "left").select(
        "id", F.coalesce("cluster", "id").alias("cluster"))


def distinctive(key):
    """Two words, or two characters with one beyond the Latin blocks."""
    return (F.size(F.split(key, " ")) >= 2) | ((F.length(key) >= 2) & key.rlike(r"[^\x{0}-\x{24f}]"))


def _star(groups: DataFrame, by: str) -> DataFrame:
    """Edges from the smallest member of each group to the others."""
    centre = groups.groupBy(by).agg(F.min("id").alias("a"))
    return groups.join(centre, by).select("a", F.col("id").alias("b")).filter("a <> b")


def cluster_authors(authors: DataFrame, kg_links: DataFrame, kg_names: DataFrame) -> DataFrame:
    """Author records linked by a shared item or a shared distinctive name.

    ``authors(id, name, alternate_names, wikidata)``, ``kg_links(qid, id)``,
    ``kg_names(qid, name)``. A name unites only the two or three records that carry it.
    """
    own = authors.filter("wikidata IS NOT NULL").select(F.col("wikidata").alias("qid"), "id")
    linked = own.unionByName(kg_links.join(authors.select("id"), "id", "left_semi").select("qid", "id")).distinct()
    written = authors.select("id", F.explode(F.concat(
        F.array("name"), F.coalesce("alternate_names", F.array().cast("array<string>")))).alias("name"))
    borrowed = linked.join(kg_names, "qid").select("id", "name")
    carriers = written.unionByName(borrowed).select("id", T.normalize_text(F.col("name")).alias("key"))
    carriers = carriers.filter((F.col("key") != "") & distinctive(F.col("key"))).distinct()
    shared = carriers.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n").between(2, MAX_NAME_SHARERS))
    edges = _star(linked, "qid").union(_star(carriers.join(shared, "key", "left_semi"), "key"))
    return connected_components(authors, edges)


def climb_parents(seed: DataFrame, edges: DataFrame, depth: int = MAX_PARENT_HOPS) -> DataFrame:
    """Every ancestor within ``depth`` levels of the seeds with its least level."""
    level = seed.select("node").distinct()
    found = level.withColumn("level", F.lit(0))
    for step in range(1, depth + 1):
        level = level.join(edges.select(F.col("child").alias("node"), "parent"), "node").select(
            F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
        found = found.unionByName(level.withColumn("level", F.lit(step)))
    return found.groupBy("node").agg(F.min("level").alias("level"))


def _closure(keys: DataFrame, parents: DataFrame) -> DataFrame:
    """The keys and all their ancestors, where a key has one parent at most.

    Pointers double each round, so the known set grows by twice as many levels each time.
    A round that adds nothing proves the set closed, also on a cycle.
    """
    known, jump = materialize(keys.select("key").distinct()), parents.select("child", "parent")
    size = known.count()
    while True:
        up = known.join(jump, known["key"] == jump["child"]).select(F.col("parent").alias("key"))
        known = materialize(known.union(up).distinct())
        before, size = size, known.count()
        if size == before:
            return known
        ahead = jump.select(F.col("child").alias("parent"), F.col("parent").alias("further"))
        jump = materialize(jump.join(ahead, "parent").select("child", F.col("further").alias("parent")))


def series_rooms(memberships: DataFrame, parents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rooms(work_id, room), series_parents(key, parent))``.

    A parent is climbed to only when two works or two needed children hold it up.
    """
    member = materialize(memberships.select("work_id", "key").distinct())
    parent = materialize(parents.filter("parent IS NOT NULL").groupBy("child").agg(F.min("parent").alias("parent")))
    direct = member.groupBy("key").agg(F.count("*").alias("works"))
    relevant = _closure(direct.select("key"), parent)
    children = relevant.join(parent, relevant["key"] == parent["child"]).groupBy("parent").agg(
        F.countDistinct("child").alias("children"))
    held = relevant.join(direct, "key", "left").join(children, relevant["key"] == children["parent"], "left").filter(
        (F.coalesce("works", F.lit(0)) >= 2) | (F.coalesce("children", F.lit(0)) >= 2)).select(
        F.col("key").alias("parent"))
    climbable = materialize(parent.join(held, "parent", "left_semi").select(F.col("child").alias("top"), "parent"))

    ends = follow_aliases(climbable.select(F.col("top").alias("loser"), F.col("parent").alias("survivor")))
    chains = direct.select("key").join(ends, direct["key"] == ends["loser"], "left").select("key", F.coalesce("survivor", "key").alias("top"))
    tops = member.join(chains.select("key", "top"), "key").select("work_id", "top").distinct()
    size = tops.groupBy("top").agg(F.count("*").alias("n"))
    rooms = tops.join(size, "top").groupBy("work_id").agg(
        F.min_by("top", F.struct(-F.col("n"), F.col("top"))).alias("room"))
    output = _closure(direct.select("key"), climbable.select(F.col("top").alias("child"), "parent"))
    above = output.join(parent, output["key"] == parent["child"], "left").select("key", "parent")
    known = output.select(F.col("key").alias("parent"), F.lit(True).alias("kept"))
    series_parents = above.join(known, "parent", "left").select(
        "key", F.when(F.col("kept"), F.col("parent")).alias("parent"))
    return rooms, series_parents


def _doubled(first: DataFrame, rounds: int | None = None) -> DataFrame:
    """Every pointer followed to its end, twice as far each round; on cycles only ``rounds`` end it."""
    state = first
    while rounds is None or rounds > 0:
        ahead = state.select(F.col("loser").alias("survivor"), F.col("survivor").alias("further"))
        if not state.join(ahead, "survivor", "left_semi").head(1):
            break
        state = materialize(state.join(ahead, "survivor", "left").select(
            "loser", F.coalesce("further", "survivor").alias("survivor")))
        rounds = None if rounds is None else rounds - 1
    return state


def follow_aliases(aliases: DataFrame) -> DataFrame:
    """``(loser, survivor)`` with every chain followed to its end.

    Pointers double each round, so a chain of n needs log n rounds. A walk that runs into a
    cycle stops before its first repeat: at the node that stands before its entry.
    """
    first = materialize(aliases.groupBy("loser").agg(F.min("survivor").alias("survivor")))
    state = _doubled(first, math.ceil(math.log2(first.count() + 1)) + 1)
    ends = first.select(F.col("loser").alias("survivor"))
    done = state.join(ends, "survivor", "left_anti").select("loser", "survivor")
    # After so many hops whatever still moves is on a cycle, and every node of a cycle is reached.
    looping = materialize(state.join(ends, "survivor", "left_semi"))
    if not looping.head(1):
        return done
    cycle = materialize(looping.select(F.col("survivor").alias("entry")).distinct())
    on_cycle = cycle.select(F.col("entry").alias("loser"))
    before = first.join(on_cycle, "loser", "left_semi").select(F.col("survivor").alias("entry"), F.col("loser").alias("last"))
    tails = first.join(looping.select("loser"), "loser", "left_semi").join(on_cycle, "loser", "left_anti")
    entered = _doubled(materialize(tails)).select("loser", F.col("survivor").alias("entry")).union(cycle.select("entry", F.col("entry")))
    return done.union(entered.join(before, "entry").select("loser", F.col("last").alias("survivor")))


def canonical_series(series: DataFrame) -> DataFrame:
    """``(slug, room)``: tombstones first, then parents, tombstones again at every step.

    ``series(series_id, slug, merged_into, parent_id)``.
    """
    dead = series.filter("merged_into IS NOT NULL").select(F.col("series_id").alias("node"), F.col("merged_into").alias("next"))
    canon = materialize(_walk(dead, MAX_TOMBSTONE_HOPS))
    ids = series.select("series_id", "slug", "parent_id").join(
        canon, F.col("series_id") == canon["node"], "left").select(
        "series_id", "slug", "parent_id", F.coalesce("target", "series_id").alias("at"))
    canon_of = ids.select(F.col("series_id").alias("parent_id"), F.col("at").alias("up"))
    upward = materialize(ids.join(canon_of, "parent_id").select(F.col("series_id").alias("at"), "up"))
    state = ids.select("slug", "at")
    for _ in range(MAX_PARENT_HOPS):
        state = state.join(upward, "at", "left").select("slug", F.coalesce("up", "at").alias("at"))
    return state.select("slug", F.col("at").alias("room"))


def room_tree(series: DataFrame, rooms: DataFrame, depth: int = MAX_PARENT_HOPS) -> DataFrame:
    """``(room, series_id, depth)`` of every live series nested under each room."""
    live = materialize(series.filter("merged_into IS NULL AND parent_id IS NOT NULL").select(
        F.col("parent_id").alias("at"), F.col("series_id").alias("below")))
    level = materialize(rooms.select("room", F.col("room").alias("at")))
    found = level.withColumn("depth", F.lit(0))
    for step in range(1, depth + 1):
        # Each level is written once; few rooms nest, so most tables end after the first.
        level = materialize(level.join(live, "at").select("room", F.col("below").alias("at")).distinct())
        if not level.head(1):
            break
        found = found.unionByName(level.withColumn("depth", F.lit(step)))
    return found.groupBy("room", F.col("at").alias("series_id")).agg(F.min("depth").alias("depth"))


def canonical_works(works: DataFrame) -> DataFrame:
    """``(work_id, canonical)`` one hop along ``merged_into`` when the target exists."""
    # Only tombstones are joined: the null of all other rows would be one hot key.
    dead = works.filter("merged_into IS NOT NULL").select("work_id", "merged_into")
    target = works.select(F.col("work_id").alias("canonical"))
    moved = dead.join(target, dead["merged_into"] == target["canonical"], "left").select(
        "work_id", F.coalesce("canonical", "work_id").alias("canonical"))
    return moved.union(works.filter("merged_into IS NULL").select("work_id", "work_id"))


def flatten_tombstones(works: DataFrame) -> DataFrame:
    """G08, write half: chains of ``merged_into`` shortened to one hop."""
    chains = works.filter("merged_into IS NOT NULL").select(
        F.col("work_id").alias("loser"), F.col("merged_into").alias("survivor"))
    flat = follow_aliases(chains)
    return works.drop("merged_into").join(flat, works["work_id"] == flat["loser"], "left").withColumn(
        "merged_into", F.col("survivor")).drop("loser", "survivor")
