"""Which series a work belongs to, and in which order it is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.graph import follow_aliases, resolved_redirects, room_tree
from foliant.operators.ranking import two_level_rank
from foliant.operators.resolve import _follow, metrics
from foliant.schemas import conform
from foliant.session import materialize, until_stable, written

# --- fixed values ----------------------------------------------------------------
MAX_AUTHOR_CLUSTERS = 3
IMPRINTS = (
    "Penguin Classics", "Oxford World's Classics", "Everyman's Library", "Vintage International", "Modern Library",
    "A Del Rey Book", "Signet Classics", "Bantam Classics", "Tor Essentials", "Harper Perennial Modern Classics",
)
OVERRIDE_RUNG = 0
SINGLETON_SLUG_LIMIT = 60
NO_YEAR = 9999
# -----------------------------------------------------------------------------------

CANDIDATE = ("work_id", "key", "name", "position", "rung")


def _wd(column: str) -> Column:
    return F.concat(F.lit("wd:"), F.col(column))


def kg_names(kg_series: DataFrame) -> DataFrame:
    """``(key, name)``: label, else the least alias, else the id."""
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label"))
    return kg_series.select(_wd("qid").alias("key"), F.coalesce(label, F.array_min("aliases"), "qid").alias("name"))


def rung1(work_items: DataFrame, memberships: DataFrame, kg_series: DataFrame) -> DataFrame:
    """Memberships the knowledge graph states; the first position given, items in order."""
    held = work_items.join(memberships.select("item", "series", "ordinal").distinct(), "item")
    position = T.parse_ordinal(F.col("ordinal"))
    order = F.when(position.isNotNull(), F.struct("item", "ordinal"))
    found = held.groupBy("work_id", _wd("series").alias("key")).agg(F.min_by(position, order).alias("position"))
    return found.join(kg_names(kg_series), "key", "left").select(
        "work_id", "key", F.coalesce("name", F.substring("key", 4, 1 << 30)).alias("name"), "position", F.lit(1).alias("rung"))


def tag_counts(works: DataFrame) -> DataFrame:
    """Works per series tag over the whole catalog."""
    return works.select(F.explode(T.series_tags(F.col("subjects"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def chosen_tags(works: DataFrame, counts: DataFrame) -> DataFrame:
    """``(work_id, tag)``: the least franchise, else the most carried series tag."""
    tagged = works.select("work_id", F.array_min(T.franchise_tags(F.col("subjects"))).alias("franchise"),
                          T.series_tags(F.col("subjects")).alias("tags"))
    listed = tagged.filter("franchise IS NULL").select("work_id", F.explode("tags").alias("tag")).join(counts, "tag", "left")
    by_series = listed.groupBy("work_id").agg(F.min_by("tag", F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "tag")).alias("tag"))
    return tagged.filter("franchise IS NOT NULL").select("work_id", F.col("franchise").alias("tag")).unionByName(by_series)


def rung2(works: DataFrame, counts: DataFrame) -> DataFrame:
    """L03."""
    name = T.tag_name(F.col("tag"))
    return chosen_tags(works, counts).select(
        "work_id", T.ol_key(name).alias("key"), name.alias("name"), F.lit(None).cast("double").alias("position"),
        F.lit(2).alias("rung")).filter("key IS NOT NULL")


def _references(texts: DataFrame, text: str, parse: Callable[[Column], Column]) -> DataFrame:
    """``(text, key, name, position)`` of the texts that name a series; each distinct text is parsed once.

    The references are written before unusable ones are left out: as a condition on the text, the parsing would be
    moved below the ``distinct`` and over to the other side of the join, and be done again for each line.
    """
    parsed = texts.select(text).distinct().select(text, parse(F.col(text)).alias("ref"))
    keyed = parsed.select(text, T.ol_key(F.col("ref.name")).alias("key"), "ref.name", "ref.position")
    return written(keyed).filter("key IS NOT NULL")


def _vote(refs: DataFrame, rung: int) -> DataFrame:
    """Majority over ``(work_id, voter, idx, key, name, position)``: one vote per voter and series, name and position voted inside the winner.

    References are dealt by work once; all counts are taken inside a work.
    """
    ballots = refs.select("work_id", "voter", "idx", "key", "name", "position").repartition("work_id").groupBy("work_id", "voter", "key").agg(
        F.min(F.struct("idx", "name", "position")).alias("b"))
    counted = materialize(ballots.groupBy("work_id", "key", F.col("b.name").alias("name"), F.col("b.position").alias("position")).agg(
        F.count("*").alias("n")))
    names = counted.groupBy("work_id", "key", "name").agg(F.sum("n").alias("n")).groupBy("work_id", "key").agg(
        F.sum("n").alias("votes"), F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("name"))
    positions = counted.filter("position IS NOT NULL").groupBy("work_id", "key", "position").agg(F.sum("n").alias("n")).groupBy(
        "work_id", "key").agg(F.min_by("position", F.struct((-F.col("n")).alias("n"), "position")).alias("position"))
    best = names.groupBy("work_id").agg(F.min_by(F.struct("key", "name"), F.struct((-F.col("votes")).alias("v"), "key")).alias("w")).select(
        "work_id", "w.key", "w.name")
    return best.join(positions, ["work_id", "key"], "left").select("work_id", "key", "name", "position", F.lit(rung).alias("rung"))


def rung3(edition_series: DataFrame) -> DataFrame:
    """``edition_series(work_id, edition_id, series[])``. Each distinct text is parsed once."""
    lines = written(edition_series.select("work_id", F.col("edition_id").alias("voter"), F.posexplode("series").alias("idx", "raw")))
    return _vote(lines.join(_references(lines, "raw", T.parse_series_string), "raw"), 3)


def rung4(titles: DataFrame) -> DataFrame:
    """``titles(work_id, voter, title)``: the work's raw title and its editions' titles."""
    lines = written(titles.select("work_id", "voter", "title"))
    return _vote(lines.join(_references(lines, "title", T.parse_title_series), "title").withColumn("idx", F.lit(0)), 4)


def candidates(*rungs: DataFrame) -> DataFrame:
    """L06."""
    result = rungs[0].select(*CANDIDATE)
    for rung in rungs[1:]:
        result = result.unionByName(rung.select(*CANDIDATE))
    return result


def series_names(cands: DataFrame, kg_series: DataFrame) -> DataFrame:
    """The most frequent written name per key, the graph's own names for its series."""
    counted = cands.filter("rung > 1").groupBy("key", "name").agg(F.count("*").alias("n"))
    written = counted.groupBy("key").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "name")).alias("name"))
    stated = kg_names(kg_series)
    return written.join(stated.select("key"), "key", "left_anti").unionByName(stated)


def blocked_keys(cands: DataFrame, imprints: tuple[str, ...] = IMPRINTS, rejects: DataFrame | None = None) -> DataFrame:
    names = cands.sparkSession.createDataFrame([(n,) for n in imprints], "name string")
    keys = names.select(T.ol_key(F.col("name")).alias("key"))
    return keys if rejects is None else keys.unionByName(rejects.select("key")).distinct()


def imprint_rejections(cands: DataFrame, authors: DataFrame, blocked: DataFrame) -> DataFrame:
    """``(key, author_clusters)`` of publisher lines: many authors with none holding half, or a blocked name."""
    held = cands.filter("rung > 1").join(authors.filter("author IS NOT NULL"), "work_id").groupBy("key", "author").agg(F.count("*").alias("n"))
    per_key = held.groupBy("key").agg(F.count("*").alias("authors"), F.max("n").alias("most"), F.sum("n").alias("total"))
    marked = per_key.join(blocked.select("key").distinct().withColumn("blocked", F.lit(True)), "key", "left")
    return marked.filter((F.col("blocked")) | ((F.col("authors") > MAX_AUTHOR_CLUSTERS) & (2 * F.col("most") < F.col("total")))).select(
        "key", F.col("authors").cast("int").alias("author_clusters"))


def fold_series(cands: DataFrame, kg_series: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(key, target)``.

    A key folds into the graph series of its name, else into the stronger series at least half of its carriers hold,
    judged in sorted key order: a key sees the folds of smaller keys only. Rounds that respect this order reach the
    sequential answer and stop when nothing changes. Works that carry the same evidence are counted once per round.
    """
    names = kg_series.select(_wd("qid").alias("target"), F.explode(F.concat(
        F.array("label"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name")).filter("name <> ''").select(
        "target", T.ol_key(F.col("name")).alias("key")).distinct()
    members = cands.filter("rung = 1").groupBy(F.col("key").alias("target")).agg(F.count("*").alias("n"))
    weak = cands.filter("rung > 1").join(rejected.select("key"), "key", "left_anti").select("work_id", "key", "rung")
    keys = weak.select("key").distinct()
    by_name = materialize(names.join(keys, "key", "left_semi").join(members, "target", "left").groupBy("key").agg(
        F.min_by("target", F.struct((-F.coalesce("n", F.lit(0))).alias("n"), "target")).alias("target")))
    open_rows = weak.join(by_name, "key", "left_anti")
    strong = cands.join(rejected.select("key"), "key", "left_anti").select(
        "work_id", F.col("key").alias("other"), F.col("rung").alias("other_rung"))
    held = open_rows.join(strong, "work_id").filter("other_rung < rung").groupBy("work_id", "key", "rung").agg(
        F.array_sort(F.collect_set("other")).alias("others"))
    carriers = open_rows.groupBy("key").agg(F.count("*").alias("carriers"))
    patterns = materialize(held.groupBy("key", "others").agg(F.count("*").alias("n")))
    spread = patterns.select("key", "others", "n", F.explode("others").alias("other"))

    def step(state: DataFrame) -> DataFrame:
        seen = state.select(F.col("key").alias("other"), "target", "named")
        visible = spread.join(seen, "other", "left").select(
            "key", "others", "n", F.when(F.col("named") | (F.col("other") < F.col("key")), F.col("target")).alias("moved"), "other")
        votes = visible.select("key", "others", "n", F.coalesce("moved", "other").alias("target")).filter("target <> key").distinct().groupBy(
            "key", "target").agg(F.sum("n").alias("n"))
        best = votes.groupBy("key").agg(F.min_by(F.struct("target", "n"), F.struct((-F.col("n")).alias("n"), "target")).alias("b"))
        folded = best.join(carriers, "key").filter("2 * b.n >= carriers").select("key", "b.target", F.lit(False).alias("named"))
        return state.filter("named").unionByName(folded)

    settled = until_stable(by_name.withColumn("named", F.lit(True)), step, lambda old, new: new.join(
        old, ["key", "target"], "left_anti").select("key").union(old.join(new, ["key", "target"], "left_anti").select("key")))
    ends = follow_aliases(settled.select(F.col("key").alias("loser"), F.col("target").alias("survivor")))
    return ends.select(F.col("loser").alias("key"), F.col("survivor").alias("target"))


def choose_memberships(cands: DataFrame, fold: DataFrame, rejected: DataFrame, kinds: DataFrame) -> DataFrame:
    """``(work_id, key, position, rung)``: every rung-1 series, else the single best rung."""
    kept = cands.join(rejected.select("key"), "key", "left_anti").join(fold, "key", "left").join(kinds, "work_id", "left").select(
        "work_id", F.coalesce("target", "key").alias("key"), F.when(F.coalesce("kind", F.lit("single")) != "collection", F.col("position")).alias("position"), "rung")
    per_key = kept.groupBy("work_id", "key").agg(
        F.min("rung").alias("rung"), F.min_by("position", F.when(F.col("position").isNotNull(), F.col("rung"))).alias("position"))
    best = kept.groupBy("work_id").agg(F.min("rung").alias("rung"))
    return per_key.join(best, ["work_id", "rung"], "left_semi").select("work_id", "key", "position", "rung")


def drop_adaptations(memberships: DataFrame, authors: DataFrame) -> DataFrame:
    """Below rung 1 only works of the series' dominant author stay; a series without known authors is left alone."""
    placed = memberships.join(authors, "work_id", "left")
    counted = placed.filter("author IS NOT NULL").groupBy("key", "author").agg(F.count("*").alias("n"))
    dominant = counted.groupBy("key").agg(F.min_by("author", F.struct((-F.col("n")).alias("n"), "author")).alias("dominant"))
    return placed.join(dominant, "key", "left").filter(
        "rung = 1 OR dominant IS NULL OR coalesce(author = dominant, false)").select("work_id", "key", "position", "rung")


def drop_lonely(memberships: DataFrame) -> DataFrame:
    """A title pattern on one book alone stands up no series."""
    lonely = memberships.groupBy("key").agg(F.count("*").alias("n"), F.min("rung").alias("r")).filter("n = 1 AND r = 4")
    return memberships.join(lonely.select("key"), "key", "left_anti").select("work_id", "key", "position", "rung")


def decided_by(works: DataFrame, memberships: DataFrame) -> DataFrame:
    """The winning rung of every work; null is a singleton."""
    best = memberships.groupBy("work_id").agg(F.min("rung").cast("int").alias("rung"))
    return works.select("work_id").join(best, "work_id", "left")


def known_series(cands: DataFrame, fold: DataFrame, kg_series: DataFrame) -> DataFrame:
    return cands.select("key").union(fold.select("target")).union(kg_series.select(_wd("qid"))).distinct()


def apply_series_overrides(ops: DataFrame, memberships: DataFrame, names: DataFrame, decided: DataFrame, known: DataFrame,
                           aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated ``ops(seq, kind, work_id, key, position, name)`` in order; ``(memberships, names, decided)``.

    Per (work, series) the last set or remove stands, so no replay is needed.
    """
    placed = ops.filter("kind IN ('set_series', 'remove_from_series')")
    if aliases is not None:
        placed = _follow(placed, "work_id", aliases)
    last = placed.groupBy("work_id", "key").agg(F.max(F.struct("seq", "kind", "position")).alias("last"))
    kept = memberships.join(last, ["work_id", "key"], "left_anti")
    added = last.filter("last.kind = 'set_series'").select("work_id", "key", F.col("last.position").alias("position"), F.lit(OVERRIDE_RUNG).alias("rung"))
    result = kept.select("work_id", "key", "position", "rung").unionByName(added)
    touched = placed.groupBy("work_id").agg(F.bool_or(F.col("kind") == "set_series").alias("was_set"))
    filled = result.select("work_id").distinct().withColumn("filled", F.lit(True))
    rung = F.when(F.col("was_set").isNull(), F.col("rung")).when(F.col("filled").isNull(), None).when(
        F.col("was_set"), F.lit(OVERRIDE_RUNG)).otherwise(F.col("rung"))
    now = decided.join(touched, "work_id", "left").join(filled, "work_id", "left").select("work_id", rung.cast("int").alias("rung"))
    made = ops.filter("kind = 'set_series' AND name <> ''").join(known.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by("name", "seq").alias("made"))
    renamed = ops.filter("kind = 'rename_series' AND name <> ''").groupBy("key").agg(F.max_by("name", "seq").alias("renamed"))
    labels = names.join(made, "key", "full").join(renamed, "key", "full").select("key", F.coalesce("renamed", "made", "name").alias("name"))
    return result, labels, now


def series_rows(memberships: DataFrame, rooms: DataFrame, series_parents: DataFrame, names: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(series(key, name, source, provenance, kind, parent_key), rooms(work_id, room))``; every work gets a room."""
    real = memberships.filter("rung > 0").groupBy("key").agg(F.min("rung").alias("rung"))
    graph = F.col("key").startswith("wd:")
    proper = series_parents.join(real, "key", "left").join(names, "key", "left").select(
        "key", F.coalesce("name", "key").alias("name"), F.when(graph, "wikidata").otherwise("openlibrary").alias("source"),
        F.when(graph, "wikidata").otherwise(F.coalesce(T.provenance_label(F.col("rung")), F.lit("override"))).alias("provenance"),
        F.lit("series").alias("kind"), F.col("parent").alias("parent_key"))
    alone = works.join(rooms, "work_id", "left_anti").withColumn("room", F.concat(F.lit("single:"), F.col("work_id")))
    singles = alone.select(F.col("room").alias("key"), F.col("title").alias("name"), F.lit("heuristic").alias("source"),
                           F.lit("single").alias("provenance"), F.lit("singleton").alias("kind"), F.lit(None).cast("string").alias("parent_key"))
    return proper.unionByName(singles), rooms.select("work_id", "room").unionByName(alone.select("work_id", "room"))


def assign_slugs(rows: DataFrame, max_length: int = T.SLUG_LIMIT) -> DataFrame:
    """``rows(identity, name)`` to ``(identity, slug)``.

    The first identity of a base keeps it; the k-th further one takes the k-th number from 2 on that is not
    itself some other name's base. With the taken numbers e1 < e2 < ..., that number is k + 1 plus the
    count of e_i with e_i - i <= k, so no identity waits for another.
    """
    based = rows.select("identity", T.slugify(F.col("name"), max_length).alias("base"))
    ranked = two_level_rank(based, ["base"], F.substring("identity", 1, 18), ["identity"], "r")
    extra = ranked.groupBy("base").agg(F.max("r").alias("size")).filter("size > 1")
    pattern = "^(.*)-([1-9][0-9]{0,17})$"
    numbered = based.select("base").distinct().select(
        F.regexp_extract("base", pattern, 1).alias("stem"), F.regexp_extract("base", pattern, 2).try_cast("long").alias("n")).filter("n >= 2")
    near = numbered.join(extra.withColumnRenamed("base", "stem"), "stem")
    placed = two_level_rank(near, ["stem"], F.floor(F.col("n") / 1000), ["n"], "i").withColumn("shift", F.col("n") - F.col("i"))
    # Taken numbers and identities of a base in one order: how many shifts are at most k is a running count,
    # taken within slices of k and carried over by the slices' sums.
    taken = placed.filter("shift <= size").select(F.col("stem").alias("base"), F.col("shift").alias("k"), F.lit(0).alias("mine"), F.lit(None).cast("string").alias("identity"))
    asking = ranked.join(taken.select("base").distinct(), "base", "left_semi").select("base", (F.col("r") - 1).cast("bigint").alias("k"), F.lit(1).alias("mine"), "identity")
    both = materialize(taken.select("base", "k", "mine", "identity").unionByName(asking).withColumn("slice", F.floor(F.col("k") / 4096)))
    per_slice = both.groupBy("base", "slice").agg(F.count_if(F.col("mine") == 0).alias("n"))
    before = per_slice.select("base", "slice", F.coalesce(F.sum("n").over(W.partitionBy("base").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    running = F.count_if(F.col("mine") == 0).over(W.partitionBy("base", "slice").orderBy("k", "mine").rowsBetween(W.unboundedPreceding, 0))
    shifted = both.withColumn("within", running).filter("mine = 1").join(before, ["base", "slice"]).select(
        "base", "identity", (F.col("within") + F.col("before")).alias("skipped"))
    number = F.col("r") + F.coalesce("skipped", F.lit(0))
    return ranked.join(shifted, ["base", "identity"], "left").select(
        "identity", F.when(F.col("r") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", number.cast("string"))).alias("slug"))


def alias_table(aliases: DataFrame, redirect_aliases: DataFrame, final: DataFrame) -> DataFrame:
    """Merge losers, and redirects whose survivor exists and whose old id is gone."""
    moved = _follow(redirect_aliases.select(F.col("from_ol").alias("ol_id"), F.col("to_ol").alias("work_id")), "work_id", aliases)
    usable = moved.join(final.select("work_id"), "work_id", "left_semi").join(
        final.select(F.col("work_id").alias("ol_id")), "ol_id", "left_anti").select("ol_id", "work_id")
    merged = aliases.select(F.col("loser").alias("ol_id"), F.col("survivor").alias("work_id"))
    return usable.unionByName(merged.join(usable.select("ol_id"), "ol_id", "left_anti"))


def build_release(g: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The five contract tables from the group tables."""
    works, editions, series, members, aliases = (g[n] for n in ("works", "editions", "series", "members", "aliases"))
    slugs = assign_slugs(series.select(F.concat(F.lit("series:"), F.col("key")).alias("identity"), "name"))
    author = works.select("work_id", T.clip_text(F.col("author")).alias("author"))
    tables = {
        "works": works.select(
            T.work_row_id(F.col("work_id")).alias("id"), F.col("work_id").alias("ol_work_id"), "canonical_key",
            T.clip_text(F.col("title")).alias("title"), T.clip_text(F.col("subtitle")).alias("subtitle"), T.clip_text(F.col("author")).alias("author"),
            "first_publish_year", "kind", T.series_row_id(F.col("room")).alias("series_id"), F.col("cover_id").alias("ol_cover_id"),
            F.col("edition_count").alias("ol_edition_count"), "readinglog_count", "ratings_count", "subjects",
            T.edition_row_id(F.col("representative_edition")).alias("representative_edition_id")),
        "editions": editions.join(author, "work_id").select(
            T.edition_row_id(F.col("edition_id")).alias("id"), F.col("edition_id").alias("ol_edition_id"), T.work_row_id(F.col("work_id")).alias("work_id"),
            T.edition_title(F.col("title")).alias("title"), T.clip_text(F.col("subtitle")).alias("subtitle"), "author",
            T.clip_text(F.col("publisher")).alias("publisher"), F.col("publish_year").alias("published_year"), "isbn_13", "page_count",
            T.cover_url(F.col("cover_id")).alias("cover_url"), F.lit("en").alias("language")),
        "series": series.join(slugs, F.concat(F.lit("series:"), F.col("key")) == F.col("identity")).select(
            T.series_row_id(F.col("key")).alias("id"), "key", "source", "provenance", T.clip_text(F.col("name")).alias("name"), "slug",
            T.series_key(F.col("name")).alias("canonical_key"), "kind", T.series_row_id(F.col("parent_key")).alias("parent_series_id")),
        "series_members": members.select(
            T.series_row_id(F.col("series_key")).alias("series_id"), T.work_row_id(F.col("work_id")).alias("work_id"), "position", "provenance", "confidence"),
        "work_aliases": aliases.select(F.col("ol_id").alias("ol_work_id"), T.work_row_id(F.col("work_id")).alias("work_id")),
    }
    return {name: conform(df, name) for name, df in tables.items()}


def reading_order(members: DataFrame) -> DataFrame:
    """``members(key, work_id, position, first_publish_year, title)`` numbered per series: position, year (nulls last), title, id."""
    bucket = F.struct(F.col("position").isNull().alias("np"), F.coalesce("position", F.lit(0.0)).alias("p"),
                      F.col("first_publish_year").isNull().alias("ny"), F.coalesce("first_publish_year", F.lit(0)).alias("y"))
    return two_level_rank(members, ["key"], bucket, ["title", "work_id"])


def placed_membership(members: DataFrame, tree: DataFrame, series: DataFrame) -> DataFrame:
    """Per (room, work) the deepest membership inside the room's tree, then the greatest name."""
    inside = members.join(tree, "series_id").join(series.select("series_id", "name"), "series_id")
    return inside.groupBy("room", "work_id").agg(F.max_by(F.struct("series_id", "position", "provenance"), F.struct("depth", "name", "series_id")).alias("m")).select(
        "room", "work_id", "m.series_id", "m.position", "m.provenance")


def room_listing(works: DataFrame, members: DataFrame, series: DataFrame) -> DataFrame:
    """Every room's live books: direct ones first, sub-series by their earliest book, each in reading order."""
    live = works.filter("merged_into IS NULL").select("work_id", F.col("series_id").alias("room"), "title", "first_publish_year")
    tree = room_tree(series, live.select("room").distinct())
    placed = placed_membership(members, tree, series).withColumnRenamed("series_id", "member_series")
    listed = live.join(placed, ["room", "work_id"], "left").join(
        series.select(F.col("series_id").alias("member_series"), F.col("name").alias("sub_name")), "member_series", "left")
    sub = F.when(F.col("member_series") != F.col("room"), F.col("member_series"))
    listed = listed.withColumn("subseries_id", sub).withColumn("subseries", F.when(sub.isNotNull(), F.col("sub_name")))
    earliest = listed.filter("subseries_id IS NOT NULL").groupBy("room", "subseries_id").agg(
        F.min(F.least(F.coalesce("first_publish_year", F.lit(NO_YEAR)), F.lit(NO_YEAR))).alias("earliest"))
    joined = listed.join(earliest, ["room", "subseries_id"], "left")
    bucket = F.struct(
        F.col("subseries_id").isNotNull().alias("sub"), F.coalesce("earliest", F.lit(0)).alias("e"), F.coalesce("subseries", F.lit("")).alias("n"),
        F.col("position").isNull().alias("np"), F.coalesce("position", F.lit(0.0)).alias("p"),
        F.col("first_publish_year").isNull().alias("ny"), F.coalesce("first_publish_year", F.lit(0)).alias("y"))
    return two_level_rank(joined, ["room"], bucket, ["title", "work_id"]).select(
        "room", "rank", "work_id", "title", "position", "subseries", "provenance")


def assign_tag_series(works: DataFrame, series: DataFrame, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(assignments(work_id, series_id, action, from_series), new_series)`` of live works.

    ``series(series_id, source, external_id, kind, catalog_release, dissolved, merged_into)``, ``placed(work_id)`` by a librarian.
    Tags are counted with case and ``_`` ignored. New rooms and singletons get ids derived from their keys.
    """
    live = works.filter("merged_into IS NULL")
    spelled = live.select("work_id", F.explode(T.series_tags(F.col("subjects"))).alias("tag"))
    folded = F.lower("tag")
    per_fold = spelled.select("work_id", folded.alias("folded")).distinct().groupBy("folded").agg(F.count("*").alias("n"))
    counts = spelled.select("tag", folded.alias("folded")).distinct().join(per_fold, "folded").select("tag", "n")
    wanted = chosen_tags(live, counts).select("work_id", "tag", T.tag_external_id(F.col("tag")).alias("external_id"))
    dead = series.filter("merged_into IS NOT NULL").select(F.col("series_id").alias("from_ol"), F.col("merged_into").alias("to_ol"))
    ends = resolved_redirects(dead, 10)
    tagged = series.filter("source = 'openlibrary'").select("external_id", F.col("series_id").alias("hit")).join(
        ends, F.col("hit") == F.col("from_ol"), "left").select("external_id", F.coalesce("resolved", "hit").alias("target")).join(
        series.select(F.col("series_id").alias("target"), F.col("dissolved").alias("target_dissolved")), "target")
    now = series.select("series_id", F.col("kind").alias("now_kind"), F.col("catalog_release").alias("now_release"))
    joined = (
        live.select("work_id", "series_id", "title").join(now, "series_id", "left").join(wanted, "work_id", "left").join(tagged, "external_id", "left")
        .join(placed.select("work_id").distinct().withColumn("placed", F.lit(True)), "work_id", "left"))
    target = F.when(F.col("external_id").isNotNull() & ~F.coalesce("target_dissolved", F.lit(False)),
                    F.coalesce("target", T.series_row_id(F.col("external_id"))))
    current = F.col("series_id").isNotNull()
    fixed = current & (F.col("now_release").isNotNull() | F.coalesce("placed", F.lit(False)))
    action = (
        F.when(fixed, "keep").when(F.col("goal").isNull(), F.when(current, "keep").otherwise("singleton")).when(~current, "assign")
        .when((F.col("series_id") == F.col("goal")) | (F.col("now_kind") == "series"), "keep").otherwise("promote"))
    decided = materialize(joined.withColumn("goal", target).withColumn("action", action))
    single = T.series_row_id(F.concat(F.lit("singleton:"), F.col("work_id")))
    assignments = decided.select(
        "work_id", F.when(F.col("action") == "keep", F.col("series_id")).when(F.col("action") == "singleton", single).otherwise(F.col("goal")).alias("series_id"),
        "action", F.col("series_id").alias("from_series"))
    fresh = decided.filter("action IN ('assign', 'promote') AND target IS NULL").groupBy(F.col("goal").alias("series_id")).agg(
        F.min("external_id").alias("external_id"), F.min(T.tag_name(F.col("tag"))).alias("name")).select(
        "series_id", "external_id", "name", F.lit("openlibrary").alias("source"), F.lit("series").alias("kind"), F.lit("ol_tag").alias("provenance"))
    singles = decided.filter("action = 'singleton'").select(
        single.alias("series_id"), F.concat(F.lit("singleton:"), F.col("work_id")).alias("external_id"), F.col("title").alias("name"),
        F.lit("heuristic").alias("source"), F.lit("singleton").alias("kind"), F.lit("single").alias("provenance"))
    return assignments, fresh.unionByName(singles)


def promote_singletons(promotions: DataFrame, threads: DataFrame, works: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``promotions(work_id, singleton, target)``; ``(threads, works, series)`` with the room's content moved and the room tombstoned."""
    move = promotions.groupBy(F.col("singleton").alias("series_id")).agg(F.min_by("target", "work_id").alias("target"), F.min("work_id").alias("book"))
    moved_threads = threads.join(move, "series_id", "left").withColumn("work_id", F.coalesce("work_id", "book")).withColumn(
        "series_id", F.coalesce("target", "series_id")).select(*threads.columns)
    moved_works = works.join(move, "series_id", "left").withColumn("series_id", F.coalesce("target", "series_id")).select(*works.columns)
    buried = series.join(move, "series_id", "left").withColumn("merged_into", F.coalesce("target", "merged_into")).select(*series.columns)
    return moved_threads, moved_works, buried


def backfill_rooms(works: DataFrame, series: DataFrame, placed: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rooms for all live works, tombstones inherit, homeless tagged threads follow; ``(works, threads, stats)``."""
    assignments, fresh = assign_tag_series(works, series, placed)
    promotions = assignments.filter("action = 'promote'").select(
        "work_id", F.col("from_series").alias("singleton"), F.col("series_id").alias("target"))
    moved_threads, moved_works, _ = promote_singletons(promotions, threads, works, series)
    kinds = series.select("series_id", "kind").unionByName(fresh.select("series_id", "kind")).groupBy("series_id").agg(F.min("kind").alias("kind"))
    live = works.filter("merged_into IS NULL").drop("series_id").join(assignments.select("work_id", "series_id"), "work_id").select(*works.columns)
    heir = live.select(F.col("work_id").alias("merged_into"), F.col("series_id").alias("heir_room"))
    inherited = moved_works.filter("merged_into IS NOT NULL").join(heir, "merged_into", "left").withColumn(
        "was_empty", F.col("series_id").isNull()).withColumn("series_id", F.coalesce("series_id", "heir_room"))
    inherited = materialize(inherited)
    all_works = materialize(live.unionByName(inherited.select(*works.columns)))
    room = all_works.select("work_id", F.col("series_id").alias("room"))
    followed = moved_threads.join(room, "work_id", "left").withColumn(
        "follows", F.col("series_id").isNull() & F.col("work_id").isNotNull()).withColumn("series_id", F.coalesce("series_id", "room"))
    followed = materialize(followed)
    stats = (
        metrics(assignments.join(kinds, "series_id", "left"), series=F.count_if(F.col("kind") == "series"), singletons=F.count_if(F.col("kind") != "series"))
        .unionByName(metrics(inherited, tombstones=F.count_if("was_empty")))
        .unionByName(metrics(followed, threads=F.count_if("follows"), orphans=F.count_if(F.col("series_id").isNull() & F.col("genre_id").isNull()))))
    return all_works, followed.select(*threads.columns), stats
