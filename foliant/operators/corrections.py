"""The log of catalog corrections and what its operations do.

An operation table is applied to a snapshot as a whole. Where several
operations of one batch name the same book, each sees what the one before it
left: a window over the book's accepted operations gives the room before every
move, so their number changes no plan. Whether a target is there, and whether a
room is left empty, is asked of the whole batch. ``fixes`` writes the log rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.graph import follow_aliases, room_tree
from foliant.operators.load import Tables, _first_free, retire_into
from foliant.operators.resolve import edition_rank
from foliant.session import materialize, written

# --- fixed values ----------------------------------------------------------------
SERIES_SUBJECT_OPS = ("rename_series", "reject_series")
GENRE_SUBJECT_OPS = ("veto_genre",)
UNDOABLE = ("set_series", "set_position", "rename_series", "remove_from_series", "reject_series", "veto_genre")
OVERRIDE, HIGH = "override", "high"
# -----------------------------------------------------------------------------------


def subject_key() -> Column:
    """What a fix is about: the series for a rename or dissolve, (book, genre) for a veto, else the book."""
    op = F.col("op")
    return F.when(op.isin(*SERIES_SUBJECT_OPS), F.concat(F.lit("series/"), F.col("series_id").cast("string"))).when(
        op.isin(*GENRE_SUBJECT_OPS), F.concat_ws("/", F.lit("veto"), F.col("work_id"), F.col("genre_id").cast("string"))).otherwise(
        F.concat(F.lit("work/"), F.col("work_id")))


def latest_per_subject(log: DataFrame) -> DataFrame:
    """The newest unreverted fix of every subject, by a combined aggregation."""
    live = log.filter("NOT reverted").withColumn("subject", subject_key()).filter("subject IS NOT NULL")
    return live.groupBy("subject").agg(F.max(F.struct("created_at", "correction_id")).alias("m")).select("subject", F.col("m.correction_id").alias("correction_id"))


def undoable(log: DataFrame, works: DataFrame, series: DataFrame) -> DataFrame:
    """Ids of the fixes an undo may be offered for."""
    latest = log.join(latest_per_subject(log).select("correction_id"), "correction_id", "left_semi").filter(F.col("op").isin(*UNDOABLE))
    about_series = latest.filter(F.col("op").isin(*SERIES_SUBJECT_OPS)).join(series.filter("merged_into IS NULL").select("series_id"), "series_id", "left_semi")
    about_work = latest.filter(~F.col("op").isin(*SERIES_SUBJECT_OPS)).join(works.filter("merged_into IS NULL").select("work_id"), "work_id", "left_semi")
    return about_series.select("correction_id").union(about_work.select("correction_id"))


def corrections_listing(log: DataFrame, works: DataFrame, series: DataFrame, users: DataFrame, runtime_only: bool | None = None, work=None,
                        series_id=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the log, newest first, with subject, room and the undo flag."""
    rows = log
    if runtime_only is not None:
        rows = rows.filter(~F.col("exportable") if runtime_only else F.col("exportable"))
    if work is not None:
        rows = rows.filter(F.col("work_id") == work)
    if series_id is not None:
        rows = rows.filter(F.col("series_id") == series_id)
    page = rows.orderBy(F.desc("created_at"), F.desc("correction_id")).offset(offset).limit(limit)
    live = works.select("work_id", F.coalesce("merged_into", "work_id").alias("live_id"))
    shown = works.select(F.col("work_id").alias("live_id"), "title", F.col("series_id").alias("work_room"))
    room = series.select(F.col("series_id").alias("work_room"), F.col("slug").alias("work_slug"))
    own = series.select("series_id", "name", F.col("slug").alias("series_slug"))
    offered = undoable(log, works, series).withColumn("can_undo", F.lit(True))
    joined = (
        page.join(users.select("user_id", "username"), "user_id", "left").join(live, "work_id", "left").join(shown, "live_id", "left").join(room, "work_room", "left")
        .join(own, "series_id", "left").join(offered, "correction_id", "left"))
    return joined.select("correction_id", "op", F.col("username").alias("user"), "exportable", "reverted", F.coalesce("can_undo", F.lit(False)).alias("undoable"),
                         F.coalesce("title", "name").alias("subject"), F.coalesce("work_slug", "series_slug").alias("room_slug"))


def series_key_of() -> Column:
    """A series' override key; a single book's page has none."""
    return F.when(F.col("kind") == "singleton", None).when(F.col("series_external").rlike("^(wd|ol):"), F.col("series_external")).otherwise(
        F.concat(F.lit("ol:"), F.col("series_canonical")))


def export_entries(log: DataFrame, works: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries(seq keys, kind, work_key, series_key, name, position), runtime_only(correction_id, reason))``.

    ``log`` holds unexported payloads: op, work_id, series_id, name, position. The first missing key is the reason.
    """
    w = works.select("work_id", F.col("source").alias("work_source"), F.col("external_id").alias("work_external"), F.col("title").alias("work_title"))
    s = series.select("series_id", "kind", F.col("external_id").alias("series_external"), F.col("canonical_key").alias("series_canonical"),
                      F.col("name").alias("series_name"), "catalog_release")
    rows = log.filter("NOT reverted").join(w, "work_id", "left").join(s, "series_id", "left").withColumn("series_key", series_key_of())
    rows = rows.withColumn("work_key", F.when(F.col("work_source") == "openlibrary", F.col("work_external")))
    needs_work = F.col("op").isin("set_series", "set_position", "remove_from_series", "merge_works")
    needs_series = F.col("op").isin("set_series", "set_position", "remove_from_series", "rename_series", "reject_series")
    needs_release = F.col("op").isin("rename_series", "reject_series", "remove_from_series")
    reason = (
        F.when(F.col("op") == "veto_genre", "the pipeline has no genre overrides")
        .when(needs_work & F.col("work_key").isNull(), F.concat(F.col("work_title"), F.lit(" has no Open Library id (heuristic work)")))
        .when(needs_release & F.col("catalog_release").isNull(), F.concat(F.col("series_name"), F.lit(" is not in a catalog release")))
        .when(needs_series & F.col("series_key").isNull(), F.concat(F.col("series_name"), F.lit(" is a single book's page, not a series"))))
    judged = rows.withColumn("reason", reason)
    kind = F.when(F.col("op") == "set_position", "set_series").otherwise(F.col("op"))
    name = F.when(F.col("op") == "rename_series", F.col("name")).when(
        F.col("op").isin("set_series", "set_position") & F.col("catalog_release").isNull(), F.col("series_name"))
    position = F.when(F.col("op").isin("set_series", "set_position"), F.col("position"))
    entries = judged.filter("reason IS NULL").select(
        "created_at", "correction_id", kind.alias("kind"), F.when(needs_work, F.col("work_key")).alias("work_key"),
        F.when(needs_series, F.col("series_key")).alias("series_key"), name.alias("name"), position.alias("position"))
    return entries, judged.filter("reason IS NOT NULL").select("correction_id", "reason")


_ENTRIES = "array<struct<set_series:struct<work:string,series:string>>>"


def exported_memberships(log: DataFrame) -> DataFrame:
    """(work key, series key) pairs unreverted exported fixes placed; ``log(override json, reverted)``."""
    entries = log.filter("NOT reverted AND override IS NOT NULL").select(F.explode(F.from_json("override", _ENTRIES)).alias("e"))
    return entries.filter("e.set_series IS NOT NULL").select(
        F.col("e.set_series.work").alias("work_key"), F.col("e.set_series.series").alias("series_key")).distinct()


def edition_listing(editions: DataFrame, work) -> DataFrame:
    """R13."""
    return editions.filter(F.col("work_id") == work).orderBy(F.asc_nulls_last("publish_year"), "title", "edition_id")


def apply_vetoes(log: DataFrame, works: DataFrame, genres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``log(correction_id, created_at, work_id, genre_id, reverted)``; ``(live vetoes, refusals)``.

    The first unreverted veto per (book, genre) holds; a later one is refused.
    """
    facts = log.join(works.select("work_id", F.lit(True).alias("known"), F.col("merged_into").isNotNull().alias("merged")), "work_id", "left").join(
        genres.select("genre_id", "retired"), "genre_id", "left")
    early = F.when(F.col("known").isNull(), "unknown_work").when(F.col("merged"), "merged").when(F.coalesce("retired", F.lit(True)), "retired_genre")
    judged = facts.withColumn("reason", early)
    fine = judged.filter("reason IS NULL AND NOT reverted")
    first = fine.groupBy("work_id", "genre_id").agg(F.min(F.struct("created_at", "correction_id")).alias("m")).select(
        "work_id", "genre_id", F.col("m.correction_id").alias("correction_id"))
    again = fine.select("correction_id").join(first, "correction_id", "left_anti").withColumn("reason", F.lit("already_vetoed"))
    return first, judged.filter("reason IS NOT NULL").select("correction_id", "reason").unionByName(again)


def apply_rename(ops: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ops(op_id, series_id, name)`` in order; the slug never changes.

    A refused repeat equals the name before it, so the previous usable name in the log is always the current one.
    """
    facts = ops.join(series.select("series_id", F.col("name").alias("start"), "kind", "merged_into", "dissolved"), "series_id", "left").withColumn(
        "name", T.collapse_edges(F.coalesce("name", F.lit(""))))
    early = (
        F.when(F.col("kind").isNull(), "unknown").when(F.col("merged_into").isNotNull(), "merged").when(F.col("kind") == "singleton", "singleton")
        .when(F.col("dissolved"), "dissolved").when(F.col("name") == "", "empty"))
    judged = facts.withColumn("reason", early)
    order = W.partitionBy("series_id").orderBy("op_id")
    usable = judged.filter("reason IS NULL").withColumn("now", F.coalesce(F.lag("name").over(order), "start"))
    same = usable.filter("name = now").select("op_id", F.lit("same").alias("reason"))
    last = usable.groupBy("series_id").agg(F.max_by("name", "op_id").alias("new_name"))
    renamed = series.join(last, "series_id", "left").withColumn("name", F.coalesce("new_name", "name")).select(*series.columns)
    return renamed, judged.filter("reason IS NOT NULL").select("op_id", "reason").unionByName(same)


def _tree_members(tables: Tables, at: DataFrame) -> DataFrame:
    """Memberships of ``at(work_id, room)`` inside the room's tree."""
    tree = room_tree(tables["series"], at.select("room").distinct())
    return at.join(tree, "room").join(tables["members"], ["work_id", "series_id"]).select("work_id", "room", "series_id", "depth", "position", "provenance", "confidence")


def _named_targets(ops: DataFrame, series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of ops that name a series: by release id, by name, else new; ``(ops with target, new series)``."""
    key = T.series_key(F.col("new_name"))
    named = ops.filter("series_id IS NULL").withColumn("name_key", key).withColumn("rid", T.series_row_id(F.concat(F.lit("ol:"), key)))
    own = series.select(F.col("series_id").alias("rid"), F.coalesce("merged_into", "series_id").alias("own_target"),
                        (F.col("merged_into").isNotNull() & (F.col("provenance") == OVERRIDE)).alias("revive"))
    same = series.filter("kind = 'series' AND merged_into IS NULL AND parent_id IS NULL AND NOT dissolved").groupBy(F.col("canonical_key").alias("name_key")).agg(
        F.min(F.struct(F.col("catalog_release").isNull().alias("runtime"), "series_id")).alias("s")).select("name_key", F.col("s.series_id").alias("by_name"))
    found = named.join(own, "rid", "left").join(same, "name_key", "left").withColumn(
        "target", F.when(F.col("revive"), F.col("rid")).otherwise(F.coalesce("own_target", "by_name", "rid")))
    fresh = found.filter("name_key <> '' AND (revive OR (own_target IS NULL AND by_name IS NULL))").groupBy(F.col("rid").alias("series_id")).agg(
        F.min_by("new_name", "op_id").alias("name"), F.min("name_key").alias("canonical_key"), F.max("revive").alias("revive"))
    return found.drop("rid", "own_target", "by_name", "revive"), fresh


def _add_series(tables: Tables, fresh: DataFrame) -> Tables:
    series = tables["series"]
    revived = fresh.filter("coalesce(revive, false)").select("series_id", F.col("name").alias("r_name"))
    back = series.join(revived, "series_id", "left").withColumn("merged_into", F.when(F.col("r_name").isNull(), F.col("merged_into"))).withColumn(
        "name", F.coalesce("r_name", "name")).select(*series.columns)
    based = fresh.filter("NOT coalesce(revive, false)").withColumn("stem", T.slugify(F.col("name")))
    used = series.select(F.col("slug").alias("stem")).distinct().withColumn("used", F.lit(True))
    free = _first_free(based, series.select("slug"))
    made = {"series_id": F.col("series_id"), "source": F.lit("heuristic"), "external_id": F.concat(F.lit("ol:"), F.col("canonical_key")), "name": F.col("name"),
            "slug": F.when(F.col("used"), F.concat_ws("-", "stem", F.col("n").cast("string"))).otherwise(F.col("stem")), "canonical_key": F.col("canonical_key"),
            "kind": F.lit("series"), "provenance": F.lit(OVERRIDE), "catalog_release": F.lit(None), "merged_into": F.lit(None), "parent_id": F.lit(None), "dissolved": F.lit(False)}
    types = dict(series.dtypes)
    rows = based.join(used, "stem", "left").join(free, "stem").select(*[made[c].cast(types[c]).alias(c) for c in series.columns])
    return {**tables, "series": back.unionByName(rows)}


class Moves(NamedTuple):
    """What a batch of moves did.

    ``accepted(op_id, work_id, room, target, position, later)``: ``room`` is where the book stood before, ``later`` its next
    accepted operation. ``removed`` are memberships with the operation that took them, ``prior`` where they stood at its target.
    ``carried(op_id, thread_id, work_id)``: threads that followed the book. ``retired(op_id, room, target, survivor, book, parent)``:
    rooms left empty, with the last operation that left them. ``created(op_id, series_id)``: series an operation made or revived.
    """

    tables: Tables
    refusals: DataFrame
    accepted: DataFrame
    removed: DataFrame
    carried: DataFrame
    retired: DataFrame
    created: DataFrame
    moved: Tables


def _judged_moves(ops: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(usable(op_id, work_id, room, target, position), refusals, new series)``; ``room`` is the book's room before the operation.

    A usable operation that names the room the book is in changes nothing, so the target of the usable one before it is always
    the current room.
    """
    named, fresh = _named_targets(ops, tables["series"])
    columns = ["op_id", "work_id", "series_id", "new_name", "position", "name_key", "target"]
    given = ops.filter("series_id IS NOT NULL").withColumn("target", F.col("series_id")).withColumn("name_key", F.lit("-"))
    asked = given.select(*columns).unionByName(named.select(*columns))
    target = tables["series"].select(F.col("series_id").alias("target"), F.col("kind").alias("t_kind"), F.col("parent_id").alias("t_parent"),
                                     F.col("dissolved").alias("t_dissolved"), F.col("merged_into").alias("t_merged"))
    state = tables["works"].select("work_id", F.col("series_id").alias("start"), F.col("merged_into").alias("w_merged"), F.lit(True).alias("known"))
    reason = (
        F.when(F.col("known").isNull(), "unknown_work").when(F.col("w_merged").isNotNull(), "merged_work")
        .when(F.col("series_id").isNotNull() == F.col("new_name").isNotNull(), "pick_one").when(F.col("name_key") == "", "no_name")
        .when(F.col("series_id").isNotNull() & F.col("t_kind").isNull(), "unknown_series").when(F.col("series_id").isNotNull() & F.col("t_merged").isNotNull(), "merged_series")
        .when(F.col("t_kind") == "singleton", "singleton").when(F.col("t_parent").isNotNull(), "sub_series").when(F.col("t_dissolved"), "dissolved"))
    judged = materialize(asked.join(state, "work_id", "left").join(target, "target", "left").withColumn("reason", reason))
    order = W.partitionBy("work_id").orderBy("op_id")
    usable = judged.filter("reason IS NULL").withColumn("room", F.coalesce(F.lag("target").over(order), "start"))
    same = usable.filter("target = room").select("op_id", F.lit("same_room").alias("reason"))
    return usable.select("op_id", "work_id", "room", "target", "position"), judged.filter("reason IS NOT NULL").select("op_id", "reason").unionByName(same), fresh


def set_series_moves(ops: DataFrame, tables: Tables) -> Moves:
    """R04 with what its log needs; ``ops(op_id, work_id, series_id, new_name, position)``."""
    usable, refusals, fresh = _judged_moves(ops, tables)
    accepted = materialize(usable.filter("target <> room").withColumn("later", F.lead("op_id").over(W.partitionBy("work_id").orderBy("op_id"))))
    made = fresh.join(accepted.select(F.col("target").alias("series_id")), "series_id", "left_semi")
    created = accepted.join(made.select(F.col("series_id").alias("target")), "target").groupBy("target").agg(F.min("op_id").alias("op_id")).select(
        "op_id", F.col("target").alias("series_id"))
    result = _add_series(tables, made)
    result["series"] = materialize(result["series"])

    # The first operation that left a room, or came to one, took what was there.
    left = materialize(accepted.groupBy("work_id", "room").agg(F.min("op_id").alias("op_id")))
    inside = _tree_members(result, left.select("work_id", "room")).join(left, ["work_id", "room"]).withColumn("prior", F.lit(False))
    came = accepted.groupBy("work_id", F.col("target").alias("series_id")).agg(F.min("op_id").alias("op_id"))
    held = tables["members"].join(came, ["work_id", "series_id"]).withColumn("prior", F.lit(True))
    taken = ["series_id", "work_id", "op_id", "prior", "position", "provenance", "confidence"]
    removed = materialize(inside.select(*taken).unionByName(held.select(*taken)).groupBy("series_id", "work_id").agg(
        F.min(F.struct(*taken[2:])).alias("m")).select("series_id", "work_id", "m.*"))
    last = accepted.filter("later IS NULL")
    added = last.select(F.col("target").alias("series_id"), "work_id", "position", F.lit(OVERRIDE).alias("provenance"), F.lit(HIGH).alias("confidence"))
    result["members"] = tables["members"].join(removed, ["series_id", "work_id"], "left_anti").select(*tables["members"].columns).unionByName(
        added.select(*tables["members"].columns))

    # A thread about the book joins it at the first operation that leaves the thread's room, and follows to the end.
    joined = tables["threads"].join(left.select("work_id", F.col("room").alias("series_id"), F.col("op_id").alias("since")), ["work_id", "series_id"])
    carried = joined.select("thread_id", "work_id", "since").join(accepted.select("op_id", "work_id"), "work_id").filter("op_id >= since").select(
        "op_id", "thread_id", "work_id")
    home = last.select("work_id", F.col("target").alias("home"))
    followers = joined.select("thread_id", "work_id").join(home, "work_id").select("thread_id", "home")
    result["threads"] = tables["threads"].join(followers, "thread_id", "left").withColumn("series_id", F.coalesce("home", "series_id")).select(*tables["threads"].columns)
    result["works"] = materialize(tables["works"].join(home, "work_id", "left").withColumn("series_id", F.coalesce("home", "series_id")).select(*tables["works"].columns))

    live = result["works"].filter("merged_into IS NULL").select(F.col("series_id").alias("room"))
    leaving = accepted.groupBy("room").agg(F.max(F.struct("op_id", "target", "work_id")).alias("m"))
    kinds = result["series"].select(F.col("series_id").alias("room"), "kind", F.col("parent_id").alias("parent"))
    empty = materialize(leaving.join(live, "room", "left_anti").join(kinds, "room").select(
        "m.op_id", "room", "m.target", F.when(F.col("kind") == "singleton", F.col("m.work_id")).alias("book"), "parent"))
    # Its target may be left empty too, by a later operation each time.
    ends = follow_aliases(empty.select(F.col("room").alias("loser"), F.col("target").alias("survivor"))).select(F.col("loser").alias("room"), "survivor")
    retired = materialize(empty.join(ends, "room"))
    return Moves(retire_into(retired, result), refusals, accepted, removed, carried, retired, created, result)


def apply_set_series(ops: DataFrame, tables: Tables) -> tuple[Tables, DataFrame]:
    """``ops(op_id, work_id, series_id, new_name, position)``; move each book to the series given or named.

    Memberships in the old room's tree go, an override membership comes, tagged threads follow, an emptied room is retired.
    """
    done = set_series_moves(ops, tables)
    return done.tables, done.refusals


def placed_members(at: DataFrame, tables: Tables) -> DataFrame:
    """``(work_id, room, placed)``: the membership a room's page places the book by, for ``at(work_id, room)``."""
    named = _tree_members(tables, at).join(tables["series"].select("series_id", "name"), "series_id")
    return named.groupBy("work_id", "room").agg(
        F.max_by(F.struct("series_id", "work_id", "position", "provenance", "confidence"), F.struct("depth", "name", "series_id")).alias("placed"))


def apply_set_position(ops: DataFrame, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """``ops(op_id, work_id, series_id, position)``; ``(members, refusals)``. The last accepted op of a book stands."""
    state = tables["works"].select("work_id", F.col("series_id").alias("room"), F.col("merged_into").alias("w_merged"))
    rooms = tables["series"].select("series_id", "kind", F.col("merged_into").alias("s_merged"))
    judged = ops.join(state, "work_id", "left").join(rooms, "series_id", "left").withColumn(
        "reason", F.when(F.col("room").isNull(), "unknown_work").when(F.col("w_merged").isNotNull(), "merged_work").when(F.col("kind").isNull(), "unknown_series")
        .when(F.col("s_merged").isNotNull(), "merged_series").when(F.col("kind") == "singleton", "singleton").when(F.col("room") != F.col("series_id"), "not_in_series"))
    last = judged.filter("reason IS NULL").groupBy("work_id", F.col("series_id").alias("room")).agg(F.max(F.struct("op_id", F.col("position").alias("new_position"))).alias("m"))
    placed = placed_members(last.select("work_id", "room"), tables)
    change = last.join(placed, ["work_id", "room"], "left").select(
        "work_id", F.coalesce("placed.series_id", "room").alias("series_id"), F.col("m.new_position").alias("position"), F.lit(OVERRIDE).alias("provenance"), F.lit(HIGH).alias("confidence"))
    members = tables["members"]
    result = members.join(change, ["series_id", "work_id"], "left_anti").select(*members.columns).unionByName(change.select(*members.columns))
    return result, judged.filter("reason IS NOT NULL").select("op_id", "reason")


def _detach(moves: DataFrame, tables: Tables) -> Tables:
    """``moves(op_id, work_id, room, title)`` onto the books' own pages, revived or new."""
    external = F.concat(F.lit("singleton:"), F.col("work_id"))
    own = tables["series"].filter("source = 'heuristic'").select(F.col("external_id").alias("ext"), F.col("series_id").alias("own_page"))
    placed = materialize(moves.withColumn("ext", external).join(own, "ext", "left").withColumn(
        "target", F.coalesce("own_page", T.series_row_id(F.col("ext")))))
    series = tables["series"]
    revived = placed.filter("own_page IS NOT NULL").select(F.col("own_page").alias("series_id"), F.col("title").alias("r_name"))
    back = series.join(revived, "series_id", "left").withColumn("hit", F.col("r_name").isNotNull()).withColumn(
        "merged_into", F.when(~F.col("hit"), F.col("merged_into"))).withColumn("dissolved", F.col("dissolved") & ~F.col("hit")).withColumn(
        "name", F.coalesce("r_name", "name")).select(*series.columns)
    made = {"series_id": F.col("target"), "source": F.lit("heuristic"), "external_id": F.col("ext"), "name": F.col("title"),
            "slug": F.concat_ws("-", T.slugify(F.col("title"), 60), F.substring("target", 1, 6)), "canonical_key": T.series_key(F.col("title")), "kind": F.lit("singleton"),
            "provenance": F.lit("single"), "catalog_release": F.lit(None), "merged_into": F.lit(None), "parent_id": F.lit(None), "dissolved": F.lit(False)}
    types = dict(series.dtypes)
    rows = placed.filter("own_page IS NULL").select(*[made[c].cast(types[c]).alias(c) for c in series.columns])
    gone = _tree_members(tables, placed.select("work_id", "room")).select("series_id", "work_id")
    m = placed.select("work_id", "room", "target")
    threads = tables["threads"].join(m, "work_id", "left").withColumn(
        "series_id", F.when(F.col("series_id") == F.col("room"), F.col("target")).otherwise(F.col("series_id"))).select(*tables["threads"].columns)
    works = tables["works"].join(m, "work_id", "left").withColumn("series_id", F.coalesce("target", "series_id")).select(*tables["works"].columns)
    return {**tables, "series": back.unionByName(rows), "works": works, "threads": threads,
            "members": tables["members"].join(gone, ["series_id", "work_id"], "left_anti").select(*tables["members"].columns)}


def apply_remove(ops: DataFrame, tables: Tables) -> tuple[Tables, DataFrame]:
    """``ops(op_id, work_id, series_id)``: the book leaves the room for its own page; a second removal of one book is refused."""
    state = tables["works"].select("work_id", "title", F.col("series_id").alias("room"), F.col("merged_into").alias("w_merged"))
    rooms = tables["series"].select("series_id", "kind", "dissolved", F.col("merged_into").alias("s_merged"))
    judged = ops.join(state, "work_id", "left").join(rooms, "series_id", "left").withColumn(
        "reason", F.when(F.col("room").isNull(), "unknown_work").when(F.col("w_merged").isNotNull(), "merged_work").when(F.col("kind").isNull(), "unknown_series")
        .when(F.col("s_merged").isNotNull(), "merged_series").when(F.col("kind") == "singleton", "singleton").when(F.col("dissolved"), "dissolved")
        .when(F.col("room") != F.col("series_id"), "not_in_series"))
    first = judged.filter("reason IS NULL").groupBy("work_id", "room", "title").agg(F.min("op_id").alias("op_id"))
    again = judged.filter("reason IS NULL").join(first.select("op_id"), "op_id", "left_anti").select("op_id", F.lit("not_in_series").alias("reason"))
    return _detach(materialize(first), tables), judged.filter("reason IS NOT NULL").select("op_id", "reason").unionByName(again)


def apply_dissolve(ops: DataFrame, tables: Tables) -> tuple[Tables, DataFrame]:
    """``ops(op_id, series_id)``: every live book to its own page, the room marked; its untagged threads stay."""
    rooms = tables["series"].select("series_id", "kind", "dissolved", F.col("merged_into").alias("s_merged"))
    judged = ops.join(rooms, "series_id", "left").withColumn(
        "reason", F.when(F.col("kind").isNull(), "unknown_series").when(F.col("s_merged").isNotNull(), "merged_series").when(F.col("kind") == "singleton", "singleton").when(F.col("dissolved"), "dissolved"))
    first = materialize(judged.filter("reason IS NULL").groupBy("series_id").agg(F.min("op_id").alias("op_id")))
    again = judged.filter("reason IS NULL").join(first.select("op_id"), "op_id", "left_anti").select("op_id", F.lit("dissolved").alias("reason"))
    books = tables["works"].filter("merged_into IS NULL").join(first, "series_id").select("op_id", "work_id", F.col("series_id").alias("room"), "title")
    result = _detach(books, tables)
    marked = first.select("series_id", F.lit(True).alias("now"))
    result["series"] = result["series"].join(marked, "series_id", "left").withColumn("dissolved", F.col("dissolved") | F.coalesce("now", F.lit(False))).select(*tables["series"].columns)
    return result, judged.filter("reason IS NOT NULL").select("op_id", "reason").unionByName(again)


def apply_split(ops: DataFrame, tables: Tables) -> tuple[Tables, DataFrame]:
    """``ops(op_id, work_id, editions[])``: the listed editions become a new work; the first valid op of a book in a batch runs.

    New rows get an id derived from the work and its least edition.
    """
    works, editions = tables["works"], tables["editions"]
    state = works.select("work_id", F.col("merged_into").alias("w_merged"), F.lit(True).alias("known"))
    total = editions.groupBy("work_id").agg(F.count("*").alias("total"))
    listed = ops.select("op_id", "work_id", F.explode(F.array_distinct("editions")).alias("edition_id"))
    owner = editions.select("edition_id", F.col("work_id").alias("owner"))
    seen = listed.join(owner, "edition_id", "left").groupBy("op_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("owner").isNull()).alias("unknown"), F.count_if(F.col("owner") != F.col("work_id")).alias("foreign"))
    judged = written(ops.join(state, "work_id", "left").join(total, "work_id", "left").join(seen, "op_id", "left").select(
        "op_id", "work_id", F.when(F.col("known").isNull(), "unknown_work").when(F.col("w_merged").isNotNull(), "merged_work").when(F.coalesce("n", F.lit(0)) == 0, "none")
        .when(F.col("unknown") > 0, "unknown_edition").when(F.col("foreign") > 0, "foreign").when(F.col("n") == F.col("total"), "all").alias("reason")))
    first = judged.filter("reason IS NULL").groupBy("work_id").agg(F.min("op_id").alias("op_id"))
    again = judged.filter("reason IS NULL").join(first.select("op_id"), "op_id", "left_anti").select("op_id", F.lit("superseded").alias("reason"))
    moved = listed.join(first.select("op_id"), "op_id", "left_semi")
    ids = moved.groupBy("work_id").agg(F.min("edition_id").alias("least")).withColumn("split_key", F.concat_ws("~", "work_id", "least")).withColumn(
        "new_work", T.work_row_id(F.col("split_key")))
    taken = written(moved.join(ids, "work_id").select("edition_id", "work_id", "new_work", "split_key"))
    split = taken.select("work_id", "new_work", "split_key").distinct()

    def after(rows: DataFrame) -> DataFrame:
        return rows.join(taken.select("edition_id", "new_work"), "edition_id", "left").withColumn("work_id", F.coalesce("new_work", "work_id"))

    touched = taken.select("work_id").union(taken.select("new_work")).distinct()
    faces = after(editions.select("edition_id", "work_id", edition_rank(editions).alias("face"))).groupBy("work_id").agg(F.max("face").alias("face"))
    best = faces.join(touched, "work_id", "left_semi").select("work_id", F.col("face.edition_id").alias("best"))
    face = editions.select(F.col("edition_id").alias("best"), F.col("title").alias("face_title"))
    types = dict(works.dtypes)
    source = works.join(split, "work_id").join(
        best.withColumnRenamed("work_id", "new_work"), "new_work").join(face, "best", "left")
    shown = T.display_title(F.col("face_title"))
    title = F.when(shown != "", shown).otherwise(F.col("title"))
    rooms = tables["series"].select("series_id", F.col("kind").alias("room_kind"))
    fresh = {"work_id": F.col("new_work"), "source": F.lit("openlibrary"), "external_id": F.col("split_key"), "title": title, "canonical_key": T.canonical_key(title, F.col("author")),
             "catalog_release": F.lit(None), "merged_into": F.lit(None), "subjects": F.lit(None), "readinglog_count": F.lit(0), "first_publish_year": F.lit(None),
             "representative": F.col("best"), "series_id": F.when(F.col("room_kind") == "series", F.col("series_id")).otherwise(T.series_row_id(F.concat(F.lit("singleton:"), F.col("new_work"))))}
    new_rows = source.join(rooms, "series_id", "left").select(*[fresh.get(c, F.col(c)).cast(types[c]).alias(c) for c in works.columns])
    updated = works.join(best, "work_id", "left").withColumn("representative", F.coalesce("best", "representative")).select(*works.columns)
    return {**tables, "works": updated.unionByName(new_rows), "editions": after(editions).select(*editions.columns)}, judged.filter("reason IS NOT NULL").select("op_id", "reason").unionByName(again)


_MEMBER = "struct<series_id:string,work_id:string,position:double,provenance:string,confidence:string>"
_BOOK = f"work:string,singleton:string,old_members:array<{_MEMBER}>,moved_threads:array<bigint>"
SNAPSHOT = (f"struct<old_name:string,name:string,old_room:string,created_series:string,member_series:string,position:double,prior:{_MEMBER},prior_target_member:{_MEMBER},{_BOOK},"
            f"books:array<struct<{_BOOK}>>,retired:struct<parent:string,threads:array<bigint>,tagged:array<bigint>,works:array<string>,repointed:array<string>>>")
IMAGE = {"kind": "string", "work_id": "string", "series_id": "string", "thread_id": "bigint", "position": "double", "provenance": "string", "confidence": "string",
         "expected": "string", "name": "string"}


def image(rows: DataFrame, kind: str, **values) -> DataFrame:
    """Before-image rows of one kind; a value not given is null.

    * ``book``: ``work_id`` goes back to ``series_id`` while it stands in ``expected``;
    * ``member``: a membership to be there again; ``placed``: the one whose ``position`` was set;
    * ``thread``: one that moved with ``work_id``;
    * ``name``: ``series_id`` was called ``name`` and is called ``expected``;
    * ``created``: a series that falls to ``expected`` if nothing is left in it;
    * ``retired``: the room ``series_id`` went to ``expected``, out of the parent ``name``; ``retired_thread``, ``retired_tag``, ``retired_work``
      and ``retired_pointer`` came from the room ``name``, was tagged there, lived there, pointed there.
    """
    values = {"kind": F.lit(kind), **{k: F.col(v) if isinstance(v, str) else v for k, v in values.items()}}
    return rows.select("correction_id", *[values.get(c, F.lit(None)).cast(t).alias(c) for c, t in IMAGE.items()])


def images_of(log: DataFrame) -> DataFrame:
    """Before-images of a log whose rows carry a JSON ``snapshot``."""
    rows = log.select("correction_id", "op", F.col("work_id").cast("string"), F.col("series_id").cast("string"), F.from_json("snapshot", SNAPSHOT).alias("s"))
    moved = rows.filter("op IN ('set_series', 'remove_from_series', 'reject_series')")
    one = F.array(F.struct(F.col("work_id").alias("work"), F.col("s.singleton").alias("singleton"), F.col("s.old_members").alias("old_members"), F.col("s.moved_threads").alias("moved_threads")))
    books = moved.select("*", F.explode(F.when(F.col("op") == "reject_series", F.col("s.books")).otherwise(one)).alias("b"))
    set_op = F.col("op") == "set_series"
    held = books.select("correction_id", F.explode("b.old_members").alias("m")).unionByName(
        rows.filter("op = 'set_series' AND s.prior_target_member IS NOT NULL").select("correction_id", F.col("s.prior_target_member").alias("m"))).unionByName(
        rows.filter("op = 'set_position' AND s.prior IS NOT NULL").select("correction_id", F.col("s.prior").alias("m"))).select("correction_id", "m.*")
    sent = books.select("correction_id", F.col("b.work").alias("work_id"), F.explode("b.moved_threads").alias("thread_id"))
    back = rows.filter("op = 'set_series' AND s.retired IS NOT NULL").select("correction_id", "series_id", F.col("s.old_room").alias("room"), "s.retired.*")
    parts = [
        image(books, "book", work_id="b.work", series_id=F.when(set_op, F.col("s.old_room")).otherwise(F.col("series_id")),
              expected=F.when(set_op, F.col("series_id")).otherwise(F.col("b.singleton"))),
        image(held, "member", **{c: c for c in ("series_id", "work_id", "position", "provenance", "confidence")}),
        image(sent, "thread", work_id="work_id", thread_id="thread_id"),
        image(rows.filter("op = 'set_position'"), "placed", work_id="work_id", series_id="s.member_series", position="s.position"),
        image(rows.filter("op = 'rename_series'"), "name", series_id="series_id", name="s.old_name", expected="s.name"),
        image(rows.filter("op = 'set_series' AND s.created_series IS NOT NULL"), "created", series_id="s.created_series", expected="s.old_room"),
        image(back, "retired", series_id="room", expected="series_id", name="parent"),
        image(back.withColumn("x", F.explode("threads")), "retired_thread", thread_id="x", name="room"),
        image(back.withColumn("x", F.explode("tagged")), "retired_tag", thread_id="x", name="room"),
        image(back.withColumn("x", F.explode("works")), "retired_work", work_id="x", name="room"),
        image(back.withColumn("x", F.explode("repointed")), "retired_pointer", series_id="x", name="room")]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _kind(images: DataFrame, kind: str) -> DataFrame:
    return images.filter(F.col("kind") == kind).drop("kind")


def _image_problems(rows: DataFrame, images: DataFrame, tables: Tables) -> DataFrame:
    """``(correction_id, problem)`` of fixes whose books, memberships, threads or rooms changed since."""
    stale = lambda df: df.select("correction_id", F.lit("stale").alias("problem"))
    books = _kind(images, "book").select("correction_id", "work_id", "expected").join(rows.select("correction_id", "op"), "correction_id")
    works = tables["works"].select("work_id", F.col("series_id").alias("room"), F.col("merged_into").alias("w_merged"))
    pages = tables["series"].select(F.col("series_id").alias("expected"), F.col("merged_into").alias("page_merged"))
    crowd = tables["works"].filter("merged_into IS NULL").join(books.filter("op <> 'set_series'").select(F.col("expected").alias("series_id")).distinct(), "series_id").groupBy(
        F.col("series_id").alias("expected")).agg(F.count("*").alias("crowd"))
    lost = books.join(works, "work_id", "left").join(pages, "expected", "left").join(crowd, "expected", "left").filter(
        "room IS NULL OR w_merged IS NOT NULL OR page_merged IS NOT NULL OR NOT (room <=> expected) OR (op <> 'set_series' AND crowd <> 1)")
    again = _kind(images, "member").join(rows.filter("op <> 'set_position'").select("correction_id"), "correction_id", "left_semi").join(
        tables["members"].select("series_id", "work_id"), ["series_id", "work_id"], "left_semi")
    sent = _kind(images, "thread").select("correction_id", "work_id", "thread_id").join(books, ["correction_id", "work_id"]).select("correction_id", "expected", "thread_id")
    gone = _kind(images, "retired")
    taken = _kind(images, "retired_thread").select("correction_id", "thread_id").join(gone.select("correction_id", "expected"), "correction_id").select("correction_id", "expected", "thread_id")
    strayed = sent.unionByName(taken).join(tables["threads"].select("thread_id", F.col("series_id").alias("now_room")), "thread_id", "left").filter("NOT (now_room <=> expected)")
    there = books.select("correction_id", "op", "expected", F.col("work_id").alias("book")).join(
        tables["threads"].select("thread_id", F.col("series_id").alias("expected"), F.col("work_id").alias("tag")), "expected").filter("op <> 'set_series' OR tag = book")
    started = there.join(sent.unionByName(taken).select("correction_id", "thread_id"), ["correction_id", "thread_id"], "left_anti").select(
        "correction_id", F.lit("new_discussion").alias("problem"))
    homes = _kind(images, "book").join(rows.filter("op = 'set_series'").select("correction_id"), "correction_id", "left_semi").select("correction_id", "series_id", "expected")
    now = tables["series"].select("series_id", F.col("merged_into").alias("now_merged"), "dissolved", F.lit(True).alias("there"))
    was = gone.select("correction_id", F.lit(True).alias("was_retired"))
    moved = homes.join(now, "series_id", "left").join(was, "correction_id", "left").filter(
        "there IS NULL OR CASE WHEN was_retired THEN NOT (now_merged <=> expected) ELSE now_merged IS NOT NULL OR dissolved END")
    return stale(lost).unionByName(stale(again)).unionByName(stale(strayed)).unionByName(stale(moved)).unionByName(started)


def revert(requests: DataFrame, log: DataFrame, tables: Tables, images: DataFrame | None = None) -> tuple[Tables, DataFrame, DataFrame]:
    """``requests(correction_id)`` undone where still possible; ``(tables, log, refusals)``.

    ``images`` are the before-images that ``fixes`` wrote; without them, a log row carries a JSON ``snapshot``. A fix is
    undone only as the latest live one of its subject and only while the rows it left are as it left them; merges and splits never.
    """
    asked = requests.select("correction_id").distinct()
    rows = materialize(log.join(asked, "correction_id", "left_semi"))
    images = materialize((images_of(rows) if images is None else images.join(asked, "correction_id", "left_semi")))
    latest = latest_per_subject(log).select("correction_id", F.lit(True).alias("latest"))
    works = tables["works"].select("work_id", F.col("series_id").alias("room"), F.col("merged_into").alias("w_merged"))
    series = tables["series"].select("series_id", F.col("name").alias("now_name"), F.col("merged_into").alias("s_merged"), "dissolved")
    members = tables["members"].select(F.col("series_id").alias("at"), "work_id", F.col("position").alias("now_position"), F.lit(True).alias("is_member"))
    placed = _kind(images, "placed").select("correction_id", F.col("series_id").alias("placed_at"), F.col("position").alias("set_to"))
    called = _kind(images, "name").select("correction_id", F.col("expected").alias("called"))
    op = F.col("op")
    at = F.when(op == "set_position", F.col("placed_at")).otherwise(F.col("series_id"))
    joined = (
        rows.join(placed, "correction_id", "left").join(called, "correction_id", "left").withColumn("at", at).join(latest, "correction_id", "left")
        .join(works, "work_id", "left").join(series, "series_id", "left").join(members, ["at", "work_id"], "left"))
    gone, room_gone = F.col("w_merged").isNotNull() | F.col("room").isNull(), F.col("s_merged").isNotNull() | F.col("now_name").isNull()
    stale = (
        ((op == "rename_series") & (room_gone | ~F.col("now_name").eqNullSafe(F.col("called"))))
        | ((op == "set_position") & (gone | (F.col("room") != F.col("series_id")) | F.col("is_member").isNull() | ~F.col("now_position").eqNullSafe(F.col("set_to"))))
        | ((op == "set_series") & F.col("is_member").isNull()) | ((op == "remove_from_series") & (room_gone | F.col("dissolved")))
        | ((op == "reject_series") & (room_gone | ~F.col("dissolved"))) | ((op == "veto_genre") & gone))
    problems = _image_problems(rows, images, tables).groupBy("correction_id").agg(F.max("problem").alias("problem"))
    reason = (
        F.when(~op.isin(*UNDOABLE), "not_undoable").when(F.col("reverted"), "already_undone").when(F.col("latest").isNull(), "later_fix")
        .when(F.coalesce(stale, F.lit(True)), "stale").otherwise(F.col("problem")))
    judged = materialize(joined.join(problems, "correction_id", "left").withColumn("reason", reason).select("correction_id", "op", "work_id", "series_id", "at", "reason"))
    good = judged.filter("reason IS NULL")
    undone = materialize(images.join(good.select("correction_id", "op"), "correction_id"))
    books, back = _kind(undone, "book"), _kind(undone, "retired")

    result = dict(tables)
    names = _kind(undone, "name").select("series_id", F.col("name").alias("old_name"))
    pages = books.filter("op <> 'set_series'").select(F.col("expected").alias("series_id"), F.col("series_id").alias("page_home"))
    reopened = good.filter("op = 'reject_series'").select("series_id", F.lit(True).alias("reopened"))
    revived = back.select("series_id", F.col("name").alias("old_parent"), F.lit(True).alias("revived"))
    followers = _kind(undone, "retired_pointer").select("series_id", F.col("name").alias("points_to"))
    returned = (
        tables["series"].join(names, "series_id", "left").join(pages, "series_id", "left").join(reopened, "series_id", "left").join(revived, "series_id", "left")
        .join(followers, "series_id", "left").withColumn("name", F.coalesce("old_name", "name"))
        .withColumn("dissolved", F.col("dissolved") & F.col("reopened").isNull())
        .withColumn("merged_into", F.when(F.col("revived").isNull(), F.coalesce("page_home", "points_to", "merged_into")))
        .withColumn("parent_id", F.when(F.col("revived"), F.col("old_parent")).otherwise(F.col("parent_id"))).select(*tables["series"].columns))
    homes = books.select("work_id", F.col("series_id").alias("home")).unionByName(
        _kind(undone, "retired_work").select("work_id", F.col("name").alias("home"))).groupBy("work_id").agg(F.min("home").alias("home"))
    result["works"] = tables["works"].join(homes, "work_id", "left").withColumn("series_id", F.coalesce("home", "series_id")).select(*tables["works"].columns)
    sent = _kind(undone, "thread").select("correction_id", "work_id", "thread_id").join(books.select("correction_id", "work_id", F.col("series_id").alias("home")), ["correction_id", "work_id"])
    carried = sent.select("thread_id", "home").unionByName(
        _kind(undone, "retired_thread").select("thread_id", F.col("name").alias("home"))).groupBy("thread_id").agg(F.min("home").alias("home"))
    untagged = _kind(undone, "retired_tag").select("thread_id", F.lit(True).alias("untag"))
    result["threads"] = tables["threads"].join(carried, "thread_id", "left").join(untagged, "thread_id", "left").withColumn(
        "series_id", F.coalesce("home", "series_id")).withColumn("work_id", F.when(F.col("untag").isNull(), F.col("work_id"))).select(*tables["threads"].columns)
    # A series an undone move created goes back to the old room if nothing is left in it.
    held = result["works"].filter("merged_into IS NULL").select("series_id").unionByName(result["threads"].select("series_id"))
    bare = _kind(undone, "created").select("series_id", F.col("expected").alias("falls_to")).join(held, "series_id", "left_anti")
    result["series"] = returned.join(bare, "series_id", "left").withColumn("merged_into", F.coalesce("falls_to", "merged_into")).select(*tables["series"].columns)
    columns, types = tables["members"].columns, dict(tables["members"].dtypes)
    dropped = good.filter("op IN ('set_series', 'set_position')").select(F.col("at").alias("series_id"), "work_id")
    result["members"] = tables["members"].join(dropped, ["series_id", "work_id"], "left_anti").select(*columns).unionByName(
        _kind(undone, "member").select(*[F.col(c).cast(types[c]).alias(c) for c in columns]))
    done = good.select("correction_id", F.lit(True).alias("done"))
    new_log = log.join(done, "correction_id", "left").withColumn("reverted", F.col("reverted") | F.coalesce("done", F.lit(False))).select(*log.columns)
    return result, new_log, judged.filter("reason IS NOT NULL").select("correction_id", "reason")
