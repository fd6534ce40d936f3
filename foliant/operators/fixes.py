"""Fixes that write the correction log: what was done, how to export it, and how to undo it.

Every function applies a table of operations to a snapshot and returns ``Recorded``: the new
snapshot, a log row for each accepted operation, before-images, and refusals. A before-image
is a row of its own (``corrections.image``), so a fix that touched a million books is as many
rows, not one value. Operations may carry ``user_id`` and ``created_at``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import corrections as R
from foliant.operators.corrections import HIGH, OVERRIDE, image
from foliant.operators.load import Tables
from foliant.session import materialize

VETOES_STAY = "the pipeline has no genre overrides"
_MEMBER = ("series_id", "work_id", "position", "provenance", "confidence")


class Recorded(NamedTuple):
    tables: Tables
    log: DataFrame
    images: DataFrame
    refusals: DataFrame


def _union(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _accepted(ops: DataFrame, refusals: DataFrame) -> DataFrame:
    return ops.join(refusals.select("op_id"), "op_id", "left_anti")


def _row(done: DataFrame, ops: DataFrame, op: str, **values) -> DataFrame:
    """Log rows for ``done(op_id, ...)``; ``override`` is the JSON of its entries, null for a fix that stays in the application."""
    null = F.lit(None)
    values = {k: F.col(v) if isinstance(v, str) else v for k, v in values.items()}
    extra = [c for c in ("user_id", "created_at") if c in ops.columns]
    if extra:
        done = done.join(ops.select("op_id", *extra).dropDuplicates(["op_id"]), "op_id")
    columns = {"work_id": "string", "series_id": "string", "genre_id": "int", "position": "double", "name": "string", "override": "string", "runtime_only_reason": "string"}
    return done.select(
        F.col("op_id").alias("correction_id"), F.lit(op).alias("op"), *[values.get(c, null).cast(t).alias(c) for c, t in columns.items()],
        *[(F.col(c) if c in extra else null.cast(t)).alias(c) for c, t in (("user_id", "long"), ("created_at", "timestamp"))], F.lit(False).alias("reverted"))


# --- names of rows in the overrides file ------------------------------------------------


def _work_names(works: DataFrame) -> DataFrame:
    missing = F.when(F.col("source") != "openlibrary", F.concat("title", F.lit(" has no Open Library id (heuristic work)")))
    return works.select("work_id", F.when(missing.isNull(), F.col("external_id")).alias("work_key"), missing.alias("no_work_key"))


def _series_names(series: DataFrame, prefix: str = "") -> DataFrame:
    """``series_key``, or the reason there is none; ``released`` if a release holds the series."""
    named = series.withColumnRenamed("external_id", "series_external").withColumnRenamed("canonical_key", "series_canonical")
    key = R.series_key_of()
    return named.select(
        F.col("series_id").alias(f"{prefix}series_id"), key.alias(f"{prefix}series_key"), F.col("name").alias(f"{prefix}series_name"),
        F.when(F.col("kind") == "singleton", F.concat("name", F.lit(" is a single book's page, not a series"))).alias(f"{prefix}no_series_key"),
        F.col("catalog_release").isNotNull().alias(f"{prefix}released"), F.col("series_external").alias(f"{prefix}external"))


def _entry(kind: str, **fields) -> Column:
    """One override entry as JSON; null fields are left out."""
    return F.to_json(F.struct(F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]).alias(kind)))


def _listed(entries: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(entries, ","), F.lit("]"))


def _removals(held: DataFrame, tables: Tables, log: DataFrame | None) -> DataFrame:
    """``held(op_id, work_id, series_id)``: entries for the memberships a build would still hold, in order of the series' external ids.

    ``(op_id, removes, no_remove_key)``. A series no release holds counts if an exported fix of ``log`` put the book there.
    """
    rows = held.join(_series_names(tables["series"]), "series_id").join(_work_names(tables["works"]).select("work_id", "work_key"), "work_id", "left")
    if log is None:
        rows = rows.withColumn("placed", F.lit(False))
    else:
        placed = R.exported_memberships(log).withColumn("placed", F.lit(True))
        rows = rows.join(placed, ["work_key", "series_key"], "left").withColumn("placed", F.coalesce("placed", F.lit(False)))
    entry = F.struct("external", _entry("remove_from_series", work="work_key", series="series_key").alias("e"), F.col("no_series_key").alias("missing"))
    # Memberships of one book in one tree.
    named = rows.filter("released OR placed").groupBy("op_id").agg(F.sort_array(F.collect_list(entry)).alias("es"))
    return named.select("op_id", F.col("es.e").alias("removes"), F.get(F.filter("es.missing", lambda x: x.isNotNull()), F.lit(0)).alias("no_remove_key"))


# --- fixes ---------------------------------------------------------------------------------


def _passed_on(retired: DataFrame) -> DataFrame:
    """``(room, through)``: each retired room and every retired room its content went on to, itself included."""
    step = retired.select("room", F.col("target").alias("next")).join(retired.select(F.col("room").alias("next")), "next", "left_semi")
    found = retired.select("room", F.col("room").alias("through"))
    frontier = step.select("room", F.col("next").alias("through"))
    while frontier.head(1):
        frontier = materialize(frontier)
        found = found.unionByName(frontier)
        frontier = frontier.join(step.select(F.col("room").alias("through"), "next"), "through").select("room", F.col("next").alias("through"))
    return materialize(found)


def set_series(ops: DataFrame, tables: Tables, log: DataFrame | None = None) -> Recorded:
    """``ops(op_id, work_id, series_id, new_name, position)``. ``log`` are earlier fixes (``override`` JSON, ``reverted``)."""
    done = R.set_series_moves(ops, tables)
    steps = done.accepted.withColumnRenamed("op_id", "correction_id")
    by_op = lambda df: df.withColumnRenamed("op_id", "correction_id")
    # The membership an operation added goes with the book's next one.
    between = done.accepted.filter("later IS NOT NULL").select(
        F.col("later").alias("correction_id"), F.col("target").alias("series_id"), "work_id", "position", F.lit(OVERRIDE).alias("provenance"), F.lit(HIGH).alias("confidence"))
    created = done.created.join(done.accepted.select("op_id", "room"), "op_id")
    own = done.retired.select(F.col("op_id").alias("correction_id"), F.col("room").alias("through"), "target", "parent", F.col("book").isNotNull().alias("single"))
    through = own.join(_passed_on(done.retired), "through")
    inside = done.moved["threads"].select("thread_id", F.col("series_id").alias("room"), F.col("work_id").isNull().alias("untagged")).join(through, "room")
    dead = done.moved["works"].select("work_id", F.col("series_id").alias("room")).join(through, "room")
    pointing = done.moved["series"].select("series_id", F.col("merged_into").alias("room")).filter("room IS NOT NULL").join(through, "room")
    images = _union([
        image(steps, "book", work_id="work_id", series_id="room", expected="target"),
        image(by_op(done.removed), "member", **{c: c for c in _MEMBER}), image(between, "member", **{c: c for c in _MEMBER}),
        image(by_op(done.carried), "thread", work_id="work_id", thread_id="thread_id"),
        image(by_op(created), "created", series_id="series_id", expected="room"),
        image(own, "retired", series_id="through", expected="target", name="parent"),
        image(inside, "retired_thread", thread_id="thread_id", name="through"),
        image(inside.filter("single AND untagged AND room = through"), "retired_tag", thread_id="thread_id", name="through"),
        image(dead, "retired_work", work_id="work_id", name="through"),
        image(pointing.select("series_id", "correction_id", "through").unionByName(through.filter("room <> through").select(F.col("room").alias("series_id"), "correction_id", "through")),
              "retired_pointer", series_id="series_id", name="through")])
    held = done.removed.filter("NOT prior").select("op_id", "work_id", "series_id").unionByName(between.select(F.col("correction_id").alias("op_id"), "work_id", "series_id"))
    rows = done.accepted.join(_work_names(tables["works"]), "work_id").join(_series_names(done.moved["series"], "t_"), F.col("t_series_id") == F.col("target")).join(
        _removals(held, done.moved | {"works": tables["works"]}, log), "op_id", "left")
    missing = F.coalesce("no_work_key", "no_remove_key", "t_no_series_key")
    put = _entry("set_series", work="work_key", series="t_series_key", position="position", name=F.when(~F.col("t_released"), F.col("t_series_name")))
    entries = F.concat(F.coalesce("removes", F.array().cast("array<string>")), F.array(put))
    rows = rows.withColumn("missing", missing).withColumn("entries", F.when(missing.isNull(), _listed(entries)))
    return Recorded(done.tables, _row(rows, ops, "set_series", work_id="work_id", series_id="target", position="position", override="entries", runtime_only_reason="missing"),
                    images, done.refusals)


def set_position(ops: DataFrame, tables: Tables) -> Recorded:
    """``ops(op_id, work_id, series_id, position)``."""
    members, refusals = R.apply_set_position(ops, tables)
    order = W.partitionBy("work_id").orderBy("op_id")
    accepted = _accepted(ops, refusals).withColumn("earlier", F.lag(F.struct("op_id", "position")).over(order))
    placed = R.placed_members(accepted.select("work_id", F.col("series_id").alias("room")).distinct(), tables)
    rows = materialize(accepted.join(placed.withColumnRenamed("room", "series_id"), ["work_id", "series_id"], "left").withColumn(
        "at", F.coalesce("placed.series_id", "series_id")))
    after = rows.filter("earlier IS NOT NULL").select("op_id", F.col("at").alias("series_id"), "work_id", F.col("earlier.position").alias("position"),
                                                      F.lit(OVERRIDE).alias("provenance"), F.lit(HIGH).alias("confidence"))
    before = rows.filter("earlier IS NULL AND placed IS NOT NULL").select("op_id", "placed.*").select("op_id", *_MEMBER).unionByName(after)
    images = _union([image(rows.withColumnRenamed("op_id", "correction_id"), "placed", work_id="work_id", series_id="at", position="position"),
                     image(before.withColumnRenamed("op_id", "correction_id"), "member", **{c: c for c in _MEMBER})])
    named = rows.join(_work_names(tables["works"]), "work_id").join(_series_names(tables["series"], "t_"), F.col("t_series_id") == F.col("at"))
    missing = F.coalesce("no_work_key", "t_no_series_key")
    put = _entry("set_series", work="work_key", series="t_series_key", position="position", name=F.when(~F.col("t_released"), F.col("t_series_name")))
    named = named.withColumn("missing", missing).withColumn("entries", F.when(missing.isNull(), _listed(F.array(put))))
    return Recorded({**tables, "members": members}, _row(named, ops, "set_position", work_id="work_id", series_id="series_id", position="position",
                                                         override="entries", runtime_only_reason="missing"), images, refusals)


def _release_key() -> Column:
    """Why a rename or a dissolve can't be exported; null if it can."""
    return F.when(~F.col("t_released"), F.concat("t_series_name", F.lit(" is not in a catalog release"))).otherwise(F.col("t_no_series_key"))


def rename(ops: DataFrame, tables: Tables) -> Recorded:
    """``ops(op_id, series_id, name)``."""
    renamed, refusals = R.apply_rename(ops, tables["series"])
    clean = _accepted(ops, refusals).withColumn("name", T.collapse_edges(F.coalesce("name", F.lit(""))))
    order = W.partitionBy("series_id").orderBy("op_id")
    rows = clean.join(_series_names(tables["series"], "t_"), F.col("t_series_id") == F.col("series_id")).withColumn(
        "t_series_name", F.coalesce(F.lag("name").over(order), "t_series_name"))
    images = image(rows.withColumnRenamed("op_id", "correction_id"), "name", series_id="series_id", name="t_series_name", expected="name")
    missing = _release_key()
    put = F.when(missing.isNull(), _listed(F.array(_entry("rename_series", series="t_series_key", name="name"))))
    rows = rows.withColumn("missing", missing).withColumn("entries", put)
    return Recorded({**tables, "series": renamed}, _row(rows, ops, "rename_series", series_id="series_id", name="name", override="entries", runtime_only_reason="missing"),
                    images, refusals)


def _detached(books: DataFrame, before: Tables, after: Tables) -> tuple[DataFrame, DataFrame]:
    """Images of ``books(correction_id, work_id, room)`` that went to their own pages, and their old memberships."""
    page = after["works"].select("work_id", F.col("series_id").alias("page"))
    at = materialize(books.join(page, "work_id"))
    held = R._tree_members(before, at.select("work_id", "room").distinct()).join(at.select("correction_id", "work_id", "room"), ["work_id", "room"])
    sent = before["threads"].select("thread_id", "work_id", F.col("series_id").alias("room")).join(at.select("correction_id", "work_id", "room"), ["work_id", "room"])
    return _union([image(at, "book", work_id="work_id", series_id="room", expected="page"), image(held, "member", **{c: c for c in _MEMBER}),
                   image(sent, "thread", work_id="work_id", thread_id="thread_id")]), held.select(F.col("correction_id").alias("op_id"), "work_id", "series_id")


def remove(ops: DataFrame, tables: Tables, log: DataFrame | None = None) -> Recorded:
    """``ops(op_id, work_id, series_id)``. ``log`` as in ``set_series``."""
    after, refusals = R.apply_remove(ops, tables)
    accepted = materialize(_accepted(ops, refusals))
    images, held = _detached(accepted.select(F.col("op_id").alias("correction_id"), "work_id", F.col("series_id").alias("room")), tables, after)
    rows = accepted.join(_work_names(tables["works"]).join(tables["works"].select("work_id", "title"), "work_id"), "work_id").join(
        _series_names(tables["series"], "t_"), F.col("t_series_id") == F.col("series_id")).join(_removals(held, tables, log), "op_id", "left")
    if log is None:
        rows = rows.withColumn("known", F.col("t_released"))
    else:
        placed = R.exported_memberships(log).select("work_key", F.col("series_key").alias("t_series_key"), F.lit(True).alias("placed"))
        rows = rows.join(placed, ["work_key", "t_series_key"], "left").withColumn("known", F.col("t_released") | F.coalesce("placed", F.lit(False)))
    missing = F.coalesce(
        "no_work_key", F.when(~F.col("known"), F.concat("t_series_name", F.lit(" is not in a catalog release"))), "no_remove_key",
        F.when(F.col("removes").isNull(), F.concat("title", F.lit(" has no catalog membership in "), "t_series_name")))
    rows = rows.withColumn("missing", missing).withColumn("entries", F.when(missing.isNull(), _listed(F.col("removes"))))
    return Recorded(after, _row(rows, ops, "remove_from_series", work_id="work_id", series_id="series_id", override="entries", runtime_only_reason="missing"), images, refusals)


def reject(ops: DataFrame, tables: Tables) -> Recorded:
    """``ops(op_id, series_id)``; a book of the room is an image row each."""
    after, refusals = R.apply_dissolve(ops, tables)
    accepted = materialize(_accepted(ops, refusals))
    books = tables["works"].filter("merged_into IS NULL").select("work_id", F.col("series_id").alias("room")).join(
        accepted.select(F.col("op_id").alias("correction_id"), F.col("series_id").alias("room")), "room")
    images, _ = _detached(books, tables, after)
    rows = accepted.join(_series_names(tables["series"], "t_"), F.col("t_series_id") == F.col("series_id"))
    missing = _release_key()
    put = F.when(missing.isNull(), _listed(F.array(F.to_json(F.struct(F.col("t_series_key").alias("reject_series"))))))
    rows = rows.withColumn("missing", missing).withColumn("entries", put)
    return Recorded(after, _row(rows, ops, "reject_series", series_id="series_id", override="entries", runtime_only_reason="missing"), images, refusals)


def veto(ops: DataFrame, tables: Tables, genres: DataFrame, log: DataFrame | None = None) -> Recorded:
    """``ops(op_id, work_id, genre_id)``; a pair that ``log`` vetoes already is refused. Votes stay, so there is nothing to keep."""
    asked = ops.select(F.col("op_id").alias("correction_id"), F.lit(1).alias("created_at"), "work_id", "genre_id", F.lit(False).alias("reverted"))
    if log is not None:
        held = log.filter("op = 'veto_genre' AND NOT reverted")
        asked = asked.unionByName(held.select("correction_id", F.lit(0).alias("created_at"), "work_id", "genre_id", F.lit(False).alias("reverted")))
    _, refused = R.apply_vetoes(asked, tables["works"], genres)
    refusals = refused.join(ops.select(F.col("op_id").alias("correction_id")), "correction_id", "left_semi").withColumnRenamed("correction_id", "op_id")
    rows = _accepted(ops, refusals)
    nothing = image(rows.withColumnRenamed("op_id", "correction_id").limit(0), "book")
    return Recorded(tables, _row(rows, ops, "veto_genre", work_id="work_id", genre_id="genre_id", runtime_only_reason=F.lit(VETOES_STAY)), nothing, refusals)
