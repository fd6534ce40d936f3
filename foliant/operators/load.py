"""Loading a release into the live tables, as whole-table transforms.

Every step maps a snapshot to a new snapshot; nothing is updated in place and
nothing is done row by row. ``Tables`` is a dict of DataFrames: works, editions,
series, members, aliases, threads, shelves, votes, inferences, vetoes, releases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.genres import genre_summary, infer_genres, live_vetoes, merge_genre_evidence, replace_inferences
from foliant.operators.graph import follow_aliases
from foliant.operators.ranking import two_level_rank
from foliant.operators.resolve import _follow, metrics, ranked_faces
from foliant.session import join_sparse, materialize, written
from foliant.sources.release import version_key

Tables = dict[str, DataFrame]


def stage_release(release: Tables, phrases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(works with genre_slugs, counts(table, rows))``."""
    lines = release["works"].select(F.col("id").alias("work_id"), F.explode(T.split_subjects(F.col("subjects"))).alias("subject"))
    slugs = infer_genres(lines, phrases).groupBy(F.col("work_id").alias("id")).agg(F.array_sort(F.collect_set("slug")).alias("genre_slugs"))
    works = release["works"].join(slugs, "id", "left").withColumn("genre_slugs", F.coalesce("genre_slugs", F.array().cast("array<string>")))
    counts = None
    for name, table in release.items():
        one = table.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        counts = one if counts is None else counts.unionByName(one)
    return works, counts


def _first_free(stems: DataFrame, taken: DataFrame) -> DataFrame:
    """``(stem, n)``: the least number from 2 on for which ``<stem>-n`` is not taken."""
    pattern = "^(.*)-([1-9][0-9]{0,17})$"
    numbered = taken.select("slug").distinct().select(
        F.regexp_extract("slug", pattern, 1).alias("stem"), F.regexp_extract("slug", pattern, 2).try_cast("long").alias("n")).filter("n >= 2")
    near = numbered.join(stems.select("stem").distinct(), "stem", "left_semi")
    run = two_level_rank(near, ["stem"], F.floor(F.col("n") / 1000), ["n"], "i").filter("n = i + 1").groupBy("stem").agg(F.count("*").alias("run"))
    return stems.select("stem").distinct().join(run, "stem", "left").select("stem", (F.coalesce("run", F.lit(0)) + 2).alias("n"))


def reslug_collisions(series: DataFrame, stage_series: DataFrame) -> DataFrame:
    """Release slugs win; another live series holding one moves to its first free number."""
    owner = stage_series.select("slug", F.col("id").alias("owner"))
    hit = series.join(owner, "slug").filter("series_id <> owner").select("series_id", F.col("slug").alias("stem")).distinct()
    free = _first_free(hit, series.select("slug").unionByName(stage_series.select("slug")))
    moved = hit.join(free, "stem").select("series_id", F.concat_ws("-", "stem", F.col("n").cast("string")).alias("new_slug"))
    return series.join(moved, "series_id", "left").withColumn("slug", F.coalesce("new_slug", "slug")).select(*series.columns)


def adoptions(works: DataFrame, stage_works: DataFrame, stage_aliases: DataFrame) -> DataFrame:
    """``(runtime, target)`` by upstream id, by alias, or (heuristic) by a key unique in the release."""
    runtime = works.filter("catalog_release IS NULL AND merged_into IS NULL")
    direct = stage_works.select(F.col("ol_work_id").alias("external_id"), F.col("id").alias("d"))
    alias = stage_aliases.select(F.col("ol_work_id").alias("external_id"), F.col("work_id").alias("a"))
    upstream = runtime.filter("source = 'openlibrary'").select(F.col("work_id").alias("runtime"), "external_id").join(
        direct, "external_id", "left").join(alias, "external_id", "left").select("runtime", F.coalesce("d", "a").alias("target")).filter("target IS NOT NULL")
    unique = stage_works.groupBy("canonical_key").agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1")
    guessed = runtime.filter("source = 'heuristic'").select(F.col("work_id").alias("runtime"), "canonical_key").join(
        unique, "canonical_key").select("runtime", "target")
    return upstream.unionByName(guessed).filter("runtime <> target")


def upsert(live: DataFrame, stage: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``stage`` overwrite or join those of ``live``; a ``keep`` column only fills a null."""
    values = [c for c in stage.columns if c not in keys]
    fresh = stage.select(*keys, F.struct(*values).alias("_s"))
    both = live.join(fresh, keys, "full")
    staged = F.col("_s").isNotNull()

    def value(name: str) -> Column:
        if name in keys or name not in values:
            return F.col(name)
        if name in keep:
            return F.coalesce(F.col(name), F.col(f"_s.{name}"))
        return F.when(staged, F.col(f"_s.{name}")).otherwise(F.col(name))

    types = dict(live.dtypes)
    return both.select(*[value(c).cast(types[c]).alias(c) for c in live.columns])


def upsert_catalog(live: Tables, stage: Tables, version: str) -> Tables:
    """Series, works and editions by id, all columns of the release contract.

    A representative chosen since is kept; source, external id of an edition and the way a work was
    identified are set on insertion only.
    """
    series = stage["series"].select(
        F.col("id").alias("series_id"), "source", F.col("key").alias("external_id"), "name", "slug", "canonical_key", "kind", "provenance",
        F.lit(version).alias("catalog_release"), F.lit(None).cast("string").alias("merged_into"), F.col("parent_series_id").alias("parent_id"))
    works = stage["works"].select(
        F.col("id").alias("work_id"), F.lit("openlibrary").alias("source"), F.col("ol_work_id").alias("external_id"), "canonical_key", "title", "subtitle", "author",
        "first_publish_year", "kind", F.lit("isbn").alias("identity_provenance"), "series_id", "ol_cover_id", "ol_edition_count", "readinglog_count", "ratings_count",
        "subjects", F.lit(version).alias("catalog_release"),
        F.lit(None).cast("string").alias("merged_into"), F.col("representative_edition_id").alias("representative"))
    editions = stage["editions"].select(
        F.col("id").alias("edition_id"), F.lit("openlibrary").alias("source"), F.col("ol_edition_id").alias("external_id"), "work_id", "title", "subtitle", "author",
        "publisher", "published_year", "isbn_13", "page_count", "cover_url", "language")
    result = dict(live)
    result["series"] = upsert(live["series"], series, ["series_id"]).withColumn("dissolved", F.coalesce("dissolved", F.lit(False)))
    result["works"] = upsert(live["works"], works, ["work_id"], keep=("representative", "source", "identity_provenance"))
    result["editions"] = upsert(live["editions"], editions, ["edition_id"], keep=("source", "external_id"))
    return result


def sync_members(members: DataFrame, series: DataFrame, stage_members: DataFrame) -> DataFrame:
    """Release series lose members the stage lacks, the stage's rows win, runtime series stay."""
    owned = series.filter("catalog_release IS NOT NULL").select("series_id")
    runtime = members.join(owned, "series_id", "left_anti")
    kept = runtime.join(stage_members.select("series_id", "work_id"), ["series_id", "work_id"], "left_anti")
    return kept.select(*members.columns).unionByName(stage_members.select(*members.columns))


def upsert_aliases(aliases: DataFrame, stage_aliases: DataFrame) -> DataFrame:
    """C06."""
    return aliases.join(stage_aliases.select("ol_work_id"), "ol_work_id", "left_anti").select("ol_work_id", "work_id").unionByName(
        stage_aliases.select("ol_work_id", "work_id"))


def move_tagged_threads(threads: DataFrame, old_rooms: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A work that changed rooms takes its tagged threads still in the old one; ``(threads, moved(thread_id))``."""
    changed = old_rooms.select("work_id", F.col("series_id").alias("old")).join(
        works.select("work_id", F.col("series_id").alias("new")), "work_id").filter("NOT (old <=> new)")
    joined = threads.join(changed, "work_id", "left").withColumn("moves", F.coalesce(F.col("series_id") == F.col("old"), F.lit(False)))
    return (joined.withColumn("series_id", F.when(F.col("moves"), F.col("new")).otherwise(F.col("series_id"))).select(*threads.columns),
            joined.filter("moves").select("thread_id"))


def merge_works(aliases: DataFrame, tables: Tables) -> Tables:
    """Fold every loser into its final survivor, with shelves, rooms, threads, editions and genre evidence."""
    return _merged(aliases, tables, ranked_faces(tables["editions"]))[0]


def _merged(aliases: DataFrame, tables: Tables, faces: DataFrame) -> tuple[Tables, DataFrame, DataFrame]:
    """C08 with the works' faces before it: ``(tables, faces after it, (loser, survivor))``. Editions are ranked once, by the work they had."""
    works, series, threads = tables["works"], tables["series"], tables["threads"]
    known = works.select("work_id")
    present = aliases.filter("loser <> survivor").join(known.withColumnRenamed("work_id", "loser"), "loser", "left_semi").join(
        known.withColumnRenamed("work_id", "survivor"), "survivor", "left_semi")
    flat = written(follow_aliases(present).filter("loser <> survivor").select("loser", "survivor"))
    room_of = works.select("work_id", "series_id")
    pairs = flat.join(room_of.select(F.col("work_id").alias("loser"), F.col("series_id").alias("from_room")), "loser").join(
        room_of.select(F.col("work_id").alias("survivor"), F.col("series_id").alias("to_room")), "survivor").join(
        series.select(F.col("series_id").alias("from_room"), F.col("kind").alias("from_kind")), "from_room", "left")
    leaving = pairs.filter("NOT (from_room <=> to_room)")
    emptied = leaving.filter("from_kind = 'singleton'").groupBy("from_room").agg(F.min(F.struct("loser", "survivor", "to_room")).alias("m")).select(
        F.col("from_room").alias("series_id"), F.col("m.loser").alias("book"), F.col("m.to_room").alias("new_room"))

    tagged = threads.join(emptied, "series_id", "left").withColumn("work_id", F.coalesce("work_id", "book")).drop("book", "new_room")
    rooms = leaving.select(F.col("loser").alias("work_id"), "to_room")
    moved = tagged.join(rooms, "work_id", "left").withColumn("series_id", F.coalesce("to_room", "series_id")).drop("to_room")

    mine = tables["shelves"].join(flat.withColumnRenamed("loser", "work_id"), "work_id", "left").withColumn("came_from", F.when(F.col("survivor").isNotNull(), F.col("work_id"))).withColumn(
        "work_id", F.coalesce("survivor", "work_id")).drop("survivor")
    rest = [c for c in tables["shelves"].columns if c not in ("user_id", "work_id")]
    first = F.min(F.struct(F.col("came_from").isNotNull().alias("guest"), "came_from", "created_at", "shelf_id", *[F.col(c).alias(f"v_{c}") for c in rest])).alias("s")
    shelves = mine.groupBy("user_id", "work_id").agg(first).select("user_id", "work_id", *[F.col(f"s.v_{c}").alias(c) for c in rest])

    editions = _follow(tables["editions"], "work_id", flat).select(*tables["editions"].columns)
    targets = flat.select(F.col("survivor").alias("work_id")).distinct()
    faces = _follow(faces, "work_id", flat).groupBy("work_id").agg(F.max("face").alias("face"))
    best = faces.join(targets, "work_id", "left_semi").select("work_id", F.col("face.edition_id").alias("best"))
    to_room = rooms.withColumnRenamed("to_room", "merged_room")
    heir = emptied.select("series_id", "new_room")
    placed = works.join(heir, "series_id", "left").withColumn("series_id", F.coalesce("new_room", "series_id")).join(to_room, "work_id", "left").withColumn(
        "series_id", F.coalesce("merged_room", "series_id")).join(flat.withColumnRenamed("loser", "work_id").withColumnRenamed("survivor", "gone_to"), "work_id", "left")
    buried = (
        join_sparse(placed, flat.select(F.col("loser").alias("merged_into"), F.col("survivor").alias("next")), "merged_into", "work_id").join(best, "work_id", "left")
        .withColumn("merged_into", F.coalesce("gone_to", "next", "merged_into"))
        .withColumn("representative", F.when(F.col("gone_to").isNull(), F.coalesce("best", "representative"))))
    votes, inferences, vetoes = merge_genre_evidence(flat, tables["votes"], tables["inferences"], tables["vetoes"])
    result = dict(tables)
    result.update(
        works=buried.select(*works.columns), editions=editions, shelves=shelves.select(*tables["shelves"].columns),
        threads=_follow(moved, "work_id", flat).select(*threads.columns), votes=votes, inferences=inferences, vetoes=vetoes,
        series=series.join(heir, "series_id", "left").withColumn("merged_into", F.coalesce("new_room", "merged_into")).select(*series.columns))
    return result, faces, flat


def _chained(first: DataFrame, second: DataFrame) -> DataFrame:
    """``(loser, survivor)`` of two merges in this order, so rows follow both by one join."""
    on = second.select(F.col("loser").alias("survivor"), F.col("survivor").alias("next"))
    return first.join(on, "survivor", "left").select("loser", F.coalesce("next", "survivor").alias("survivor")).unionByName(
        second.join(first.select("loser"), "loser", "left_anti").select("loser", "survivor"))


def retire_into(retired: DataFrame, tables: Tables) -> Tables:
    """Move the content of ``retired(room, survivor, book)`` into the survivors and tombstone the rooms.

    ``book`` is a singleton's one work: the room's untagged threads are tagged with it.
    """
    r = retired.select(F.col("room").alias("series_id"), "survivor", "book")
    result = dict(tables)
    result["threads"] = tables["threads"].join(r, "series_id", "left").withColumn("work_id", F.coalesce("work_id", "book")).withColumn(
        "series_id", F.coalesce("survivor", "series_id")).select(*tables["threads"].columns)
    result["works"] = tables["works"].join(r, "series_id", "left").withColumn("series_id", F.coalesce("survivor", "series_id")).select(*tables["works"].columns)
    follow = r.select(F.col("series_id").alias("merged_into"), F.col("survivor").alias("next"))
    series = tables["series"]
    result["series"] = join_sparse(series.join(r, "series_id", "left"), follow, "merged_into", "series_id").withColumn(
        "merged_into", F.coalesce("survivor", "next", "merged_into")).withColumn(
        "parent_id", F.when(F.col("survivor").isNull(), F.col("parent_id"))).select(*series.columns)
    return result


def _majority_room(former: DataFrame, works: DataFrame) -> DataFrame:
    """``former(room, work_id)`` to ``(room, survivor)``: where most of the works live now, then the least id."""
    now = former.join(works.select("work_id", "series_id"), "work_id").filter("series_id <> room").groupBy("room", "series_id").agg(F.count("*").alias("n"))
    return now.groupBy("room").agg(F.min_by("series_id", F.struct((-F.col("n")).alias("n"), "series_id")).alias("survivor"))


def _carried(retired: DataFrame, tables: Tables) -> DataFrame:
    """The threads that leave with retired rooms."""
    return tables["threads"].join(retired.select(F.col("room").alias("series_id")), "series_id", "left_semi").select("thread_id")


def retire_rooms(tables: Tables, former: DataFrame) -> tuple[Tables, DataFrame]:
    """Rooms of ``former(room, work_id)`` that hold no live work any more; ``(tables, retired)``."""
    live = tables["works"].filter("merged_into IS NULL").select(F.col("series_id").alias("room"))
    dead = tables["series"].filter("merged_into IS NOT NULL").select(F.col("series_id").alias("room"))
    empty = former.join(live, "room", "left_anti").join(dead, "room", "left_anti")
    retired = materialize(_majority_room(empty, tables["works"]).withColumn("book", F.lit(None).cast(dict(tables["works"].dtypes)["work_id"])))
    return retire_into(retired, tables), retired


def settle_absent(tables: Tables, stage: Tables, version: str, old_rooms: DataFrame) -> tuple[Tables, DataFrame]:
    """Rows of earlier releases the new one lacks: merged by alias, kept when referenced, else deleted; ``(tables, stats)``."""
    return _settled(tables, stage, version, old_rooms, ranked_faces(tables["editions"]))[:2]


def _settled(tables: Tables, stage: Tables, version: str, old_rooms: DataFrame, faces: DataFrame) -> tuple[Tables, DataFrame, DataFrame]:
    """C10 with the works' faces before it: ``(tables, stats, (loser, survivor))``."""
    works, series = tables["works"], tables["series"]
    alias = stage["work_aliases"].select(F.col("ol_work_id").alias("external_id"), F.col("work_id").alias("alias_target"))
    absent = works.filter((F.col("catalog_release") != version) & F.col("merged_into").isNull()).join(
        stage["works"].select(F.col("id").alias("work_id")), "work_id", "left_anti").join(alias, "external_id", "left")
    used = tables["threads"].select("work_id").union(tables["shelves"].select("work_id")).filter("work_id IS NOT NULL").distinct().withColumn("used", F.lit(True))
    fate = written(absent.join(used, "work_id", "left").select("work_id", "alias_target", F.when(F.col("alias_target").isNotNull(), "merge").when(
        F.col("used"), "keep").otherwise("delete").alias("fate")))
    merged, _, flat = _merged(fate.filter("fate = 'merge'").select(F.col("work_id").alias("loser"), F.col("alias_target").alias("survivor")), tables, faces)
    doomed = fate.filter("fate = 'delete'").select("work_id")
    kept_works = join_sparse(merged["works"].join(doomed, "work_id", "left_anti"), doomed.withColumnRenamed("work_id", "merged_into"), "merged_into", "work_id", "left_anti")
    merged["works"] = written(kept_works.select(*works.columns))

    gone = merged["series"].filter((F.col("catalog_release") != version) & F.col("merged_into").isNull()).join(
        stage["series"].select(F.col("id").alias("series_id")), "series_id", "left_anti").select("series_id", "kind")
    held = merged["works"].select("series_id").union(merged["threads"].select("series_id")).filter("series_id IS NOT NULL").distinct()
    unused = materialize(gone.join(held, "series_id", "left_anti").select("series_id"))
    shadow = merged["series"].join(unused.withColumnRenamed("series_id", "merged_into"), "merged_into", "left_semi").join(held, "series_id", "left_anti").select("series_id")
    merged["series"] = merged["series"].join(unused.union(shadow), "series_id", "left_anti").select(*series.columns)
    left = gone.join(held, "series_id", "left_semi").select(F.col("series_id").alias("room"), "kind")
    former = old_rooms.select("work_id", F.col("series_id").alias("room")).join(left, "room", "left_semi")
    alone = former.groupBy("room").agg(F.count("*").alias("n"), F.min("work_id").alias("only"))
    retired = materialize(_majority_room(former, merged["works"]).join(alone, "room").join(left, "room").select(
        "room", "survivor", F.when((F.col("kind") == "singleton") & (F.col("n") == 1), F.col("only")).alias("book")))
    result = retire_into(retired, merged)
    carried = materialize(_carried(retired, merged))
    stats = metrics(fate, kept_works=F.count_if(F.col("fate") == "keep"), deleted_works=F.count_if(F.col("fate") == "delete"),
                    merged_works=F.count_if(F.col("fate") == "merge")).unionByName(
        metrics(unused, deleted_series=F.count("*"))).unionByName(metrics(retired, retired_series=F.count("*"))).unionByName(
        metrics(carried, moved_threads=F.count("*")))
    return result, stats, flat


class OlderRelease(RuntimeError):
    """The release is older than one already loaded."""


def load_release(live: Tables, stage: Tables, version: str, phrases: DataFrame, genres: DataFrame, force: bool = False) -> tuple[Tables, DataFrame]:
    """C11: the whole load; ``(live tables, stats(metric, value))``. The same version is a no-op, an older one is refused.

    ``live['releases'](version)`` holds what was loaded; ``genres(genre_id, slug, parent_id, retired)`` the taxonomy.
    The tables returned hold the genre summary after all merges and inferences.
    """
    spark = live["works"].sparkSession
    loaded = live["releases"]
    state = loaded.agg(F.max(F.col("version") == version).alias("same"), F.max(version_key(F.col("version")) > version_key(F.lit(version))).alias("newer")).first()
    if state["same"]:
        return live, spark.createDataFrame([("noop", 1)], "metric string, value bigint")
    if state["newer"] and not force:
        raise OlderRelease(f"{version} is older than a loaded release")
    staged_works, staged_rows = stage_release(stage, phrases)
    staged_works = written(staged_works)
    before = live["series"].select("series_id", "slug")
    tables = dict(live)
    tables["series"] = reslug_collisions(live["series"], stage["series"])
    adopted = written(adoptions(live["works"], stage["works"], stage["work_aliases"]))
    former = live["works"].join(adopted, F.col("work_id") == F.col("runtime")).select(F.col("series_id").alias("room"), F.col("target").alias("work_id"))
    old_rooms = written(live["works"].filter("catalog_release IS NOT NULL").select("work_id", "series_id"))
    freed = adopted.select(F.col("runtime").alias("work_id"), F.lit(True).alias("freed"))
    tables["works"] = live["works"].join(freed, "work_id", "left").withColumn(
        "external_id", F.when(F.col("freed"), F.concat(F.lit("merged:"), F.replace("work_id", F.lit("-"), F.lit("")))).otherwise(F.col("external_id"))).select(*live["works"].columns)
    reslugged = tables["series"].select("series_id", F.col("slug").alias("now")).join(before, "series_id").filter("now <> slug")
    tables = upsert_catalog(tables, stage, version)
    editions = tables["editions"] = written(tables["editions"])
    faces = written(ranked_faces(editions))  # two merges choose from them
    tables["members"] = sync_members(live["members"], tables["series"], stage["series_members"])
    tables["aliases"] = upsert_aliases(live["aliases"], stage["work_aliases"])
    tables["threads"], moved = move_tagged_threads(live["threads"], old_rooms, tables["works"])
    for name in ("works", "series", "threads"):
        tables[name] = written(tables[name])
    tables, faces, adopting = _merged(adopted.select(F.col("runtime").alias("loser"), F.col("target").alias("survivor")), tables, faces)
    for name in ("works", "series", "threads"):
        tables[name] = written(tables[name])
    threads = tables["threads"]
    tables, retired = retire_rooms(tables, written(former))
    carried = _carried(retired, {"threads": threads})
    tables, settled, settling = _settled(tables, stage, version, old_rooms, faces)
    tables["editions"] = _follow(editions, "work_id", _chained(adopting, settling)).select(*editions.columns)
    slugs = staged_works.select(F.col("id").alias("work_id"), F.explode("genre_slugs").alias("slug"))
    tables["inferences"] = replace_inferences(tables["inferences"], slugs, staged_works.select(F.col("id").alias("work_id")), genres, "catalog")
    tables["releases"] = loaded.select("version").unionByName(spark.createDataFrame([(version,)], "version string"))
    votes, vetoes = tables["votes"], live_vetoes(tables["vetoes"])
    tables["summary"] = genre_summary(votes, tables["inferences"], genres, vetoes, tables["works"])
    stats = (
        metrics(reslugged, reslugged=F.count("*")).unionByName(metrics(adopted, adopted=F.count("*"))).unionByName(metrics(moved, moved_threads=F.count("*")))
        .unionByName(metrics(carried, moved_threads=F.count("*"))).unionByName(metrics(retired, retired_series=F.count("*"))).unionByName(settled)
        .unionByName(staged_rows.select(F.concat(F.lit("rows_"), "table").alias("metric"), F.col("rows").alias("value"))))
    return tables, stats.groupBy("metric").agg(F.sum("value").alias("value"))


def merge_preview(pairs: DataFrame, tables: Tables) -> DataFrame:
    """``pairs(source, target)`` with what a merge would move and both sides' counts."""
    works, threads = tables["works"], tables["threads"]
    rooms = works.select("work_id", "series_id").join(tables["series"].select("series_id", "kind"), "series_id", "left")
    tagged = threads.filter("work_id IS NOT NULL").groupBy("work_id").agg(F.count("*").alias("tagged"))
    untagged = threads.filter("work_id IS NULL").groupBy("series_id").agg(F.count("*").alias("untagged"))

    def counted(name: str, out: str) -> DataFrame:
        return tables[name].filter("work_id IS NOT NULL").groupBy("work_id").agg(F.count("*").alias(out))

    side = rooms.join(tagged, "work_id", "left").join(untagged, "series_id", "left").join(counted("shelves", "shelves"), "work_id", "left").join(
        counted("editions", "editions"), "work_id", "left").join(counted("votes", "genre_votes"), "work_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tagged", "untagged", "shelves", "editions", "genre_votes")}
    side = side.select("work_id", "series_id", "kind", *[v.alias(c) for c, v in zero.items()])
    named = {p: side.select(*[F.col(c).alias(f"{p}_{c}") for c in side.columns]) for p in ("source", "target")}
    both = pairs.filter("source <> target").join(named["source"], F.col("source") == F.col("source_work_id")).join(
        named["target"], F.col("target") == F.col("target_work_id"))

    def own(p: str) -> Column:
        return F.col(f"{p}_tagged") + F.when(F.col(f"{p}_kind") == "singleton", F.col(f"{p}_untagged")).otherwise(0)

    carried = F.when((F.col("source_kind") == "singleton") & ~F.col("source_series_id").eqNullSafe(F.col("target_series_id")), F.col("source_untagged")).otherwise(0)
    return both.select(
        "source", "target", (F.col("source_tagged") + carried).alias("threads"), F.col("source_shelves").alias("shelves"),
        F.col("source_editions").alias("editions"), F.col("source_genre_votes").alias("genre_votes"), own("source").alias("source_threads"),
        own("target").alias("target_threads"), F.col("target_shelves").alias("target_shelves"), F.col("target_editions").alias("target_editions"))
