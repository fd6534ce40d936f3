"""Threads, posts, votes and shelves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranking import two_level_rank


def vote_scores(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``log(event_id, ts, user_id, target_id, value)``; the last value per reader and target wins, 0 clears."""
    last = log.groupBy("user_id", "target_id").agg(F.max_by("value", F.struct("ts", "event_id")).cast("int").alias("value"))
    scores = last.groupBy("target_id").agg(F.sum("value").cast("int").alias("score"))
    return last.filter("value <> 0"), scores


def thread_summaries(threads: DataFrame, users: DataFrame, genres: DataFrame, posts: DataFrame, votes: DataFrame,
                     room=None, genre=None, work=None, user=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A room's live threads by score (then id), each with its count of live posts and the caller's vote.

    The room is filtered first, so posts and votes are reduced to its threads before they are counted.
    """
    kept = threads.filter("NOT deleted")
    for column, value in (("series_id", room), ("genre_id", genre), ("work_id", work)):
        if value is not None:
            kept = kept.filter(F.col(column) == value)
    page = kept.join(users.select("user_id", F.col("username").alias("author")), "user_id").orderBy(
        F.desc("score"), "thread_id").offset(offset).limit(limit)
    counted = posts.filter("NOT deleted").join(page.select("thread_id"), "thread_id", "left_semi").groupBy("thread_id").agg(
        F.count("*").alias("post_count"))
    mine = votes.filter(F.col("user_id") == user if user is not None else F.lit(False)).select(
        F.col("target_id").alias("thread_id"), F.col("value").alias("my_vote"))
    return (
        page.join(genres.select("genre_id", F.col("slug").alias("genre_slug")), "genre_id", "left")
        .join(counted, "thread_id", "left").join(mine, "thread_id", "left")
        .select("thread_id", "title", "score", "work_id", "author", "genre_slug",
                F.coalesce("post_count", F.lit(0)).alias("post_count"), F.coalesce("my_vote", F.lit(0)).alias("my_vote"))
        .orderBy(F.desc("score"), "thread_id"))


def mask_deleted(df: DataFrame, texts: tuple[str, ...] = ("content",), hidden: tuple[str, ...] = ("user_id", "author")) -> DataFrame:
    """Deleted rows keep ids and score but lose text, author and user."""
    for name in texts:
        df = df.withColumn(name, F.when(F.col("deleted"), F.lit("")).otherwise(F.col(name)))
    for name in hidden:
        if name in df.columns:
            df = df.withColumn(name, F.when(~F.col("deleted"), F.col(name)))
    return df


def reply_tree(posts: DataFrame, users: DataFrame, votes: DataFrame, user=None) -> DataFrame:
    """Every shown post with its root and the sort keys of the two-level tree.

    A thread may hold most of all posts, so the tree is rows to be read in the
    order (thread_id, root_seq, root_id, depth, seq, post_id), never one nested value.
    """
    above = posts.select(F.col("post_id").alias("parent_id"), "thread_id", F.col("seq").alias("parent_seq"), F.lit(True).alias("held"))
    placed = posts.join(above, ["parent_id", "thread_id"], "left").select(
        "thread_id", F.when(F.col("held"), F.col("parent_id")).otherwise(F.col("post_id")).alias("root_id"), "post_id",
        F.when(F.col("held"), 1).otherwise(0).alias("depth"), F.coalesce("parent_seq", "seq").alias("root_seq"), "seq",
        "user_id", "content", "deleted")
    live_replies = placed.filter("depth = 1 AND NOT deleted")
    support = live_replies.select(F.col("root_id").alias("post_id")).distinct().withColumn("supports", F.lit(True))
    roots = placed.filter("depth = 0").join(support, "post_id", "left").filter("NOT deleted OR supports").drop("supports")
    mine = votes.filter(F.col("user_id") == user if user is not None else F.lit(False)).select(
        F.col("target_id").alias("post_id"), F.col("value").alias("my_vote"))
    shown = roots.unionByName(live_replies).join(users.select("user_id", F.col("username").alias("author")), "user_id", "left").join(
        mine, "post_id", "left").withColumn("my_vote", F.coalesce("my_vote", F.lit(0)))
    return mask_deleted(shown)


def apply_deletes(log: DataFrame, threads: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Author-only deletions and edits, decided set-wise by event order.

    ``log(event_id, ts, user_id, action, target_id, content)`` with actions delete_thread, delete_post and edit_post;
    returns ``(threads, posts, refusals(event_id, reason))``.
    """
    at = F.struct("ts", "event_id")
    owned_threads = threads.select(F.col("thread_id").alias("target_id"), F.col("user_id").alias("owner"), F.col("deleted").alias("was_deleted"))
    owned_posts = posts.select(F.col("post_id").alias("target_id"), F.col("user_id").alias("owner"), F.col("deleted").alias("was_deleted"))
    on_threads = log.filter("action = 'delete_thread'").join(owned_threads, "target_id")
    on_posts = log.filter("action <> 'delete_thread'").join(owned_posts, "target_id")
    strangers = on_threads.filter("user_id <> owner").select("event_id").unionByName(
        on_posts.filter("user_id <> owner").select("event_id")).withColumn("reason", F.lit("not_author"))

    gone = on_threads.filter("user_id = owner AND NOT was_deleted").groupBy(F.col("target_id").alias("thread_id")).agg(F.min(at).alias("gone_at"))
    openers = posts.filter("parent_id IS NULL").groupBy("thread_id").agg(
        F.min(F.struct("seq", "post_id", "user_id", "deleted")).alias("opener"))
    cascade = gone.join(openers, "thread_id").join(threads.select("thread_id", "user_id"), "thread_id").filter(
        "opener.user_id = user_id AND NOT opener.deleted").select(F.col("opener.post_id").alias("post_id"), "gone_at")
    own = on_posts.filter("user_id = owner AND NOT was_deleted")
    asked = own.filter("action = 'delete_post'").select(F.col("target_id").alias("post_id"), at.alias("gone_at"))
    dead = asked.unionByName(cascade).groupBy("post_id").agg(F.min("gone_at").alias("gone_at"))

    edits = on_posts.filter("action = 'edit_post' AND user_id = owner").join(
        dead.withColumnRenamed("post_id", "target_id"), "target_id", "left").withColumn(
        "late", F.col("was_deleted") | F.coalesce(F.col("gone_at") < at, F.lit(False)))
    refusals = strangers.unionByName(edits.filter("late").select("event_id", F.lit("already_deleted").alias("reason")))
    kept = edits.filter("NOT late").groupBy(F.col("target_id").alias("post_id")).agg(
        F.max_by("content", at).alias("new_content"), F.max("ts").alias("edited_at"))

    new_threads = threads.join(gone, "thread_id", "left").withColumn(
        "title", F.when(F.col("gone_at").isNotNull(), F.lit("")).otherwise(F.col("title"))).withColumn(
        "deleted", F.col("deleted") | F.col("gone_at").isNotNull()).drop("gone_at")
    new_posts = posts.join(dead, "post_id", "left").join(kept, "post_id", "left").withColumn(
        "content", F.when(F.col("gone_at").isNotNull(), F.lit("")).otherwise(F.coalesce("new_content", "content"))).withColumn(
        "deleted", F.col("deleted") | F.col("gone_at").isNotNull()).drop("gone_at", "new_content")
    return new_threads, new_posts, refusals


def place_threads(requests: DataFrame, works: DataFrame, series: DataFrame, genres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``requests(event_id, user_id, title, work_id, series_id, genre_slug)`` to new thread rows and refusals.

    ``works(work_id, merged_into, series_id)``, ``series(series_id, dissolved)``, ``genres(genre_id, slug, parent_id, retired)``.
    """
    live = works.select(F.col("work_id").alias("live_id"), F.col("series_id").alias("work_room"))
    target = works.select("work_id", F.coalesce("merged_into", "work_id").alias("live_id"))
    rooms = series.select("series_id", "dissolved")
    kinds = genres.select(F.col("slug").alias("genre_slug"), "genre_id", F.col("parent_id").alias("genre_parent"), "retired")
    joined = (
        requests.join(target, "work_id", "left").join(live, "live_id", "left").join(rooms, "series_id", "left")
        .join(kinds, "genre_slug", "left"))
    in_room = F.col("series_id").isNotNull()
    reason = (
        F.when(in_room & F.col("dissolved").isNull(), "unknown_series").when(in_room & F.col("dissolved"), "dissolved")
        .when(in_room & F.col("work_id").isNotNull() & ~F.coalesce(F.col("work_room") == F.col("series_id"), F.lit(False)), "not_in_series")
        .when(~in_room & F.col("genre_slug").isNotNull() & F.col("genre_id").isNull(), "unknown_genre")
        .when(~in_room & F.col("genre_parent").isNotNull(), "subgenre")
        .when(~in_room & F.col("retired"), "retired_genre")
        .when(~in_room & F.col("work_id").isNotNull() & F.col("live_id").isNull(), "unknown_work")
        .when(~in_room & (F.col("work_id").isNull() == F.col("genre_slug").isNull()), "no_single_home"))
    judged = joined.withColumn("reason", reason)
    rows = judged.filter("reason IS NULL").select(
        "event_id", "user_id", "title", F.coalesce("series_id", "work_room").alias("series_id"), F.col("live_id").alias("work_id"),
        F.when(~in_room, F.col("genre_id")).alias("genre_id"))
    return rows, judged.filter("reason IS NOT NULL").select("event_id", "reason")


def place_replies(requests: DataFrame, threads: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """D06, reply half: replies go to live top-level posts of live threads."""
    t = threads.select("thread_id", F.col("deleted").alias("thread_gone"))
    p = posts.select(F.col("post_id").alias("parent_id"), F.col("deleted").alias("parent_gone"),
                     F.col("parent_id").alias("grandparent_id"), F.lit(True).alias("parent_known"))
    judged = requests.join(t, "thread_id", "left").join(p, "parent_id", "left").withColumn(
        "reason", F.when(F.col("thread_gone").isNull(), "unknown_thread").when(F.col("thread_gone"), "thread_deleted")
        .when(F.col("parent_id").isNotNull() & F.col("parent_known").isNull(), "unknown_parent")
        .when(F.col("parent_gone"), "parent_deleted").when(F.col("grandparent_id").isNotNull(), "too_deep"))
    return (judged.filter("reason IS NULL").select(*requests.columns),
            judged.filter("reason IS NOT NULL").select("event_id", "reason"))


def apply_shelf_log(log: DataFrame, shelves: DataFrame, works: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``log(event_id, ts, user_id, work_id, action, status)`` with add, update and remove.

    Whether a book stands on a shelf depends only on the last add or remove
    before an event, accepted or not, so running windows decide every event.
    """
    moved = log.join(works.select("work_id", F.coalesce("merged_into", "work_id").alias("live_id")), "work_id").select(
        "user_id", F.col("live_id").alias("work_id"), F.lit(1).alias("phase"), "ts", "event_id", "action", "status")
    had = shelves.select("user_id", "work_id", F.lit(0).alias("phase"), F.lit(None).cast("timestamp").alias("ts"),
                         F.lit(None).cast("bigint").alias("event_id"), F.lit("add").alias("action"), "status")
    rows = had.unionByName(moved)
    key = W.partitionBy("user_id", "work_id").orderBy("phase", "ts", "event_id")
    past = key.rowsBetween(W.unboundedPreceding, -1)
    toggle = F.when(F.col("action").isin("add", "remove"), F.col("action"))
    present = F.coalesce(F.last(toggle, ignorenulls=True).over(past) == "add", F.lit(False))
    judged = rows.withColumn("present", present).withColumn("reason", F.when(
        (F.col("action") == "add") & F.col("present"), "conflict").when(
        F.col("action").isin("update", "remove") & ~F.col("present"), "missing"))
    refusals = judged.filter("reason IS NOT NULL").select("event_id", "reason")
    last = judged.filter("reason IS NULL").groupBy("user_id", "work_id").agg(
        F.max(F.struct("phase", "ts", "event_id", "action", "status")).alias("last"))
    return last.filter("last.action <> 'remove'").select("user_id", "work_id", F.col("last.status").alias("status")), refusals


def profile_shelves(shelves: DataFrame, works: DataFrame) -> DataFrame:
    """Each reader's works per status, newest first, as ranked rows."""
    rows = shelves.join(works.select("work_id", "title"), "work_id")
    return two_level_rank(rows, ["user_id", "status"], F.to_date("created_at"),
                          [F.desc("created_at"), F.desc("shelf_id")], descending=True).select(
        "user_id", "status", "rank", "work_id", "title")


def collapse_shelves(shelves: DataFrame) -> DataFrame:
    """The oldest row per reader and work, by a combined aggregation."""
    rest = [c for c in shelves.columns if c not in ("user_id", "work_id", "created_at", "shelf_id")]
    oldest = F.min(F.struct("created_at", "shelf_id", *rest)).alias("oldest")
    return shelves.groupBy("user_id", "work_id").agg(oldest).select("user_id", "work_id", "oldest.*")


def carry_links(links: DataFrame, editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links move from an edition to its work; ``(rows, stranded)``."""
    owner = editions.select("edition_id", F.col("work_id").alias("owner"))
    moved = links.join(owner, "edition_id", "left").withColumn("work_id", F.coalesce("work_id", "owner")).drop("owner")
    return moved, moved.filter("edition_id IS NOT NULL AND work_id IS NULL")


def first_genre_per_work(editions: DataFrame) -> DataFrame:
    """D11."""
    return editions.filter("work_id IS NOT NULL AND genre_id IS NOT NULL").groupBy("work_id").agg(F.min("genre_id").alias("genre_id"))


def legacy_genre_rows(works: DataFrame, inferences: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``works(work_id, merged_into, genre_id)`` become inference rows and inferred summary rows."""
    rows = works.filter("genre_id IS NOT NULL").select("work_id", "genre_id", F.lit("open_library").alias("source"))
    new_inferences = inferences.unionByName(rows.join(inferences, ["work_id", "genre_id", "source"], "left_anti"))
    marks = works.filter("genre_id IS NOT NULL AND merged_into IS NULL").select("work_id", "genre_id", F.lit(True).alias("mark"))
    merged = summary.join(marks, ["work_id", "genre_id"], "full").select(
        "work_id", "genre_id", F.coalesce("direct_votes", F.lit(0)).alias("direct_votes"), F.coalesce("score", F.lit(0)).alias("score"),
        (F.coalesce("inferred", F.lit(False)) | F.coalesce("mark", F.lit(False))).alias("inferred"),
        F.coalesce("vetoed", F.lit(False)).alias("vetoed"))
    return new_inferences, merged
