"""Genres on works: inference, readers' votes, roll-up and the effective rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.folds import ordered_fold
from foliant.session import materialize

# --- fixed values ----------------------------------------------------------------
MAX_GENRES_PER_READER = 5
TOP_GENRES = 3
ANY_PREFIX = r"(?i)^\s*[a-z_]+\s*:"
GENRE_PREFIX = r"(?i)^\s*genre\s*:"
STRONG_SOURCES = ("open_library", "catalog")
# -----------------------------------------------------------------------------------


def flatten_taxonomy(rules: DataFrame) -> DataFrame:
    """``rules(position, slug, name, match[], exclude[], children[])`` to one row per genre."""
    def phrases(column):
        return F.transform(F.coalesce(column, F.array().cast("array<string>")), T.normalize_text)

    parents = rules.select(
        "slug", F.trim("name").alias("name"), F.lit(None).cast("string").alias("parent"), F.col("position").cast("int").alias("position"),
        phrases(F.col("match")).alias("match"), phrases(F.col("exclude")).alias("exclude"))
    below = rules.select(F.col("slug").alias("parent"), F.posexplode("children").alias("position", "child"))
    children = below.select(
        F.col("child.slug").alias("slug"), F.trim("child.name").alias("name"), "parent", "position",
        phrases(F.col("child.match")).alias("match"), phrases(F.col("child.exclude")).alias("exclude"))
    return parents.unionByName(children)


def taxonomy_phrases(flat: DataFrame) -> DataFrame:
    """``(slug, kind, phrase)`` rows of a flattened taxonomy."""
    return flat.select("slug", F.lit("match").alias("kind"), F.explode("match").alias("phrase")).unionByName(
        flat.select("slug", F.lit("exclude").alias("kind"), F.explode("exclude").alias("phrase")))


def infer_genres(subjects: DataFrame, phrases: DataFrame) -> DataFrame:
    """``subjects(work_id, subject)`` to ``(work_id, slug)``.

    Only distinct subject texts are matched. A phrase is looked up by its first
    word, so the match is an equi-join and never every subject against every phrase.
    """
    s = F.col("subject")
    tier = F.when(s.rlike(GENRE_PREFIX), 1).when(~s.rlike(ANY_PREFIX), 2)
    lines = subjects.select("work_id", tier.alias("tier"), F.regexp_replace(s, GENRE_PREFIX, "").alias("raw")).filter("tier IS NOT NULL")
    texts = lines.select("raw").distinct().withColumn("text", T.normalize_text(F.col("raw"))).filter("text <> ''")
    words = texts.select("raw", "text", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    keyed = phrases.select("slug", "kind", T.normalize_text(F.col("phrase")).alias("phrase")).filter("phrase <> ''").withColumn(
        "word", F.substring_index("phrase", " ", 1))
    holds = F.contains(F.concat(F.lit(" "), F.col("text"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" ")))
    hits = words.join(keyed, "word").filter(holds).groupBy("raw", "slug").agg(
        F.bool_or(F.col("kind") == "match").alias("hit"), F.bool_or(F.col("kind") == "exclude").alias("barred"))
    found = lines.join(hits.filter("hit AND NOT barred").select("raw", "slug"), "raw").groupBy("work_id", "slug").agg(F.min("tier").alias("tier"))
    best = F.min("tier").over(W.partitionBy("work_id"))  # a work's own genres
    return found.withColumn("best", best).filter("tier = best").select("work_id", "slug")


def sync_taxonomy(old: DataFrame, new: DataFrame, threads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(genres, changes(slug, change), violations(slug, problem))``.

    ``old``/``new`` hold (slug, name, parent, position), ``old`` also ``retired``; ``threads(slug)`` one row per thread.
    """
    o = old.select("slug", F.struct("name", "parent", "position", "retired").alias("o"))
    n = new.select("slug", F.struct("name", "parent", "position").alias("n"))
    both = o.join(n, "slug", "full")
    fields = F.array_compact(F.array(
        *[F.when(~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}")), F.lit(label)) for f, label in
          (("name", "name"), ("parent", "parent_id"), ("position", "position"))],
        F.when(F.col("o.retired"), F.lit("unretired"))))
    change = (
        F.when(F.col("o").isNull(), F.concat(F.lit("+ "), F.col("slug")))
        .when(F.col("n").isNull(), F.when(~F.col("o.retired"), F.concat(F.lit("- retired "), F.col("slug"))))
        .when(F.size(fields) > 0, F.concat(F.lit("~ "), F.col("slug"), F.lit(" ("), F.array_join(fields, ", "), F.lit(")"))))
    changes = both.select("slug", change.alias("change")).filter("change IS NOT NULL")
    kept = F.coalesce(F.col("n"), F.struct("o.name", "o.parent", "o.position"))
    genres = both.select("slug", kept.alias("kept_row"), F.col("n").isNull().alias("retired")).select("slug", "kept_row.*", "retired")
    stranded = both.filter("o IS NOT NULL AND o.parent IS NULL AND n.parent IS NOT NULL").join(threads, "slug", "left_semi")
    violations = stranded.select("slug", F.lit("has discussion threads and cannot become a subgenre").alias("problem"))
    return genres, changes, violations


def replace_inferences(old: DataFrame, new: DataFrame, scope: DataFrame, genres: DataFrame, source: str) -> DataFrame:
    """Swap one source's rows for the works in ``scope``; ``new(work_id, slug)``."""
    live = genres.filter("NOT retired").select("slug", "genre_id")
    added = new.join(scope.select("work_id"), "work_id", "left_semi").join(live, "slug").select(
        "work_id", "genre_id", F.lit(source).alias("source")).distinct()
    replaced = scope.select("work_id").distinct().withColumn("source", F.lit(source))
    return old.join(replaced, ["work_id", "source"], "left_anti").select("work_id", "genre_id", "source").unionByName(added).distinct()


def category_inferences(inferences: DataFrame, categories: DataFrame, phrases: DataFrame, genres: DataFrame) -> DataFrame:
    """The weak source speaks only for works the strong ones said nothing about."""
    strong = inferences.filter(F.col("source").isin(*STRONG_SOURCES)).select("work_id")
    open_works = materialize(categories.select("work_id").distinct().join(strong, "work_id", "left_anti"))
    open_categories = categories.join(open_works, "work_id", "left_semi")
    return replace_inferences(inferences, infer_genres(open_categories.withColumnRenamed("category", "subject"), phrases),
                              open_works, genres, "google")


def live_vetoes(vetoes: DataFrame) -> DataFrame:
    return vetoes.filter("NOT reverted").select("work_id", "genre_id").distinct()


def genre_summary(votes: DataFrame, inferences: DataFrame, genres: DataFrame, vetoes: DataFrame, works: DataFrame,
                  ids: DataFrame | None = None) -> DataFrame:
    """One row per (work, genre) with direct votes, rolled-up score, inferred and vetoed flags.

    ``vetoes(work_id, genre_id)`` are the live ones. ``ids`` restricts every input the same way, so a
    partial recompute equals the same rows of a full one.
    """
    def scoped(df: DataFrame) -> DataFrame:
        return df if ids is None else df.join(ids.select("work_id").distinct(), "work_id", "left_semi")

    votes, inferences, vetoes = scoped(votes), scoped(inferences), scoped(vetoes.select("work_id", "genre_id").distinct())
    up = genres.filter("parent_id IS NOT NULL").select("genre_id", "parent_id")

    def rolled(df: DataFrame) -> DataFrame:
        return df.join(vetoes, ["work_id", "genre_id"], "left_anti").join(up, "genre_id").drop("genre_id").withColumnRenamed(
            "parent_id", "genre_id")

    ballot = votes.select("work_id", "genre_id", "user_id")
    credits = ballot.withColumn("direct", F.lit(1)).unionByName(rolled(ballot).withColumn("direct", F.lit(0)))
    # one row per reader first: the hot (work, genre) is combined before the last shuffle
    per_reader = credits.groupBy("work_id", "genre_id", "user_id").agg(F.sum("direct").alias("direct"))
    scores = per_reader.groupBy("work_id", "genre_id").agg(
        F.count("*").cast("int").alias("score"), F.sum("direct").cast("int").alias("direct_votes"))
    implied = inferences.select("work_id", "genre_id")
    inferred = implied.unionByName(rolled(implied).select("work_id", "genre_id")).distinct()
    # one aggregation instead of three outer joins: every input becomes a flagged row
    rows = (
        scores.select("work_id", "genre_id", "direct_votes", "score", F.lit(False).alias("inferred"), F.lit(False).alias("vetoed"))
        .unionByName(inferred.select("work_id", "genre_id", F.lit(0).alias("direct_votes"), F.lit(0).alias("score"),
                                     F.lit(True).alias("inferred"), F.lit(False).alias("vetoed")))
        .unionByName(vetoes.select("work_id", "genre_id", F.lit(0).alias("direct_votes"), F.lit(0).alias("score"),
                                   F.lit(False).alias("inferred"), F.lit(True).alias("vetoed"))))
    merged = rows.groupBy("work_id", "genre_id").agg(
        F.max("direct_votes").alias("direct_votes"), F.max("score").alias("score"),
        F.bool_or("inferred").alias("inferred"), F.bool_or("vetoed").alias("vetoed"))
    return merged.join(works.filter("merged_into IS NULL").select("work_id"), "work_id", "left_semi")


def _vote_step(state: dict, row) -> list[tuple]:
    if row.action == "have":
        state["votes"].setdefault(row.genre_id, bool(row.counts))
    elif row.action == "unvote":
        state["votes"].pop(row.genre_id, None)
    elif row.genre_id not in state["votes"]:
        if sum(state["votes"].values()) >= MAX_GENRES_PER_READER:
            return [("refused", row.event_id, row.user_id, row.work_id, row.genre_id, "cap")]
        state["votes"][row.genre_id] = True
    return []


def _vote_finish(key: tuple, state: dict) -> list[tuple]:
    return [("vote", None, key[0], key[1], genre, None) for genre in state["votes"]]


def apply_genre_votes(log: DataFrame, works: DataFrame, genres: DataFrame, vetoes: DataFrame,
                      existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(votes(user_id, work_id, genre_id), refusals(event_id, reason))``.

    ``log(event_id, ts, user_id, work_id, genre_id, action)``, ``works(work_id, merged_into, kind)``. Refusals
    that no earlier action can change are decided set-wise; only the cap needs the order.
    """
    target = works.select("work_id", F.coalesce("merged_into", "work_id").alias("live_id"))
    kinds = works.select(F.col("work_id").alias("live_id"), "kind")
    barred = vetoes.select(F.col("work_id").alias("live_id"), "genre_id", F.lit(True).alias("vetoed")).distinct()
    placed = log.join(target, "work_id").join(kinds, "live_id").join(
        genres.select("genre_id", "retired"), "genre_id").join(barred, ["live_id", "genre_id"], "left")
    reason = F.when(F.col("action") == "vote", F.when(F.col("kind") == "collection", "collection").when(
        F.col("retired"), "retired").when(F.col("vetoed"), "vetoed"))
    judged = placed.withColumn("reason", reason)
    rows = judged.filter("reason IS NULL").select(
        "user_id", F.col("live_id").alias("work_id"), F.lit(1).alias("phase"), "ts", "event_id", "genre_id", "action",
        F.lit(True).alias("counts"))
    if existing is not None:
        had = existing.join(genres.select("genre_id", "retired"), "genre_id").join(
            barred.withColumnRenamed("live_id", "work_id"), ["work_id", "genre_id"], "left")
        rows = rows.unionByName(had.select(
            "user_id", "work_id", F.lit(0).alias("phase"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("bigint").alias("event_id"),
            "genre_id", F.lit("have").alias("action"), (~F.col("retired") & F.col("vetoed").isNull()).alias("counts")))
    user_type, work_type = dict(log.dtypes)["user_id"], dict(log.dtypes)["work_id"]
    # Up to the cap's number of genres on a book, the last action on a genre decides; only readers beyond it need the order.
    rows = materialize(rows)
    last = rows.groupBy("user_id", "work_id", "genre_id").agg(
        F.max_by("action", F.struct("phase", "ts", "event_id")).alias("last"), F.bool_or(F.col("action") != "unvote").alias("asked"))
    last = materialize(last)
    wide = last.filter("asked").groupBy("user_id", "work_id").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_GENRES_PER_READER).select("user_id", "work_id")
    settled = last.filter("last <> 'unvote'").join(wide, ["user_id", "work_id"], "left_anti").select("user_id", "work_id", "genre_id")
    folded = ordered_fold(
        rows.join(wide, ["user_id", "work_id"], "left_semi").select("user_id", "work_id", "phase", "ts", "event_id", "genre_id", "action", "counts"),
        ["user_id", "work_id"], ["phase", "ts", "event_id"], lambda: {"votes": {}}, _vote_step,
        f"what string, event_id bigint, user_id {user_type}, work_id {work_type}, genre_id {dict(log.dtypes)['genre_id']}, reason string",
        _vote_finish)
    votes = folded.filter("what = 'vote'").select("user_id", "work_id", "genre_id").unionByName(settled)
    refusals = judged.filter("reason IS NOT NULL").select("event_id", "reason").unionByName(
        folded.filter("what = 'refused'").select("event_id", "reason"))
    return votes, refusals


def effective_genres(summary: DataFrame, genres: DataFrame) -> DataFrame:
    """readers' genres where any live vote counts, else the inferred ones."""
    shown = summary.filter("NOT vetoed").join(genres.filter("NOT retired").select("genre_id"), "genre_id", "left_semi")
    voted = shown.filter("score > 0").select("work_id").distinct().withColumn("voted", F.lit(True))
    joined = shown.join(voted, "work_id", "left")
    return joined.filter("(voted AND score > 0) OR (voted IS NULL AND inferred)").select(
        "work_id", "genre_id", "score", F.when(F.col("voted"), "readers").otherwise("inferred").alias("source"))


def top_genres(effective: DataFrame, genres: DataFrame, n: int = TOP_GENRES) -> DataFrame:
    """The first ``n`` per work by score, position, slug; the limit is pushed below the shuffle."""
    order = W.partitionBy("work_id").orderBy(F.desc("score"), "position", "slug")
    ranked = effective.join(genres.select("genre_id", "slug", "name", "position"), "genre_id").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n).select("work_id", "rank", "slug", "name")


def my_live_votes(votes: DataFrame, summary: DataFrame, genres: DataFrame, user) -> DataFrame:
    live = summary.filter("NOT vetoed").join(genres.filter("NOT retired").select("genre_id"), "genre_id", "left_semi").select("work_id", "genre_id")
    return votes.filter(F.col("user_id") == user).join(live, ["work_id", "genre_id"], "left_semi").select("work_id", "genre_id").distinct()


def genre_cards(effective: DataFrame, summary: DataFrame, genres: DataFrame, votes: DataFrame, user=None,
                vetoes: DataFrame | None = None) -> DataFrame:
    """Effective genres of every work with parent, direct votes and the caller's votes; vetoed rows when ``vetoes`` is given."""
    parent = genres.select(F.col("genre_id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    named = genres.select("genre_id", "slug", "name", "parent_id").join(parent, "parent_id", "left").drop("parent_id")
    cards = effective.select("work_id", "genre_id", "score", "source").join(
        summary.select("work_id", "genre_id", "direct_votes"), ["work_id", "genre_id"]).withColumn(
        "vetoed", F.lit(False)).withColumn("veto_id", F.lit(None).cast("bigint"))
    if vetoes is not None:
        hidden = summary.filter("vetoed").join(
            vetoes.filter("NOT reverted").select("work_id", "genre_id", F.col("veto_id").cast("bigint").alias("veto_id")), ["work_id", "genre_id"])
        cards = cards.unionByName(hidden.select("work_id", "genre_id", "score", F.lit(None).cast("string").alias("source"),
                                                "direct_votes", F.lit(True).alias("vetoed"), "veto_id"))
    cards = cards.join(named, "genre_id")
    if user is None:
        return cards.withColumn("my_vote", F.lit(None).cast("boolean")).withColumn("my_vote_count", F.lit(None).cast("int")).drop("genre_id")
    mine = my_live_votes(votes, summary, genres, user)
    count = mine.groupBy("work_id").agg(F.count("*").cast("int").alias("my_vote_count"))
    flagged = cards.join(mine.withColumn("mine", F.lit(True)), ["work_id", "genre_id"], "left").join(count, "work_id", "left")
    return flagged.select(
        "work_id", "slug", "name", "parent_slug", "score", "source", "direct_votes", "vetoed", "veto_id",
        F.when(~F.col("vetoed"), F.coalesce("mine", F.lit(False))).alias("my_vote"), F.coalesce("my_vote_count", F.lit(0)).alias("my_vote_count"))


def _moved(df: DataFrame, aliases: DataFrame) -> DataFrame:
    joined = df.join(aliases.select(F.col("loser").alias("work_id"), "survivor"), "work_id", "left")
    return joined.withColumn("work_id", F.coalesce("survivor", "work_id")).drop("survivor")


def merge_genre_evidence(aliases: DataFrame, votes: DataFrame, inferences: DataFrame, vetoes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Votes, inferences and live vetoes follow a merged work; one row per key is left."""
    live = vetoes.filter("NOT reverted")
    moved_vetoes = _moved(live, aliases).select(vetoes.columns).unionByName(vetoes.filter("reverted"))
    return (_moved(votes, aliases).select("user_id", "work_id", "genre_id").distinct(),
            _moved(inferences, aliases).select("work_id", "genre_id", "source").distinct(), moved_vetoes)


def merge_genres(aliases: DataFrame, votes: DataFrame, inferences: DataFrame, vetoes: DataFrame, summary: DataFrame, genres: DataFrame,
                 works: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """N11 with the summary: evidence moves, then the rows of all works that took part are summed anew."""
    votes, inferences, vetoes = merge_genre_evidence(aliases, votes, inferences, vetoes)
    touched = aliases.select(F.col("loser").alias("work_id")).union(aliases.select("survivor")).distinct()
    fresh = genre_summary(votes, inferences, genres, live_vetoes(vetoes), works, touched)
    return votes, inferences, vetoes, summary.join(touched, "work_id", "left_anti").unionByName(fresh.select(*summary.columns))


def genre_tree(genres: DataFrame) -> DataFrame:
    """Live parents in order, each with its live children in order (the taxonomy has two levels)."""
    live = genres.filter("NOT retired")
    kids = live.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("genre_id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "name", "slug"))).alias("children"))
    return live.filter("parent_id IS NULL").join(kids, "genre_id", "left").select(
        "genre_id", "slug", "name", "position", F.coalesce(
            F.transform("children", lambda c: F.struct(c["slug"].alias("slug"), c["name"].alias("name"))),
            F.array().cast("array<struct<slug:string,name:string>>")).alias("children")).orderBy("position", "name")


def genre_page(genres: DataFrame, effective: DataFrame, works: DataFrame) -> DataFrame:
    """Per genre, its room and its live children with their listed books."""
    listed = works.filter("kind = 'single' AND merged_into IS NULL").select("work_id")
    books = effective.join(listed, "work_id", "left_semi").groupBy("genre_id").agg(F.count("*").alias("book_count"))
    child = genres.filter("parent_id IS NOT NULL AND NOT retired").join(books, "genre_id", "left").select(
        F.col("parent_id").alias("genre_id"), F.col("slug").alias("child_slug"), F.coalesce("book_count", F.lit(0)).alias("book_count"))
    room = genres.select(F.col("genre_id").alias("parent_id"), F.col("slug").alias("parent_slug"))
    return genres.join(room, "parent_id", "left").select("genre_id", "slug", F.coalesce("parent_slug", "slug").alias("room_slug"), "retired").join(
        child, "genre_id", "left").drop("genre_id")


def genre_works(genre_id, effective: DataFrame, works: DataFrame, sort: str = "top", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a genre's listed works."""
    listed = works.filter("kind = 'single' AND merged_into IS NULL")
    rows = effective.filter(F.col("genre_id") == genre_id).join(listed, "work_id")
    order = [F.desc("score"), F.desc("readinglog_count"), "title", "work_id"] if sort == "top" else ["title", "work_id"]
    return rows.orderBy(*order).offset(offset).limit(limit).select(
        "work_id", "title", "score", "readinglog_count", (F.col("source") == "inferred").alias("inferred"))


def rebuild_genres(works: DataFrame, subjects: DataFrame, phrases: DataFrame, votes: DataFrame, inferences: DataFrame,
                   genres: DataFrame, vetoes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Redo the inferences of works with stored subjects, then the whole summary.

    ``works(work_id, merged_into, catalog_release)``: a release work's rows belong to ``catalog``, the others' to ``open_library``.
    """
    live = works.filter("merged_into IS NULL").join(subjects.select("work_id").distinct(), "work_id", "left_semi")
    live = materialize(live.select("work_id", "catalog_release"))
    inferred = materialize(infer_genres(subjects.join(live.select("work_id"), "work_id", "left_semi"), phrases))
    redone = replace_inferences(inferences, inferred, live.filter("catalog_release IS NULL"), genres, "open_library")
    redone = materialize(replace_inferences(redone, inferred, live.filter("catalog_release IS NOT NULL"), genres, "catalog"))
    return redone, genre_summary(votes, redone, genres, vetoes, works)
