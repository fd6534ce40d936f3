"""Selection rules and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.graph import resolve_column

# --- fixed values ----------------------------------------------------------------
MIN_PAGES = 40
# (rule, title patterns, subject patterns, publisher patterns), matched ignoring case
JUNK_RULES = (
    ("calendar",
     (r"\bcalendars?\b", r"\b(?:planner|desk diary|pocket diary)\b", r"\b(?:19|20)[0-9][0-9]\s+(?:diary|journal|planner)\b"),
     (r"^calendars?$", r"^diaries \(blank-books\)$", r"^blank[- ]books?$"), ()),
    ("colouring_book",
     (r"\bcolou?ring\s+book\b", r"\bcolou?ring\s+(?:and|&)\s+activity\b"), (r"^colou?ring books?$",), ()),
    ("thesis", (), (r"^(?:theses|dissertations)\b", r"^dissertations, academic$"),
     (r"\buniversity microfilms\b", r"\bproquest\b")),
    ("government_document", (), (r"^government publications\b",),
     (r"\bgovernment printing office\b", r"\bstationery office\b", r"^g\.?p\.?o\.?$", r"^h\.?m\.?s\.?o\.?$")),
    ("study_guide",
     (r"^(?:summary|analysis|study guide|workbook)\s+(?:of|for|&|and)\b", r"\bstudy guide\b",
      r"^(?:sparknotes|cliffsnotes|cliffs notes|bookrags)\b"), (r"^study guides?$",), ()),
)
PLACEHOLDER_TYPE, PLACEHOLDER_BYTES = "image/png", 9103
INFERENCE_SOURCES = ("catalog", "open_library", "google")
OVERRIDE_KINDS = ("merge_works", "split_work", "set_series", "remove_from_series", "reject_series", "rename_series")
SLUG = r"^[a-z0-9]+(?:-[a-z0-9]+)*$"
TAXONOMY_KEYS = ("slug", "name", "description", "match", "exclude", "children")
# -----------------------------------------------------------------------------------


def read_set(logs: DataFrame, kg: DataFrame, redirects: DataFrame, editions: DataFrame) -> DataFrame:
    """ids of works worth keeping, redirects followed.

    ``logs(ol_id)``, ``kg(ol_id)``, ``editions(ol_id, work_ol_id)``.
    """
    seen = logs.select("ol_id").filter("ol_id <> ''").distinct().union(
        kg.filter("ol_id LIKE '%W'").select("ol_id")).distinct()
    works = resolve_column(seen, "ol_id", redirects)
    linked = kg.filter("ol_id LIKE '%M'").select("ol_id").distinct()
    owners = editions.filter("work_ol_id IS NOT NULL").join(linked, "ol_id", "left_semi").select(
        F.col("work_ol_id").alias("ol_id"))
    return works.union(owners).distinct()


def _any(patterns: tuple[str, ...], column: Column) -> Column:
    return column.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def _matcher(patterns: tuple[str, ...]):
    return lambda text: _any(patterns, text)


def _named(publishers: Column) -> Column:
    return F.filter(F.coalesce(publishers, F.array().cast("array<string>")), lambda p: p != "")


def publisher_hits(publishers: Column, rules=JUNK_RULES) -> dict[str, Column]:
    """Per rule with publisher patterns: does every one of these publishers match?"""
    return {name: (F.size(_named(publishers)) > 0) & F.forall(_named(publishers), _matcher(houses))
            for name, _, _, houses in rules if houses}


def junk_reason(title: Column, subjects: Column, author_ids: Column, max_pages: Column,
                every_publisher: dict[str, Column], rules=JUNK_RULES, min_pages: int = MIN_PAGES) -> Column:
    """the first rule that drops a work, or null. Every publisher must match, any subject may."""
    reason = F.when(F.coalesce(F.size(author_ids), F.lit(0)) <= 0, "no_author").when(max_pages < min_pages, "short")
    for name, titles, topics, houses in rules:
        hits = []
        if titles:
            hits.append(_any(titles, F.coalesce(title, F.lit(""))))
        if topics:
            hits.append(F.coalesce(F.exists(subjects, _matcher(topics)), F.lit(False)))
        if houses:
            hits.append(F.coalesce(every_publisher[name], F.lit(False)))
        reason = reason.when(reduce(lambda a, b: a | b, hits), name)
    return reason


def english_evidence(editions: DataFrame, rules=JUNK_RULES) -> DataFrame:
    """Per work: the largest page count, and per rule whether every publisher of its English editions matches.

    The test runs per edition and is folded with ``bool_and``, so no work's
    publishers are ever gathered.
    """
    english = editions.filter("is_english AND work_ol_id IS NOT NULL")
    named = _named(F.col("publishers"))
    every = [F.bool_and(F.when(F.size(named) > 0, hit)).alias(f"every_{name}")
             for name, hit in publisher_hits(F.col("publishers"), rules).items()]
    return english.groupBy(F.col("work_ol_id").alias("ol_id")).agg(
        F.max("number_of_pages").alias("max_pages"), F.lit(True).alias("english"), *every)


def select_works(works: DataFrame, editions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(kept(ol_id), drops(ol_id, rule))``.

    ``works(ol_id, title, subjects, author_ids)``, ``editions(work_ol_id, is_english, number_of_pages, publishers)``.
    """
    every = {name: F.col(f"every_{name}") for name, _, _, houses in JUNK_RULES if houses}
    judged = works.join(english_evidence(editions), "ol_id", "left").select(
        "ol_id", F.when(F.col("english").isNull(), "not_english").otherwise(junk_reason(
            F.col("title"), F.col("subjects"), F.col("author_ids"), F.col("max_pages"), every)).alias("rule"))
    return judged.filter("rule IS NULL").select("ol_id"), judged.filter("rule IS NOT NULL")


def live_works(works: DataFrame) -> DataFrame:
    """single books that were not merged away."""
    return works.filter("kind = 'single' AND merged_into IS NULL")


def search_filters(works: DataFrame, effective: DataFrame, genres: list[int] | None = None, author: str | None = None,
                   year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """all requested genres effective, all author words present, year inside the range."""
    kept = works
    if author:
        words = F.split(T.series_key(F.lit(author)), " ")
        kept = kept.filter(F.size(F.array_except(words, F.split(T.series_key(F.col("author")), " "))) == 0)
    if year_from is not None:
        kept = kept.filter(F.col("first_publish_year") >= year_from)
    if year_to is not None:
        kept = kept.filter(F.col("first_publish_year") <= year_to)
    if genres:
        wanted = sorted(set(genres))
        full = effective.filter(F.col("genre_id").isin(wanted)).groupBy("work_id").agg(
            F.countDistinct("genre_id").alias("n")).filter(F.col("n") == len(wanted))
        kept = kept.join(full.select("work_id"), "work_id", "left_semi")
    return kept


def validate_filters(filters: DataFrame, genres: DataFrame) -> DataFrame:
    """violations of filter rows ``(filter_id, genres[], year_from, year_to)``."""
    live = genres.filter("NOT retired").select("slug")
    unknown = filters.select("filter_id", F.explode("genres").alias("slug")).join(live, "slug", "left_anti").select(
        "filter_id", F.lit("genre").alias("param"), F.concat(F.lit("Unknown genre: "), F.col("slug"), F.lit(".")).alias("message"))
    inverted = filters.filter("year_from > year_to").select(
        "filter_id", F.lit("year_to").alias("param"), F.lit("year_to is before year_from.").alias("message"))
    return unknown.unionByName(inverted)


def real_covers(checks: DataFrame) -> DataFrame:
    """addresses whose landed check shows a real image."""
    kind = F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1))
    placeholder = (kind == PLACEHOLDER_TYPE) & (F.coalesce("content_length", F.lit(-1)) == PLACEHOLDER_BYTES)
    return checks.filter((F.col("status") == 200) & kind.startswith("image/") & ~placeholder).select("url").distinct()


def _broken(df: DataFrame, rule: str, condition: str, key: str) -> DataFrame:
    return df.filter(condition).select(F.lit(rule).alias("rule"), F.expr(f"CAST({key} AS STRING)").alias("key"))


def _repeated(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    keys = df.groupBy(*columns).count().filter("count > 1")
    return keys.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(c).cast("string") for c in columns]).alias("key"))


def check_constraints(threads: DataFrame, votes: DataFrame, shelves: DataFrame, inferences: DataFrame,
                      corrections: DataFrame) -> DataFrame:
    """Every violated row or key of the live-table constraints."""
    sources = ", ".join(f"'{s}'" for s in INFERENCE_SOURCES)
    parts = [
        _broken(threads, "thread_one_home", "(series_id IS NOT NULL) = (genre_id IS NOT NULL)", "thread_id"),
        _broken(threads, "thread_tag_needs_series", "work_id IS NOT NULL AND series_id IS NULL", "thread_id"),
        _broken(votes, "vote_value", "value NOT IN (-1, 1)", "vote_id"),
        _broken(votes, "vote_one_target", "(thread_id IS NOT NULL) = (post_id IS NOT NULL)", "vote_id"),
        _repeated(votes.filter("thread_id IS NOT NULL"), "vote_user_thread", "user_id", "thread_id"),
        _repeated(votes.filter("post_id IS NOT NULL"), "vote_user_post", "user_id", "post_id"),
        _repeated(shelves, "shelf_user_work", "user_id", "work_id"),
        _broken(inferences, "inference_source", f"source NOT IN ({sources})", "concat(work_id, '/', genre_id)"),
        _broken(corrections, "correction_export_state",
                "(override IS NULL) <> (runtime_only_reason IS NOT NULL)", "correction_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def normalize_series_key(raw: Column) -> Column:
    """``wd:Q...`` as it is, ``ol:<name>`` keyed; anything else is null."""
    prefix, rest = F.substring_index(raw, ":", 1), F.trim(F.regexp_replace(raw, "^[^:]*:", ""))
    return F.when(~raw.contains(":") | (rest == ""), None).when(prefix == "wd", F.concat(F.lit("wd:"), rest)).when(
        prefix == "ol", F.concat(F.lit("ol:"), T.series_key(rest)))


def validate_overrides(overrides: DataFrame, works: DataFrame, edition_owner: DataFrame, known_series: DataFrame,
                       folded: DataFrame, memberships: DataFrame) -> DataFrame:
    """Override entries that name something the build does not hold.

    ``overrides(file, idx, kind, works[], editions[], series, name)``, ``edition_owner(edition, work)`` after merges,
    ``folded(key, target)``, ``memberships(work_id, key)`` before series overrides.
    """
    entry = overrides.withColumn("key", normalize_series_key(F.col("series"))).withColumn("at", F.struct("file", "idx"))

    def problem(df: DataFrame, text: Column) -> DataFrame:
        return df.select(F.col("at.file").alias("file"), F.col("at.idx").alias("idx"), text.alias("problem"))

    kinds = F.col("kind").isin(*OVERRIDE_KINDS)
    naming = F.col("kind").isin("set_series", "remove_from_series", "reject_series", "rename_series")
    named = F.col("kind").isin("set_series", "remove_from_series", "merge_works", "split_work")
    ids = entry.filter(named).select("at", "kind", F.explode("works").alias("work_id"))
    unknown_work = problem(ids.join(works.select("work_id"), "work_id", "left_anti").distinct(),
                           F.concat(F.lit("unknown work "), F.col("work_id")))
    parts = [
        problem(entry.filter(~kinds), F.concat(F.lit("unknown override "), F.col("kind"))),
        problem(entry.filter((F.col("kind") == "merge_works") & (F.size("works") < 2)), F.lit("needs two works")),
        problem(entry.filter((F.col("kind") == "split_work") & (F.size("editions") < 1)), F.lit("needs an edition")),
        problem(entry.filter(naming & F.col("key").isNull()), F.lit("malformed series")),
        unknown_work,
    ]
    pieces = entry.filter("kind = 'split_work'").select(
        "at", F.get("works", 0).alias("work"), F.explode("editions").alias("edition"))
    parts.append(problem(pieces.join(edition_owner, ["edition", "work"], "left_anti"),
                         F.concat(F.lit("foreign edition "), F.col("edition"))))
    keyed = entry.filter(naming & F.col("key").isNotNull())
    gone = folded.select("key", "target")
    parts.append(problem(keyed.join(gone, "key"), F.concat(F.lit("folded into "), F.col("target"))))
    strange = keyed.join(gone, "key", "left_anti").join(known_series.select("key"), "key", "left_anti")
    creates = (F.col("kind") == "set_series") & F.col("key").startswith("ol:") & (F.coalesce("name", F.lit("")) != "")
    parts.append(problem(strange.filter(~creates), F.concat(F.lit("no series "), F.col("key"))))
    removals = keyed.filter("kind = 'remove_from_series'").join(gone, "key", "left_anti").join(
        known_series.select("key"), "key", "left_semi").withColumn("work_id", F.get("works", 0))
    parts.append(problem(removals.join(memberships, ["work_id", "key"], "left_anti"),
                         F.concat(F.col("work_id"), F.lit(" is not a member of "), F.col("key"))))
    return reduce(DataFrame.unionByName, parts)


def validate_taxonomy(rules: DataFrame) -> DataFrame:
    """``rules(slug, name, parent, keys[], phrases[])`` -> ``(slug, problem)``."""
    def problem(condition: Column, text: str) -> DataFrame:
        return rules.filter(condition).select("slug", F.lit(text).alias("problem"))

    parents = rules.filter("parent IS NOT NULL").select(F.col("slug").alias("parent")).distinct()
    normalized = F.transform("phrases", T.normalize_text)
    repeated = rules.groupBy("slug").count().filter("count > 1").select("slug", F.lit("duplicate slug").alias("problem"))
    third = rules.join(parents, "parent", "left_semi").select("slug", F.lit("third level").alias("problem"))
    parts = [
        problem(~F.coalesce(F.col("slug"), F.lit("")).rlike(SLUG), "bad slug"), repeated,
        problem(F.trim(F.coalesce("name", F.lit(""))) == "", "empty name"),
        problem(F.size(F.array_except("keys", F.array(*[F.lit(k) for k in TAXONOMY_KEYS]))) > 0, "unknown key"),
        problem(F.exists(normalized, lambda p: p == ""), "empty phrase"), third,
    ]
    return reduce(DataFrame.unionByName, parts)


def stale_subjects(works: DataFrame) -> DataFrame:
    """Upstream works with tags in a subject text that holds no line break."""
    text = F.lower(F.coalesce("subjects", F.lit("")))
    return works.filter((F.col("source") == "openlibrary") & ~text.contains("\n")
                        & (text.contains("series:") | text.contains("franchise:"))).select("work_id")
