"""Release checks and report figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators.graph import resolve_column
from foliant.operators.ranking import two_level_rank
from foliant.operators.series import reading_order

# --- fixed values ----------------------------------------------------------------
GOLDEN_THRESHOLD = 0.95
TOP_WORKS = 5000
MAX_MEMBERS = 40
LISTED_GAP = 1000
# -----------------------------------------------------------------------------------


class GoldenGateError(RuntimeError):
    """The golden set is empty or the release misses it."""


def _aligned(golden: DataFrame, members: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expected and actual works of every golden series next to each other, and the chosen series."""
    moved = golden.join(aliases.select(F.col("ol_id").alias("work_id"), F.col("work_id").alias("now")), "work_id", "left").select(
        "name", "seq", F.coalesce("now", "work_id").alias("work_id"))
    votes = moved.join(members.select("key", "work_id"), "work_id").groupBy("name", "key").agg(F.count("*").alias("n"))
    chosen = votes.groupBy("name").agg(F.min_by("key", F.struct((-F.col("n")).alias("n"), "key")).alias("key"))
    expected = two_level_rank(moved, ["name"], F.floor(F.col("seq") / 1000), ["seq"]).select("name", "work_id", F.col("rank").alias("wanted"))
    ordered = reading_order(members.join(chosen.select("key").distinct(), "key", "left_semi")).select("key", "work_id", "rank")
    actual = chosen.join(ordered, "key").select("name", "work_id", F.col("rank").alias("found"))
    return expected.join(actual, ["name", "work_id"], "full"), chosen


def golden_evaluate(golden: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """``golden(name, seq, work_id)`` against ``members(key, work_id, position, first_publish_year, title)``.

    One row per golden series: the release series most of its works are in, counts of missing and unexpected works,
    and whether membership and order are exact.
    """
    both, chosen = _aligned(golden, members, aliases)
    counted = both.groupBy("name").agg(
        F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unexpected"),
        F.count_if(~F.col("wanted").eqNullSafe(F.col("found"))).alias("misplaced"))
    return counted.join(chosen, "name", "left").select(
        "name", "key", "missing", "unexpected", (F.col("key").isNotNull() & (F.col("missing") + F.col("unexpected") == 0)).alias("membership_ok"),
        (F.col("key").isNotNull() & (F.col("misplaced") == 0)).alias("order_ok"))


def golden_failures(golden: DataFrame, members: DataFrame, aliases: DataFrame) -> DataFrame:
    """A01, detail: ``(name, work_id, problem)`` rows."""
    both, _ = _aligned(golden, members, aliases)
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("wanted").isNull(), "unexpected").when(F.col("wanted") != F.col("found"), "misplaced")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select("name", "work_id", "problem")


def golden_rates(result: DataFrame) -> DataFrame:
    return result.agg(F.count("*").alias("total"), F.count_if("membership_ok").alias("membership_ok"), F.count_if("order_ok").alias("order_ok"))


def golden_gate(result: DataFrame, threshold: float = GOLDEN_THRESHOLD) -> None:
    """Raise unless both rates reach the threshold."""
    row = golden_rates(result).first()
    if row["total"] == 0:
        raise GoldenGateError("the golden set is empty")
    membership, order = row["membership_ok"] / row["total"], row["order_ok"] / row["total"]
    if membership < threshold or order < threshold:
        raise GoldenGateError(f"golden set: membership {membership:.1%}, order {order:.1%} (need {threshold:.0%})")


def golden_draft(kg: DataFrame, redirects: DataFrame, editions: DataFrame, works: DataFrame, qid: str) -> DataFrame:
    """The works of one graph series by its own ordinals, for a person to verify."""
    rows = kg.filter(F.col("series") == qid)
    by_work = resolve_column(rows.filter("ol_id LIKE '%W'").withColumn("work_id", F.col("ol_id")), "work_id", redirects)
    by_edition = rows.filter("ol_id LIKE '%M'").join(editions.select(F.col("edition_id").alias("ol_id"), "work_id"), "ol_id")
    held = by_work.select("work_id", "item", "ol_id", "ordinal").unionByName(by_edition.select("work_id", "item", "ol_id", "ordinal"))
    position = T.parse_ordinal(F.col("ordinal"))
    order = F.when(position.isNotNull(), F.struct("item", "ol_id", "ordinal"))
    found = held.groupBy("work_id").agg(F.min_by(position, order).alias("position"))
    return found.join(works.select("work_id", "title"), "work_id", "left").select(
        "work_id", "position", F.coalesce("title", F.lit("NOT IN CATALOG")).alias("title")).orderBy(F.asc_nulls_last("position"), "work_id")


def stage_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """A04."""
    return reduce(DataFrame.unionByName, [t.agg(F.lit(n).alias("table"), F.count("*").alias("rows")) for n, t in tables.items()])


def drop_tally(drops: DataFrame) -> DataFrame:
    """A05."""
    return drops.groupBy("rule").agg(F.count("*").alias("works"))


def rung_shares(decisions: DataFrame, works: DataFrame, n: int = TOP_WORKS) -> DataFrame:
    """Deciding rung of the ``n`` most read works."""
    top = decisions.join(works.select("work_id", "readinglog_count"), "work_id").orderBy(F.desc("readinglog_count"), "work_id").limit(n)
    label = F.coalesce(T.provenance_label(F.col("rung")), F.lit("singleton"))
    tally = top.groupBy(label.alias("rung")).agg(F.count("*").alias("works"))
    total = F.sum("works").over(W.partitionBy())  # a handful of rows: one per rung
    return tally.select("rung", "works", (F.col("works") / total).alias("share"))


def _shown(number: Column) -> Column:
    return F.when(number == F.floor(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))


def suspicious_series(members: DataFrame, works: DataFrame, most: int = MAX_MEMBERS) -> DataFrame:
    """Series with too many members, several authors, repeated positions or gaps between whole ones.

    A gap is found between neighbouring positions. Up to ``LISTED_GAP`` missing numbers are
    listed, a wider gap is shown as its two ends, as positions may be any number.
    """
    placed = members.join(works.select("work_id", "author"), "work_id")
    base = placed.groupBy("key").agg(F.count("*").alias("members"), F.countDistinct("author").alias("authors"))
    spots = placed.filter("position IS NOT NULL").groupBy("key", "position").agg(F.count("*").alias("n"))
    repeated = spots.filter("n > 1").groupBy("key").agg(F.array_sort(F.collect_list("position")).alias("repeated"))
    whole = spots.filter("position = floor(position)").select("key", F.col("position").cast("bigint").alias("p"))
    ahead = whole.withColumn("next", F.lead("p").over(W.partitionBy("key").orderBy("p"))).filter("next > p + 1")
    first, last = F.col("p") + 1, F.col("next") - 1
    listed = F.when(last - first < LISTED_GAP, F.array_join(F.sequence(first, F.least(last, first + LISTED_GAP)).cast("array<string>"), ", ")).otherwise(
        F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
    missing = ahead.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("p", listed.alias("text")))).alias("missing"))
    problems = base.join(repeated, "key", "left").join(missing, "key", "left").select(
        "key", "members", "authors", F.coalesce(F.array_join(F.transform("repeated", _shown), ", "), F.lit("")).alias("duplicate_positions"),
        F.coalesce(F.array_join(F.transform("missing", lambda m: m["text"]), ", "), F.lit("")).alias("gaps"))
    return problems.filter((F.col("members") > most) | (F.col("authors") > 1) | (F.col("duplicate_positions") != "") | (F.col("gaps") != ""))


def release_diff(current: DataFrame, previous: DataFrame, aliases: DataFrame, old_aliases: DataFrame, slugs: DataFrame | None = None,
                 old_slugs: DataFrame | None = None) -> DataFrame:
    """``(change, id, before, after)`` against the previous release; ``current``/``previous`` are (work_id, room)."""
    now, was = current.select("work_id", F.col("room").alias("after")), previous.select("work_id", F.col("room").alias("before"))
    moved = was.join(now, "work_id").filter("before <> after").select(F.lit("moved").alias("change"), F.col("work_id").alias("id"), "before", "after")
    merged = aliases.join(old_aliases.select("ol_id"), "ol_id", "left_anti").select(
        F.lit("merged").alias("change"), F.col("ol_id").alias("id"), F.lit(None).cast("string").alias("before"), F.col("work_id").alias("after"))
    gone = was.join(now.select("work_id"), "work_id", "left_anti").join(aliases.select(F.col("ol_id").alias("work_id")), "work_id", "left_anti").select(
        F.lit("disappeared").alias("change"), F.col("work_id").alias("id"), "before", F.lit(None).cast("string").alias("after"))
    result = moved.unionByName(merged).unionByName(gone)
    if slugs is None or old_slugs is None:
        return result
    renamed = old_slugs.select("key", F.col("slug").alias("before")).join(slugs.select("key", F.col("slug").alias("after")), "key").filter("before <> after")
    return result.unionByName(renamed.select(F.lit("slug").alias("change"), F.col("key").alias("id"), "before", "after"))


def row_digest(df: DataFrame) -> Column:
    """The md5 of a row: its cells in order of their names, each with its length before it, ``-`` for null; fractions to nine places."""
    def cell(field) -> Column:
        value = F.col(f"`{field.name}`")
        shown = (value.cast("decimal(38,9)") if field.dataType.typeName() in ("double", "float", "decimal") else value).cast("string")
        return F.coalesce(F.concat(F.length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))

    return F.md5(F.concat(F.lit(""), *[cell(f) for f in sorted(df.schema.fields, key=lambda f: f.name)]))


def release_digest(tables: dict[str, DataFrame]) -> DataFrame:
    """A content hash per table that neither row order nor partitioning can change, and that any engine can compute.

    Each half of a row's md5 gives a number of sixty bits; the digest is the two sums over all rows.
    """
    def half(start: int) -> Column:
        number = F.conv(F.substring("row", start, 15), 16, 10).cast("decimal(38,0)")
        return F.coalesce(F.sum(number), F.lit(0)).cast("decimal(38,0)").cast("string")

    parts = [t.select(row_digest(t).alias("row")).agg(F.lit(n).alias("table"), F.count("*").alias("rows"), F.concat_ws("-", half(1), half(16)).alias("digest"))
             for n, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def imprint_report(rejections: DataFrame) -> DataFrame:
    """A10."""
    return rejections.orderBy("key").select("key", "author_clusters")
