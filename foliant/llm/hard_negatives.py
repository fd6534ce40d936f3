"""Hard negatives by anchor clusters that share sorted candidate lists (operator 13).

Anchors fall into clusters around a few centres. For a cluster whose members lie within angle
``b`` of its centre, ``|x| cos(max(0, angle(x, centre) - b))`` times a member's own length bounds
the member's inner product with ``x``. The candidates are listed once a cluster in descending
order of that bound, and every member walks the list until the bound at its place is too small
for anything it still looks for: the walk ends certified.

Lists are cut into blocks of bounded size that tasks walk side by side. All anchors first walk
one block; the scores found there end their walks through the other blocks earlier.

Two walks make the result: among rows of the anchor's label for its positives, then among rows of
other labels for the best scores within each positive's window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.code_compression import integers
from foliant.llm.common import query, stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # of a hundred parts of the positive's score
CENTRES = 16
SAMPLE = 2048  # anchors the centres are fitted on
BLOCK, BATCH = 2048, 2048  # candidates and anchors that meet in one call
STEP = 512  # places of a list walked at a time
LIMIT = 1 << 20  # larger integers would carry ranked scores past 64 bits
_SLACK = 1e-6  # covers the rounding of angles
_NONE, _ALL = -(1 << 62), 1 << 62


def centres(points: np.ndarray, k: int = CENTRES, rounds: int = 10) -> np.ndarray:
    """Unit centres of spherical k-means; the first points are the first centres."""
    lengths = np.linalg.norm(points, axis=1)
    unit = points[lengths > 0] / lengths[lengths > 0][:, None]
    if not len(unit):
        return np.eye(1, points.shape[1])
    found = unit[:k].copy()
    for _ in range(rounds):
        nearest = (unit @ found.T).argmax(1)
        for c in range(len(found)):
            total = unit[nearest == c].sum(0)
            if np.linalg.norm(total) > 1e-9:
                found[c] = total / np.linalg.norm(total)
    return found


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.float64)


def _angles(vectors: np.ndarray, lengths: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles to a unit centre; a zero vector's is 0."""
    return np.arccos(np.clip(np.where(lengths > 0, vectors @ centre / np.where(lengths > 0, lengths, 1), 1), -1, 1))


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    top = max(np.abs(left).max(initial=0), 1) * max(np.abs(right).max(initial=0), 1) * left.shape[1]
    if top < 1 << 53:
        return np.rint(left @ right.T).astype(np.int64)
    return left.astype(np.int64) @ right.astype(np.int64).T


def walk(members: np.ndarray, centre: np.ndarray, ids: np.ndarray, labels: np.ndarray, low: np.ndarray, high: np.ndarray, found: dict, want: int,
         same_label: bool) -> tuple[np.ndarray, int]:
    """The best ranked candidates of each member and window, and how many (member, place) pairs were scored.

    ``found`` holds ``vectors``, ``lengths``, ``ids``, ``labels`` and ``rank`` (by id) of the
    candidates. A window takes scores from ``low`` to ``high``. The result holds ``score * n + n - 1 - rank``,
    descending, or ``_NONE``.
    """
    n = len(found["ids"])
    lengths = np.linalg.norm(members, axis=1)
    widest = _angles(members, lengths, centre).max(initial=0)
    bound = found["lengths"] * (np.cos(np.maximum(0, _angles(found["vectors"], found["lengths"], centre) - widest)) + _SLACK)
    listed = np.argsort(-bound, kind="stable")
    best = np.full((*low.shape, want), _NONE, np.int64)
    scored, live = 0, np.arange(len(members))
    for at in range(0, n, STEP):
        last = best[live, :, -1]
        needed = np.maximum(low[live], np.where(last == _NONE, _NONE, last // n)).min(1)
        live = live[lengths[live] * bound[listed[at]] >= needed]
        if not len(live):
            break
        here = listed[at:at + STEP]
        scored += len(live) * len(here)
        score = _products(members[live], found["vectors"][here])
        ranked = score * n + (n - 1 - found["rank"][here])
        fits = (labels[live][:, None] == found["labels"][here][None]) == same_label
        fits &= ids[live][:, None] != found["ids"][here][None]
        for w in range(low.shape[1]):
            inside = fits & (score >= low[live, w][:, None]) & (score <= high[live, w][:, None])
            some = np.flatnonzero(inside.any(1))
            if len(some):
                both = np.concatenate([best[live[some], w], np.where(inside[some], ranked[some], _NONE)], axis=1)
                best[live[some], w] = -np.sort(-np.partition(both, both.shape[1] - want, axis=1)[:, -want:], axis=1)
    return best, scored


def _visits(candidates: DataFrame, anchors: DataFrame, scope: str, middle: np.ndarray, want: int, same_label: bool) -> DataFrame:
    """``(row, slot, found_id, score)``: the best ``want`` of each block for every window of its anchors.

    Both sides carry ``scope``, ``block`` and ``batch``.
    """
    dim = middle.shape[1]
    schema = "row long, slot int, found_id long, score long"

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            vectors = _matrix(left["ints"], dim)
            ids = left["vec_id"].to_numpy()
            by_id = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            found = {"vectors": vectors, "lengths": np.linalg.norm(vectors, axis=1), "ids": ids, "labels": left["label"].to_numpy(), "rank": rank}
            members, rows, own, labels = _matrix(right["ints"], dim), right["row"].to_numpy(), right["vec_id"].to_numpy(), right["label"].to_numpy()
            lows, highs = right["low"].to_pylist(), right["high"].to_pylist()
            slots = max(map(len, lows))
            low = np.array([x + [_ALL] * (slots - len(x)) for x in lows], np.int64)
            high = np.array([x + [_NONE] * (slots - len(x)) for x in highs], np.int64)
            cluster = right["cluster"].to_numpy()
            for c in np.unique(cluster).tolist():
                mine = np.flatnonzero(cluster == c)
                best, _ = walk(members[mine], middle[c], own[mine], labels[mine], low[mine], high[mine], found, want, same_label)
                member, slot, place = np.nonzero(best != _NONE)
                ranked = best[member, slot, place]
                out.append((rows[mine][member], slot, ids[by_id[len(ids) - 1 - ranked % len(ids)]], ranked // len(ids)))
        names = [c.split()[0] for c in schema.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        return pa.table([pa.array(np.concatenate([x[i] for x in out]) if out else [], k) for i, k in enumerate(kinds)], names)

    key = [scope, "block", "batch"]
    return candidates.groupBy(*key).cogroup(anchors.groupBy(*key)).applyInArrow(meet, schema)


def _top(found: DataFrame, want: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("row", "slot").orderBy(F.desc("score"), "found_id"))
    return found.withColumn("place", place).filter(F.col("place") <= want)


def shared_walks(rows: DataFrame, anchors: DataFrame, middle: np.ndarray, want: int, same_label: bool) -> DataFrame:
    """``(row, slot, found_id, score, place)``: the best ``want`` rows of every window of every anchor.

    ``rows`` are ``(row, vec_id, label, ints)``; ``anchors`` carry ``cluster`` and the windows' ends
    ``low`` and ``high`` too. Lists hold one label with ``same_label``, else all rows.
    """
    if same_label:
        rows, anchors = rows.withColumn("scope", F.col("label")), anchors.withColumn("scope", F.col("label"))
        sizes = stored(rows.groupBy("scope").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks")).join(
            anchors.groupBy("scope").agg(F.ceil(F.count("*") / BATCH).cast("long").alias("batches")), "scope"), "list-sizes")
        rows, anchors = rows.join(sizes, "scope"), anchors.join(sizes, "scope")
    else:
        counts = {"scope": 0, "blocks": -(-rows.count() // BLOCK), "batches": max(1, -(-anchors.count() // BATCH))}
        rows, anchors = (df.withColumns({name: F.lit(n).cast("long") for name, n in counts.items()}) for df in (rows, anchors))
    candidates = rows.select(
        "scope", "vec_id", "label", "ints", F.pmod(F.xxhash64("row"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch"))
    placed = anchors.withColumn("batch", F.pmod(F.xxhash64("row"), F.col("batches")))
    first = stored(_top(_visits(candidates.filter("block = 0"), placed.withColumn("block", F.lit(0).cast("long")), "scope", middle, want, same_label), want), "first-block")
    # Where a window is full already, only scores that reach its last place matter.
    full = first.filter(F.col("place") == want).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("last"))
    raised = placed.filter("blocks > 1").join(full, "row", "left").withColumn(
        "low", F.transform("low", lambda x, i: F.greatest(x, F.coalesce(F.try_element_at("last", i.cast("int")), x)))).withColumn(
        "block", F.explode(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1)))
    others = _visits(candidates.filter("block > 0"), raised, "scope", middle, want, same_label)
    return _top(first.drop("place").unionByName(others), want)


def _floored(value: Column, by: int) -> Column:
    return ((value - F.pmod(value, F.lit(by))) / by).cast("long")


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, lowest: int = LOWEST, highest: int = HIGHEST) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchor`` is a condition on ``vec_id``. Scores are inner products of ``floor(scale * x)``.
    Positives are the first rows of the anchor's label; negatives the first rows of other labels
    with ``lowest * positive_score <= 100 * negative_score <= highest * positive_score``; higher
    scores come first, ties by smaller id. A row whose id, label or vector is null takes no part,
    nor does one with an empty vector, a null or non-finite component, one of 4,096 or more in
    magnitude (at scale 256), or another length than the smallest id's. Rows that repeat an id are rows of their own, but
    never partners of an anchor of that id. Other columns are not read; an empty table, or one
    without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    columns = {"vec_id": id_col, "label": label_col}
    usable = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    read = stored(integers(usable, scale, LIMIT, columns, vec_col).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "ints"), "integers")
    shortest = read.orderBy("vec_id", F.length("ints"), "ints").limit(1).select(F.length("ints")).collect()
    dim = shortest[0][0] // 4 if shortest else 0
    rows = read.filter(F.length("ints") == 4 * dim)
    chosen = rows.filter(anchor)
    sample = chosen.orderBy(F.xxhash64("vec_id"), "ints", "row").limit(SAMPLE).select("ints").collect()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sample:
        return spark.createDataFrame([], out)
    middle = centres(np.frombuffer(b"".join(bytes(r[0]) for r in sample), "<i4").reshape(-1, dim).astype(np.float64))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = (_matrix(batch.column(3), dim) @ middle.T).argmax(1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster, pa.int32())], ["row", "vec_id", "label", "ints", "cluster"])

    anchors = stored(chosen.mapInArrow(nearest, "row long, vec_id long, label long, ints binary, cluster int"), "anchors")
    any_score = anchors.withColumn("low", F.array(F.lit(_NONE))).withColumn("high", F.array(F.lit(_ALL)))
    best = stored(shared_walks(rows, any_score, middle, positives, True).select(
        "row", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # One window for each distinct score of a positive; at most ``positives`` an anchor.
    low, high = -_floored(-F.col("positive_score") * lowest, 100), _floored(F.col("positive_score") * highest, 100)
    windows = best.select("row", "positive_score", low.alias("low"), high.alias("high")).filter("low <= high").distinct()
    windows = windows.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive_score", "low", "high"))).alias("windows"))
    windows = stored(windows, "windows")
    asking = anchors.join(windows.select("row", F.col("windows.low").alias("low"), F.col("windows.high").alias("high")), "row")
    hard = shared_walks(rows, asking, middle, negatives, False)
    slots = windows.select("row", F.posexplode("windows").alias("slot", "window")).select("row", "slot", F.col("window.positive_score").alias("positive_score"))
    return hard.join(slots, ["row", "slot"]).join(best, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


CHECK = """
WITH kept AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
        AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3"""


@query("op13_hard_negatives", CHECK)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mine(vectors, F.col("vec_id") % 50 == 0)
