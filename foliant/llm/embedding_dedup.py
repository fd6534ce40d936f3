"""Near-duplicate embeddings by a subspace pigeonhole join (operator 8).

Unit vectors of cosine ``c`` or more are within squared distance ``2 - 2c``. After a fixed
rotation the dimensions fall into blocks, each with a budget in proportion to its share of
them; a pair within the whole distance is within budget in one block at least. Each block is
range-joined by itself: a grid over its first two coordinates has cells twice as wide as the
block's radius; a vector is at home in one cell and visits all cells its radius reaches.
Within a cell, homes and visitors within the block's budget are candidates, and candidates
are verified by their exact cosine. A pair counts in the first block that holds it, so the
union over blocks needs no pair list: a cell returns link counts and a spanning forest.

Coordinates are whole numbers of exactly computed products, so that every task sees the same
block distances. Equal vectors are one class from the start; a crowded cell is cut into
pieces of ``HOMES`` by ``VISITORS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import query, stored, table
from foliant.operators.graph import connected_components

SIMILARITY = 0.98
BLOCK_DIMS = 16
KEY_DIMS = 2
HOMES, VISITORS = 512, 2048
SEED = 8128

_UNIT = float(1 << 20)  # coordinates of unit vectors are whole numbers of this scale
_ROTATION_UNIT = float(1 << 14)
_SLACK = 1.004  # covers the rounding of coordinates and rotation


def rotation(dim: int) -> np.ndarray:
    """A random rotation rounded to whole numbers: products and sums of coordinates stay exact."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return np.rint(q * np.sign(np.diag(r)) * _ROTATION_UNIT)


def rotated(vectors: np.ndarray, turn: np.ndarray) -> np.ndarray:
    unit = vectors / np.sqrt(np.square(vectors).sum(1, keepdims=True))
    return np.rint((np.rint(unit * _UNIT) @ turn) / _ROTATION_UNIT)


def block_edges(dim: int) -> list[tuple[int, int]]:
    n = max(1, round(dim / BLOCK_DIMS))
    cuts = [dim * i // n for i in range(n + 1)]
    return list(zip(cuts[:-1], cuts[1:]))


def budgets(dim: int, similarity: float) -> list[float]:
    whole = (2 - 2 * similarity) * _UNIT**2 * _SLACK
    return [whole * (b - a) / dim for a, b in block_edges(dim)]


def _block_distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.square(left).sum(1)[:, None] + np.square(right).sum(1)[None] - 2 * (left @ right.T)


def _prepared(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, vec, digest)``: ``vec`` as float64 bytes, null where it can't link."""
    kind = vectors.schema[label_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, digest = [], []
            labels = batch.column(1).to_pylist()
            column = batch.column(2)
            for i, label in enumerate(labels):
                value = column[i]
                x = None
                if label is not None and value.is_valid and len(value) and not value.values.null_count:
                    # Minus zero equals zero.
                    x = value.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                    with np.errstate(over="ignore"):
                        length = np.square(x).sum()
                    if not np.isfinite(x).all() or not x.any():
                        x = None
                    elif not np.isfinite(length) or length < 1e-200:
                        x = x / np.abs(x).max()
                raw.append(None if x is None else x.tobytes())
                digest.append(None if x is None else xxhash.xxh3_128_digest(raw[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(raw, pa.binary()), pa.array(digest, pa.binary())],
                                             ["vec_id", "label", "vec", "digest"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vec_col).cast(T.ArrayType(T.DoubleType())).alias("v")).mapInArrow(
        run, f"vec_id long, label {kind}, vec binary, digest binary")


def _placed(classes: DataFrame, similarity: float) -> DataFrame:
    """Each class at home in one cell of each block and visiting all cells in reach."""
    kind = classes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            raw = batch.column(3).to_pylist()
            sizes = np.array([len(x) for x in raw])
            for size in np.unique(sizes).tolist():
                dim, rows = size // 8, np.flatnonzero(sizes == size)
                if dim not in turns:
                    turns[dim] = rotation(dim)
                at = rotated(np.frombuffer(b"".join(raw[i] for i in rows), "<f8").reshape(-1, dim), turns[dim])
                for b, ((lo, hi), budget) in enumerate(zip(block_edges(dim), budgets(dim, similarity))):
                    key, reach = at[:, lo:min(hi, lo + KEY_DIMS)], np.sqrt(budget)
                    low = np.floor((key - reach) / (2 * reach)).astype(np.int64)
                    high = np.floor((key + reach) / (2 * reach)).astype(np.int64)
                    own = np.floor(key / (2 * reach)).astype(np.int64)
                    parts = [(np.arange(len(rows)), own, True)]
                    for mask in range(1 << key.shape[1]):
                        pick = np.array([mask >> d & 1 for d in range(key.shape[1])], bool)
                        # Two cells at most lie in reach along a coordinate; equal ends count once.
                        real = ((high > low) | ~pick).all(1)
                        parts.append((np.flatnonzero(real), np.where(pick, high, low)[real], False))
                    for index, cell, home in parts:
                        if len(index):
                            taken = pa.array(rows[index])
                            cells = cell[:, 0] * (1 << 24) + (cell[:, 1] if cell.shape[1] > 1 else 0)
                            yield pa.RecordBatch.from_arrays([
                                batch.column(1).take(taken), pa.array(np.full(len(index), dim), pa.int32()), pa.array(np.full(len(index), b), pa.int32()),
                                pa.array(cells, pa.int64()), pa.array(np.full(len(index), home)), batch.column(0).take(taken),
                                batch.column(2).take(taken), batch.column(3).take(taken), batch.column(4).take(taken)],
                                ["label", "dim", "block", "cell", "home", "rep", "n", "vec", "digest"])

    return classes.select("rep", "label", "n", "vec", "digest").mapInArrow(
        run, f"label {kind}, dim int, block int, cell long, home boolean, rep long, n long, vec binary, digest binary")


def _spanning(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and columns of a link matrix, the smallest id in their component."""
    top = np.iinfo(np.int64).max
    row = left.copy()
    while True:
        column = np.minimum(right, np.where(link, row[:, None], top).min(0))
        again = np.minimum(row, np.where(link, column[None], top).min(1))
        if (again == row).all():
            return row, column
        row = again


def _cell_links(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        dim, block = group["dim"][0].as_py(), group["block"][0].as_py()
        home = group["home"].to_numpy()
        ids, copies, digest = group["rep"].to_numpy(), group["n"].to_numpy(), np.array(group["digest"].to_pylist(), "S16")
        vectors = np.frombuffer(b"".join(group["vec"].to_pylist()), "<f8").reshape(-1, dim)
        at = rotated(vectors, rotation(dim))
        allowed, edges = budgets(dim, similarity), block_edges(dim)
        out = []
        h, v = np.flatnonzero(home), np.flatnonzero(~home)
        if len(h) and len(v):
            lo, hi = edges[block]
            near = (_block_distances(at[h, lo:hi], at[v, lo:hi]) <= allowed[block]) & (digest[h][:, None] != digest[v][None])
            h, v, near = h[near.any(1)], v[near.any(0)], near[near.any(1)][:, near.any(0)]
        if len(h) and len(v):
            unit = vectors / np.sqrt(np.square(vectors).sum(1, keepdims=True))
            link = near & (unit[h] @ unit[v].T >= similarity)
            counted = link.copy()
            for b in range(block):
                lo, hi = edges[b]
                counted &= _block_distances(at[h, lo:hi], at[v, lo:hi]) > allowed[b]
            row, column = _spanning(link, ids[h], ids[v])
            linked, met = link.any(1), link.any(0)
            out = [(h[linked], row[linked], (counted @ copies[v])[linked]), (v[met], column[met], np.zeros(met.sum(), np.int64))]
        at, other, links = (np.concatenate([x[i] for x in out]).astype(np.int64) if out else np.zeros(0, np.int64) for i in range(3))
        taken = pa.array(at)
        return pa.table([group["label"].take(taken), group["digest"].take(taken), group["rep"].take(taken), pa.array(other), pa.array(links)],
                        ["label", "digest", "rep", "other", "links"])

    return run


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows link when their labels are equal and not null, their dimensions agree and their
    cosine in double precision reaches ``similarity``. A vector that is null, empty or zero or
    holds a null or non-finite component links with nothing; so does a null id, and it is
    kept. Rows that repeat an id are vectors of their own in the counts. ``component_id`` is
    the smallest id reachable. Other columns are not read. An empty table gives no rows.
    """
    base = stored(_prepared(vectors, id_col, vec_col, label_col), "vectors")
    usable = base.filter("digest is not null and vec_id is not null")
    classes = stored(usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec")), "classes")
    placed = stored(_placed(classes, similarity), "cells")
    cell = ["label", "dim", "block", "cell"]
    crowd = placed.groupBy(*cell).agg(
        F.ceil(F.count_if("home") / HOMES).cast("int").alias("h"), F.ceil(F.count_if(~F.col("home")) / VISITORS).cast("int").alias("v")).filter("h > 0")
    cut = placed.join(crowd, cell)
    spread = F.xxhash64("rep", F.lit(1))
    cut = cut.select(*placed.columns,
                     F.when(F.col("home"), F.array(F.pmod(spread, F.col("h")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("h") - 1)).alias("hs"),
                     F.when(F.col("home"), F.sequence(F.lit(0), F.col("v") - 1)).otherwise(F.array(F.pmod(spread, F.col("v")).cast("int"))).alias("vs"))
    cut = cut.withColumn("hs", F.explode("hs")).withColumn("vs", F.explode("vs"))
    found = stored(cut.groupBy(*cell, "hs", "vs").applyInArrow(
        _cell_links(similarity), f"label {base.schema['label'].dataType.simpleString()}, digest binary, rep long, other long, links long"), "links")
    counts = found.groupBy("label", "digest").agg(F.sum("links").alias("links"))
    edges = found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")).distinct()
    component = connected_components(classes.select(F.col("rep").alias("id")), edges)
    of_class = classes.select("label", "digest", "rep", "n").join(counts, ["label", "digest"], "left").join(component, F.col("rep") == F.col("id"), "left")
    joined = base.join(of_class.select("label", "digest", "n", "links", "cluster"), ["label", "digest"], "left")
    linked = F.col("n").isNotNull() & F.col("vec_id").isNotNull()
    component_id = F.when(linked, F.col("cluster")).otherwise(F.col("vec_id"))
    return joined.select(
        "vec_id", F.when(linked, F.coalesce("links", F.lit(0)) + F.col("n") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component_id.alias("component_id"), F.col("vec_id").eqNullSafe(component_id).alias("kept"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
