"""Vector codes with per-dimension value dictionaries (operator 12).

Components become integers, and vectors are cut into parts, each coded by the nearest entry of
the part's codebook. Vectors are kept in blocks. A block holds, for every dimension, the
dictionary of the distinct integers that occur there and a code for each vector. To measure a
block against codebooks, the squared differences of every dictionary integer to all entries are
tabulated once a dimension; the distances of all its vectors are then rows gathered from these
tables by code and added up.

A round reads the blocks once. Each task adds up its vectors by entry, so a round moves no more
than the codebooks' size from each task, and the driver holds one set of codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import query, stored, table

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 24  # larger integers would carry sums of squares past 64 bits
BLOCK = 4096
STRIPE = 512  # vectors whose distances are added up at a time


def integers(vectors: DataFrame, scale: int, limit: int, columns: dict[str, str], vec_col: str) -> DataFrame:
    """``columns`` (new name: old name) and ``ints``, little-endian 32-bit ``floor(scale * x)``.

    Without rows whose vector is null or empty, holds a null or non-finite component, or one whose
    integer isn't below ``limit`` in magnitude.
    """
    kept = vectors.select(*[F.col(old).alias(new) for new, old in columns.items()], F.col(vec_col).cast(T.ArrayType(T.DoubleType())).alias("__v"))
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept.schema.fields[:-1]], T.StructField("ints", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = lists.flatten()
            sizes = np.diff(np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
            values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False)) if flat.null_count else flat.to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(values.astype(np.float64) * scale)
                good = np.abs(whole) < limit
            owner = np.repeat(np.arange(len(sizes)), sizes)
            wrong = np.bincount(owner[~good], minlength=len(sizes)) > 0
            pick = np.flatnonzero((sizes > 0) & ~wrong)
            whole = np.where(good, whole, 0).astype("<i4")
            ends = np.cumsum(sizes)
            raw = [whole[ends[i] - sizes[i]:ends[i]].tobytes() for i in pick.tolist()]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(pick)) for c in batch.columns[:-1]), pa.array(raw, pa.binary())], schema.names)

    return kept.mapInArrow(run, schema)


def part_edges(dim: int, parts: int) -> list[int]:
    return [dim * p // parts for p in range(parts + 1)]


def _blocks(rows: DataFrame, dim: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors: their columns as lists, and of each dimension the dictionary and the codes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                ints = np.frombuffer(b"".join(some.column(2).to_pylist()), "<i4").reshape(-1, dim)
                known = [np.unique(ints[:, d], return_inverse=True) for d in range(dim)]
                ends = np.cumsum([0, *(len(v) for v, _ in known)], dtype=np.int32)
                values = pa.ListArray.from_arrays(pa.array([0, dim], pa.int32()), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate([v for v, _ in known]), pa.int32())))
                codes = np.stack([c.reshape(-1).astype("<u2") for _, c in known]).tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some.column(c)) for c in range(2)]
                yield pa.RecordBatch.from_arrays([*lists, values, pa.array([codes], pa.binary())], ["vec_ids", "labels", "values", "codes"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "ints").mapInArrow(run, f"vec_ids array<long>, labels array<{kind}>, values array<array<int>>, codes binary")


def assign(values: list[np.ndarray], codes: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(entry, distance)`` of each vector and part. ``values`` are the dictionaries, ``codes`` one row a dimension.

    ``books`` hold one row an entry. Ties go to the lower entry.
    """
    n, at = codes.shape[1], 0
    entry, distance = np.zeros((n, len(books)), np.int64), np.zeros((n, len(books)), np.int64)
    for p, book in enumerate(books):
        width = book.shape[1]
        dims = range(at, at + width)
        at += width
        if not width:
            continue
        differences = [values[d].astype(np.int64)[:, None] - book[:, d - dims.start][None] for d in dims]
        small = sum(int(np.abs(x).max()) ** 2 for x in differences) < 1 << 31
        tables = [(x * x).astype(np.int32 if small else np.int64) for x in differences]
        for begin in range(0, n, STRIPE):
            stripe = slice(begin, begin + STRIPE)
            total = tables[0][codes[dims.start, stripe]]
            for d in dims[1:]:
                total += tables[d - dims.start][codes[d, stripe]]
            best = total.argmin(1)
            entry[stripe, p], distance[stripe, p] = best, total[np.arange(len(best)), best]
    return entry, distance


def _read(batch: pa.RecordBatch, i: int, dim: int) -> tuple[list[np.ndarray], np.ndarray]:
    lists = batch.column(2)[i].values
    values = [x.values.to_numpy() for x in lists]
    return values, np.frombuffer(batch.column(3)[i].as_py(), "<u2").reshape(dim, -1)


def train(blocks: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """``rounds`` rounds of assigning all vectors and moving entries to the floor of their mean; unused ones stay."""
    dim, widest = sum(b.shape[1] for b in books), max(b.shape[1] for b in books)
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], books=books) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(b), np.int64) for b in books]
            sums = [np.zeros(b.shape, np.int64) for b in books]
            for batch in batches:
                for i in range(batch.num_rows):
                    values, codes = _read(batch, i, dim)
                    entry, _ = assign(values, codes, books)
                    at = 0
                    for p, book in enumerate(books):
                        counts[p] += np.bincount(entry[:, p], minlength=len(book))
                        for d in range(book.shape[1]):
                            np.add.at(sums[p][:, d], entry[:, p], values[at + d][codes[at + d]].astype(np.int64))
                        at += book.shape[1]
            for p, book in enumerate(books):
                used = np.flatnonzero(counts[p])
                totals = np.zeros((len(used), widest), np.int64)
                totals[:, :book.shape[1]] = sums[p][used]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * widest, pa.int32()), pa.array(totals.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(counts[p][used]), flat],
                                                 ["part", "entry", "n", "totals"])

        moved = blocks.mapInArrow(run, "part int, entry int, n long, totals array<long>").groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("totals")[d].cast("decimal(38,0)")).alias(f"t{d}") for d in range(widest)])
        books = [b.copy() for b in books]
        for row in moved.collect():  # one row an entry
            book = books[row["part"]]
            book[row["entry"]] = [int(row[f"t{d}"]) // row["n"] for d in range(book.shape[1])]
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, label, codes, error)`` of every kept vector, and the codebooks, one array a part.

    ``codes`` is a byte for each part (two, little-endian, beyond 256 entries), ``error`` the sum
    of squared distances. A row whose vector is null or empty or holds a null or non-finite
    component is dropped, and so is one with a component of 16,384 or more in magnitude, whose
    integer the tables can't hold. Vectors have the length that the smallest id's has; rows of another length
    are dropped. A length that ``parts`` doesn't divide gives parts that differ by one. Codebooks
    start as the parts of the vectors of the smallest ids, nulls last, equal ids in order of
    their integers; with fewer vectors there are fewer entries. Null and repeated ids are coded
    like others. Other columns are not read. Without kept vectors there are no rows and no entries.
    """
    read = stored(integers(vectors, scale, LIMIT, {"vec_id": id_col, "label": label_col}, vec_col).withColumn(
        "vec_id", F.col("vec_id").cast("long")), "integers")
    first = read.orderBy(F.asc_nulls_last("vec_id"), F.length("ints"), "ints").limit(1).collect()
    dim = len(first[0]["ints"]) // 4 if first else 0
    same = read.filter(F.length("ints") == 4 * dim)
    # At most ``entries`` rows.
    seeds = same.orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).select("ints").collect() if dim else []
    start = np.frombuffer(b"".join(bytes(r[0]) for r in seeds), "<i4").reshape(-1, dim or 1).astype(np.int64)
    edges = part_edges(dim, parts)
    books = [start[:, a:b] for a, b in zip(edges, edges[1:])]
    kind = read.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {kind}, codes binary, error long"
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema), books
    blocks = stored(_blocks(same, dim), "coded-blocks")
    books = train(blocks, books, rounds)
    wide = "<u2" if entries > 256 else "u1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                entry, distance = assign(*_read(batch, i, dim), books)
                raw = [x.tobytes() for x in entry.astype(wide)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, batch.column(1)[i].values, pa.array(raw, pa.binary()),
                                                  pa.array(distance.sum(1))], ["vec_id", "label", "codes", "error"])

    return blocks.mapInArrow(run, schema), books


def decompress(coded: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """``(vec_id, vec)``: the entries of a vector's codes, scaled back. A null code gives a null vector."""
    wide = "<u2" if max(map(len, books)) > 256 else "u1"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if raw is None else np.concatenate([b[e] for b, e in zip(books, np.frombuffer(raw, wide))]) / scale
                       for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], ["vec_id", "vec"])

    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, vec array<double>")


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def _check() -> str:
    """The same steps in SQL: part rows against codebook rows, the nearest by the smallest (distance, entry)."""
    steps = ["""kept AS (SELECT vec_id, label, embedding AS e FROM embeddings
        WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
    cells AS MATERIALIZED (SELECT vec_id, label, d // 16 AS part, d % 16 AS pos, CAST(floor(1024 * CAST(e[d + 1] AS DOUBLE)) AS BIGINT) AS v
        FROM kept, (SELECT unnest(range(64)) AS d)),
    first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256),
    book0 AS MATERIALIZED (SELECT part, entry, pos, v FROM cells JOIN first USING (vec_id))"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""near{r} AS MATERIALIZED (SELECT vec_id, part, min(distance * 256 + entry) AS best FROM
            (SELECT c.vec_id, part, b.entry, sum((c.v - b.v) * (c.v - b.v)) AS distance FROM cells c JOIN book{r} b USING (part, pos)
             GROUP BY c.vec_id, part, b.entry) GROUP BY vec_id, part)""")
        if r < ROUNDS:
            steps.append(f"""book{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN
            (SELECT part, CAST(best % 256 AS BIGINT) AS entry, pos, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v
             FROM near{r} JOIN cells USING (vec_id, part) GROUP BY 1, 2, 3) m USING (part, entry, pos))""")
    return "WITH " + ",\n    ".join(steps) + f""",
    coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % 256 AS INT)), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
        FROM near{ROUNDS} GROUP BY vec_id)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
        (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""


@query("op12_vector_codes", _check())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    coded = stored(coded, "codes")
    totals = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"))  # null beyond 64 bits
    return coded.alias("c").join(totals.alias("t"), F.col("c.label").eqNullSafe(F.col("t.label"))).select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))
