"""Conflict-constrained best-fit packing of documents into context windows (operator 10).

Pieces are dealt by a hash of their document's place in the table into groups of bounded size and packed within
them, largest first. Open bins stand in order of the room they have left and carry two
bitmaps: the sources and the duplicate clusters they hold. For a piece the search starts at
the first bin with room enough and goes on to successors until a bin holds neither its
source nor its cluster: the tightest compatible bin. If there is none, a bin is opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import query, stored, table

CAPACITY = 2048
GROUP_PIECES = 1024
STRIDE = 256  # bins looked at in one step of the search


def _bits(values: list) -> np.ndarray:
    """A bit number for each value that occurs more than once; -1 for null and single values, which can't conflict."""
    often = {v: i for i, v in enumerate(v for v, n in Counter(values).items() if n > 1 and v is not None)}
    return np.array([often.get(v, -1) for v in values], np.int64)


def best_fit(sizes: np.ndarray, sources: list, clusters: list, capacity: int) -> np.ndarray:
    """The bin of each piece, in the order given. No bin holds two pieces of one source or of one cluster."""
    marks = [_bits(sources), _bits(clusters)]
    n = len(sizes)
    # Rows of ``maps`` are 64-bit words of the bitmaps, columns are places in residual order.
    room, number = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    maps = [np.zeros((int(m.max(initial=-1)) // 64 + 1, n + 1), np.uint64) for m in marks]
    bins, out = 0, np.zeros(n, np.int64)
    for i in range(n):
        size = int(sizes[i])
        bit = [(int(m[i]) >> 6, np.uint64(1) << np.uint64(m[i] & 63)) if m[i] >= 0 else None for m in marks]
        place = int(np.searchsorted(room[:bins], size))
        while place < bins:
            ahead = slice(place, min(bins, place + STRIDE))
            free = np.ones(ahead.stop - place, bool)
            for m, b in zip(maps, bit):
                if b is not None:
                    free &= (m[b[0], ahead] & b[1]) == 0
            k = int(free.argmax())
            if free[k]:
                place += k
                break
            place = ahead.stop
        if place < bins:
            left, which, held = int(room[place]) - size, int(number[place]), [m[:, place].copy() for m in maps]
            # The bin moves down to where its smaller residual belongs.
            to = int(np.searchsorted(room[:place], left))
            for a in (room, number):
                a[to + 1:place + 1] = a[to:place].copy()
            for m in maps:
                m[:, to + 1:place + 1] = m[:, to:place].copy()
        else:
            left, which, held = capacity - size, bins, [np.zeros(len(m), np.uint64) for m in maps]
            to = int(np.searchsorted(room[:bins], left))
            for a in (room, number):
                a[to + 1:bins + 1] = a[to:bins].copy()
            for m in maps:
                m[:, to + 1:bins + 1] = m[:, to:bins].copy()
            bins += 1
        room[to], number[to] = left, which
        for m, h, b in zip(maps, held, bit):
            if b is not None:
                h[b[0]] |= b[1]
            m[:, to] = h
        out[i] = which
    return out


def words_in(text: Column) -> Column:
    """Words as runs of anything but white space; the unit of length of the registered query."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def pack(docs: DataFrame, capacity: int = CAPACITY, length: Column | None = None, cluster: Column | None = None, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source", group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``(doc_id, piece, start, length, bin_group, bin, bin_offset, bin_fill)`` for each piece of a document.

    ``length`` counts words unless given, ``cluster`` is a hash of the text unless given. A
    document longer than ``capacity`` is cut into full windows, which fill bins of their own,
    and a rest that is packed like other documents; ``start`` is where a piece begins. A bin
    is named by ``(bin_group, bin)``; full windows have a negative ``bin`` number.

    A null source conflicts with nothing, nor does a null cluster. A document of length 0
    gets one piece of length 0. Null and repeated ids are packed as rows of their own; pieces of
    equal size go in order of (id, source, cluster). Every piece is packed; an empty table
    gives no rows. Other columns are not read.
    """
    cluster = F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) if cluster is None else cluster
    size = words_in(F.col(text_col)) if length is None else length.cast("long")
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.col(source_col).cast("string").alias("source"),
                              cluster.alias("cluster")), "lengths")
    groups = max(1, -(-rows.count() // group_pieces))
    # The place in the written table deals rows that are equal in everything to different groups too.
    group = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    schema = "doc_id long, piece long, start long, length long, bin_group long, bin long, bin_offset long, bin_fill long"
    names = [c.split()[0] for c in schema.split(", ")]

    def fill(part: pa.Table) -> pa.Table:
        size, source, cluster = (part[c].to_numpy() if c == "size" else part[c].to_pylist() for c in ("size", "source", "cluster"))
        ids = part["doc_id"].to_pylist()
        whole = np.maximum(size - 1, 0) // capacity
        rest = size - whole * capacity
        order = sorted(range(len(ids)), key=lambda i: (-rest[i], ids[i] is None, ids[i], source[i] or "", str(cluster[i])))
        chosen = best_fit(rest[order], [source[i] for i in order], [cluster[i] for i in order], capacity)
        fills = np.bincount(chosen, weights=rest[order]).astype(np.int64)
        offset = np.zeros(len(fills), np.int64)
        doc, columns, full = [], [], 0
        group_no = part["bin_group"][0].as_py()
        for i, b in zip(order, chosen.tolist()):
            for k in range(int(whole[i])):
                full += 1
                doc.append(ids[i])
                columns.append((k, k * capacity, capacity, group_no, -full, 0, capacity))
            doc.append(ids[i])
            columns.append((int(whole[i]), int(whole[i]) * capacity, int(rest[i]), group_no, b, int(offset[b]), int(fills[b])))
            offset[b] += rest[i]
        return pa.table([pa.array(doc, pa.int64()), *(pa.array(c, pa.int64()) for c in zip(*columns))], names)

    return rows.withColumn("bin_group", group).groupBy("bin_group").applyInArrow(fill, schema)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
