"""Cost-balanced packing of token ids into training sequences (operator 11).

The cost of a piece of ``n`` tokens is linear in ``n`` for the matrix products of a model and
quadratic for its attention, which doesn't cross pieces. Documents are dealt at random into
groups of bounded size. A group's tokens fix its sequences: as many full ones as they fill, and
for the rest one sequence for each binary digit, so that none has to be padded. Pieces go in
descending order, each to the sequence of lowest cost that has room for it. A piece for which
none has room is cut: it fills the cheapest open sequence, and what is left queues again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe_codec import encode_texts, slices
from foliant.llm.common import query, table
from foliant.llm.token_output import CACHED_CHUNKS, END_ID, VOCABULARY

CAPACITY = 1024
MODEL_WIDTH = 4096
GROUP_BYTES = 8 << 20
ROW_BYTES = 16  # what a document weighs besides its text
SEQUENCES = 1 << 32  # numbers set aside for the sequences of a group


def cost(tokens, model_width: int = MODEL_WIDTH):
    """Multiplications of a layer for a piece, over ``4 * model_width``: 24 w^2 a token, 4 w for each pair of tokens."""
    return 6 * model_width * tokens + tokens * tokens


def capacities(total: int, capacity: int) -> np.ndarray:
    """Sequence lengths that hold ``total`` tokens without padding: full ones, then powers of two."""
    rest = total % capacity
    return np.array([capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], np.int64)


def balance(lengths: list[int], capacity: int = CAPACITY, model_width: int = MODEL_WIDTH) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of every piece; documents are numbers of ``lengths``.

    Equal lengths go in order of document and start, equal costs to the lower sequence number.
    """
    room = capacities(sum(lengths), capacity)
    size, spent = room.copy(), np.zeros(len(room), np.int64)
    out, full = [], 0
    queue = []
    for number, length in enumerate(lengths):
        # Windows of full length come first of all, each to an empty sequence.
        for start in range(0, length - capacity + 1, capacity):
            out.append((number, start, capacity, full, 0))
            full += 1
        if length % capacity:
            queue.append((-(length % capacity), number, length - length % capacity))
    room[:full], spent[:full] = 0, cost(capacity, model_width)
    heapq.heapify(queue)
    top = np.iinfo(np.int64).max
    while queue:
        length, number, start = heapq.heappop(queue)
        length = -length
        fits = room >= length
        at = int(np.where(fits, spent, top).argmin())
        if not fits[at]:
            at = int(np.where(room > 0, spent, top).argmin())
            left = length - int(room[at])
            heapq.heappush(queue, (-left, number, start + length - left))
            length -= left
        out.append((number, start, length, at, int(size[at] - room[at])))
        room[at] -= length
        spent[at] += cost(length, model_width)
    return out


def pack_balanced(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id",
                  text_col: str = "text", model_width: int = MODEL_WIDTH, group_bytes: int = GROUP_BYTES, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length, cost[, ids])`` for each piece.

    Every text is encoded whole and ended by ``end_id``; null and empty texts are that id alone.
    ``ids`` are little-endian unsigned 32-bit integers. A sequence is ``capacity`` long or a power
    of two; its pieces lie without gaps from offset 0. Null and repeated ids, and rows equal in
    every column, are documents of their own. An empty table gives no rows. Other columns are not
    read. Which documents share a group depends on the order of the rows of ``docs``: give it
    a table, or a plan whose order a rerun repeats.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    weight = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).head()[0] or 0
    groups = max(1, -(-weight // group_bytes))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, cost long" + (
        ", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def fill(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        texts = group["text"].combine_chunks()
        coded: list[bytes] = []
        for a, b in slices(texts, GROUP_BYTES):
            coded += [x.tobytes() + end for x in encode_texts([t or "" for t in texts.slice(a, b - a).to_pylist()], vocabulary, False, CACHED_CHUNKS)]
        ids = group["doc_id"].to_pylist()
        # Rows come in any order; equal keys are equal documents.
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, len(coded[i]), coded[i]))
        sizes = [len(coded[i]) // 4 for i in order]
        base = group["group"][0].as_py() * SEQUENCES
        whole = capacities(sum(sizes), capacity).tolist()
        pieces = balance(sizes, capacity, model_width)
        number, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        parts = [coded[order[n]][4 * s:4 * (s + k)] for n, s, k, _, _ in pieces]
        columns = [pa.array([ids[order[n]] for n in number.tolist()], pa.int64()), start, length, [zlib.crc32(x) for x in parts],
                   np.array(sizes, np.int64)[number], base + sequence, offset, np.array(whole, np.int64)[sequence], cost(length, model_width)]
        arrays = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns]
        return pa.table(arrays + ([pa.array(parts, pa.binary())] if with_ids else []), [c.split()[0] for c in schema.split(", ")])

    # The row number is no part of the result: it deals equal documents to different groups.
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(fill, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, n_pieces, cost, ids, starts)`` of each sequence; ``starts`` are the offsets where attention starts anew.

    ``pieces`` is a result of ``pack_balanced`` with ids. A sequence is bounded by the capacity.
    """
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.count("*").alias("n_pieces"), F.sum("cost").alias("cost"), held.alias("held")).select(
        "sequence_id", "length", "n_pieces", "cost", F.aggregate("held.ids", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x)).alias("ids"),
        F.col("held.offset").alias("starts"))


@query("op11_cost_balanced_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_balanced(table(spark, sf_dir, "documents"), with_ids=False)
