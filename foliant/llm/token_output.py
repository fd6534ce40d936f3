"""Token ids as Simple-8b words (operator 2).

A segment is a run of whole documents in ascending id order. Its ids are packed into 64-bit
little-endian words: the top four bits select how many ids the other sixty hold and how wide
each is. Ids that don't fit the segment's widest slot are escaped: the all-ones code stands in
their place and they follow in an array of their own. The number of ids before every block of
``BLOCK`` words is stored too, so that a block can be decoded by itself, and all blocks at once.

Segments are rows of a Parquet folder whose files are in id order. Spark's writer commits it,
so a lost executor leaves no half-written part, and no file is addressed by a task itself.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.bpe_codec import encode_texts, slices
from foliant.llm.common import query, shared_folder, table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 0
SEGMENT_IDS = 1 << 18
SLICE_BYTES = 4 << 20  # texts encoded together: larger slices hold fewer distinct chunks
CACHED_CHUNKS = 500_000

# --- fixed values --------------------------------------------------------------
MAGIC = b"S8B1"
HEADER = "<4sIIIII"  # magic, slot width, ids, words, blocks, escapes
BLOCK = 64
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30)
WIDTHS = (15, 20, 30)
# -------------------------------------------------------------------------------


def pack(ids: np.ndarray) -> bytes:
    """One segment's payload. Ids are below 2**32."""
    ids = np.asarray(ids, np.uint32)
    n = len(ids)
    cost = {w: n * w + (32 + w) * int((ids >= (1 << w) - 1).sum()) for w in WIDTHS}
    width = min(cost, key=cost.get)
    code = (1 << width) - 1
    escaped = ids >= code
    codes = np.where(escaped, np.uint32(code), ids).astype(np.uint64)
    choice, step = np.zeros(n, np.uint8), np.zeros(n, np.int64)
    place = np.arange(n, dtype=np.int32)
    for s in reversed(range(len(COUNTS))):
        count, bits = COUNTS[s], BITS[s]
        if bits > width:
            continue
        if bits == width:
            choice[:], step[:] = s, count
            continue
        wide = codes >= (1 << bits)
        if np.diff(np.flatnonzero(wide), prepend=-1, append=n + 60).max() <= count:
            continue
        # The next id that is too wide; past the end all fits, as the last word may be padded.
        far = np.minimum.accumulate(np.where(wide, place, n + 60)[::-1])[::-1]
        fits = far - place >= count
        choice[fits], step[fits] = s, count
    follow, starts, at = (place + step).tolist(), [], 0
    while at < n:
        starts.append(at)
        at = follow[at]
    starts = np.array(starts, np.int64)
    picked = choice[starts] if n else choice
    padded = np.append(codes, np.zeros(60, np.uint64))
    words = np.zeros(len(starts), np.uint64)
    for s in np.unique(picked).tolist():
        here = np.flatnonzero(picked == s)
        values = padded[starts[here][:, None] + np.arange(COUNTS[s])]
        shifted = values << (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s]))
        words[here] = np.bitwise_or.reduce(shifted, axis=1) | (np.uint64(s) << np.uint64(60))
    blocks, escapes = starts[::BLOCK].astype("<u4"), ids[escaped].astype("<u4")
    head = struct.pack(HEADER, MAGIC, width, n, len(words), len(blocks), len(escapes))
    return b"".join([head, blocks.tobytes(), words.astype("<u8").tobytes(), escapes.tobytes()])


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, all blocks at once: words of one selector are shifted together."""
    magic, width, n, n_words, n_blocks, n_escapes = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at = struct.calcsize(HEADER)
    blocks = np.frombuffer(payload, "<u4", n_blocks, at)
    words = np.frombuffer(payload, "<u8", n_words, at + 4 * n_blocks)
    escapes = np.frombuffer(payload, "<u4", n_escapes, at + 4 * n_blocks + 8 * n_words)
    picked = (words >> np.uint64(60)).astype(np.uint8)
    counts = np.array(COUNTS, np.int64)[picked]
    # Within a block, words follow from its stored start.
    starts = np.cumsum(counts) - counts
    if n_words:
        first = np.repeat(np.arange(n_blocks) * BLOCK, BLOCK)[:n_words]
        starts = starts - starts[first] + blocks.astype(np.int64)[first // BLOCK]
    out = np.zeros(n + 60, np.uint32)
    for s in np.unique(picked).tolist():
        here = np.flatnonzero(picked == s)
        values = (words[here][:, None] >> (np.arange(COUNTS[s], dtype=np.uint64) * np.uint64(BITS[s]))) & np.uint64((1 << BITS[s]) - 1)
        out[starts[here][:, None] + np.arange(COUNTS[s])] = values
    out = out[:n]
    out[out == (1 << width) - 1] = escapes
    return out


def write_tokens(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Encode every text, append ``end_id`` and write segments in ascending (id, text) order under ``folder``.

    Null ids come first. A null or empty text is its end id alone. Repeated ids may spread
    over parts. Segments close at ``SEGMENT_IDS`` ids, after a whole document. An empty table
    writes an empty folder.
    """
    schema = "part int, segment int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, start = TaskContext.get().partitionId(), 0, 0
        ids, doc_ids, size = [], [], 0
        end = np.array([end_id], np.uint32)

        def close() -> pa.RecordBatch:
            joined = np.concatenate([x for pair in ids for x in (pair, end)])
            row = [[part], [segment], [start], [size], [doc_ids], [[len(x) + 1 for x in ids]], [pack(joined)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                coded = encode_texts([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()], vocabulary, ranked=False, keep=CACHED_CHUNKS)
                for doc_id, x in zip(batch.column(0).slice(a, b - a).to_pylist(), coded):
                    ids.append(x)
                    doc_ids.append(doc_id)
                    size += len(x) + 1
                    if size >= SEGMENT_IDS:
                        yield close()
                        segment, start = segment + 1, start + size
                        ids, doc_ids, size = [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    ordered.mapInArrow(run, schema).write.option("compression", "uncompressed").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``(doc_id, part, part_start, ids)`` of every document in a written folder; ids as a binary of little-endian uint32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum([0, *row["lengths"]])
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()),
                    pa.array(ends[:-1] + row["part_start"], pa.int64()),
                    pa.array([ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())], ["doc_id", "part", "part_start", "ids"])

    return spark.read.parquet(folder).select("part", "part_start", "doc_ids", "lengths", "payload").mapInArrow(
        run, "doc_id long, part int, part_start long, ids binary")


def token_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, base)``: ids in all earlier parts. A row per written part, from its segments' counts."""
    totals = spark.read.parquet(folder).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


@query("op2_token_output")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder)
    # The digests are taken where the ids are read: only they meet the starts.
    read = read_tokens(spark, folder).select(
        "doc_id", "part", "part_start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return read.join(token_starts(spark, folder), "part").select(
        "doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
