"""Exact duplicates by a tree-merge of sorted digest runs (operator 5).

Every input partition sorts its digests and collapses them to a run. Runs then meet in
rounds: in round *r* the nodes that differ only in digit *r* of their number exchange, and
each keeps the slice of the digest space whose digit *r* is its own. Two-way rounds are the
binomial (hypercube) exchange; ``fan_in`` runs merge at once in the general form. After the
last round a node owns one slice of the digest space, merged over all inputs, so no node
ever holds more than its slice, and a text with very many copies is one row per node from
the first level on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import query, stored, table

_RUN = "node int, digest binary, bytes long, keep_id long, n long"
_LOWEST = np.iinfo(np.int64).min


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse rows sorted by (digest, bytes); equal means the whole digest and the byte length agree.

    One row is held back between batches, as its group may go on.
    """
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        if not rows.num_rows:
            continue
        digest, length = rows["digest"].combine_chunks(), rows["bytes"].combine_chunks()
        fresh = np.ones(len(digest), bool)
        if len(digest) > 1:
            fresh[1:] = pc.or_(pc.not_equal(digest[1:], digest[:-1]), pc.not_equal(length[1:], length[:-1])).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(fresh)
        ids = rows["keep_id"].combine_chunks()
        best = np.maximum.reduceat(ids.fill_null(_LOWEST).to_numpy(zero_copy_only=False), starts)
        known = np.maximum.reduceat(ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int8), starts) > 0
        count = np.add.reduceat(rows["n"].to_numpy(), starts)
        take = pa.array(starts)
        out = pa.RecordBatch.from_arrays(
            [rows["node"].combine_chunks().take(take), digest.take(take), length.take(take),
             pa.array(best, pa.int64(), mask=~known), pa.array(count, pa.int64())], schema=batch.schema)
        held = out.slice(out.num_rows - 1)
        if out.num_rows > 1:
            yield out.slice(0, out.num_rows - 1)
    if held is not None:
        yield held


def digest_groups(digests: DataFrame, fan_in: int = 4) -> DataFrame:
    """``(digest, bytes, keep_id, n)`` of each distinct text from ``(doc_id, digest, bytes)``.

    The number of nodes is the largest power of ``fan_in`` within the session's shuffle
    partitions. ``keep_id`` is the largest id of the group, null only if all its ids are.
    """
    width = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = 1
    while fan_in ** (rounds + 1) <= width:
        rounds += 1
    nodes = fan_in**rounds
    runs = digests.select(
        F.pmod(F.spark_partition_id(), F.lit(nodes)).cast("int").alias("node"), "digest", "bytes",
        F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    runs = runs.sortWithinPartitions("digest", "bytes").mapInArrow(_merge, _RUN)
    slice_of = F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(nodes))
    for r in range(rounds):
        step = fan_in**r
        own, wanted = (F.floor(c / step) % fan_in for c in (F.col("node"), slice_of))
        sent = runs.withColumn("node", (F.col("node") + (wanted - own) * step).cast("int"))
        runs = sent.repartitionById(nodes, F.col("node")).sortWithinPartitions("digest", "bytes").mapInArrow(_merge, _RUN)
    return runs.select("digest", "bytes", "keep_id", "n")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 4) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal when their bytes are: the 256-bit digest and the byte length agree. A
    null text counts as empty, and empty texts equal each other. The largest id of a group
    stays; a null id stays only where the group has no other. Rows that repeat both id and
    text are marked alike. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes")), "digests")
    groups = digest_groups(base, fan_in).filter("n > 1")
    joined = base.join(groups, ["digest", "bytes"], "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


CHECK = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""


@query("op5_exact_dedup", CHECK)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))
