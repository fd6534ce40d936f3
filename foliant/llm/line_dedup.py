"""Repeated line chunks with content-defined boundaries (operator 1).

A text's lines are hashed; a rolling hash over the last ``WINDOW`` line hashes decides after
which lines a chunk ends, so the boundaries of a repeated passage don't depend on what stands
before it. Chunks of two lines and more that stand in several places are removed everywhere
but at the first, after their bytes were compared.

The first pass counts chunk digests only. A filter of fixed size made from the repeated
digests picks the chunks whose text the second pass sends on; there, grouping by the text
itself is the byte comparison, so neither a digest collision nor a full filter changes
the result. Very frequent chunks are combined before every shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import query, stored, table

WINDOW = 2
DIVISOR = 2  # mean number of lines to a boundary
MIN_LINES = 2
FILTER_BITS = 1 << 25  # the filter has this many bits at any size of the input: 4 MB

_FACTOR = 31


def chunks_of(text: str) -> list[tuple[int, str]]:
    """``(lines, text)`` of each chunk; joined by line feeds they give the text back."""
    lines = text.split("\n")
    recent, begin, out = [0] * (WINDOW - 1), 0, []
    for i, line in enumerate(lines):
        recent.append(int(md5(line.encode()).hexdigest()[:7], 16))
        rolling = 0
        for h in recent[-WINDOW:]:
            rolling = rolling * _FACTOR + h
        del recent[0]
        if (rolling >> 10) % DIVISOR == 0:
            out.append((i + 1 - begin, "\n".join(lines[begin:i + 1])))
            begin = i + 1
    if begin < len(lines):
        out.append((len(lines) - begin, "\n".join(lines[begin:])))
    return out


def _digest(chunk: str) -> int:
    return int.from_bytes(md5(chunk.encode()).digest()[:8], "little", signed=True)


def _text_key(text: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in batch.column(0):
            found: dict[int, int] = {}
            for lines, chunk in chunks_of(text.as_py()) if text.is_valid else ():
                if lines >= MIN_LINES:
                    d = _digest(chunk)
                    found[d] = found.get(d, 0) + 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["digest", "n"])


def _filter_of(repeated: DataFrame) -> np.ndarray:
    """The digests as a two-probe bit filter; at most ``FILTER_BITS / 64`` words reach the driver."""
    mask = FILTER_BITS - 1
    probes = repeated.select(F.explode(F.array(
        F.col("digest").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("digest", 32).bitwiseAND(F.lit(mask)))).alias("p"))
    words = probes.groupBy(F.shiftright("p", 6).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    held = words.toPandas()
    bits[held["word"].to_numpy()] = held["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return bits


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, no)`` of the chunks to remove, from ``(doc_id, text_key, text)``."""
    counted = docs.select("text").mapInArrow(_count_rows, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    shipped = docs.sparkSession.sparkContext.broadcast(_filter_of(counted.select("digest")))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shipped.value, FILTER_BITS - 1
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0), batch.column(1), batch.column(2)):
                if not text.is_valid:
                    continue
                rows = []
                for no, (lines, chunk) in enumerate(chunks_of(text.as_py())):
                    if lines >= MIN_LINES:
                        d = _digest(chunk)
                        probes = d & mask, (d >> 32) & mask
                        if all(int(bits[p >> 6]) >> (p & 63) & 1 for p in probes):
                            rows.append((doc_id.as_py(), key.as_py(), no, d, chunk))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "text_key", "no", "digest", "chunk"])

    found = stored(docs.mapInArrow(candidates, "doc_id long, text_key long, no int, digest long, chunk string"), "chunks")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "no")
    first = found.groupBy("digest", "chunk").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "chunk", "first")
    return found.join(first, ["digest", "chunk"]).filter(place != F.col("first")).select("doc_id", "text_key", "no")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, chunks_removed, lines_removed)`` for every row of ``docs``.

    A repeated chunk stays at its first place in the order of (id, text checksum, number in
    the text); null ids come last. Rows that repeat both id and text are one document: each
    keeps what the first keeps. A null text stays null, an empty text is a single empty line,
    a text may lose all of its chunks and become empty. Lines end at line feeds. Other
    columns are not read. An empty table gives no rows.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    gone = repeated_chunks(keyed).groupBy("doc_id", "text_key").agg(F.collect_set("no").alias("gone")).toDF("d", "k", "gone")
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text", "gone")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chunks, lines = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2)):
                if not text.is_valid or not gone.is_valid:
                    texts.append(text.as_py())
                    chunks.append(0)
                    lines.append(0)
                    continue
                out = set(gone.as_py())
                cut = chunks_of(text.as_py())
                texts.append("\n".join(c for i, (_, c) in enumerate(cut) if i not in out))
                chunks.append(len(out))
                lines.append(sum(n for i, (n, _) in enumerate(cut) if i in out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(chunks, pa.int64()), pa.array(lines, pa.int64())],
                                             ["doc_id", "text", "chunks_removed", "lines_removed"])

    return joined.mapInArrow(strip, "doc_id long, text string, chunks_removed long, lines_removed long")


CHECK = r"""
WITH rows AS (SELECT doc_id, text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k FROM documents),
docs AS (SELECT DISTINCT doc_id, text, k FROM rows WHERE text IS NOT NULL),
lines AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
cut AS (SELECT *, ((coalesce(lag(h) OVER o, 0) * 31 + h) >> 10) % 2 = 0 AS ends FROM hashed WINDOW o AS (PARTITION BY doc_id, k ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM cut),
chunks AS (SELECT doc_id, k, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM numbered GROUP BY ALL),
judged AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS LAST, k, no) > 1 AS gone FROM chunks),
left_over AS (SELECT doc_id, k, coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS clean,
  count(*) FILTER (gone) AS chunks_removed, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS lines_removed FROM judged GROUP BY ALL)
SELECT r.doc_id, CASE WHEN r.text IS NOT NULL THEN clean END AS text, coalesce(chunks_removed, 0) AS chunks_removed,
  coalesce(lines_removed, 0) AS lines_removed
FROM rows r LEFT JOIN left_over l ON r.doc_id IS NOT DISTINCT FROM l.doc_id AND r.k = l.k AND r.text IS NOT NULL"""


@query("op1_line_dedup", CHECK)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
