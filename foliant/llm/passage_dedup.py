"""Repeated passages of lines with their true edges (operator 1).

Any two adjacent lines are a window. A window that stood at an earlier place goes with both of
its lines, so a repeated passage of two lines and more goes from its first to its last line,
whatever stands around it and however its lines fall into the chunks of ``line_dedup``.

The first pass counts window digests only and the bit filter of ``line_dedup`` picks the windows
that may repeat. The lines of those are compared byte by byte: grouped by their text, a digest
with two texts shows up, and windows with such a line are told apart by their text. So neither
a digest collision nor a full filter changes the result, and each text is shuffled once at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe_codec import slices
from foliant.llm.common import query, stored, table
from foliant.llm.line_dedup import FILTER_BITS, _filter_of, _text_key

SLICE = 1 << 22
DIGEST_BYTES = 8

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _lines_of(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lines of some texts, the text each belongs to, and its number there."""
    cut = [t.split("\n") if t is not None else [] for t in texts]
    sizes = np.array([len(c) for c in cut], np.int64)
    doc = np.repeat(np.arange(len(cut)), sizes)
    return [line for c in cut for line in c], doc, np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _windows(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, their digests, text and number, the first line of each window, and the windows' digests."""
    lines, doc, no = _lines_of(texts)
    digests = np.frombuffer(b"".join(md5(line.encode()).digest()[:DIGEST_BYTES].ljust(8, b"\0") for line in lines), np.uint64)
    first = np.flatnonzero(doc[1:] == doc[:-1])
    mixed = (digests[first] ^ (digests[first] >> np.uint64(31))) * _FACTOR + digests[first + 1]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTOR
    return lines, digests.view(np.int64), doc, no, first, (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def _count_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(0), SLICE):
            found, n = np.unique(_windows(batch.column(0).slice(a, b - a).to_pylist())[5], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], ["digest", "n"])


def _candidates(bits: np.ndarray, digests: np.ndarray) -> np.ndarray:
    kept = np.ones(len(digests), bool)
    for probe in (digests, digests.view(np.uint64) >> np.uint64(32)):
        p = probe.astype(np.uint64) & np.uint64(FILTER_BITS - 1)
        kept &= (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return kept


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, no)`` of the windows to remove, by their first line, from ``(doc_id, text_key, text)``."""
    context = docs.sparkSession.sparkContext
    counted = docs.select("text").mapInArrow(_count_windows, "digest long, n long").groupBy("digest").agg(F.sum("n").alias("n")).filter("n > 1")
    shipped = context.broadcast(_filter_of(counted.select("digest")))

    def lines_in_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), SLICE):
                lines, digests, _, _, first, windows = _windows(batch.column(0).slice(a, b - a).to_pylist())
                at = first[_candidates(shipped.value, windows)]
                told = {lines[i]: digests[i] for i in np.union1d(at, at + 1).tolist()}
                yield pa.RecordBatch.from_arrays([pa.array(told.values(), pa.int64()), pa.array(told, pa.string())], ["digest", "line"])

    texts = docs.select("text").mapInArrow(lines_in_windows, "digest long, line string").groupBy("digest", "line").agg(F.count("*").alias("n"))
    # Digests of several texts: none is expected among 64-bit digests.
    collided = context.broadcast({r[0] for r in texts.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest").collect()})

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doubtful = np.array(sorted(collided.value), np.int64)
        for batch in batches:
            for a, b in slices(batch.column(2), SLICE):
                lines, digests, doc, no, first, windows = _windows(batch.column(2).slice(a, b - a).to_pylist())
                at = first[_candidates(shipped.value, windows)]
                doubt = np.isin(digests[at], doubtful) | np.isin(digests[at + 1], doubtful)
                told = [f"{lines[i]}\n{lines[i + 1]}" if d else "" for i, d in zip(at.tolist(), doubt.tolist())]
                row = pa.array(doc[at] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(row), batch.column(1).take(row), pa.array(no[at], pa.int32()), pa.array(digests[at]), pa.array(digests[at + 1]),
                     pa.array(told, pa.string())], ["doc_id", "text_key", "no", "upper", "lower", "told"])

    found = stored(docs.mapInArrow(places, "doc_id long, text_key long, no int, upper long, lower long, told string"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "no")
    same = ["upper", "lower", "told"]
    first = found.groupBy(*same).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select(*same, "first")
    shares_a_line = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("no") == F.col("first.no") + 1)
    return found.join(first, same).filter((place != F.col("first")) & ~shares_a_line).select("doc_id", "text_key", "no")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, runs_removed, lines_removed)`` for every row of ``docs``.

    A line goes if it and a neighbour stood next to each other at an earlier place, in the order
    of (id, text checksum, number of the line); null ids come last. Of one line repeated without
    a break the first two stay. Every line that goes stays somewhere before. Rows that repeat
    both id and text are one document: each keeps what the first keeps. A null text stays null,
    an empty text is a single empty line, a text may lose all of its lines and become empty.
    Lines end at line feeds. Other columns are not read. An empty table gives no rows.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    gone = repeated_windows(keyed).groupBy("doc_id", "text_key").agg(F.collect_set("no").alias("gone")).toDF("d", "k", "gone")
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text", "gone")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs, removed = [], [], []
            for text, gone in zip(batch.column(1), batch.column(2)):
                if not text.is_valid or not gone.is_valid:
                    texts.append(text.as_py())
                    runs.append(0)
                    removed.append(0)
                    continue
                begins = gone.as_py()
                out = {*begins, *(i + 1 for i in begins)}
                texts.append("\n".join(line for i, line in enumerate(text.as_py().split("\n")) if i not in out))
                runs.append(sum(i - 1 not in out for i in out))
                removed.append(len(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(runs, pa.int64()), pa.array(removed, pa.int64())],
                                             ["doc_id", "text", "runs_removed", "lines_removed"])

    return joined.mapInArrow(strip, "doc_id long, text string, runs_removed long, lines_removed long")


CHECK = r"""
WITH rows AS (SELECT doc_id, text, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k FROM documents),
docs AS (SELECT DISTINCT doc_id, text, k FROM rows WHERE text IS NOT NULL),
lines AS (SELECT doc_id, k, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
paired AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, k ORDER BY i) AS below FROM lines),
placed AS (SELECT *, row_number() OVER o AS r, first_value(struct_pack(d := doc_id, k := k, i := i)) OVER o AS f FROM paired
  WINDOW o AS (PARTITION BY line, below ORDER BY doc_id NULLS LAST, k, i)),
again AS (SELECT *, below IS NOT NULL AND r > 1 AND NOT (f.d IS NOT DISTINCT FROM doc_id AND f.k = k AND i = f.i + 1) AS w FROM placed),
judged AS (SELECT *, w OR coalesce(lag(w) OVER (PARTITION BY doc_id, k ORDER BY i), false) AS gone FROM again),
led AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id, k ORDER BY i), false) AS leads FROM judged),
left_over AS (SELECT doc_id, k, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean,
  count(*) FILTER (leads) AS runs_removed, count(*) FILTER (gone) AS lines_removed FROM led GROUP BY ALL)
SELECT r.doc_id, CASE WHEN r.text IS NOT NULL THEN clean END AS text, coalesce(runs_removed, 0) AS runs_removed,
  coalesce(lines_removed, 0) AS lines_removed
FROM rows r LEFT JOIN left_over l ON r.doc_id IS NOT DISTINCT FROM l.doc_id AND r.k = l.k AND r.text IS NOT NULL"""


@query("op1_passage_dedup", CHECK)
def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_passages(table(spark, sf_dir, "documents"))
