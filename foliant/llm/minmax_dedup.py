"""Near-duplicate documents by min-max hashing (operator 7).

A document is the set of its five-word shingles. Each of ``PERMUTATIONS`` hash functions is
evaluated once for a shingle, and both the smallest and the largest value are kept, so a
signature has twice as many independent agreeing positions as hash evaluations. Bands of
``ROWS`` positions group documents; a pair of similarity 0.75 shares no band with
probability under 4e-6, while documents that share only a passage rarely meet.

Equal sets are one class from the start. In each band bucket a pivot is compared with all
other classes; the signatures drop hopeless pairs, the whole sets confirm the rest. Members
that a pivot leaves in different components are compared in a second round, block by block:
a bucket is cut into blocks of bounded size, and a task counts the shared shingles of two
blocks and returns the links that join components. So a large group of copies costs one
comparison a member, no pair list of a bucket is made, and yet every pair of a bucket that
could add a link is compared on its whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.bpe_codec import slices
from foliant.llm.common import query, stored, table
from foliant.operators.graph import connected_components

WORDS = 5
SIMILARITY = 75  # percent
PERMUTATIONS = 118
ROWS = 5
BLOCK = 512  # members of a block
COLUMNS = 4096  # shingles counted at once
SEED = 20260117
HOPELESS = 0.62  # an estimate below this is more than four and a half deviations under the threshold
SLICE = 2 << 20

_SIGNED = np.int64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_K1, _K2, _K3 = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _K1
    h = (h ^ (h >> np.uint64(33))) * _K2
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, ends)``: the sorted distinct 64-bit shingle hashes of each text, one after another.

    A-Z are lowered; words are runs of bytes other than space and 0x09-0x0D. A word's hash is
    a polynomial of its bytes taken from running sums; a shingle's, one of its words' hashes.
    With fewer than five words the whole sequence is one shingle; without words there is none.
    """
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    power = np.cumprod(np.full(len(data), 0x5851F42D4C957F2D, np.uint64))
    running = np.cumsum((_mix(np.arange(1, 257, dtype=np.uint64)))[data] * power)
    # Powers are odd, so they have inverses: the hash doesn't depend on the word's place.
    inverse = np.cumprod(np.full(len(data), pow(0x5851F42D4C957F2D, -1, 1 << 64), np.uint64))
    word = _mix((running[stops - 1] - running[starts - 1]) * inverse[starts] + (stops - starts).astype(np.uint64) * _K3)
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds[:-1])
    count = np.diff(np.append(first, len(starts)))
    n = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    used = np.minimum(count, WORDS)[doc]
    code = used.astype(np.uint64)
    padded = np.append(word, np.zeros(WORDS, np.uint64))
    for k in range(WORDS):
        code = np.where(k < used, _mix(code * _K3 + padded[at + k]), code)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    fresh = np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
    code, doc = code[fresh], doc[fresh]
    return code, np.searchsorted(doc, np.arange(len(texts)), "right")


def signatures(code: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(sets x 2 PERMUTATIONS) minima and maxima; rows of empty sets are zero."""
    random = np.random.default_rng(SEED)
    factors = random.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    masks = random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
    out = np.zeros((len(ends), 2 * PERMUTATIONS), np.uint64)
    sizes = np.diff(ends, prepend=0)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (ends - sizes)[some]
        for k in range(PERMUTATIONS):
            values = (code ^ masks[k]) * factors[k]
            out[some, 2 * k] = np.minimum.reduceat(values, starts)
            out[some, 2 * k + 1] = np.maximum.reduceat(values, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(sets x bands) keys. A band takes positions of different permutations."""
    spread = np.concatenate([signature[:, 0::2], signature[:, 1::2]], axis=1)
    grouped = spread[:, :spread.shape[1] // ROWS * ROWS].reshape(len(spread), -1, ROWS)
    key = np.arange(grouped.shape[1], dtype=np.uint64) * _K3
    for r in range(ROWS):
        key = _mix(key * _K1 + grouped[:, :, r])
    return key


def _bytes_of(texts: pa.Array) -> list[bytes]:
    return [t or b"" for t in texts.cast(pa.binary()).to_pylist()]


def profiles(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, set_a, set_b, keys, signature)`` from ``(doc_id, text)``.

    ``set_a`` and ``set_b`` are two 64-bit sums over the set: with its size they name it.
    ``signature`` keeps a byte of each position.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                code, ends = shingle_sets(_bytes_of(batch.column(1).slice(a, b - a)))
                signed = signatures(code, ends)
                upto = [np.append(np.uint64(0), np.cumsum(_mix(code * k + _K3)))[np.append(0, ends)] for k in (_K1, _K2)]
                keys = bands(signed)
                fold = (signed >> np.uint64(20)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(ends, prepend=0), pa.int64()),
                    *(pa.array(np.diff(x).view(_SIGNED)) for x in upto),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(_SIGNED))),
                    pa.array([row.tobytes() for row in fold], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "keys", "signature"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>, signature binary")


def _sets(docs: DataFrame) -> DataFrame:
    """``(id, shingles)``: whole shingle sets from ``(id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                code, ends = shingle_sets(_bytes_of(batch.column(1).slice(a, b - a)))
                offsets = pa.array(np.append(0, ends).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(code.view(_SIGNED)))],
                                                 ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _plausible(pairs: DataFrame) -> DataFrame:
    """``(a, b)`` of the pairs ``(a, b, sa, sb)`` that their signatures don't rule out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            good = (left == right).mean(1) >= HOPELESS
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good)) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(likely: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that reach the similarity on their whole sets; ``sets(id, signature, shingles)``."""
    whole = sets.select("id", "shingles")
    both = likely.join(whole.toDF("a", "xa"), "a").join(whole.toDF("b", "xb"), "b")
    shared = F.size(F.array_intersect("xa", "xb"))
    return both.filter(100 * shared >= SIMILARITY * (F.size("xa") + F.size("xb") - shared)).select("a", "b").distinct()


def _star_links(bucket: DataFrame, sets: DataFrame) -> DataFrame:
    """The links of each bucket's smallest member."""
    pivot = F.min(F.struct(F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"))).alias("p")
    chosen = bucket.groupBy("key").agg(pivot).select("key", "p.*")
    alike = 100 * F.least("n", "pivot_n") >= SIMILARITY * F.greatest("n", "pivot_n")
    pairs = bucket.join(chosen, "key").filter((F.col("rep") > F.col("pivot")) & alike).select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    sign = sets.select("id", "signature")
    likely = stored(_plausible(pairs.join(sign.toDF("a", "sa"), "a").join(sign.toDF("b", "sb"), "b")), "likely")
    return _confirmed(likely, sets)


def _joining(group: pa.Table) -> list[tuple[int, int]]:
    """Links between members of two blocks, or of one, that join components not joined in this group before.

    Shared shingles are counted for all pairs at once; those that only one member has count for none.
    """
    rep, n, label, own = (group[c].to_numpy() for c in ("rep", "n", "label", "own"))
    lists = group["shingles"].combine_chunks()
    codes = lists.flatten().to_numpy()
    member = np.repeat(np.arange(len(rep)), lists.value_lengths().to_numpy())
    _, column, often = np.unique(codes, return_inverse=True, return_counts=True)
    number = np.cumsum(often > 1) - 1
    several = often[column] > 1
    member, column = member[several], number[column[several]]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    shared = np.zeros((len(rep), len(rep)), np.float32)
    total = int(column[-1]) + 1 if len(column) else 0
    for begin in range(0, total, COLUMNS):
        x, y = np.searchsorted(column, [begin, begin + COLUMNS])
        held = np.zeros((len(rep), COLUMNS), np.float32)
        held[member[x:y], column[x:y] - begin] = 1
        shared += held @ held.T
    shared = shared.astype(np.int64)
    link = (100 * shared >= SIMILARITY * (n[:, None] + n[None] - shared)) & (label[:, None] != label[None])
    if own.min() != own.max():
        link &= own[:, None] != own[None]
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for p, q in zip(*np.nonzero(np.triu(link))):
        x, y = find(int(label[p])), find(int(label[q]))
        if x != y:
            up[x] = y
            out.append((int(rep[p]), int(rep[q])))
    return out


def _block_links(bucket: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join all components which any pair of a bucket's members joins."""
    blocks = bucket.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = bucket.join(blocks, "key").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.join(sets.select(F.col("id").alias("rep"), "shingles"), "rep").select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "label", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            edge = np.any([np.diff(held[c].to_numpy()) != 0 for c in ("key", "i", "j")], axis=0)
            cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
            yield from joined(held, cuts)
            held = held.slice(cuts[-1])
        if held is not None:
            yield from joined(held, [0, held.num_rows])

    def joined(table: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        found = [pair for x, y in zip(cuts, cuts[1:]) if y - x > 1 for pair in _joining(table.slice(x, y - x))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    return rows.join(moved, "label", "left").withColumn("label", F.coalesce("cluster", "label")).drop("cluster")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Documents link when 100 times their shared shingles reach 75 times their union; a
    component's id is its smallest document id, and that document is kept. A null or
    wordless text has an empty set and links with nothing. A row with a null id is its own
    component and kept. Rows that repeat an id are one node: it links where any of its texts
    does. Other columns are not read. An empty table gives no rows.
    """
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = stored(profiles(named), "profiles")
    known = base.filter("doc_id is not null and n_shingles > 0")
    names = ["set_a", "set_b", "n_shingles"]
    classes = known.groupBy(*names).agg(F.min("doc_id").alias("rep"))
    reps = stored(known.select("doc_id", *names, "keys", "signature").join(
        classes.withColumnRenamed("rep", "doc_id"), ["doc_id", *names], "left_semi").dropDuplicates(["doc_id", *names]).withColumnRenamed("doc_id", "rep"), "classes")
    rows = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    bucket = stored(rows.join(shared.select("key"), "key").select("key", "rep", "n", F.col("rep").alias("label")), "buckets")
    # The texts are dealt once: whole sets of all that met anyone.
    wanted = bucket.select(F.col("rep").alias("doc_id")).distinct()
    sets = _sets(named.join(wanted, "doc_id", "left_semi"))
    sets = stored(sets.join(reps.select(F.col("rep").alias("id"), "signature"), "id"), "sets")
    label = reps.select("rep", F.col("rep").alias("label")).distinct()
    for links_of in (_star_links, _block_links):
        found = stored(links_of(bucket, sets), "links")
        # Only labels that met are contracted further.
        met = found.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct()
        nodes = met.select(F.col("a").alias("id")).union(met.select("b"))
        moved = stored(connected_components(nodes, met).select(F.col("id").alias("label"), "cluster"), "moves")
        label = stored(_relabelled(label, moved), "labels")
        if links_of is _block_links:
            break
        # A pivot has met its whole bucket; the others matter where they span components.
        rest = _relabelled(bucket, moved)
        spans = rest.groupBy("key").agg(F.min("rep").alias("pivot"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key", "pivot")
        bucket = stored(rest.join(spans, "key").filter("rep <> pivot").select("key", "rep", "n", "label"), "buckets")
    of_class = reps.select(*names, "rep").join(label, "rep").select(*names, "label")
    member = base.join(of_class, names, "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("label")).otherwise(F.col("doc_id"))
    return member.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


@query("op7_minmax_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
