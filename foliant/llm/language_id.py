"""Language identification of mixed text (operator 4).

Every letter lies in a script by its code-point range; a word's script narrows the candidate
languages to those that use it. A word's score for a language is the sum of weights of the
three- and five-letter windows around its letters. Viterbi over the words, with a penalty
for each switch, then labels spans. Those scores only compare learned languages, so a
confidence tells how well the letters suit their labels at all.

Weights come from a bounded sample of labelled rows (``SAMPLE_DOCS`` for each language);
their windows are hashed and counted on the executors. Prediction reads nothing but texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.bpe_codec import slices
from foliant.llm.common import per_process, query, table

SAMPLE_DOCS = 500
BUCKET_BITS = 17
SWITCH_PENALTY = 12.0
SMOOTHING = 0.5
MIN_SCRIPT_SHARE = 0.02
BENEFIT = 10.0  # letters that count as well known in the confidence of any text in a learned script
SLICE = 1 << 20
STEPS = 64  # words in a block of the parallel Viterbi
UNKNOWN = "und"

# --- fixed values --------------------------------------------------------------
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F),
    ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x3134F),
)
# -------------------------------------------------------------------------------
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))


class Model(NamedTuple):
    """``weights`` (buckets x languages) and ``uses`` (scripts x languages, booleans).

    ``weights`` plus ``mean`` (buckets) are log probabilities. ``usual`` and ``unseen`` (languages)
    are a letter's mean log probability in held-out rows of the language, and in windows it never had.
    """

    languages: list[str]
    weights: np.ndarray
    uses: np.ndarray
    mean: np.ndarray
    usual: np.ndarray
    unseen: np.ndarray


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case (0 if no letter) and its script."""
    def build() -> tuple[np.ndarray, np.ndarray]:
        lower, script = np.zeros(0x110000, np.uint32), np.zeros(0x110000, np.uint8)
        for c in range(0x323B0):
            if unicodedata.category(chr(c))[0] == "L":
                small = chr(c).lower()
                lower[c] = ord(small) if len(small) == 1 else c
        for name, a, b in SCRIPT_RANGES:
            script[a:b + 1] = SCRIPTS.index(name)
        return lower, script

    return per_process("characters", build)


class Words(NamedTuple):
    """Words of some texts in order: ``doc``, character ``start`` and ``end``, letter count, script, and per letter its word and buckets."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    first: np.ndarray
    near: np.ndarray
    wide: np.ndarray


def _bucket(code: np.ndarray) -> np.ndarray:
    mixed = (code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def words_of(texts: list[str]) -> Words:
    """Runs of letters are words; everything else, and the edge of a text, is a boundary."""
    lower, script = _characters()
    joined = "\n".join(["", *texts, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = lower[points]
    is_letter = low > 0
    at = np.flatnonzero(is_letter)
    lead = ~is_letter[at - 1] if len(at) else np.zeros(0, bool)
    first = np.flatnonzero(lead)
    start = at[first]
    end = at[np.append(first[1:], len(at))[:len(first)] - 1] + 1
    bounds = np.cumsum([1, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(bounds, start, "right") - 1
    code = low.astype(np.uint64)
    before, here, after = code[at - 1], code[at], code[at + 1]
    further = np.where(before > 0, code[np.maximum(at - 2, 0)], 0).astype(np.uint64)
    beyond = np.where(after > 0, code[np.minimum(at + 2, len(code) - 1)], 0).astype(np.uint64)
    k = np.uint64(0x9DDFEA08EB382D69)
    three = ((before * k + here) * k + after) * k
    five = ((three + further) * k + beyond) * k + np.uint64(1)
    return Words(doc, start - bounds[doc], end - bounds[doc], end - start, script[points[start]], first, _bucket(three), _bucket(five))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window and script counts of each language and half, summed over a slice before they leave the task."""
    for batch in batches:
        for a, b in slices(batch.column(1), SLICE):
            langs, texts, halves = (batch.column(c).slice(a, b - a).to_pylist() for c in range(3))
            for lang, half in dict.fromkeys(zip(langs, halves)):
                w = words_of([t for t, x, h in zip(texts, langs, halves) if x == lang and h == half])
                buckets = np.bincount(np.concatenate([w.near, w.wide]), minlength=1 << BUCKET_BITS)
                scripts = np.bincount(w.script, weights=w.letters, minlength=len(SCRIPTS)).astype(np.int64)
                used, seen = np.flatnonzero(buckets), np.flatnonzero(scripts)
                keys = np.concatenate([used, -1 - seen])
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(keys), pa.string()), pa.array([half] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                    pa.array(np.concatenate([buckets[used], scripts[seen]]), pa.int64())], ["lang", "half", "key", "n"])


def _letter_scores(counts: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For each language, the mean log probability of a letter's two windows in ``counts`` by a model fitted on ``other``."""
    odds = np.log((other + SMOOTHING) / (other.sum(0) + SMOOTHING * len(other)))
    return 2 * (counts * odds).sum(0) / np.maximum(counts.sum(0), 1)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on at most ``sample_docs`` rows of each language with a known label.

    Rows equal in id and text count once; ids may be null or repeat. Distinct rows are counted (approximately, which only
    steers the thinning), thinned by a hash of id and text to about three times the bound, and cut to it by hash order:
    the ranking sees a bounded number of rows, and every language with a text has rows. The model has
    ``2**BUCKET_BITS`` weights for each language whatever the input. Each half of the sample is
    held out from a model of the other half to learn how well rows of a language usually score.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"),
                           F.xxhash64(text_col, id_col, F.lit(1)).alias("h2")).filter("lang is not null and text is not null")
    counted = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("distinct")).collect()
    sizes = {r["lang"]: r["n"] for r in counted}
    if not sizes:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool),
                     np.zeros(1 << BUCKET_BITS, np.float32), np.zeros(0), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in counted for x in (r["lang"], min(1.0, 3.0 * sample_docs / max(1, r["distinct"])))])
    thin = rows.filter(F.pmod(F.col("h"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
    key = ["lang", "h", "h2"]
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "h2"))
    chosen = thin.select(*key).distinct().withColumn("r", rank).filter(F.col("r") <= sample_docs).drop("r")
    sample = thin.join(chosen, key, "left_semi").dropDuplicates(key).select(
        "lang", "text", F.pmod(F.shiftright("h", 32), F.lit(2)).cast("int").alias("half"))
    summed = sample.mapInArrow(_counts, "lang string, half int, key long, n long").groupBy("lang", "half", "key").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    halves, scripts = np.zeros((2, 1 << BUCKET_BITS, len(languages))), np.zeros((len(SCRIPTS), len(languages)))
    column = summed["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    key, n, half = summed["key"].to_numpy(), summed["n"].to_numpy(), summed["half"].to_numpy()
    window = key >= 0
    halves[half[window], key[window], column[window]] = n[window]
    np.add.at(scripts, (-1 - key[~window], column[~window]), n[~window])
    counts = halves.sum(0)
    odds = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts)))
    mean = odds.mean(1)
    sizes_of = halves.sum(1)
    usual = (_letter_scores(halves[0], halves[1]) * sizes_of[0] + _letter_scores(halves[1], halves[0]) * sizes_of[1]) / np.maximum(sizes_of.sum(0), 1)
    usual = np.where((sizes_of > 0).all(0), usual, _letter_scores(counts, counts))  # a single row can't be held out
    unseen = 2 * np.log(SMOOTHING / (counts.sum(0) + SMOOTHING * len(counts)))
    return Model(languages, (odds - mean[:, None]).astype(np.float32), scripts / np.maximum(scripts.sum(0), 1) >= MIN_SCRIPT_SHARE,
                 mean.astype(np.float32), usual, unseen)


def word_scores(model: Model, words: Words) -> np.ndarray:
    """(words x languages); languages that don't use a word's script are out, unless none does."""
    if not len(words.first):
        return np.zeros((0, len(model.languages)), np.float32)
    letters = model.weights[words.near] + model.weights[words.wide]
    scores = np.add.reduceat(letters, words.first, axis=0)
    allowed = model.uses[words.script]
    scores[~allowed & allowed.any(1, keepdims=True)] = -1e4
    scores[~allowed.any(1)] = 0
    return scores


def viterbi(scores: np.ndarray, doc: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of each word, where each change of label within a document costs ``penalty``.

    Documents are cut into blocks of ``STEPS`` words. Best paths through all blocks are found
    at once from every entry label, blocks are chained, and labels are read back the same way,
    so a long document takes no more passes over a batch than its blocks.
    """
    n, width = scores.shape
    if not n:
        return np.zeros(0, np.uint8)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    lengths = np.diff(np.append(starts, n))
    per_doc = -(-lengths // STEPS)
    total = int(per_doc.sum())
    block_doc = np.repeat(np.arange(len(starts)), per_doc)
    first_block = np.cumsum(per_doc) - per_doc
    block_no = np.arange(total) - first_block[block_doc]
    inner = np.arange(n) - np.repeat(starts, lengths)
    grid = np.zeros((STEPS, total, width), np.float32)
    word_block = first_block[np.repeat(np.arange(len(starts)), lengths)] + inner // STEPS
    grid[inner % STEPS, word_block] = scores
    penalty = np.float32(penalty)

    through = np.where(np.eye(width, dtype=bool), np.float32(0), -penalty)[None] + grid[0][:, None, :]
    for t in range(1, STEPS):
        through = np.maximum(through, through.max(2, keepdims=True) - penalty) + grid[t][:, None, :]
    # Documents by falling number of blocks: those still running are a prefix.
    order = np.argsort(-per_doc, kind="stable")
    running = np.searchsorted(-per_doc[order], -np.arange(per_doc.max()), "left")
    entry = np.zeros((total, width), np.float32)
    value = np.zeros((len(starts), width), np.float32)
    for b in range(int(per_doc.max())):
        docs = order[:running[b]]
        blocks = first_block[docs] + b
        entry[blocks] = value[docs]
        left = (value[docs][:, :, None] + through[blocks]).max(1)
        value[docs] = left - left.max(1, keepdims=True)

    came = np.zeros((STEPS, total, width), np.uint8)
    labels = np.arange(width, dtype=np.uint8)
    state = entry
    for t in range(STEPS):
        top = state.argmax(1)
        best = np.take_along_axis(state, top[:, None], 1) - penalty
        switch = best > state
        came[t] = np.where(switch, top[:, None].astype(np.uint8), labels[None])
        state = np.where(switch, best, state) + grid[t]
    back = np.broadcast_to(labels, (total, width)).copy()
    for t in reversed(range(STEPS)):
        back = np.take_along_axis(came[t], back, 1)
    leave = np.zeros(total, np.uint8)
    final = value.argmax(1).astype(np.uint8)
    for b in reversed(range(int(per_doc.max()))):
        docs = order[:running[b]]
        blocks = first_block[docs] + b
        leave[blocks] = final[docs]
        final[docs] = back[blocks, final[docs]]
    path, at = np.zeros((STEPS, total), np.uint8), leave
    every = np.arange(total)
    for t in reversed(range(STEPS)):
        path[t] = at
        at = came[t][every, at]
    return path[inner % STEPS, word_block]


def _confidence(model: Model, words: Words, scores: np.ndarray, labels: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts: the share of letters in learned scripts, times how well those suit their labels.

    A letter counts 0 if the label's language never had its windows and 1 if it scores as letters
    of held-out rows do. ``BENEFIT`` letters that count 1 are added, as few letters tell little.
    """
    known = model.uses[words.script].any(1)
    at = np.add.reduceat(model.mean[words.near] + model.mean[words.wide], words.first) if len(words.first) else np.zeros(0)
    found = at + scores[np.arange(len(labels)), labels]
    scale = np.maximum(model.usual - model.unseen, 1e-3)[labels]
    suits = np.where(known, np.maximum(found - words.letters * model.unseen[labels], 0) / scale, 0)
    suited, learned, every = (np.bincount(words.doc, weights=w, minlength=n) for w in (suits, words.letters * known, words.letters))
    return np.minimum((suited + BENEFIT) / (learned + BENEFIT), 1) * learned / np.maximum(every, 1)


def label_texts(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY):
    """``(doc, start, end, label)`` arrays of the spans, ``(doc, label) -> letters`` counts and each text's confidence."""
    words = words_of(texts)
    width = max(len(model.languages), 1)
    scores = word_scores(model, words) if model.languages else np.zeros((len(words.doc), 1), np.float32)
    labels = viterbi(scores, words.doc, penalty)
    letters = np.bincount(words.doc * width + labels, weights=words.letters, minlength=len(texts) * width).reshape(len(texts), width)
    fresh = np.append(True, (words.doc[1:] != words.doc[:-1]) | (labels[1:] != labels[:-1])) if len(labels) else np.zeros(0, bool)
    lead = np.flatnonzero(fresh)
    tail = np.append(lead[1:], len(labels))[:len(lead)] - 1
    confidence = _confidence(model, words, scores, labels, len(texts)) if model.languages else np.zeros(len(texts))
    return words.doc[lead], words.start[lead], words.end[tail], labels[lead], letters, confidence


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", penalty: float = SWITCH_PENALTY,
             carry: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, lang_pred, score, spans, confidence)`` and the columns of ``carry`` for every row of ``docs``; each whole text is read.

    ``spans`` are ``(start, end, lang)`` in characters. ``lang_pred`` is the language of most
    letters and ``score`` its share of them. ``confidence`` (0 to 1) falls where letters are in
    scripts or windows that no language was learned with. A text that is null or has no letter is ``und``
    with score and confidence 0 and no span, as is any text if the model has learned no language. Words in a
    script that no learned language uses follow their neighbours. Ids may be null or repeat;
    other columns are not read.
    """
    schema = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>, confidence double"
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))  # plain arrays, as workers may lack this package; the size is fixed by BUCKET_BITS and the number of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = Model(*shipped.value)
        names = pa.array(learned.languages or [UNKNOWN])
        for batch in batches:
            for a, b in slices(batch.column(1), SLICE):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                doc, start, end, label, letters, confidence = label_texts(learned, texts, penalty)
                some = letters.sum(1) > 0 if learned.languages else np.zeros(len(texts), bool)
                doc, start, end, label = (x[some[doc]] for x in (doc, start, end, label))
                pred = [learned.languages[i] if s else UNKNOWN for i, s in zip(letters.argmax(1), some)]
                score = np.where(some, letters.max(1) / np.maximum(letters.sum(1), 1), 0.0)
                spans = pa.StructArray.from_arrays(
                    [pa.array(start, pa.int32()), pa.array(end, pa.int32()), names.take(pa.array(label))], ["start", "end", "lang"])
                offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(np.where(some, confidence, 0.0), pa.float64()), *(c.slice(a, b - a) for c in batch.columns[2:])],
                    ["doc_id", "lang_pred", "score", "spans", "confidence", *carry])

    return docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *carry).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for a quarter of the ids, by checksum; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
