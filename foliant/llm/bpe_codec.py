"""Byte-level BPE encoding and decoding over Arrow batches (operator 3).

The vocabulary is a rank file. A ``tokenizers`` model is built from it: bytes map to
printable characters, and every way to join two known tokens into a third becomes a merge
of the third's rank, which is the rule of rank files (always join the pair whose result
has the lowest rank).

A single space before a non-space always begins a new piece of the split pattern, so a text
is encoded as its space-separated chunks. Chunks repeat: a slice of texts is turned into a
dictionary of its chunks, only those are encoded, and the ids of the texts are gathered from
them. Each Python worker keeps the ids of a bounded number of chunks.
"""

from __future__ import annotations

import base64
import codecs
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import per_process, query, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CACHED_CHUNKS = 300_000  # about 200 bytes each
CACHED_LENGTH = 48
SLICE_BYTES = 1 << 20
SLICE_IDS = 1 << 19

_BOUNDARY = re.compile(r" (?=\S)")
_INSIDE = re.compile(r" \s")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def rank_tokenizer(path: str, pattern: str = public_tokenizers.PATTERN):
    """A ``tokenizers`` byte-level BPE that encodes as the rank file demands."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, shown = read_ranks(path), byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    joins = sorted((rank, cut, token) for token, rank in ranks.items() for cut in range(1, len(token))
                   if token[:cut] in ranks and token[cut:] in ranks)
    model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[(name[t[:c]], name[t[c:]]) for _, c, t in joins], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return tokenizer


def file_tokenizer(path: str, plain_specials: bool = False):
    """A tokenizer file as the library reads it: a special token's string in a text is that token.

    With ``plain_specials`` such strings are ordinary text.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = plain_specials
    return tokenizer


class ChunkEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids by way of their chunks."""

    def __init__(self, tokenizer, keep: int = CACHED_CHUNKS) -> None:
        self.tokenizer, self.keep, self.known = tokenizer, keep, {}
        # Special tokens are found in a text before it is split; a text with one isn't cut into chunks.
        self.specials = [] if tokenizer.encode_special_tokens else [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for shown, number in vocabulary.items():
            self.lengths[number] = len(shown)  # a character for each byte

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text cut before each space that a non-space follows; those spaces are left off."""
        return _BOUNDARY.split(text) if _INSIDE.search(text) else text.split(" ")

    def _alone(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)] if strings else []

    def _together(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk with its space, from one pass over all of them: token lengths show where each ends."""
        if not chunks:
            return []
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(chunks)], add_special_tokens=False)[0].ids, "<u4")
        wanted = np.cumsum([len(c.encode()) + 1 for c in chunks])
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), wanted, "left") + 1
        raw, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, list[int]]:
        """The chunks of all texts in a row, the place of each text's first, and the order the texts are in."""
        odd = {i for i, t in enumerate(texts) if _INSIDE.search(t) or any(s in t for s in self.specials)}
        plain = [i for i in range(len(texts)) if i not in odd]
        lists = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        rest = [[texts[i]] if any(s in texts[i] for s in self.specials) else self.chunks(texts[i]) for i in sorted(odd)]
        chunks = pa.concat_arrays([lists.flatten().cast(pa.large_string()), pa.array(list(chain.from_iterable(rest)), pa.large_string())])
        counts = np.concatenate([np.diff(lists.offsets.to_numpy()), np.array(list(map(len, rest)), np.int64)])
        return chunks, np.cumsum(counts) - counts, plain + sorted(odd)

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        texts = list(texts)
        if not texts:
            return []
        chunks, heads, order = self._cut(texts)
        coded = chunks.dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        if len(self.known) > self.keep:
            self.known = {c: self.known[c] for c in set(names) & self.known.keys()}
        known = self.known
        # A text's first chunk has no space before it and is encoded as it is.
        first = [names[k] for k in which[heads]]
        which[heads] = np.arange(len(names), len(names) + len(heads))
        used = np.bincount(which, minlength=len(names))[:len(names)] > 0
        missing = [c for c, u in zip(names, used.tolist()) if u and c not in known]
        # White space at the end of a chunk would run into the next chunk's space.
        plain = [c for c in missing if c and not c[-1].isspace()]
        ended = [c for c in missing if not c or c[-1].isspace()]
        known.update(zip(plain, self._together(plain)))
        known.update(zip(ended, self._alone([" " + c for c in ended])))
        parts = [known.get(c, b"") for c in names] + self._alone(first)
        for c in missing:
            if len(c) > CACHED_LENGTH:
                del known[c]
        # The ids of all chunks are gathered from those of the distinct ones.
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts, counts = np.cumsum(lengths) - lengths, lengths[which]
        ends = np.cumsum(counts)
        gather = np.repeat(starts[which] - (ends - counts), counts)
        gather += np.arange(len(gather))
        ids = np.frombuffer(b"".join(parts), "<u4")[gather].tobytes()
        cuts = np.append((ends - counts)[heads], ends[-1]) * 4
        out = [b""] * len(texts)
        for i, x, y in zip(order, cuts.tolist(), cuts[1:].tolist()):
            out[i] = ids[x:y]
        return out


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a text column of at most ``limit`` bytes each, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def _encoder(path: str, ranked: bool, keep: int = CACHED_CHUNKS) -> ChunkEncoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return per_process(("encoder", path, ranked), lambda: ChunkEncoder(rank_tokenizer(path) if ranked else file_tokenizer(path), keep))


def encode_texts(texts: list[str], path: str, ranked: bool = True, keep: int = CACHED_CHUNKS) -> list[np.ndarray]:
    """Token ids of each text."""
    return [np.frombuffer(x, "<u4") for x in _encoder(path, ranked, keep).encode(texts)]


def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each rank."""
    def build() -> list[bytes]:
        ranks = read_ranks(path)
        back = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            back[rank] = token
        return back

    return per_process(("token bytes", path), build)


def _offsets(raw: bytes, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each token: the first character it touches, the end of the last, and whether a character is split at an edge."""
    data = np.frombuffer(raw, np.uint8)
    begins = (data & 0xC0) != 0x80
    upto = np.cumsum(begins, dtype=np.int32)
    ends = np.cumsum(lengths[ids], dtype=np.int64)
    starts = ends - lengths[ids]
    inside = ~np.append(begins, True)
    return upto[starts] - 1, upto[ends - 1], inside[starts] | inside[ends]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS, offsets: bool = True) -> DataFrame:
    """``(doc_id, ids, split_tokens[, char_start, char_end])`` for every row of ``docs``.

    ``char_start`` and ``char_end`` are character offsets of each token; a token with part of
    a character covers that whole character. ``split_tokens`` counts tokens with an edge inside
    a character. A null text is empty and has no ids. Strings that look like special tokens
    are ordinary text. Other columns are not read; ids may be null or repeat.
    """
    schema = "doc_id long, ids array<int>, split_tokens int" + (", char_start array<int>, char_end array<int>" if offsets else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(t) for t in _token_bytes(ranks)], np.int32)
        for batch in batches:
            for a, b in slices(batch.column(1)):
                texts = [t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]
                coded = encode_texts(texts, ranks)
                ends = np.cumsum([0, *map(len, coded)]).astype(np.int32)
                ids = np.concatenate(coded).astype(np.int32) if coded else np.zeros(0, np.int32)
                columns = [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, ids)]
                start = stop = np.zeros(0, np.int32)
                split = np.zeros(0, bool)
                if len(ids):
                    start, stop, split = _offsets("".join(texts).encode(), ids, lengths)
                columns.append(pa.array(np.diff(np.append(0, np.cumsum(split, dtype=np.int64))[ends]), pa.int32()))
                if offsets:
                    # Offsets count from the start of the document, not of the slice.
                    before = np.repeat(np.cumsum([0, *map(len, texts)])[:-1].astype(np.int32), np.diff(ends))
                    columns += [pa.ListArray.from_arrays(ends, start - before), pa.ListArray.from_arrays(ends, stop - before)]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``(doc_id, ids, decoded)``: the bytes of each document's tokens; null ids decode to null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _token_bytes(ranks)
        for batch in batches:
            lists = batch.column(1)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)) // SLICE_IDS
            for a, b in zip(*(np.searchsorted(ends, np.unique(ends), side) for side in ("left", "right"))):
                some = lists.slice(a, b - a)
                raw = [b"".join([parts[t] for t in x.values.to_numpy().tolist()]) if x.is_valid else None for x in some]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), some, pa.array(raw, pa.binary())], ["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def token_texts(ids: Iterable[int], ranks: str = RANKS) -> list[str]:
    """The text each token adds; a split character appears with the token that completes it."""
    parts, reader = _token_bytes(ranks), codecs.getincrementaldecoder("utf-8")("replace")
    return [reader.decode(parts[t]) for t in ids]


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(table(spark, sf_dir, "documents"), offsets=False)
    return decode(coded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
