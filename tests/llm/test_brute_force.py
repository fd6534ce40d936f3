"""Queries without SQL: against plain models, exact round trips and held-out labels."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import bpe_codec, embedding_dedup, language_id, minmax_dedup, packing, registry, token_output

from fixtures import DOCS, LONG, awkward, best_fit_model, documents, grouped, near_model

SF = "/root/testdata/sf0.001"


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def rank_encoding():
    import tiktoken

    with open(bpe_codec.RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- token output ---------------------------------------------------------------


def id_lists():
    small = st.lists(st.integers(0, 40), max_size=300)
    return st.lists(st.one_of(small, st.lists(st.integers(0, 2**32 - 1), max_size=70), st.lists(st.just(0), max_size=200)), max_size=6).map(
        lambda parts: [x for p in parts for x in p])


@settings(max_examples=150, deadline=None)
@given(id_lists())
def test_words_give_the_ids_back(ids):
    assert token_output.unpack(token_output.pack(np.array(ids, np.uint32))).tolist() == ids


def test_words_are_dense():
    ids = np.random.default_rng(1).integers(0, 900, 50_000).astype(np.uint32)
    assert len(token_output.pack(ids)) < 50_000 * 8 / 6 * 1.05


def token_model(rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_output_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, "documents").collect()]
    assert sorted(tuple(r) for r in registry.queries()["op2_token_output"](spark, SF).collect()) == token_model(rows)


def test_token_output_of_awkward_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 50)
    rows = [r for r in awkward() if r[0] is not None and r[0] != 5]
    token_output.write_tokens(documents(spark, rows), str(tmp_path / "t"))
    found = token_output.read_tokens(spark, str(tmp_path / "t")).join(token_output.token_starts(spark, str(tmp_path / "t")), "part")
    assert sorted((r["doc_id"], r["base"] + r["part_start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) for r in found.collect()) == token_model([r[:2] for r in rows])
    token_output.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "none"))
    assert token_output.read_tokens(spark, str(tmp_path / "none")).collect() == []


def test_special_strings_are_what_the_library_makes_of_them():
    texts = ["<|endoftext|> hi", "a <|endoftext|>b<|endoftext|>", "<|endoftext| >", " <|endoftext|>  x\n"]
    library = Tokenizer.from_file(token_output.VOCABULARY)
    assert [x.tolist() for x in bpe_codec.encode_texts(texts, token_output.VOCABULARY, ranked=False)] == [
        library.encode(t, add_special_tokens=False).ids for t in texts]
    plain = bpe_codec.ChunkEncoder(bpe_codec.file_tokenizer(token_output.VOCABULARY, plain_specials=True))
    assert 50256 not in np.frombuffer(plain.encode(texts[:1])[0], "<u4")


def test_repeated_and_null_ids_keep_all_their_tokens(spark, tmp_path):
    docs = documents(spark, [(None, "a", "x", "y"), (None, "b", "x", "y"), (1, "c", "x", "y"), (1, "c", "x", "y")])
    token_output.write_tokens(docs, str(tmp_path / "t"))
    starts = token_output.read_tokens(spark, str(tmp_path / "t")).join(token_output.token_starts(spark, str(tmp_path / "t")), "part").collect()
    assert sorted(r["base"] + r["part_start"] for r in starts) == [0, 2, 4, 6]


# --- byte-level BPE -------------------------------------------------------------


def test_codec_of_the_given_table(spark, rank_encoding):
    want = set()
    for r in read(spark, "documents").collect():
        ids = rank_encoding.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in registry.queries()["op3_byte_bpe"](spark, SF).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text(" \n\t ab'sl1.é日", max_size=20), st.sampled_from(["aaaa", "    ", "\x1c ", "don't", "…", "😀"])), max_size=8))
def test_any_text_is_coded_as_the_rank_file_demands(rank_encoding, parts):
    text = "".join(parts)
    assert bpe_codec.encode_texts([text], bpe_codec.RANKS)[0].tolist() == rank_encoding.encode_ordinary(text)


def test_every_character_is_coded_as_the_rank_file_demands(rank_encoding):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    wrong = []
    for begin in range(0, len(points), 4096):
        text = " ".join(f"a{chr(c)}1{chr(c)} {chr(c)}" for c in points[begin:begin + 4096])
        if bpe_codec.encode_texts([text], bpe_codec.RANKS)[0].tolist() != rank_encoding.encode_ordinary(text):
            wrong.append(begin)
    assert wrong == []


def test_codec_of_awkward_documents(spark, rank_encoding):
    coded = bpe_codec.encode(documents(spark, awkward()))
    texts = grouped((r[0], r[1] or "") for r in awkward())
    for r in coded.collect():
        assert any(r["ids"] == rank_encoding.encode_ordinary(t) for t in texts[r["doc_id"]])
    assert sorted(r["decoded"] for r in bpe_codec.decode(coded).collect()) == sorted((r[1] or "").encode() for r in awkward())
    assert bpe_codec.encode(spark.createDataFrame([], DOCS)).collect() == []


def test_offsets_cover_split_characters(spark):
    text = "naïve 😀 日本語 𓀀x"
    row = bpe_codec.encode(documents(spark, [(1, "before", None, None), (2, text, None, None)])).filter("doc_id = 2").first()
    parts = bpe_codec._token_bytes(bpe_codec.RANKS)
    at, split = 0, 0
    for token, start, end in zip(row["ids"], row["char_start"], row["char_end"]):
        piece = parts[token]
        inside = [i for i, c in enumerate(text) for b in range(len(c.encode())) if at <= len(text[:i].encode()) + b < at + len(piece)]
        assert (start, end) == (inside[0], inside[-1] + 1)
        at += len(piece)
        split += piece.decode(errors="ignore").encode() != piece
    assert row["split_tokens"] == split > 0
    assert "".join(bpe_codec.token_texts(row["ids"])) == text


# --- language -------------------------------------------------------------------


def test_held_out_accuracy_and_no_look_at_the_label(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in registry.queries()["op4_language_id"](spark, sf).collect()}
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [i for i, r in found.items() if r["held_out"]]
    assert {i for i in labels if zlib.crc32(str(i).encode()) % 4 == 2} == set(held)
    assert sum(found[i]["lang_pred"] == labels[i] for i in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def path_model(scores, penalty):
    """Viterbi word by word."""
    best, back = np.array(scores[0], float), []
    for s in scores[1:]:
        top = int(best.argmax())
        moved = best.max() - penalty > best
        back.append(np.where(moved, top, np.arange(len(best))))
        best = np.where(moved, best.max() - penalty, best) + s
    at, out = int(best.argmax()), []
    for b in reversed(back):
        out.append(at)
        at = int(b[at])
    return [*reversed(out)][:0] + [at, *reversed(out)], best.max()


def test_blocks_find_a_best_path():
    random_ = np.random.default_rng(4)
    lengths = [1, 2, 63, 64, 65, 130, 700, 5]
    scores = random_.normal(0, 2, (sum(lengths), 3)).astype(np.float32)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    labels = language_id.viterbi(scores, doc, 3.0)
    for d in range(len(lengths)):
        own, path = scores[doc == d], labels[doc == d]
        value = own[np.arange(len(own)), path].sum() - 3.0 * (np.diff(path.astype(int)) != 0).sum()
        assert abs(value - path_model(own, 3.0)[1]) < 1e-2


def test_mixed_and_awkward_texts(spark):
    rows = read(spark, "documents").collect()
    model = language_id.fit(read(spark, "documents"))
    by_lang = defaultdict(str)
    for r in rows:
        by_lang[r["lang"]] += " " + r["text"]
    en, fr = by_lang["en"][:3000], by_lang["fr"][:2000]
    mixed = language_id.identify(documents(spark, [(1, en + "\n" + fr, None, None)]), model).first()
    main = [s for s in mixed["spans"] if s["end"] - s["start"] > 500]
    assert mixed["lang_pred"] == "en" and [s["lang"] for s in main] == ["en", "fr"] and abs(main[1]["start"] - len(en)) < 60
    found = language_id.identify(documents(spark, awkward()), model).collect()
    assert len(found) == len(awkward())
    unknown = [r for r in found if r["lang_pred"] == "und"]
    assert all(r["score"] == 0 and r["spans"] == [] for r in unknown) and Counter(r["doc_id"] for r in unknown) == Counter([1, 2, 3, None, 15])
    assert language_id.identify(spark.createDataFrame([], DOCS), model).collect() == []
    nothing = language_id.fit(spark.createDataFrame([], DOCS))
    assert {r["lang_pred"] for r in language_id.identify(documents(spark, awkward()), nothing).collect()} == {"und"}


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, t, x, "s") for i, (t, x) in enumerate([("привет мир дом", "ru"), ("γειά σου κόσμε", "el"), ("hello the world", "en")] * 3)]
    model = language_id.fit(documents(spark, rows))
    found = language_id.identify(documents(spark, [(1, "жук", None, None), (2, "ωρα", None, None), (3, "xyzzy", None, None), (4, "漢字", None, None)]), model)
    got = {r["doc_id"]: r["lang_pred"] for r in found.collect()}
    assert (got[1], got[2], got[3]) == ("ru", "el", "en") and got[4] in model.languages


# --- near duplicates ------------------------------------------------------------


def test_near_duplicates_of_the_given_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in read(spark, "documents").collect()]
    want = near_model(rows)
    found = registry.queries()["op7_minmax_near_dedup"](spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_a_drifting_group(spark):
    """Neighbours link and distant members don't, so the first pivots can't settle a bucket."""
    random_ = random.Random(11)
    words = [f"v{random_.randrange(10**6)}" for _ in range(400)]
    rows = []
    for i in range(90):
        for _ in range(4):
            words[random_.randrange(400)] = f"n{random_.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, rows[3][1]) for i in range(200)]
    random_.shuffle(rows)
    found = minmax_dedup.near_duplicates(documents(spark, [(*r, None, "s") for r in rows])).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == near_model(rows)


def test_near_duplicates_of_awkward_documents(spark):
    found = minmax_dedup.near_duplicates(documents(spark, awkward())).collect()
    want = near_model([r[:2] for r in awkward()])
    assert len(found) == len(awkward())
    for r in found:
        assert r["component_id"] == want.get(r["doc_id"]) and r["kept"] == (r["doc_id"] == r["component_id"])
    assert {r["doc_id"]: r["n_shingles"] for r in found if r["doc_id"] in (1, 2, 3, 4, 9)} == {1: 0, 2: 0, 3: 0, 4: 1, 9: 116}
    assert minmax_dedup.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def test_min_and_max_positions_estimate_the_similarity():
    words = [f"w{i}" for i in range(3000)]
    a, b = " ".join(words).encode(), " ".join(words[600:] + [f"x{i}" for i in range(600)]).encode()
    code, ends = minmax_dedup.shingle_sets([a, b])
    signature = minmax_dedup.signatures(code, ends)
    left, right = set(code[:ends[0]].tolist()), set(code[ends[0]:].tolist())
    assert abs((signature[0] == signature[1]).mean() - len(left & right) / len(left | right)) < 0.15


# --- embeddings -----------------------------------------------------------------


def vector_model(rows, similarity=0.98):
    sets, links = Sets_(), Counter()
    good = []
    for k, (i, v, label) in enumerate(rows):
        if i is not None:
            sets.find(i)
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good.append((k, i, x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()), label))
    for n, (k, i, x, label) in enumerate(good):
        for k2, i2, y, label2 in good[:n]:
            if label == label2 and len(x) == len(y) and float(x @ y) >= similarity:
                links[k] += 1
                links[k2] += 1
                sets.join(i, i2)
    return [(i, links[k], i if i is None else sets.find(i)) for k, (i, _, _) in enumerate(rows)]


from fixtures import Sets as Sets_  # noqa: E402


def test_vectors_of_the_given_table(spark):
    rows = [tuple(r) for r in read(spark, "embeddings").select("vec_id", "embedding", "label").collect()]
    found = registry.queries()["op8_embedding_near_dedup"](spark, SF).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found) == sorted(vector_model(rows))


@pytest.mark.parametrize("homes, visitors", [(512, 2048), (8, 16)])
def test_awkward_vectors(spark, monkeypatch, homes, visitors):
    monkeypatch.setattr(embedding_dedup, "HOMES", homes)
    monkeypatch.setattr(embedding_dedup, "VISITORS", visitors)
    random_ = np.random.default_rng(5)
    centre = random_.normal(size=24)
    rows = [(i, (centre + random_.normal(size=24) * 0.14).tolist(), 1) for i in range(80)]
    rows += [(100 + i, rows[0][1], 1) for i in range(60)] + [(200 + i, rows[0][1], 2) for i in range(3)]
    rows += [(300, None, 1), (301, [], 1), (302, [0.0] * 24, 1), (303, [float("nan")] * 24, 1), (304, [None] * 24, 1), (305, [float("inf")] * 24, 1),
             (306, rows[1][1], None), (None, rows[2][1], 1), (307, [1.0, 2.0], 1), (308, [-2.0, -4.0], 1), (309, [2.0, 4.0], 1), (310, [1e300, 2e300], 1),
             (311, [3.0], 1), (312, [-0.0, 1.0, 2.0], 1), (313, [0.0, 1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n int, digest string")
    found = embedding_dedup.near_vectors(df).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in found), key=key) == sorted(vector_model(rows), key=key)
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


# --- packing --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.sampled_from([None, *"abcdefgh"]), st.sampled_from([None, *range(6)])), max_size=120))
def test_best_fit_takes_the_tightest_compatible_bin(items):
    sizes = np.array([i[0] for i in items], np.int64)
    found = packing.best_fit(sizes, [i[1] for i in items], [i[2] for i in items], 50)
    bins = defaultdict(list)
    for item, b in zip(items, found.tolist()):
        others = bins[b]
        room = {k: 50 - sum(x[0] for x in v) for k, v in bins.items()}
        fits = [room[k] for k, v in bins.items() if room[k] >= item[0] and not any(
            (x[1] == item[1] is not None and x[1] is not None) or (x[2] == item[2] and x[2] is not None) for x in v)]
        assert (room[b] == min(fits)) if fits else not others
        others.append(item)


def test_packing_of_awkward_documents(spark):
    rows = awkward()
    found = packing.pack(documents(spark, rows), capacity=64).collect()
    length, cover = Counter(), defaultdict(list)
    for r in found:
        cover[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        length[r["doc_id"]] += r["length"]
    words = Counter()
    for i, text, _, _ in rows:
        words[i] += len((text or "").encode().split())
    assert length == words and len(cover[6]) == -(-len(LONG.split()) // 64) and cover[1] == [(0, 0, 0)]
    source, text = {r[0]: r[3] for r in rows}, {r[0]: r[1] or "" for r in rows}
    for (_, b), inside in grouped(((r["bin_group"], r["bin"]), r) for r in found).items():
        assert sum(r["length"] for r in inside) == inside[0]["bin_fill"] <= 64
        known = [r["doc_id"] for r in inside if r["doc_id"] is not None and source[r["doc_id"]] is not None]
        assert len({source[i] for i in known}) == len(known) and len({text[i] for i in known}) == len(known)
        spans = sorted((r["bin_offset"], r["length"]) for r in inside)
        assert all(a + n <= c for (a, n), (c, _) in zip(spans, spans[1:]))
    assert packing.pack(spark.createDataFrame([], DOCS)).collect() == []


def test_query_packs_the_given_table_as_the_model_does(spark):
    rows = {r["doc_id"]: r for r in read(spark, "documents").collect()}
    found = registry.queries()["op10_best_fit_packing"](spark, SF).collect()
    for group, pieces in grouped((r["bin_group"], r) for r in found).items():
        rests = sorted((r for r in pieces if r["bin"] >= 0), key=lambda r: (-r["length"], r["doc_id"]))
        items = [(r["length"], rows[r["doc_id"]]["source"], rows[r["doc_id"]]["text"]) for r in rests]
        _, fills = best_fit_model(items, packing.CAPACITY)
        assert sorted(fills.values()) == sorted({r["bin"]: r["bin_fill"] for r in rests}.values())


# --- repeated rows ---------------------------------------------------------------


WORDS = {"en": "the house and the river are old", "fr": "la maison et le fleuve sont vieux", "de": "das Haus und der Fluss sind alt"}


def labelled(spark, counts, ids):
    rows = [(ids(k), f"{WORDS[x]} {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}", x, None) for x, n in counts.items() for k in range(n)]
    return documents(spark, rows)


@pytest.mark.parametrize("counts, ids", [
    ({"en": 1500}, lambda k: 7), ({"fr": 1500, "en": 300}, lambda k: 7), ({"en": 1500, "de": 4}, lambda k: None), ({"en": 1, "fr": 1, "de": 1}, lambda k: k),
    ({"fr": 3000, "en": 1500}, lambda k: k)])
def test_every_language_is_learned_whatever_the_ids(spark, counts, ids):
    docs = labelled(spark, counts, ids)
    model = language_id.fit(docs, sample_docs=100)
    assert sorted(model.languages) == sorted(counts)
    found = language_id.identify(documents(spark, [(i, t, None, None) for i, t in enumerate(WORDS.values())]), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in found if list(WORDS)[r["doc_id"]] in counts} == {i: x for i, x in enumerate(WORDS) if x in counts}
    once = language_id.fit(docs.unionByName(docs), sample_docs=100)  # equal rows count once
    assert (once.weights == model.weights).all()


def test_the_sample_is_bounded(spark, monkeypatch):
    """One text of one id, or many of null ids: at most the bound is learned from."""
    read_texts = []
    original = language_id._letter_scores
    monkeypatch.setattr(language_id, "_letter_scores", lambda counts, other: (read_texts.append(counts.sum()), original(counts, other))[1])
    language_id.fit(documents(spark, [(None, f"word {'abcdefghij'[k % 10]} {'klmnopqrst'[k // 10 % 10]} {'uvwxyzabcd'[k // 100]}", "en", None) for k in range(1000)]), sample_docs=20)
    assert 0 < sum(read_texts[:2]) <= 20 * 2 * len("wordabc")
    assert language_id.fit(documents(spark, [(7, "same words", "en", None)] * 2000), sample_docs=20).languages == ["en"]


def test_predictions_equal_a_plain_model(spark):
    """Word scores, narrowing by script, best path, majority and share, from the model's weights with plain loops."""
    import unicodedata

    docs = read(spark, "documents")
    model = language_id.fit(docs.filter(~language_id.held_out()), sample_docs=50)
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(1000).collect()][:60] + [(10**6, "Жук the house жук 漢字 la maison"), (10**6 + 1, None), (10**6 + 2, "12")]
    script_of = {}
    for name, a, b in language_id.SCRIPT_RANGES:
        script_of |= dict.fromkeys(range(a, b + 1), language_id.SCRIPTS.index(name))
    bucket = lambda x: ((x ^ (x >> 29)) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - language_id.BUCKET_BITS)
    k, m = 0x9DDFEA08EB382D69, 2**64

    def plain(text):
        text = text or ""
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text]
        low = [x if unicodedata.category(c)[0] == "L" else 0 for x, c in zip(low, text)]
        low = [0, 0, *low, 0, 0]
        words, i = [], 2
        while i < len(low) - 2:
            if not low[i]:
                i += 1
                continue
            j = i
            while low[j]:
                j += 1
            score = np.zeros(len(model.languages))
            for p in range(i, j):
                before, after = low[p - 1], low[p + 1]
                three = ((before * k + low[p]) * k + after) * k % m
                five = ((three + (low[p - 2] if before else 0)) * k + (low[p + 2] if after else 0)) * k + 1
                score += model.weights[bucket(three)].astype(float) + model.weights[bucket(five % m)].astype(float)
            allowed = model.uses[script_of.get(ord(text[i - 2]), 0)]
            words.append((np.where(allowed, score, -1e4) if allowed.any() else score * 0, j - i))
            i = j
        if not words:
            return "und", 0.0
        value, back = words[0][0], []
        for score, _ in words[1:]:
            top = int(value.argmax())
            stay = value >= value[top] - language_id.SWITCH_PENALTY
            back.append([x if stay[x] else top for x in range(len(value))])
            value = np.where(stay, value, value[top] - language_id.SWITCH_PENALTY) + score
        at = int(value.argmax())
        path = [at]
        for b in reversed(back):
            path.append(b[path[-1]])
        letters = np.zeros(len(value))
        for x, (_, n) in zip(reversed(path), words):
            letters[x] += n
        return model.languages[int(letters.argmax())], letters.max() / letters.sum()

    found = {r["doc_id"]: r for r in language_id.identify(documents(spark, [(i, t, None, None) for i, t in rows]), model).collect()}
    for i, t in rows:
        pred, score = plain(t)
        assert found[i]["lang_pred"] == pred and found[i]["score"] == pytest.approx(score, abs=0.02), i


def test_equal_rows_are_dealt_to_all_groups(spark):
    packed = packing.pack(documents(spark, [(None, "the very same words", "en", "s")] * 20_000)).groupBy("bin_group").count().collect()
    assert len(packed) > 15 and max(r["count"] for r in packed) < 1400
