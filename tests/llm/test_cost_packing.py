"""Cost-balanced packing against the library's ids, a plain model of the rule, and its promises."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from foliant.llm import cost_packing, registry

from fixtures import DOCS, LONG, awkward, documents

SF = "/root/testdata/sf0.001"


def model_balance(lengths, capacity, width):
    """The rule with plain lists: largest piece first, cheapest sequence with room, else cut."""
    total = sum(lengths)
    size = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    held, spent, out = [0] * len(size), [0] * len(size), []
    todo = []
    for d, n in enumerate(lengths):
        todo += [(min(capacity, n - s), d, s) for s in range(0, n, capacity)]
    while todo:
        todo.sort(key=lambda p: (-p[0], p[1], p[2]))
        n, d, s = todo.pop(0)
        at = min((q for q in range(len(size)) if size[q] - held[q] >= n), key=lambda q: (spent[q], q), default=None)
        if at is None:
            at = min((q for q in range(len(size)) if size[q] > held[q]), key=lambda q: (spent[q], q))
            part = size[at] - held[at]
            todo.append((n - part, d, s + part))
            n = part
        out.append((d, s, n, at, held[at]))
        held[at] += n
        spent[at] += 6 * width * n + n * n
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=40), st.sampled_from([1, 4, 16, 20, 64]), st.sampled_from([0, 1, 50]))
def test_pieces_go_where_the_rule_says(lengths, capacity, width):
    assert sorted(cost_packing.balance(lengths, capacity, width)) == sorted(model_balance(lengths, capacity, width))


def check(pieces, rows, capacity=1024):
    """Every id of every document once, sequences without gaps or padding."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in rows)
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_sequence[p["sequence_id"]].append((p["offset"], p["length"], p["sequence_length"]))
        of_doc[p["doc_id"], p["doc_tokens"]].append(p)
    for held in of_sequence.values():
        at = 0
        for offset, length, _ in sorted(held):
            assert offset == at and length > 0
            at += length
        assert at == held[0][2] and (at == capacity or at < capacity and at & (at - 1) == 0)
    by_id = defaultdict(list)
    for (i, t), ids in zip(rows, [np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t in rows]):
        by_id[i, len(ids)].append(ids)
    assert of_doc.keys() == by_id.keys()
    for key, whole in by_id.items():
        assert sum(p["length"] for p in of_doc[key]) == sum(map(len, whole))
        assert all(any(zlib.crc32(x[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for x in whole) for p in of_doc[key])
        if len(whole) == 1:
            spans = sorted((p["start"], p["length"]) for p in of_doc[key])
            assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
    assert len(wanted) == len(rows)


def test_every_id_of_the_given_table_lies_in_one_piece(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(registry.queries()["op11_cost_balanced_packing"](spark, SF).collect(), rows)


def test_awkward_documents_and_sequences(spark):
    rows = [*awkward(), (20, "<|endoftext|> and", "en", "a")]
    docs = documents(spark, rows)
    pieces = cost_packing.pack_balanced(docs, group_bytes=20_000)
    found = pieces.collect()
    check(found, [r[:2] for r in rows])
    assert len({p["sequence_id"] >> 32 for p in found}) > 5
    whole = {s["sequence_id"]: s for s in cost_packing.sequences(pieces).collect()}
    for p in found:
        s = whole[p["sequence_id"]]
        assert bytes(s["ids"])[4 * p["offset"]:4 * (p["offset"] + p["length"])] == bytes(p["ids"]) and p["offset"] in s["starts"]
    assert cost_packing.pack_balanced(spark.createDataFrame([], DOCS)).collect() == []


def test_equal_rows_spread_over_groups(spark):
    docs = documents(spark, [(None, "the same text again and again", "en", "a")] * 6000 + [(1, LONG, "de", "b")] * 2)
    found = cost_packing.pack_balanced(docs, group_bytes=40_000, with_ids=False).collect()
    sizes = defaultdict(int)
    for p in found:
        if p["doc_id"] is None:
            sizes[p["sequence_id"] >> 32] += p["start"] == 0
    assert sum(sizes.values()) == 6000 and max(sizes.values()) < 1000


def test_costs_are_even():
    """Against first fit in descending order, which also keeps documents whole: it puts small ones together."""
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(5, 1, 3000).astype(int) + 1, 900).tolist()
    spent, held = defaultdict(int), defaultdict(int)
    pieces = cost_packing.balance(lengths, 1024, 64)
    for _, _, n, q, _ in pieces:
        spent[q] += cost_packing.cost(n, 64)
        held[q] += n
    ours = np.array([spent[q] for q in spent if held[q] == 1024])
    room, costs = [], []
    for n in sorted(lengths, reverse=True):
        at = next((q for q, r in enumerate(room) if r >= n), None)
        if at is None:
            at = len(room)
            room.append(1024)
            costs.append(0)
        room[at] -= n
        costs[at] += cost_packing.cost(n, 64)
    assert ours.std() < np.std(costs) and ours.max() <= max(costs)
    assert len(pieces) - len(lengths) < len(spent)  # a cut a sequence at most
