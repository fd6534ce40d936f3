"""Vector codes and hard negatives against plain Python on small awkward tables."""

import math
from collections import defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from foliant.llm import code_compression, hard_negatives

VECTORS = "vec_id long, embedding array<float>, label int, entry string, part string, codes string, error string, ints string, row string, score string"


def table(spark, rows):
    """Vectors with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, x, *"abcdefg") for i, v, x in rows], VECTORS)


def awkward(n=60, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, dim).astype(np.float32).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    copy = rows[3][1]
    return rows + [
        (100, copy, 1), (101, copy, 2), (101, copy, 2), (150, copy, None), (None, copy, 1), (200, [0.0] * dim, 1), (250, [0.0] * dim, 2),
        (102, None, 1), (103, [None] * dim, 1), (104, [float("nan")] + copy[1:], 1), (105, [float("inf")] + copy[1:], 1), (106, [-float("inf")] + copy[1:], 1),
        (107, [1e30] + copy[1:], 1), (108, [], 1), (109, copy[:3], 1), (300, (-np.array(copy)).tolist(), 3), (301, [-1e-9] * dim, 3), (-50, rows[7][1], 0)]


def usable(rows, scale, limit, dim):
    return [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
            if v and None not in v and all(math.isfinite(x) and abs(math.floor(scale * x)) < limit for x in v) and len(v) == dim]


def codes_model(rows, dim, parts=4, entries=256, rounds=4):
    kept = usable(rows, 1024, 1 << 24, dim)
    cuts = [dim * p // parts for p in range(parts + 1)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[r[1][a:b] for r in seeds] for a, b in zip(cuts, cuts[1:])]

    def nearest(v):
        found = []
        for book, a, b in zip(books, cuts, cuts[1:]):
            found.append(min((sum((x - y) ** 2 for x, y in zip(v[a:b], e)), k) for k, e in enumerate(book)))
        return found

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, k) in enumerate(nearest(v)):
                members[p, k].append(v[cuts[p]:cuts[p + 1]])
        for (p, k), vs in members.items():
            books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    return [(i, label, bytes(k for _, k in nearest(v)), sum(d for d, _ in nearest(v))) for i, v, label in kept], books


@pytest.mark.parametrize("dim, parts, entries", [(8, 4, 256), (8, 4, 7), (10, 4, 5), (3, 4, 6)])
def test_codes_equal_the_plain_steps(spark, monkeypatch, dim, parts, entries):
    monkeypatch.setattr(code_compression, "BLOCK", 16)
    monkeypatch.setattr(code_compression, "STRIPE", 5)
    rows = awkward(dim=dim)
    coded, books = code_compression.compress(table(spark, rows).repartition(3), parts=parts, entries=entries)
    wanted, model_books = codes_model(rows, dim, parts, entries)
    order = lambda rows: sorted(rows, key=repr)
    assert order((r["vec_id"], r["label"], bytes(r["codes"]), r["error"]) for r in coded.collect()) == order(wanted)
    assert [b.tolist() for b in books] == model_books
    back = code_compression.decompress(coded, books).collect()
    assert len(back) == len(wanted) and all(len(r["vec"]) == dim for r in back)


def test_few_entries_leave_little_error(spark):
    """Vectors around 40 points come back close to them."""
    rng = np.random.default_rng(8)
    points = rng.normal(0, 1, (40, 8))
    rows = [(i, (points[i % 40] + rng.normal(0, 0.001, 8)).astype(np.float32).tolist(), i % 3) for i in range(400)]
    coded, books = code_compression.compress(table(spark, rows), entries=64)
    back = {r["vec_id"]: np.array(r["vec"]) for r in code_compression.decompress(coded, books).collect()}
    assert max(np.abs(back[i] - np.array(v)).max() for i, v, _ in rows) < 0.02


def test_no_vectors_no_codes(spark):
    for rows in ([], [(1, None, 2), (2, [float("nan")], None)]):
        coded, books = code_compression.compress(table(spark, rows))
        assert coded.collect() == [] and all(not b.size for b in books)
        assert code_compression.books_digest(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def negatives_model(rows, dim, anchor, positives=5, negatives=3):
    kept = [(n, i, v, label) for n, (i, v, label) in enumerate(usable([r for r in rows if r[0] is not None and r[2] is not None], 256, 1 << 20, dim))]
    out = []
    for n, i, v, label in kept:
        if not anchor(i):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), j, m) for _, j, w, m in kept if j != i)
        for p, j, m in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, j, k + 1, t, -p, -s) for k, (s, t, _) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("dim, sizes", [(8, (16, 8, 4)), (3, (7, 50, 3)), (8, (2048, 2048, 512))])
def test_negatives_equal_a_full_comparison(spark, monkeypatch, dim, sizes):
    for name, value in zip(("BLOCK", "BATCH", "STEP"), sizes):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = awkward(n=90, dim=dim)
    wanted = negatives_model(rows, dim, lambda i: i % 5 == 0)
    found = hard_negatives.mine(table(spark, rows).repartition(3), F.col("vec_id") % 5 == 0).collect()
    assert len(wanted) > 50 and sorted(map(tuple, found)) == wanted


def test_tables_without_anchors_give_nothing(spark):
    for rows in ([], [(1, None, 2)], [(1, [0.5, 0.5], 2), (2, [0.5, 0.1], 3)], [(50, [0.5, 0.5], 1)], [(50, [0.0, 0.0], 1), (51, [0.0, 0.0], 2)]):
        assert hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0).collect() == []


def test_zero_scores_have_a_window_of_their_own(spark):
    rows = [(50, [0.0, 0.0], 1), (51, [0.5, 0.1], 1), (52, [0.3, 0.1], 2), (53, [0.9, 0.1], 2)]
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, found)) == [(50, 51, 1, 52, 0, 0), (50, 51, 2, 53, 0, 0)]


def test_walks_end_early_and_certified():
    """Anchors near their centre among spread candidates: a fraction of the list is scored, the best are right."""
    rng = np.random.default_rng(2)
    vectors = np.rint(rng.normal(0, 100, (4000, 16)))
    members = np.rint(vectors[0] + rng.normal(0, 5, (40, 16)))
    rank = np.arange(4000)
    found = {"vectors": vectors, "lengths": np.linalg.norm(vectors, axis=1), "ids": rank + 1000, "labels": np.zeros(4000, int), "rank": rank}
    low, high = np.full((40, 1), hard_negatives._NONE), np.full((40, 1), hard_negatives._ALL)
    middle = vectors[0] / np.linalg.norm(vectors[0])
    best, scored = hard_negatives.walk(members, middle, np.arange(40), np.zeros(40, int), low, high, found, 3, True)
    scores = (members @ vectors.T).astype(int)
    assert (best[:, 0] // 4000 == -np.sort(-scores, axis=1)[:, :3]).all()
    assert scored < 0.4 * scores.size
