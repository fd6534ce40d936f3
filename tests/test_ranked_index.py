"""The tiered index answers like the full ranking and reads no tier that can't change the answer."""

import itertools
import random
import uuid

import pytest

from foliant.operators import ranked_index as RI
from foliant.operators import search as S
from foliant.session import ensure_checkpoint_dir

VOCABULARY = ["ash", "birch", "cedar", "date", "elm"]
QUERIES = [(1, "ash"), (2, "birch ash"), (3, "the cedar, Elm date"), (4, "ash zinnia"), (5, "the of"), (6, ""), (7, "elm elm birch"), (8, None)]
COLUMNS = ("doc_id bigint, title string, author string, subjects string, readers int, edition_count int, first_publish_year int, "
           "kind string, merged_into int")


def _works(seed: int, count: int = 400) -> list[tuple]:
    rng = random.Random(seed)

    def text(most):
        return " ".join(rng.choices(VOCABULARY + ["the", "x", "y"], k=rng.randint(0, most))) or None

    return [(i, text(4), text(2), text(9), rng.choice([None, 0, 3, 10 ** rng.randint(0, 6)]), rng.choice([None, 1, 2]), rng.choice([None, 1900, 1950]),
             "omnibus" if i % 17 == 0 else "single", 1 if i % 13 == 0 else None) for i in range(count)]


def _stored(spark, works) -> str:
    path = f"{ensure_checkpoint_dir(spark)}/ranked-{uuid.uuid4().hex}"
    RI.write_ranked_index(works, path, 4)
    return path


def _answer(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())


def _full(spark, works, limit=20):
    asked = spark.createDataFrame(QUERIES, "query_id int, query string")
    known = works.fillna({"readers": 0})
    return _answer(S.rank_search(S.build_search_index(known), known, asked, limit))


@pytest.mark.parametrize("limit", [1, 20])
def test_tiers_answer_like_the_full_ranking(spark, limit):
    works = spark.createDataFrame(_works(limit), COLUMNS)
    path = _stored(spark, works)
    read = []
    found = _answer(RI.search_ranked(spark, path, QUERIES, limit, 4, tiers_read=read))
    assert found == _full(spark, works, limit)
    assert {q for q, *_ in found} == {1, 2, 3, 7} == {q for q, _ in read}
    odd = works.filter("doc_id % 2 = 1")
    assert _answer(RI.search_ranked(spark, path, QUERIES, limit, 4, odd)) == _full(spark, odd, limit)


def test_tiers_below_the_last_hit_are_not_read(spark):
    rows = [(i, "ash birch", None, None, 10 ** 6 if i < 40 else 1, 1, None, "single", None) for i in range(800)]
    works = spark.createDataFrame(rows, COLUMNS)
    path = _stored(spark, works)
    read = []
    found = _answer(RI.search_ranked(spark, path, QUERIES[:2], 20, 4, tiers_read=read))
    assert found == [row for row in _full(spark, works) if row[0] < 3]
    # Equal works of forty readers' favourites fill the upper tiers; the bulk can't reach them.
    last = max(tier for _, tier in read)
    every = {r["tier"] for r in spark.read.parquet(f"{path}/postings").select("tier").distinct().collect()}
    assert last < max(every)


def test_an_index_without_works_and_no_queries_give_no_rows(spark):
    path = _stored(spark, spark.createDataFrame([], COLUMNS))
    assert RI.search_ranked(spark, path, QUERIES, 20, 4).collect() == []
    assert RI.search_ranked(spark, path, [], 20, 4).columns == ["query_id", "rank", "doc_id", "score"]


def _density(entries, n):
    """Minimal covers by trying every interval: entries are (pos, term, weight) in order."""
    whole = [(i, j) for i in range(len(entries)) for j in range(i, len(entries)) if len({t for _, t, _ in entries[i:j + 1]}) == n]
    covers = [(i, j) for i, j in whole if (i + 1, j) not in whole and (i, j - 1) not in whole]
    return sum(((j - i + 1) / sum(1 / entries[k][2] for k in range(i, j + 1))) / (1 + max(entries[j][0] - entries[i][0] - (j - i), 0)) for i, j in covers)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_no_document_scores_above_its_ceiling(n):
    rng = random.Random(n)
    short = [list(t) for k in range(n, 7) for t in itertools.product(range(n), repeat=k)] if n < 4 else []
    for terms in short + [rng.choices(range(n), k=rng.randint(n, 24)) for _ in range(300)]:
        if len(set(terms)) < n:
            continue
        weights = rng.choice([[1.0], [0.4, 0.2], [1.0, 0.4, 0.2]])
        entries = [(i, t, rng.choice(weights)) for i, t in enumerate(terms)]
        of = [[w for _, t, w in entries if t == k] for k in range(n)]
        assert _density(entries, n) <= RI.ceiling([(sum(ws), len(ws), max(ws)) for ws in of])
