"""Repeated passages go whole, wherever they stand."""

import random

import duckdb
import pytest

from foliant.llm import passage_dedup

from fixtures import DOCS, awkward, documents
from test_sql_checks import same


def planted(n=40):
    """Documents of own lines around passages of 2 to 5 lines and over 50 words; each passage stands in three documents."""
    chance = random.Random(5)
    line = lambda tag, words: " ".join(f"{tag}{chance.randrange(10**6)}" for _ in range(words))
    passages = [[line("p", 26) for _ in range(2 + k % 4)] for k in range(n)]
    own = {i: [line("o", 8) for _ in range(chance.randrange(1, 4))] for i in range(6 * n)}
    rows = [(i, "\n".join([*own[2 * i], *passages[i % n], *own[2 * i + 1]]), "en", f"s{i}") for i in range(3 * n)]
    return rows, {i: [*own[2 * i], *(passages[i] if i < n else []), *own[2 * i + 1]] for i in range(3 * n)}


def test_every_planted_passage_goes_whole(spark):
    rows, want = planted()
    found = {r["doc_id"]: r for r in passage_dedup.dedup_passages(documents(spark, rows)).collect()}
    assert {i: r["text"].split("\n") for i, r in found.items()} == want
    assert sum(r["runs_removed"] for r in found.values()) == 80


def test_periodic_texts(spark):
    texts = {1: "a\nb\na\nb\na\nb", 2: "x\nx\nx\nx\nx", 3: "x\nx\nx", 4: "b\nq\na", 5: "z\na\nb", 6: "u\nu\nu"}
    found = {r["doc_id"]: r["text"] for r in passage_dedup.dedup_passages(documents(spark, [(i, t, "en", "s") for i, t in texts.items()])).collect()}
    assert found == {1: "a\nb", 2: "x\nx", 3: "", 4: "b\nq\na", 5: "z", 6: "u\nu\nu"}


@pytest.mark.parametrize("digest_bytes", [8, 1])
def test_awkward_documents_and_colliding_digests(spark, monkeypatch, digest_bytes):
    monkeypatch.setattr(passage_dedup, "DIGEST_BYTES", digest_bytes)
    rows = awkward() + [(100 + r[0], *r[1:]) for r in planted(12)[0]]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    same(passage_dedup.dedup_passages(documents(spark, rows)), con, passage_dedup.CHECK)


def test_no_documents(spark):
    assert passage_dedup.dedup_passages(spark.createDataFrame([], DOCS)).collect() == []
