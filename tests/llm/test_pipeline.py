"""The pipeline's stages against what each should keep."""

import corpus_pipeline as P
import pytest

from foliant.llm import packing

from fixtures import DOCS, awkward, documents, near_model

SF = "/root/testdata/sf0.001"


def test_each_stage_keeps_what_it_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = P.known_language(spark, docs, SF)
    assert first.columns == list(P.COLUMNS)
    kept = {r["doc_id"]: r for r in first.collect()}
    assert {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])} - set(kept) == set()
    largest = {}
    for r in kept.values():
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    second = P.drop_exact_copies(spark, first, SF)
    assert {(r["text"], r["doc_id"]) for r in second.collect()} == set(largest.items()) and second.columns == list(P.COLUMNS)
    third = P.drop_near_copies(spark, second, SF)
    component = near_model([(r["doc_id"], r["text"]) for r in second.collect()])
    assert {r["doc_id"] for r in third.collect()} == {i for i, c in component.items() if i == c} and third.columns == list(P.COLUMNS)
    last = {r["doc_id"] for r in P.pack_windows(spark, third, SF).collect()}
    assert last == {r["doc_id"] for r in third.collect()}
    whole = P.run(spark, SF)
    assert {r["doc_id"] for r in whole.collect()} == last
    assert all(r["bin_fill"] <= packing.CAPACITY for r in whole.collect())


@pytest.mark.parametrize("name, stage", P.STAGES)
def test_awkward_and_empty_inputs(spark, name, stage):
    assert stage(spark, spark.createDataFrame([], DOCS), SF).collect() == []
    found = stage(spark, documents(spark, awkward()), SF).collect()
    ids = {r[0] for r in awkward()}
    assert found and {r["doc_id"] for r in found} <= ids
    if name == "exact dedup":
        assert sorted((r["doc_id"] for r in found if r["text"] == "one two")) == [5]
    if name == "language ID":
        assert not {1, 2, 3, 15} & {r["doc_id"] for r in found}
