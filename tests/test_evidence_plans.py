"""Series strings are parsed once per distinct text, and a search leaves out other terms' postings before any exchange."""

from foliant.operators import search as S
from foliant.operators import series as L


def _planned(monkeypatch, module) -> list:
    """The query executions of what a module materializes."""
    seen, materialize = [], module.materialize
    monkeypatch.setattr(module, "materialize", lambda df: seen.append(df._jdf.queryExecution()) or materialize(df))
    return seen


def test_lines_are_counted_without_parsing_them_again(spark, monkeypatch):
    seen = _planned(monkeypatch, L)
    lines = [("W1", "e1", ["Ash Saga ; 2", "Birch, #1"]), ("W1", "e2", ["Ash Saga ; 2"]), ("W1", "e2", ["Ash Saga ; 2"]), ("W1", "e3", ["Birch, #3", None]),
             ("W1", None, ["Ash Saga, #2"]), ("W2", "e4", None), ("W2", "e5", ["  "]), (None, "e6", ["Cedar ; 1"])]
    found = L.rung3(spark.createDataFrame(lines, "work_id string, edition_id string, series array<string>"))
    assert sorted(map(tuple, found.collect()), key=str) == [("W1", "ol:ash saga", "Ash Saga", 2.0, 3), (None, "ol:cedar", "Cedar", None, 3)]  # no position is joined to no work
    titles = [("W1", "", "Elm (Ash Saga, #2)"), ("W1", "e1", "Elm (Ash Saga, #2)"), ("W1", "e2", "Elm"), ("W2", "e3", None)]
    found = L.rung4(spark.createDataFrame(titles, "work_id string, voter string, title string"))
    assert sorted(map(tuple, found.collect())) == [("W1", "ol:ash saga", "Ash Saga", 2.0, 4)]
    assert len(seen) == 2
    for plan in seen:
        assert "regexp" not in plan.optimizedPlan().toString().lower()


def test_postings_of_other_terms_are_not_exchanged(spark, monkeypatch):
    seen = _planned(monkeypatch, S)
    docs = spark.createDataFrame(
        [(i, ("Ash trees", "Birch", None)[i % 3], "Elm", "ash, birches; the things", i, 1, None, "single", 1 if i == 3 else None) for i in range(9)],
        "doc_id long, title string, author string, subjects string, readers long, edition_count int, first_publish_year int, kind string, merged_into int")
    asked = spark.createDataFrame([(1, "ash"), (2, "elm thing"), (3, "the"), (4, None), (5, "zinnia")], "query_id int, query string")
    found = S.rank_search(S.build_search_index(docs), docs, asked, 3)
    # Two covers of weights 1 and 0.2 for a title with the word; book 3 is merged away.
    assert [(r["query_id"], r["rank"], r["doc_id"]) for r in found.orderBy("query_id", "rank").collect()] == [
        (1, 1, 6), (1, 2, 0), (1, 3, 8), (2, 1, 8), (2, 2, 7), (2, 3, 6)]
    (plan,) = seen
    assert "BroadcastHashJoin" in plan.sparkPlan().toString()
    assert "Exchange hashpartitioning" not in plan.executedPlan().toString()


def test_stems_and_words_of_odd_texts(spark):
    texts = spark.createDataFrame([("Series, ss THINGS; walked ies bed ing s",), ("",), (None,), (" ,; ",)], "t string")
    found = [r["w"] for r in texts.select(S.words(texts["t"]).alias("w")).collect()]
    assert found == [["series", "ss", "things", "walked", "ies", "bed", "ing", "s"], [], [], []]
    terms = spark.createDataFrame([(w,) for w in found[0] + [None]], "w string")
    assert [r[0] for r in terms.select(S.stem(terms["w"])).collect()] == ["sery", "ss", "thing", "walk", "ies", "bed", "ing", "s", None]
