"""Fixes that log what they did: undone in turn they leave the snapshot as it was."""

import json

from foliant.operators import corrections as R
from foliant.operators import fixes as X
from foliant.session import written as write

SERIES = "series_id string, source string, external_id string, name string, slug string, canonical_key string, kind string, provenance string, catalog_release string, merged_into string, parent_id string, dissolved boolean"
WORKS = "work_id string, source string, external_id string, title string, series_id string, merged_into string"
OPS = "op_id int, work_id string, series_id string, new_name string, position double"
NAMES = ("works", "series", "members", "threads")


def written(state):
    return {k: write(v) for k, v in state.items()}


def recorded(done):
    return X.Recorded(written(done.tables), write(done.log), write(done.images), write(done.refusals))


def tables(spark):
    def row(s, kind="series", parent=None, release="r1", merged=None):
        return (s, "openlibrary", f"ol:{s}", s, f"slug-{s}", s, kind, "ol_tag", release, merged, parent, False)

    return written({
        "works": spark.createDataFrame([("w1", "openlibrary", "OL1W", "One", "s1", None), ("w2", "openlibrary", "OL2W", "Two", "s1", None), ("w3", "heuristic", "h3", "Three", "p3", None),
                                        ("w4", "openlibrary", "OL4W", "Four", "p3", "w3"), ("w5", "openlibrary", "OL5W", "Five", "s2", None)], WORKS),
        "series": spark.createDataFrame([row("s1"), row("s1a", parent="s1"), row("s2"), row("s3", release=None), row("p3", "singleton", release=None), row("old", merged="p3")], SERIES),
        "members": spark.createDataFrame([("s1", "w1", 1.0, "ol_tag", "medium"), ("s1a", "w1", 3.0, "ol_tag", "low"), ("s1", "w2", 2.0, "ol_tag", "medium"),
                                          ("s2", "w5", None, "ol_tag", "low")], "series_id string, work_id string, position double, provenance string, confidence string"),
        "threads": spark.createDataFrame([(1, "s1", "w1"), (2, "s1", None), (3, "p3", None), (4, "p3", "w4"), (5, "s2", "w5"), (6, "s3", None)], "thread_id bigint, series_id string, work_id string"),
    })


def content(state):
    shown = {"works": ("work_id", "series_id"), "series": ("series_id", "name", "merged_into", "parent_id", "dissolved"),
             "members": ("series_id", "work_id", "position", "provenance", "confidence"), "threads": ("thread_id", "series_id", "work_id")}
    return {name: {tuple(r) for r in state[name].select(*columns).collect()} for name, columns in shown.items()}


def undo_all(state, log, images):
    """Undo what can be undone until nothing can; the state and how many rounds it took."""
    rounds = 0
    while True:
        before = log.filter("reverted").count()
        state, log, refused = R.revert(log.filter("NOT reverted").select("correction_id"), log, state, images)
        state, log = written(state), write(log)
        if log.filter("reverted").count() == before:
            return state, log, rounds
        rounds += 1


def test_several_moves_of_a_book_are_logged_one_by_one(spark):
    start = tables(spark)
    ops = spark.createDataFrame([(1, "w1", "s2", None, 5.0), (2, "w1", "s2", None, None), (3, "w1", None, "New Home", 1.0), (4, "w1", "s3", None, None), (5, "w3", None, "new home!", None),
                                 (6, "w3", "s2", None, 7.0), (7, "w2", "s3", None, 1.0), (8, "w9", "s2", None, None), (9, "w4", "s2", None, None)], OPS)
    done = recorded(X.set_series(ops, start))
    assert {tuple(r) for r in done.refusals.collect()} == {(2, "same_room"), (8, "unknown_work"), (9, "merged_work")}
    log = {r["correction_id"]: r for r in done.log.collect()}
    assert sorted(log) == [1, 3, 4, 5, 6, 7]
    assert json.loads(log[1]["override"]) == [
        {"remove_from_series": {"work": "OL1W", "series": "ol:s1"}}, {"remove_from_series": {"work": "OL1W", "series": "ol:s1a"}},
        {"set_series": {"work": "OL1W", "series": "ol:s2", "position": 5.0}}]
    assert json.loads(log[4]["override"]) == [{"set_series": {"work": "OL1W", "series": "ol:s3", "name": "s3"}}]
    assert log[5]["override"] is None and log[5]["runtime_only_reason"] == "Three has no Open Library id (heuristic work)"
    after = content(done.tables)
    assert dict(after["works"])["w1"] == "s3" and {t for t in after["threads"] if t[2] == "w1"} == {(1, "s3", "w1")}
    # The page and the new room are both left empty in the end: all they held goes on to s2 and s3.
    assert {r[0]: r[2] for r in after["series"]}["p3"] == "s2" and {t for t in after["threads"] if t[0] in (3, 4)} == {(3, "s2", "w3"), (4, "s2", "w4")}
    assert {r[0]: r[2] for r in after["series"]}["s1"] == "s3"
    state, log, rounds = undo_all(done.tables, done.log, done.images)
    before, again = content(start), content(state)
    assert rounds == 4 and not log.filter("NOT reverted").count()
    assert again["works"] == before["works"] and again["members"] == before["members"] and again["threads"] == before["threads"]
    assert {r for r in again["series"] if r[1] != "New Home"} == before["series"]
    assert [r[2] is None for r in again["series"] if r[1] == "New Home"] == [False]  # what the first move made is a tombstone


def test_removal_dissolving_positions_and_names_come_back(spark):
    start = tables(spark)
    placed = recorded(X.set_position(spark.createDataFrame([(1, "w1", "s1", 8.0), (2, "w1", "s1", 4.0), (3, "w5", "s2", 2.0)], "op_id int, work_id string, series_id string, position double"), start))
    named = recorded(X.rename(spark.createDataFrame([(4, "s1", "A"), (5, "s1", "A"), (6, "s1", "B")], "op_id int, series_id string, name string"), placed.tables))
    removed = recorded(X.remove(spark.createDataFrame([(7, "w5", "s2")], "op_id int, work_id string, series_id string"), named.tables))
    rejected = recorded(X.reject(spark.createDataFrame([(8, "s1")], "op_id int, series_id string"), removed.tables))
    parts = (placed, named, removed, rejected)
    log, images = X._union([p.log for p in parts]), X._union([p.images for p in parts])
    assert {(r["correction_id"], r["runtime_only_reason"]) for r in log.collect()} == {(i, None) for i in (1, 2, 3, 4, 6, 7, 8)}
    after = content(rejected.tables)
    assert after["members"] == set() and dict(after["works"])["w1"] not in ("s1", "s2")
    assert {m for m in content(placed.tables)["members"] if m[1] == "w1"} == {("s1", "w1", 1.0, "ol_tag", "medium"), ("s1a", "w1", 4.0, "override", "high")}
    state, log, _ = undo_all(rejected.tables, log, images)
    before, again = content(start), content(state)
    assert not log.filter("NOT reverted").count()
    assert all(again[n] == before[n] for n in ("works", "members", "threads"))
    pages = {r[0]: r[2] for r in again["series"]} .items() - {r[0]: r[2] for r in before["series"]}.items()
    assert {r for r in again["series"] if r[0] in {b[0] for b in before["series"]}} == before["series"] and sorted(t for _, t in pages) == ["s1", "s1", "s2"]


def test_a_move_that_others_built_on_stays(spark):
    start = tables(spark)
    done = recorded(X.set_series(spark.createDataFrame([(1, "w1", "s2", None, 5.0)], OPS), start))

    def refused(**changed):
        _, log, refusals = R.revert(done.log.select("correction_id"), done.log, {**done.tables, **changed}, done.images)
        return [tuple(r) for r in refusals.collect()]

    now = done.tables
    assert refused(works=now["works"].replace("s2", "s3", ["series_id"])) == [(1, "stale")]
    assert refused(members=now["members"].filter("series_id <> 's2'")) == [(1, "stale")]
    assert refused(threads=now["threads"].unionByName(spark.createDataFrame([(50, "s2", "w1")], now["threads"].schema))) == [(1, "new_discussion")]
    assert refused(threads=now["threads"].filter("thread_id <> 1")) == [(1, "stale")]
    # A membership the move replaced is there again under the same key, so such a move is never undone.
    prior = {**start, "members": start["members"].unionByName(spark.createDataFrame([("s2", "w1", 9.0, "ol_tag", "low")], start["members"].schema))}
    done = recorded(X.set_series(spark.createDataFrame([(1, "w1", "s2", None, 5.0)], OPS), prior))
    assert done.images.filter("kind = 'member'").count() == 3 and refused() == [(1, "stale")]


def test_a_page_with_company_keeps_its_book(spark):
    done = recorded(X.remove(spark.createDataFrame([(1, "w1", "s1")], "op_id int, work_id string, series_id string"), tables(spark)))
    page = done.tables["works"].filter("work_id = 'w1'").first()["series_id"]
    crowded = {**done.tables, "works": done.tables["works"].replace("s2", page, ["series_id"])}
    assert [tuple(r) for r in R.revert(done.log.select("correction_id"), done.log, crowded, done.images)[2].collect()] == [(1, "stale")]


def test_vetoes_are_logged_once_and_undone(spark):
    genres = spark.createDataFrame([(1, False), (2, True)], "genre_id int, retired boolean")
    ops = spark.createDataFrame([(1, "w1", 1), (2, "w1", 1), (3, "w1", 2), (4, "w4", 1), (5, "w2", 1)], "op_id int, work_id string, genre_id int")
    done = recorded(X.veto(ops, tables(spark), genres))
    assert {tuple(r) for r in done.refusals.collect()} == {(2, "already_vetoed"), (3, "retired_genre"), (4, "merged")}
    again = recorded(X.veto(spark.createDataFrame([(9, "w2", 1)], "op_id int, work_id string, genre_id int"), tables(spark), genres, done.log))
    assert [tuple(r) for r in again.refusals.collect()] == [(9, "already_vetoed")] and again.log.count() == 0
    _, log, refused = R.revert(done.log.select("correction_id"), done.log, tables(spark), done.images)
    assert log.filter("reverted").count() == 2 and refused.count() == 0


def test_a_later_exported_move_knows_the_earlier_ones(spark):
    """Leaving a series no release holds is exported if an exported fix put the book there."""
    first = recorded(X.set_series(spark.createDataFrame([(1, "w2", "s3", None, None)], OPS), tables(spark)))
    second = recorded(X.remove(spark.createDataFrame([(2, "w2", "s3")], "op_id int, work_id string, series_id string"), first.tables, first.log))
    assert json.loads(second.log.first()["override"]) == [{"remove_from_series": {"work": "OL2W", "series": "ol:s3"}}]
    alone = recorded(X.remove(spark.createDataFrame([(2, "w2", "s3")], "op_id int, work_id string, series_id string"), first.tables))
    assert alone.log.first()["override"] is None and alone.log.first()["runtime_only_reason"] == "s3 is not in a catalog release"


def test_the_number_of_jobs_does_not_depend_on_the_moves_of_a_book(spark):
    def jobs(n):
        ops = spark.createDataFrame([(i, "w1", f"s{2 + i % 2}", None, None) for i in range(n)], OPS)
        group = f"moves-{n}"
        spark.sparkContext.setJobGroup(group, group)
        R.apply_set_series(ops, tables(spark))[0]["works"].count()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(40) <= jobs(2) + 2
