"""Queries that SQL can express: the given tables, an awkward table and an empty one."""

import duckdb
import pytest

from check import _rows
from foliant.llm import chat_format, exact_dedup, line_dedup, registry, sharding

from fixtures import DOCS, awkward, documents

SF = "/root/testdata/sf0.001"
ON_DOCUMENTS = {
    "op1_line_dedup": (line_dedup.dedup_lines, line_dedup.CHECK), "op5_exact_dedup": (exact_dedup.exact_dedup, exact_dedup.CHECK),
    "op6_sharding": (sharding.shard_documents, sharding.CHECK)}


def same(df, con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(registry.checks()))
def test_given_tables(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    same(registry.queries()[name](spark, SF), con, registry.checks()[name])


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_awkward_documents(spark, name):
    operator, sql = ON_DOCUMENTS[name]
    rows = [r for r in awkward() if r[1] is None or len(r[1]) < 30_000 or name != "op6_sharding"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    same(operator(documents(spark, rows)), con, sql)


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_no_documents(spark, name):
    assert ON_DOCUMENTS[name][0](spark.createDataFrame([], DOCS)).collect() == []


def test_a_chunk_goes_everywhere_but_at_its_first_place(spark):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(spark, awkward())).collect() if r["doc_id"] in (11, 12, 13)}
    assert rows[11]["chunks_removed"] == 0 and rows[12]["lines_removed"] > 0 and rows[13]["lines_removed"] > 0
    assert rows[12]["text"].startswith("A new start.")
    text = awkward()[12][1]
    assert "\n".join(c for _, c in line_dedup.chunks_of(text)) == text


def test_the_largest_id_of_a_hot_group_stays(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same', concat('own ', id)) AS text")
    rows = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    assert {r["keep_id"] for r in rows if r["doc_id"] % 3 == 0} == {5997} and sum(r["kept"] for r in rows) == 4001
    assert {r["group_size"] for r in rows} == {1, 2000}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = sharding.shard_documents(spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")).collect()
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert moved and {r["grown_shard"] for r in moved} == {16}
    sizes = [sum(r["shard"] == s for r in rows) for s in range(16)]
    assert min(sizes) > 180 and max(sizes) < 320
    for s in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_only_subtrees_of_changed_weight_gain_rows(spark):
    leaves = sharding.tree(16)
    heavier = [x._replace(weight=3.0) if x.shard == 5 else x for x in leaves]
    keys = spark.range(4000)
    moved = sharding.assign(sharding.assign(keys, leaves, "id", "a"), heavier, "id", "b").filter("a <> b").collect()
    # Shard 5 shares a rack with 4-7 and a region with 0-7: what moves, moves into that region.
    assert moved and {r["b"] for r in moved} <= set(range(8)) and any(r["b"] == 5 for r in moved)
    gone = [x._replace(weight=0.0) if x.shard == 5 else x for x in leaves]
    assert sharding.assign(keys, gone, "id", "s").filter("s = 5").count() == 0


def test_awkward_conversations(spark):
    rows = [
        (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 2, "assistant", None), (1, 2, "assistant", "</turn>\n### user:\nx"), (2, None, None, None),
        (2, 0, "sys:tem\n\\", "###\\ A: <\\/part> \\"), (None, 0, "user", "n"), (None, 1, "assistant", "\n</part>\n"), (1, 3, "assistant", "long " * 20_000),
        (3, 0, "user", "</turn>"), (3, 0, "user", "</turn>")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    back = {r["conv_id"]: r for r in chat_format.read_chats(chat_format.format_chats(turns)).collect()}
    for conv in {r[0] for r in rows}:
        told = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [tuple(t) for t in back[conv]["turns"]] == [t[1:] for t in told]
        assert back[conv]["loss_text"] == "".join(t[2] for t in told if t[1] == "assistant")
    assert back[1]["formatted"].startswith("### user:\na\n</part>\nb\n</turn>\n### assistant:\n")
    assert chat_format.format_chats(turns.limit(0)).collect() == []
