r"""Chat formatting with DataFrame functions only (operator 9).

Turn structs are collected per conversation and sorted; neighbours with one role are merged
into one block by array functions; the blocks are concatenated::

    ### user:
    first text
    </part>
    second text of the same role
    </turn>
    ### assistant:
    ...

Inside texts a control string gets one more backslash in a fixed place (``</turn>`` becomes
``<\/turn>``, ``### Assistant:`` becomes ``###\ Assistant:``), and one that has n backslashes
there already gets n + 1; reading takes one away. All other text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import query, table

# --- fixed values --------------------------------------------------------------
END_TURN = "\n</turn>\n"
END_PART = "\n</part>\n"
LEARNED_ROLE = "assistant"
# -------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)/(turn|part)>", r"<$1\\/$2>"), r"###(\\*) (\w+:)", r"###$1\\ $2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"###\\(\\*) (\w+:)", r"###$1 $2"), r"<\\(\\*)/(turn|part)>", r"<$1/$2>")


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit(":"), F.lit("\\c")), F.lit("\n"), F.lit("\\n"))


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\c"), F.lit(":")), F.lit("\\b"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``(conv_id, formatted, loss_spans)``: one row per conversation.

    ``loss_spans`` are ``(start, length)`` in code points, counted from 1, of the assistant's
    texts as they stand in ``formatted``. Turns sort by (turn, role, text), nulls first, so
    repeated turn numbers have an order too. A null text or role is empty; rows without a
    conversation id form one conversation with a null id. Other columns are not read. An
    empty table gives no rows.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    size = F.size("t")

    def piece(x: Column, i: Column) -> Column:
        before, after = F.get("t", i - 1)["role"], F.get("t", i + 1)["role"]
        opens = (i == 0) | (before != x["role"])
        closes = (i == size - 1) | (after != x["role"])
        return F.struct(
            F.when(opens, F.concat(F.lit("### "), _role_in(x["role"]), F.lit(":\n"))).otherwise(F.lit("")).alias("head"),
            escape(x["text"]).alias("body"),
            F.when(closes, F.lit(END_TURN)).otherwise(F.lit(END_PART)).alias("tail"),
            (x["role"] == LEARNED_ROLE).alias("learned"))

    pieces = chats.select("conv_id", F.transform("t", piece).alias("p")).withColumn(
        "n", F.transform("p", lambda x: F.length(x["head"]) + F.length(x["body"]) + F.length(x["tail"])))

    def span(x: Column, i: Column) -> Column:
        before = F.aggregate(F.slice("n", F.lit(1), i), F.lit(0), lambda a, b: a + b)
        return F.struct(x["learned"].alias("learned"), (before + F.length(x["head"]) + 1).alias("start"), F.length(x["body"]).alias("length"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.transform(F.filter(F.transform("p", span), lambda x: x["learned"]),
                    lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``(conv_id, turns, loss_text)`` read back from ``format_chats``: ``turns`` are ``(role, text)`` in order."""
    blocks = F.split("formatted", END_TURN)

    def block(x: Column) -> Column:
        role = _role_out(F.substring(F.substring_index(x, ":\n", 1), 5, 1 << 30))
        body = F.substring(x, F.length(F.substring_index(x, ":\n", 1)) + 3, F.lit(1 << 30))
        return F.transform(F.split(body, END_PART), lambda y: F.struct(role.alias("role"), unescape(y).alias("text")))

    turns = F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), block))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"], s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


CHECK = r"""
WITH raw AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
seen AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o AS before, lead(role) OVER o AS after,
    length(text) + length(regexp_extract_all(text, '<\\*/(?:turn|part)>|###\\* \w+:'))  AS n
  FROM raw WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 9 + CASE WHEN before IS DISTINCT FROM role
    THEN 6 + length(role) + length(regexp_extract_all(role, '[\\:\n]')) ELSE 0 END)::BIGINT AS formatted_chars
FROM seen GROUP BY conv_id"""


@query("op9_chat_format", CHECK)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    back = read_chats(format_chats(told.unionByName(extra)))
    spoken = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
