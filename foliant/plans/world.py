"""The given tables as seen by the registered queries.

``World`` opens the Parquet tables lazily and offers adapter views: catalog,
genre and discussion shapes derived from whole tables by SQL text that Spark
and the SQL check share. ``query`` registers a plan with its check.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.session import count_rows_in_memory, written

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "fx_user": "SELECT c_custkey AS user_id, c_name AS username FROM customer",
    "fx_author": """
        SELECT DISTINCT concat('OL', substr(p_brand, 7), 'A') AS author_id, p_brand AS name FROM part
        UNION ALL SELECT concat('OL', 100 + n_nationkey, 'A'), concat('Brand#', n_nationkey + 1) FROM nation
        UNION ALL SELECT concat('OL', 200 + r_regionkey, 'A'), concat('Brand#', r_regionkey + 1) FROM region
        UNION ALL SELECT concat('OL', 300 + s_suppkey, 'A'),
          CASE WHEN s_acctbal < 1000 THEN 'Brand#1' ELSE s_name END FROM supplier""",
    "fx_author_kg": """
        SELECT concat('Q', n_regionkey) AS qid, concat('OL', 100 + n_nationkey, 'A') AS author_id FROM nation
        UNION ALL SELECT concat('Q', 50 + s_nationkey), concat('OL', 300 + s_suppkey, 'A') FROM supplier""",
    "fx_work": """
        SELECT concat('OL', p_partkey + 1, 'W') AS work_id, p_partkey + 1 AS work_num,
          CASE p_partkey % 8 WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' (Deluxe Edition)')
            WHEN 2 THEN concat(p_name, ' #', p_size % 9 + 1) WHEN 3 THEN concat(p_name, ', Vol. ', p_size % 9 + 1)
            WHEN 4 THEN concat(p_name, ': Illustrated Edition') WHEN 5 THEN concat(p_name, ' Box Set')
            WHEN 6 THEN concat(p_name, ': ', lower(p_type))
            ELSE concat(p_name, ' (', p_brand, ' Chronicles, #', p_size % 9 + 1, ')') END AS raw_title,
          concat('OL', substr(p_brand, 7), 'A') AS author_id, p_brand AS author,
          1950 + p_size AS first_publish_year, p_size AS readinglog_count, CAST(p_partkey % 5 AS INT) AS edition_count,
          CASE WHEN p_partkey % 97 = 3 THEN concat('OL', p_partkey, 'W') END AS merged_into,
          p_size % 25 AS series_id, p_type AS shelf_mark FROM part""",
    "fx_edition": """
        SELECT concat('OL', l_orderkey, 'x', l_linenumber, 'x', l_partkey, 'x', l_suppkey, 'M') AS edition_id,
          concat('OL', l_partkey + 1, 'W') AS work_id, l_returnflag <> 'R' AS is_english, p_name AS title, p_brand AS author,
          CASE WHEN l_linenumber % 3 = 0 THEN lower(p_type) END AS subtitle, CAST(l_quantity * 6 AS INT) AS page_count,
          s_name AS publisher, CAST(year(l_shipdate) AS INT) AS publish_year,
          CASE l_linenumber % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language,
          CASE WHEN l_linenumber % 2 = 0 THEN concat('https://c/', l_suppkey, '.jpg') END AS cover_url,
          CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS cover_id,
          CASE l_linenumber % 3
            WHEN 0 THEN concat(lpad(CAST((l_orderkey * 7919 + l_partkey) % 1000000000 AS STRING), 9, '0'), 'X')
            WHEN 1 THEN concat('978-', lpad(CAST((l_orderkey * 7919 + l_partkey) % 10000000000 AS STRING), 10, '0'))
            ELSE 'n/a' END AS isbn_raw,
          CASE l_linenumber % 4 WHEN 0 THEN concat(p_type, ' Saga ; ', p_size % 9 + 1)
            WHEN 1 THEN concat(p_type, ' Saga, #', p_size % 9 + 1)
            WHEN 2 THEN concat(split_part(p_name, ' ', 1), ' Cycle (', p_size % 9 + 1, ')')
            ELSE concat(p_brand, ' Chronicles ; ', p_size % 9 + 1) END AS series_string
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "fx_subject": """
        SELECT concat('OL', p_partkey + 1, 'W') AS work_id, 1 AS line,
          CASE WHEN p_size <= 16 THEN concat('series:', p_type, '_Saga')
            WHEN p_size <= 33 THEN concat('Series: ', p_brand, ' Chronicles')
            ELSE concat('franchise:', split_part(p_name, ' ', 1)) END AS subject FROM part
        UNION ALL SELECT concat('OL', p_partkey + 1, 'W'), 2,
          CASE WHEN p_brand = 'Brand#7' THEN 'franchise:Brand#7 World' WHEN p_size <= 8 THEN 'series:Brand#1 Chronicles'
            WHEN p_size <= 25 THEN concat('genre: ', lower(p_type)) ELSE concat('place:', lower(p_type)) END FROM part
        UNION ALL SELECT concat('OL', p_partkey + 1, 'W'), 3,
          CASE p_type WHEN 'ECONOMY' THEN concat('Fiction, ', p_name, ', epic') WHEN 'SMALL' THEN 'Great Britain -- Small History'
            WHEN 'MEDIUM' THEN 'Medium -- History -- Fiction' WHEN 'PROMO' THEN 'Promotional objects'
            WHEN 'STANDARD' THEN 'Standard-bearers' ELSE concat('Detective and ', p_name) END FROM part""",
    "fx_log": """
        SELECT concat('OL', CAST(floor(value * 7) AS BIGINT) + 1, 'W') AS work_id,
          CASE WHEN event_type = 'purchase' THEN 'rating' ELSE 'reading_log' END AS kind, user_id, event_id, ts FROM events""",
    "fx_redirect": """
        SELECT concat('OL', p_partkey + 1, 'W') AS from_ol,
          concat('OL', CASE WHEN p_size > 45 THEN p_partkey ELSE p_partkey + 2 END, 'W') AS to_ol
        FROM part WHERE p_type IN ('PROMO', 'SMALL', 'LARGE')""",
    "fx_kg_membership": """
        SELECT concat('Q1', p_partkey) AS item,
          CASE WHEN p_brand = 'Brand#5' THEN 'Q4' ELSE concat('Q', p_size % 12) END AS series,
          CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '1a' ELSE CAST(p_size % 9 + 1 AS STRING) END AS ordinal,
          concat('OL', p_partkey + 1, 'W') AS ol_id FROM part WHERE p_type = 'ECONOMY' OR p_brand = 'Brand#5'""",
    "fx_kg_series": """
        SELECT concat('Q', n_nationkey) AS qid,
          CASE n_nationkey WHEN 0 THEN 'Brand#2 Chronicles' WHEN 1 THEN 'Brand 3: Chronicles' WHEN 7 THEN 'Small Saga'
            ELSE n_name END AS label,
          CASE WHEN n_nationkey >= 4 THEN concat('Q', n_nationkey % 4) END AS parent FROM nation""",
    "fx_series_parent": """
        SELECT n_nationkey AS series_id,
          CASE WHEN n_nationkey % 4 <> 0 THEN n_nationkey - n_nationkey % 4
               WHEN n_nationkey % 8 = 4 THEN n_nationkey - 4 END AS parent_id, n_name AS name FROM nation""",
    "fx_taxonomy": """
        SELECT DISTINCT lower(p_type) AS slug, CAST(NULL AS STRING) AS parent, length(p_type) AS position,
          'match' AS kind, lower(p_type) AS phrase FROM part
        UNION ALL SELECT DISTINCT split_part(p_name, ' ', 1), 'economy', length(split_part(p_name, ' ', 1)),
          'match', split_part(p_name, ' ', 1) FROM part
        UNION ALL SELECT DISTINCT 'medium', CAST(NULL AS STRING), 6, 'exclude', 'fiction' FROM part WHERE p_type = 'MEDIUM'""",
    "fx_genre": """
        SELECT r_regionkey AS genre_id, r_name AS name, lower(replace(r_name, ' ', '-')) AS slug,
          CAST(NULL AS INT) AS parent_id, r_regionkey AS position, false AS retired FROM region
        UNION ALL SELECT 100 + n_nationkey, n_name, lower(replace(n_name, '_', '-')), n_regionkey, n_nationkey,
          n_nationkey % 11 = 10 FROM nation""",
    "fx_genre_vote": """
        SELECT DISTINCT user_id, concat('OL', CAST(floor(value * 7) AS BIGINT) + 1, 'W') AS work_id,
          CASE WHEN event_type = 'error' THEN CAST(event_id % 5 AS INT) ELSE CAST(100 + event_id % 25 AS INT) END AS genre_id
        FROM events""",
    "fx_genre_action": """
        SELECT event_id, ts, user_id, concat('OL', event_id % 3 + 1, 'W') AS work_id,
          CAST(100 + event_id % 25 AS INT) AS genre_id,
          CASE WHEN event_type = 'error' THEN 'unvote' ELSE 'vote' END AS action FROM events""",
    "fx_genre_inference": """
        SELECT concat('OL', p_partkey + 1, 'W') AS work_id, CAST(100 + p_partkey % 25 AS INT) AS genre_id,
          CASE WHEN p_type = 'SMALL' THEN 'google' WHEN p_type = 'LARGE' THEN 'open_library' ELSE 'catalog' END AS source
        FROM part""",
    "fx_veto": """
        SELECT concat('OL', p_partkey + 1, 'W') AS work_id, CAST(100 + p_partkey % 25 AS INT) AS genre_id,
          p_size > 40 AS reverted, p_partkey AS veto_id FROM part WHERE p_name LIKE '%bolt'""",
    "fx_thread": """
        SELECT conv_id AS thread_id, concat('thread ', conv_id) AS title, conv_id % 150 AS user_id,
          CAST(conv_id % 25 AS INT) AS series_id, CAST(conv_id % 5 AS INT) AS genre_id,
          concat('OL', conv_id % 40 + 1, 'W') AS work_id, conv_id % 7 = 0 AS deleted FROM conversations WHERE turn = 0""",
    "fx_post": """
        SELECT conv_id * 100 + turn AS post_id, conv_id AS thread_id,
          CASE WHEN role = 'assistant' AND turn > 0 THEN conv_id * 100 + turn - 1 END AS parent_id,
          turn AS seq, (conv_id + turn) % 150 AS user_id, text AS content, (conv_id + turn) % 5 = 0 AS deleted
        FROM conversations""",
    "fx_vote": """
        SELECT event_id, ts, user_id, event_id % 40 AS thread_id,
          CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 WHEN 'signup' THEN -1 ELSE 0 END AS value
        FROM events""",
    "fx_shelf": """
        SELECT event_id AS shelf_id, user_id, concat('OL', event_id % 60 + 1, 'W') AS work_id,
          CASE event_type WHEN 'view' THEN 'want_to_read' WHEN 'click' THEN 'reading' ELSE 'read' END AS status,
          ts AS created_at FROM events""",
    "fx_correction": """
        SELECT o_orderkey AS correction_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'merge_works'
            WHEN '2' THEN 'set_series' WHEN '3' THEN 'rename_series' WHEN '4' THEN 'veto_genre'
            ELSE 'remove_from_series' END AS op,
          concat('OL', o_custkey % 400 + 1, 'W') AS work_id, CAST(o_custkey % 25 AS INT) AS series_id,
          CAST(100 + o_custkey % 25 AS INT) AS genre_id,
          o_custkey % 150 AS user_id, o_orderdate AS created_at, o_orderstatus = 'F' AS reverted,
          o_totalprice > 200000 AS exportable FROM orders""",
    "fx_golden": """
        SELECT concat(p_type, ' Saga') AS name,
          CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_size % 9, 1950 + p_size, p_name, concat('OL', p_partkey + 1, 'W')) AS INT) AS seq,
          concat('OL', p_partkey + 1, 'W') AS work_id FROM part WHERE p_size <= 16""",
    "fx_release_prev": """
        SELECT concat('OL', p_partkey + 1, 'W') AS work_id, concat('s', p_size % 10) AS room FROM part WHERE p_brand <> 'Brand#9'""",
    "fx_release_cur": """
        SELECT concat('OL', p_partkey + 1, 'W') AS work_id,
          concat('s', CASE WHEN p_type = 'SMALL' THEN (p_size + 1) % 10 ELSE p_size % 10 END) AS room
        FROM part WHERE p_brand <> 'Brand#3'""",
    "fx_search_doc": """
        SELECT doc_id, split_part(text, '.', 1) AS title, source AS author,
          concat(lang, ' ', substr(text, length(split_part(text, '.', 1)) + 1)) AS subjects, n_chars AS readers FROM documents""",
    "fx_cover_check": """
        SELECT concat('https://c/', s_suppkey, '.jpg') AS url, CASE WHEN s_suppkey % 7 = 0 THEN 404 ELSE 200 END AS status,
          CASE WHEN s_suppkey % 5 = 0 THEN 'image/png' WHEN s_suppkey % 11 = 0 THEN 'text/html' ELSE 'image/jpeg; q=1' END AS content_type,
          CAST(CASE WHEN s_suppkey % 10 = 0 THEN 9103 ELSE 20000 + s_suppkey END AS BIGINT) AS content_length FROM supplier""",
}

# The rows of a view in another join order, for Spark. Lines meet the suppliers while they are narrow and the parts by the
# id of the work, so editions leave the last join dealt by work and what asks for them by work needs no further exchange.
# Exchanges carry bare columns; the texts made of them are made after the last one.
EDITION = VIEWS["fx_edition"].split("FROM lineitem")[0].replace("concat('OL', l_partkey + 1, 'W') AS work_id", "l_work AS work_id").replace(
    "l_returnflag <> 'R' AS is_english", "is_english").replace("CAST(year(l_shipdate) AS INT) AS publish_year", "publish_year").strip()
EDITION_ID = EDITION.removeprefix("SELECT ").split(" AS edition_id")[0]
PLANNED = {
    "fx_edition_line": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, is_english, publish_year, l_work, s_name, p_name, p_brand, p_type, p_size
        FROM (SELECT *, concat('OL', l_partkey + 1, 'W') AS l_work
          FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag <> 'R' AS is_english,
            CAST(year(l_shipdate) AS INT) AS publish_year FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey)
          JOIN (SELECT *, concat('OL', p_partkey + 1, 'W') AS p_work FROM part) ON l_work = p_work""",
    "fx_edition": f"{EDITION} FROM fx_edition_line",
}

_NAMES = re.compile(r"\bfx_[a-z_]+\b")


def _used(text: str, views: dict[str, str], seen: list[str]) -> list[str]:
    for name in _NAMES.findall(text):
        if name in views and name not in seen:
            _used(views[name], views, seen)
            if name not in seen:
                seen.append(name)
    return seen


def with_views(text: str, views: dict[str, str] = VIEWS) -> str:
    """Put the adapter views a statement names in front of it as common table expressions."""
    body = text.strip()
    used = _used(body, views, [])
    if not used:
        return body
    heads = ", ".join(f"{name} AS ({views[name].strip()})" for name in used)
    match = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if match:
        return f"WITH {match.group(1) or ''}{heads}, {body[match.end():]}"
    return f"WITH {heads} {body}"


class World:
    """Lazy access to one scale folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        count_rows_in_memory(spark)
        self._tables: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))
        return self._tables[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over the tables and adapter views the text names."""
        return self.sql_over(text)

    def sql_over(self, text: str, **rows: DataFrame) -> DataFrame:
        """The same, also over ``rows``, which the text names ``rows_<name>``."""
        full = with_views(text, VIEWS | PLANNED | {f"fx_{name}": f"SELECT * FROM rows_{name}" for name in self._kept})
        named = []
        for name, df in (self._kept | rows).items():
            if re.search(rf"\brows_{name}\b", full):
                named.append(f"rows_{uuid.uuid4().hex}")
                df.createOrReplaceTempView(named[-1])
                full = re.sub(rf"\brows_{name}\b", named[-1], full)
        for name in TABLES:
            if re.search(rf"\b{name}\b", full):
                self.table(name).createOrReplaceTempView(name)
        made = self.spark.sql(full)
        for view in named:
            self.spark.catalog.dropTempView(view)
        return made

    def keep(self, name: str) -> None:
        """Derive an adapter view once and write it; what names it from here on reads the table."""
        if name not in self._kept:
            self._kept[name] = written(self.fx(name))

    def fx(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM fx_{name}")


Plan = Callable[[World], DataFrame]
PLANS: dict[str, Plan] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under ``name`` with the SQL that must give the same rows."""
    def register(plan: Plan) -> Plan:
        if name in PLANS:
            raise ValueError(f"duplicate query {name}")
        PLANS[name] = plan
        if check is not None:
            CHECKS[name] = with_views(check)
        return plan

    return register
