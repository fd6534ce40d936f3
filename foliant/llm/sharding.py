"""Shards by a hierarchical weighted hash tree (operator 6), DataFrame functions only.

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight``
with ``u`` hashed from the key and the child's name, and the smallest draw wins; a child is
chosen in proportion to its weight. A draw depends on nothing but the child itself, so a
changed weight moves keys only into or out of the subtree below it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import query, table
from foliant.operators.ranking import two_level_rank


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def tree(shards: int, base: int = 16, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """The leaves of a tree of ``shards`` equal shards.

    The first ``base`` shards fill racks and regions in turn. A shard beyond them opens a
    region of its own, so that nothing but the new leaf gains weight anywhere and one more
    shard takes rows only into itself.
    """
    per_region = per_rack * racks
    built = -(-base // per_region)
    return [Leaf(s // per_region, s // per_rack, s) if s < base else Leaf(built + s - base, 10**6 + s, s) for s in range(shards)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / F.lit(float(weight))


def _choose(key: Column, children: dict[str, tuple[float, int]]) -> Column:
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(number).alias("c")) for name, (weight, number) in children.items()]
    return draws[0]["c"] if len(draws) == 1 else F.array_min(F.array(*draws))["c"]


def assign(rows: DataFrame, leaves: Sequence[Leaf], key_col: str, out: str) -> DataFrame:
    """Add the int column ``out``: the shard that ``key_col`` descends to. Zero weights get nothing.

    The tree is configuration: its size doesn't depend on the rows. Equal keys share a
    shard; a null key is the key ``null``.
    """
    leaves = [leaf for leaf in leaves if leaf.weight > 0]
    key = F.coalesce(F.col(key_col).cast("string"), F.lit("null"))
    region_col, rack_col = f"__{out}_region", f"__{out}_rack"
    regions: dict[str, tuple[float, int]] = {}
    racks: dict[int, dict[str, tuple[float, int]]] = {}
    shards: dict[int, dict[str, tuple[float, int]]] = {}
    for leaf in leaves:
        name = f"region{leaf.region}"
        regions[name] = (regions.get(name, (0, 0))[0] + leaf.weight, leaf.region)
        level, name = racks.setdefault(leaf.region, {}), f"rack{leaf.rack}"
        level[name] = (level.get(name, (0, 0))[0] + leaf.weight, leaf.rack)
        shards.setdefault(leaf.rack, {})[f"shard{leaf.shard}"] = (leaf.weight, leaf.shard)

    def descend(parent: str, levels: dict[int, dict[str, tuple[float, int]]]) -> Column:
        steps = None
        for number, children in levels.items():
            here = F.col(parent) == number
            steps = F.when(here, _choose(key, children)) if steps is None else steps.when(here, _choose(key, children))
        return steps

    return rows.withColumn(region_col, _choose(key, regions)).withColumn(rack_col, descend(region_col, racks)).withColumn(
        out, descend(rack_col, shards).cast("int")).drop(region_col, rack_col)


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``docs``.

    The law is ``key``: id and shard count decide. ``size`` is the text's UTF-8 bytes plus
    one (null: one). ``slot`` numbers a shard's rows from 0 by (id block, checksum slice,
    id, checksum, size); rows equal in all of these are interchangeable. Slots come from
    ranks within small (shard, block) groups shifted by counts, so no task orders a shard.
    Rows with a null id share one shard. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = assign(assign(rows, tree(shards), "doc_id", "shard"), tree(shards + 1), "doc_id", "grown_shard")
    block = F.floor(F.coalesce("doc_id", F.lit(-1)) / F.lit(1 << 20)) * 64 + F.col("text_crc32") % 64
    ranked = two_level_rank(rows, ["shard"], block.cast("long"), ["doc_id", "text_crc32", "size"], out="slot", dtype="long")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("slot") - 1).alias("slot"), "grown_shard")


def _descent_sql(leaves: Sequence[Leaf], out: str) -> str:
    values = ", ".join(f"({x.region}, {x.rack}, {x.shard}, {x.weight})" for x in leaves)

    def draw(name: str) -> str:
        return f"-ln((('0x' || substr(md5(k || ':{name}' || {name}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / w"

    return f"""
{out}_leaf(region, rack, shard, weight) AS (VALUES {values}),
{out}_a AS (SELECT k, arg_min(region, {draw('region')}) AS region
  FROM keys, (SELECT region, sum(weight)::DOUBLE AS w FROM {out}_leaf GROUP BY ALL) GROUP BY k),
{out}_b AS (SELECT k, arg_min(rack, {draw('rack')}) AS rack
  FROM {out}_a JOIN (SELECT region, rack, sum(weight)::DOUBLE AS w FROM {out}_leaf GROUP BY ALL) USING (region) GROUP BY k),
{out} AS (SELECT k, arg_min(shard, {draw('shard')}) AS shard
  FROM {out}_b JOIN (SELECT rack, shard, weight::DOUBLE AS w FROM {out}_leaf) USING (rack) GROUP BY k)"""


# DuckDB has no crc32: the check folds the bytes of each text through the table of the polynomial.
CHECK = f"""
WITH keys AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
{_descent_sql(tree(16), 'now')},
{_descent_sql(tree(17), 'grown')},
bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)),
  lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
codes AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, 2 * strlen(text) + 1, 2), lambda i: ('0x' || substr(hex(encode(text)), i, 2))::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS crc FROM texts, bits),
placed AS (SELECT doc_id, (coalesce(strlen(d.text), 0) + 1)::BIGINT AS size, crc AS text_crc32,
    now.shard::INT AS shard, grown.shard::INT AS grown_shard
  FROM documents d JOIN codes c ON coalesce(d.text, '') = c.text
  JOIN now ON now.k = coalesce(doc_id::VARCHAR, 'null') JOIN grown ON grown.k = now.k)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
  ORDER BY floor(coalesce(doc_id, -1) / 1048576) * 64 + text_crc32 % 64, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM placed"""


@query("op6_sharding", CHECK)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
