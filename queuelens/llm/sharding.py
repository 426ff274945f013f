"""Sharding by histogram sort: exact byte counts below candidate key boundaries, refined until the splitters meet
the tolerance, then one exchange.

Only DataFrame functions run on executors. The driver sees histograms whose length is bounded by the cell parameters,
never rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import cut, small_table, table, text_or_empty, utf8_size

#: A key has 63 bits: 39 of the text's hash, then 24 of the id's hash. Equal texts are neighbours, and one large group
#: of equal texts can still be cut inside.
KEY_BITS, TEXT_BITS = 63, 39
#: Bits of the key's prefix at each round of refinement: a cell opens into 16 or 32, so few are opened too far.
LEVELS = (12, 16, 20, 24, 29, 34, 39, 44, 49, 54, 59, 63)
#: A range of keys holds at most this many rows, or this part of all rows where that is more, which bounds the plan.
RANGE_ROWS, RANGE_SHARE = 1_000_000, 16_384


def sort_key(text: Column, doc_id: Column) -> Column:
    high = F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS)
    low = F.shiftrightunsigned(F.xxhash64(doc_id), 64 - (KEY_BITS - TEXT_BITS))
    return F.shiftleft(high, KEY_BITS - TEXT_BITS).bitwiseOR(low)


def _histogram(keys: DataFrame, level: int, opened: list[int] | None) -> list[tuple[int, int, int]]:
    """(prefix, rows, bytes) at LEVELS[level], for all keys or below the opened prefixes of the level before."""
    if opened is not None:
        above = small_table(keys.sparkSession, [{"p": p} for p in opened], "p bigint")
        keys = keys.join(F.broadcast(above), F.shiftright("key", KEY_BITS - LEVELS[level - 1]) == F.col("p"))
    prefix = F.shiftright("key", KEY_BITS - LEVELS[level]).alias("prefix")
    rows = keys.groupBy(prefix).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b")).collect()
    return [(r.prefix, r.n, r.b) for r in rows]


def leaves(keys: DataFrame, shards: int, tolerance: float, cell_rows: int | None) -> list[dict]:
    """Key ranges that are refined until each holds at most cell_rows rows and each shard's target byte count lies
    within tolerance (a part of a shard) of a range's edge, or the key has no bits left."""
    cells = {(0, p): (n, b) for p, n, b in _histogram(keys, 0, None)}
    rows, total = sum(n for n, _ in cells.values()), sum(b for _, b in cells.values())
    most = cell_rows or max(64, min(RANGE_ROWS, rows // 1024), rows // RANGE_SHARE)
    slack = tolerance * total / shards
    order = lambda at: at[1] << (KEY_BITS - LEVELS[at[0]])
    for level in range(len(LEVELS)):
        opened, below = [], 0
        for at in sorted(cells, key=order):
            n, b = cells[at]
            target = ((below + b) * shards // total) * total / shards if total else 0  # the last target up to its end
            far = below < target < below + b and min(target - below, below + b - target) > slack
            if at[0] == level and (n > most or far and n > 1) and level + 1 < len(LEVELS):
                opened.append(at[1])
            below += b
        if not opened:
            if level + 1 < len(LEVELS) and any(at[0] > level for at in cells):
                continue
            break
        for p in opened:
            del cells[level, p]
        cells |= {(level + 1, p): (n, b) for p, n, b in _histogram(keys, level + 1, opened)}
    found, below, edges = [], 0, [0]
    for at in sorted(cells, key=order):
        below += cells[at][1]
        edges.append(below)
    cuts = []
    for i in range(1, shards):
        want = total * i / shards
        k = bisect_right(edges, want)
        k = k if k < len(edges) and edges[k] - want < want - edges[k - 1] else k - 1
        cuts.append(max(k, cuts[-1] if cuts else 0))
    first = [0] * shards
    for i, at in enumerate(sorted(cells, key=order)):
        shard = bisect_right(cuts, i)
        found.append({"level": at[0], "prefix": at[1], "leaf": i, "shard": shard, "first": first[shard]})
        first[shard] += cells[at][0]
    return found


def histogram_sort_shards(
    docs: DataFrame,
    shards: int = 16,
    tolerance: float = 0.001,
    cell_rows: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Deals rows to shards of nearly equal bytes (UTF-8 bytes of the text plus 1), in key order, each row with its
    slot in its shard.

    Equal texts share a key prefix and so a shard, but for a group that is itself larger than the tolerance allows:
    that one is cut. Splitters stand at the row edge nearest to each target.

    Null text counts as empty; a null id is an id like others; repeated rows get slots of their own; an empty table
    gives no rows. Of the input's columns only the id, the text and ``carry`` are read, so others may have any name.
    Returns id, size, text_crc32, the carried columns, shard, slot.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    keys = docs.select(
        F.col(id_col).alias("_id"),
        utf8_size(text_col).__add__(F.lit(1)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        sort_key(text, F.col(id_col)).alias("key"),
        F.struct(*[F.col(c) for c in carry]).alias("_carry") if carry else F.lit(0).alias("_carry"),
    )
    keys = cut(keys)
    plan = leaves(keys, shards, tolerance, cell_rows)
    dealt = keys
    levels = sorted({x["level"] for x in plan}) or [0]
    for level in levels:
        part = [{"p": x["prefix"], f"leaf{level}": x["leaf"], f"shard{level}": x["shard"], f"first{level}": x["first"]} for x in plan if x["level"] == level]
        small = small_table(spark, part, f"p bigint, leaf{level} int, shard{level} int, first{level} bigint")
        dealt = dealt.join(F.broadcast(small), F.shiftright("key", KEY_BITS - LEVELS[level]) == F.col("p"), "left").drop("p")
    pick = lambda name: F.coalesce(*[F.col(f"{name}{level}") for level in levels])
    dealt = dealt.select("_id", "size", "text_crc32", "key", "_carry", pick("leaf").alias("leaf"), pick("shard").alias("shard"), pick("first").alias("first"))
    in_leaf = W.partitionBy("leaf").orderBy("key", "_id", "text_crc32", "size")
    out = dealt.withColumn("slot", F.col("first") + F.row_number().over(in_leaf).cast("long") - 1)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", *[F.col(f"_carry.{c}").alias(c) for c in carry], "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
