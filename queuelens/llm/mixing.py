"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of equal bytes. Block k of a source with weight w is released at floor(k/w) and due at
ceil((k+1)/w), in exact fractions. Earliest deadline first among released blocks meets every deadline as the weights sum
to 1, so that in every prefix of a phase each source is less than one block from its share, however long the phase. The
driver lays the slots of all blocks, one number for each block; executors look them up. A phase ends when a source has no
blocks left; the next one renormalises the weights of the rest, so that no row is left out. Blocks grow with the input once
there are ``max_blocks`` of them, so that the plan is bounded: a block is then a millionth of all bytes.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import cut, small_table, table, utf8_size


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the weights' proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * scale) for s, x in exact.items()}


def edf_phase(left: dict[str, int], parts: dict[str, int]) -> list[str]:
    """Sources of a phase's slots, earliest deadline first among released blocks, until a source has no blocks left."""
    if len(left) == 1:
        return [s for s, n in left.items() for _ in range(n)]
    whole = sum(parts[s] for s in left)
    done, owners = dict.fromkeys(left, 0), []
    ready, later = [(-(-whole // parts[s]), s) for s in left], []
    heapq.heapify(ready)
    while True:
        t = len(owners)
        while later and later[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(later)[1:])
        deadline, s = heapq.heappop(ready)
        assert t < deadline
        owners.append(s)
        done[s] = k = done[s] + 1
        if k == left[s]:
            return owners
        heapq.heappush(later, (k * whole // parts[s], -(-(k + 1) * whole // parts[s]), s))


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> list[dict]:
    """Rows of at most ``period`` slots of a phase and a source: its first block there, how many, the row's first slot,
    the blocks' slots from there, and the source's weight in the phase as q / d (q is at least n)."""
    left, done, at, plan = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    parts = whole_weights({s: weights[s] for s in left}) if left else {}
    while left:
        owners, whole = edf_phase(left, parts), sum(parts[s] for s in left)
        for begin in range(0, len(owners), period):
            slots: dict[str, list[int]] = {}
            for i, s in enumerate(owners[begin : begin + period]):
                slots.setdefault(s, []).append(i)
            for s in sorted(slots):
                n = len(slots[s])
                plan.append({"src": s, "block0": done[s], "n": n, "slot0": at + begin, "q": parts[s] * n, "d": whole * n, "slots": slots[s]})
                done[s] += n
                left[s] -= n
        left = {s: n for s, n in left.items() if n}
        at += len(owners)
    return plan


def pfair_mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_bytes: int = 16384,
    period: int = 1024,
    max_blocks: int = 1 << 20,
    max_sources: int | None = None,
    cell_rows: int = 250_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """Places every row in the mixed stream: returns the input's columns (or those in ``carry``) under ``row``, a
    struct, and src, block, slot, in_block; the stream is the order by (slot, in_block).

    ``weights`` gives each source's target; sources that it lacks get weight by the square root of their bytes, as all
    do without it. A source's rows stand in the order of their id's hash. A row belongs to the block in which its
    first byte stands (bytes of the text plus 1), so a long row covers several slots and the slots of its later blocks
    may hold no row.

    Null sources are one source; null texts count as empty; repeated rows all stay, side by side; an empty table gives
    no rows. The driver holds the sources' totals and a number for each block, and the executors get these numbers: blocks
    hold ``block_bytes``, or as much more as leaves ``max_blocks`` of them (and one more a source at most). With
    ``max_sources``, more sources raise ValueError.
    """
    spark = docs.sparkSession
    src = F.when(F.col(source_col).isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col(source_col).cast("string")))
    rows = docs.select(
        src.alias("src"), F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("id"), (utf8_size(text_col) + 1).alias("size"), F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("row")
    )
    if text_col not in (carry or docs.columns):
        rows = cut(rows)  # sizes are known from here on; texts are read once
    sizes = rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    if max_sources is not None and len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    block_bytes = max(block_bytes, -(-sum(r.bytes for r in sizes) // max_blocks))
    given = {"null" if k is None else f"={k}": float(v) for k, v in (weights or {}).items()}
    target = {r.src: given.get(r.src, math.sqrt(r.bytes)) for r in sizes}
    if any(w <= 0 for w in target.values()):
        raise ValueError("weights must be positive")
    plan = phases({r.src: -(-r.bytes // block_bytes) for r in sizes}, target, period)
    # Running bytes within a source in two steps, so that no task holds a source: within cells of hash ranges, and over cells.
    bits = max(6, math.ceil(math.log2(max([1, *(r.n for r in sizes)]) / cell_rows + 1)))
    rows = rows.withColumn("cell", F.shiftrightunsigned("h", 64 - bits))
    cells = rows.groupBy("src", "cell").agg(F.sum("size").alias("bytes"))
    before = F.sum("bytes").over(W.partitionBy("src").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("src", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    in_cell = W.partitionBy("src", "cell").orderBy("h", "id", "size")
    running = F.coalesce(F.sum("size").over(in_cell.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("running", running).join(cells, ["src", "cell"])
    start = F.col("before") + F.col("running")
    rows = rows.select("src", "row", F.floor(start / block_bytes).cast("long").alias("block"), F.pmod(start, F.lit(block_bytes)).cast("int").alias("in_block"))
    # The plan's rows by source and run of blocks, so that each row of the data meets one of them.
    slots: dict[str, list[int]] = defaultdict(list)
    for p in plan:
        slots[p["src"]] += [p["slot0"] + x for x in p["slots"]]
    steps = [{"plan_src": s, "run": i // period, "slots": x[i : i + period]} for s, x in slots.items() for i in range(0, len(x), period)]
    steps = small_table(spark, steps, "plan_src string, run bigint, slots array<bigint>")
    placed = rows.join(F.broadcast(steps), (F.col("src") == F.col("plan_src")) & (F.floor(F.col("block") / period) == F.col("run")))
    slot = F.element_at("slots", (F.pmod("block", F.lit(period)) + 1).cast("int"))
    return placed.select("row", "src", "block", slot.alias("slot"), "in_block")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, block of the source, slot of the block in the stream, place of the row in the block (bytes)."""
    mixed = pfair_mix(table(spark, sf_dir, "documents"), carry=("doc_id", "source"))
    return mixed.select("row.doc_id", "row.source", "block", "slot", "in_block")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixed order: files and the rows in them follow the stream."""
    mixed = pfair_mix(docs)
    return mixed.repartitionByRange("slot").sortWithinPartitions("slot", "in_block").select("row.*")
