"""Near-duplicate vectors by a neighbour graph that is refined by descent.

The graph starts from random hyperplanes: for each of several tables, vectors lie in the order of their sign codes, and each
is compared with its surroundings in blocks of exact matrix products; its best neighbours within reach make its list. Joins
with neighbours of neighbours refine it. Lists that are full of links are enlarged by further tables in which only vectors
of other components count, since links inside a component are counted below without lists. Threshold edges make components.
Inside one, vectors within half the threshold's angle of its centre all link with each other; only the others are compared,
tile by tile. An audit against all rows measures recall, and tables are added until it is high enough.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import cut, forget, join_spread, small_table, table
from queuelens.llm.components import connected_components
from queuelens.llm.records import groups

#: Bits of a code; rows of a block, which is compared with itself and the one before; entries of a list.
BITS, BLOCK, LIST = 40, 256, 8
#: Vectors of a component, or of a part of one, that are compared at once.
TILE = 512
#: Similarity for which the number of tables is chosen, and the share of such pairs that may share no block.
DESIGN, MISSED = 0.97, 0.001
#: Vectors of the audit, recall that it asks for, and tables that it may add.
SAMPLE, RECALL, MORE = 1024, 0.98, 12
#: Tables that lie on disk at a time.
TABLES = 2


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of all rows; v is null where a vector can't link: null, zero, or with null or non-finite components."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine & F.col(id_col).isNotNull(), x).alias("v"))


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of length one in double precision, shorter ones padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < size[:, None]] = flat
    out /= np.abs(out).max(axis=1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _totals(width: int):
    """The sum of a task's unit vectors, by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            total += _units(batch.column(0), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["at", "x"])

    return run


def _placed(sent: Broadcast):
    """Each vector once for each table, with its code there: the signs of its distances from hyperplanes through the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, planes = sent.value
        for batch in batches:
            u = _units(batch.column("v"), len(mean)) - mean
            for number, normal in planes:
                code = ((u @ normal) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                columns = [pa.array(np.full(len(batch), number, np.int32)), pa.array(code), *(batch.column(c) for c in ("node", "component", "v"))]
                yield pa.RecordBatch.from_arrays(columns, names=["number", "code", "node", "component", "v"])

    return run


def _lists(width: int, most: int, reach: float):
    """The best neighbours of each vector of other components among the rows around it."""

    def best(blocks: list[tuple]) -> pa.RecordBatch:
        number, node, component, u = (np.concatenate(c) for c in zip(*blocks, strict=True))
        s = u @ u.T
        s[(component[:, None] == component[None, :]) | (number[:, None] != number[None, :])] = -2
        k = min(most, len(s) - 1)
        some = np.flatnonzero(s.max(axis=1) >= reach)
        at = np.argpartition(-s[some], k - 1, axis=1)[:, :k] if len(some) else np.empty((0, 1), np.int64)
        near = np.take_along_axis(s[some], at, axis=1)
        r, c = np.nonzero(near >= reach)
        return pa.RecordBatch.from_arrays([pa.array(node[some][r]), pa.array(node[at[r, c]]), pa.array(near[r, c])], names=["a", "b", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[tuple] = []
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                held.append((*(part.column(c).to_numpy() for c in ("number", "node", "component")), _units(part.column("v"), width)))
                size += len(part)
                if size >= BLOCK:
                    yield best(before + held)
                    before, held, size = held, [], 0
        if size and sum(len(x[0]) for x in before + held) > 1:
            yield best(before + held)

    return run


class _Graph:
    """Vectors, their mean and the edges found so far."""

    def __init__(self, nodes: DataFrame, width: int, n: int, threshold: float, reach: float, seed: int):
        self.nodes, self.width, self.n, self.threshold, self.reach, self.seed = nodes, width, n, threshold, reach, seed
        rows = nodes.select("v").mapInArrow(_totals(width), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # a number a component
        self.mean = np.zeros(width)
        for r in rows:
            self.mean[r.at] = r.x / n
        self.edges: list[DataFrame] = []
        self.labels: DataFrame | None = None
        self.tables = 0

    def all_edges(self) -> DataFrame:
        out = self.edges[0]
        for more in self.edges[1:]:
            out = out.unionByName(more)
        return out

    def add_tables(self, count: int) -> bool:
        """Adds the lists of more tables, TABLES at a time; whether they hold links."""
        new, spark = [], self.nodes.sparkSession
        nodes = self.nodes.withColumn("component", F.col("node"))
        if self.labels is not None:
            nodes = self.nodes.join(self.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        for at in range(0, count, TABLES):
            planes = [(t, np.random.default_rng(self.seed + t).standard_normal((self.width, BITS))) for t in range(self.tables, self.tables + min(TABLES, count - at))]
            sent = spark.sparkContext.broadcast((self.mean, planes))
            kind = self.nodes.schema["v"].dataType.simpleString()
            placed = nodes.select("node", "component", "v").mapInArrow(_placed(sent), f"number int, code long, node long, component long, v {kind}")
            keys = ["number", "code", "node"]
            near = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_lists(self.width, LIST, self.reach), "a long, b long, similarity double")
            new.append(cut(near.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))))
            self.tables += len(planes)
        self.edges += new
        return any(not e.where(F.col("similarity") >= self.threshold).isEmpty() for e in new)

    def link(self) -> None:
        """Components of the links found so far."""
        old, self.labels = self.labels, cut(connected_components(self.all_edges().where(F.col("similarity") >= self.threshold).select("a", "b")).withColumnRenamed("id", "node"))
        if old is not None:
            forget(old)

    def _across(self, edges: DataFrame) -> DataFrame:
        """Edges both ways, between components, with these."""
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        for end in ("a", "b"):
            both = both.join(self.labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")), end, "left")
        both = both.withColumns({f"{end}_in": F.coalesce(f"{end}_in", end) for end in ("a", "b")})
        return both

    def descend(self) -> None:
        """Joins with neighbours of neighbours until they link no more components. Within a component nothing is to be found
        by lists, so a path a - b - c counts if a and c are in two; then so are the ends of one of its edges. Each round
        follows the edges of the last."""
        fresh = self.all_edges()
        while True:
            first = self._across(fresh).where("a_in <> b_in")
            if first.isEmpty():
                return
            second = self._across(self.all_edges()).select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("b_in").alias("c_in"))
            pairs = first.join(second, "b").where("a_in <> c_in").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
            known = self.all_edges().select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            pairs = pairs.join(known, ["a", "b"], "left_anti")
            for end in ("a", "b"):
                pairs = pairs.join(self.nodes.select(F.col("node").alias(end), F.col("v").alias(f"{end}_v")), end)
            new = cut(pairs.select("a", "b", "a_v", "b_v").mapInArrow(_compared(self.width), "a long, b long, similarity double").where(F.col("similarity") >= self.reach))
            self.edges.append(new)
            if new.where(F.col("similarity") >= self.threshold).isEmpty():
                return
            self.link()
            fresh = new

    def saturated(self) -> bool:
        """Whether a list is full of links to its own component."""
        best = F.row_number().over(W.partitionBy("a").orderBy(F.desc("similarity"), "b"))
        lists = self.all_edges().groupBy("a", "b").agg(F.max("similarity").alias("similarity")).withColumn("nth", best).where(f"nth = {LIST}")
        return not lists.where(F.col("similarity") >= self.threshold).isEmpty()


def _compared(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = (_units(batch.column(2), width) * _units(batch.column(3), width)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["a", "b", "similarity"])

    return run


def _block_counts(width: int, threshold: float):
    """How many vectors of its group each vector links with: of all in one group, or of the other side where there are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            node, side = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int8)
            vectors = pa.array([r[2] for r in rows], pa.list_(pa.float64()))
            near = _units(vectors, width)
            near = near @ near.T >= threshold
            np.fill_diagonal(near, False)
            if (side != side[0]).any():
                near &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(near.sum(axis=1))], names=["node", "n"])

    return run


def _centre_sums(width: int):
    """Sums of unit vectors by component and position, of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            total = np.zeros((len(ids), width))
            np.add.at(total, at, _units(batch.column(1), width))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, width)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(ids))), pa.array(total.ravel())], names=["component", "at", "x"])

    return run


def _cores(width: int, half: float):
    """Whether each vector lies within half the threshold's angle of its component's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre = np.array([c if any(c) else [1.0, *c[1:]] for c in batch.column(3).to_pylist()], float).reshape(len(batch), width)
            s = (_units(batch.column(2), width) * centre).sum(axis=1) / np.linalg.norm(centre, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.arccos(np.clip(s, -1, 1)) < half)], names=["component", "node", "v", "core"])

    return run


def link_counts(members: DataFrame, width: int, threshold: float) -> DataFrame:
    """(node, n): links of each vector inside its component, exact; members (component, node, v, size)."""
    kind = members.schema["v"].dataType.simpleString()
    alone = members.where("size = 2").select("node", F.lit(1).cast("long").alias("n"))
    few = members.where(f"size > 2 and size <= {TILE}").select("component", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", F.lit(0).alias("side"), "v")
    large = members.where(f"size > {TILE}")
    parts = [alone]
    if not large.isEmpty():
        sums = large.select("component", "v").mapInArrow(_centre_sums(width), "component long, at int, x double").groupBy("component", "at").agg(F.sum("x").alias("x"))
        centres = sums.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("centre"))  # width numbers
        sizes = large.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        centred = join_spread(large.select("component", "node", "v"), cut(centres.join(sizes, "component")), ["component"], "size")
        cores = cut(centred.select("component", "node", "v", "centre").mapInArrow(_cores(width, math.acos(threshold) / 2 - 1e-7), f"component long, node long, v {kind}, core boolean"))
        split = cut(cores.groupBy("component").agg(F.count_if("core").alias("inner"), F.count_if(~F.col("core")).alias("outer"), F.count(F.lit(1)).alias("size")))
        known = join_spread(cores, split, ["component"], "size")
        parts.append(known.where("core").select("node", (F.col("inner") - 1).alias("n")))
        tiles = {s: F.greatest(F.lit(1), F.ceil(F.col(s) / TILE)).cast("int") for s in ("inner", "outer")}
        mine = F.pmod(F.xxhash64("node"), F.when(F.col("core"), tiles["inner"]).otherwise(tiles["outer"])).cast("int")
        met = known.where("outer > 0").withColumns({"mine": mine, "inner_tiles": tiles["inner"], "outer_tiles": tiles["outer"]})
        # (i, j): outer tiles i <= j with each other, or, with j under 0, the outer tile i with the inner tile -1 - j
        outer = met.where("not core").withColumn("other", F.explode(F.expr("sequence(0, outer_tiles - 1)")))
        parts.append(_counted(outer.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", (F.col("mine") > F.col("other")).cast("int").alias("side"), "v"), width, threshold))
        shells = met.where("not core and inner > 0").withColumn("other", F.explode(F.expr("sequence(0, inner_tiles - 1)"))).select("component", F.col("mine").alias("i"), (-1 - F.col("other")).alias("j"), "node", F.lit(0).alias("side"), "v")
        inner = met.where("core").withColumn("other", F.explode(F.expr("sequence(0, outer_tiles - 1)"))).select("component", F.col("other").alias("i"), (-1 - F.col("mine")).alias("j"), "node", F.lit(1).alias("side"), "v")
        parts.append(_counted(shells.unionByName(inner), width, threshold))
    parts.append(_counted(few, width, threshold))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.groupBy("node").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    keys = ["component", "i", "j"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_block_counts(width, threshold), "node long, n long")


def _true_counts(sent: Broadcast, width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, units = sent.value
        total = np.zeros(len(nodes), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                near = units @ _units(part.column(1), width).T >= threshold
                total += (near & (nodes[:, None] != part.column(0).to_numpy()[None, :])).sum(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total)], names=["node", "n"])

    return run


def _recall(nodes: DataFrame, counts: DataFrame, width: int, threshold: float) -> float:
    """Links found over links there are, of SAMPLE vectors by the hash of their numbers, against all rows."""
    spark = nodes.sparkSession
    rows = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).collect()
    units = _units(pa.array([r.v for r in rows], pa.list_(pa.float64())), width)
    sent = spark.sparkContext.broadcast((np.array([r.node for r in rows], np.int64), units))
    true = nodes.select("node", "v").mapInArrow(_true_counts(sent, width, threshold), "node long, n long").groupBy("node").agg(F.sum("n").alias("true"))
    r = F.broadcast(true).join(counts, "node", "left").agg(F.sum("true").alias("true"), F.sum(F.least("true", F.coalesce("n", F.lit(0)))).alias("found")).first()
    return r.found / r.true if r.true else 1.0


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0, recall: float = RECALL) -> tuple[DataFrame, float]:
    """(id, n_links, component_id) of every row, and the recall of links that the audit measured.

    Vectors that are null, zero or hold null or non-finite components, and rows without an id, link with nothing and are
    components of their own. Vectors of different lengths count as padded with zeros. Each row is a vector of its own,
    also where ids or vectors repeat; ids of components are the smallest in reach. An empty table gives no rows.

    Links are never below the threshold. Those between vectors of one component are complete; one between two components
    is missed only if no table put its ends, or neighbours that lead from one to the other, into one block. The number
    of tables grows with the logarithm of the number of rows; the audit adds more, up to MORE, until it finds a share of
    ``recall``, and warns if it doesn't. Components that are wider than the threshold's angle cost the product of their
    outer and all their vectors, in tiles.
    """
    spark = vectors.sparkSession
    every = cut(usable(vectors, id_col, vector_col).withColumn("node", F.monotonically_increasing_id()))
    nodes = cut(every.where(F.col("v").isNotNull()).select("node", "id", "v").repartition(F.xxhash64("node")))
    facts = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not facts.n:
        return every.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")), 1.0
    graph = _Graph(nodes.select("node", "v"), facts.width, facts.n, threshold, math.cos(min(math.pi, 2 * math.acos(threshold))), seed)
    together = (1 - math.acos(DESIGN) / math.pi) ** max(1.0, math.log2(max(2.0, facts.n / (2 * BLOCK))))
    graph.add_tables(max(2, math.ceil(math.log(MISSED) / math.log(1 - min(together, 0.999)))))
    graph.link()
    graph.descend()
    if graph.saturated():
        while graph.add_tables(TABLES):  # enlarged lists
            graph.link()
            graph.descend()
    added = 0
    while True:
        members = graph.labels.join(nodes, "node")
        info = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("component_id"))
        members = cut(join_spread(members, cut(info), ["component"], "size"))
        counts = cut(link_counts(members.select("component", "node", "v", "size"), facts.width, threshold))
        found = _recall(nodes, counts, facts.width, threshold)
        if found >= recall or added >= MORE:
            break
        added += TABLES
        graph.add_tables(TABLES)
        graph.link()
        graph.descend()
    if found < recall:
        warnings.warn(f"near_vectors: the audit found {found:.3f} of the links", stacklevel=2)
    linked = members.select("node", "component_id").join(counts, "node")
    out = every.select("node", "id").join(linked, "node", "left")
    return out.select("id", F.coalesce("n", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``embeddings``; see near_vectors()."""
    out, _ = near_vectors(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept.alias("kept"))


SQL = """
with recursive v as (
  select row_number() over () as node, vec_id, cast(embedding as double[]) as x,
    embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0 as ok
  from embeddings),
links as (select a.node as a, b.node as b, b.vec_id as low from v a join v b on a.node <> b.node and a.ok and b.ok and list_cosine_similarity(a.x, b.x) >= 0.95),
reach as (
  select node, vec_id as low from v
  union
  select l.a, r.low from reach r join links l on l.b = r.node)
select vec_id, cast((select count(*) from links l where l.a = v.node) as bigint) as n_links,
  (select min(low) from reach r where r.node = v.node) as component_id,
  (select min(low) from reach r where r.node = v.node) = vec_id as kept
from v
"""
