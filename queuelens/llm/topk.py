"""Exact top-k by distributed histogram selection.

Queries go in chunks of a bounded size, which are broadcast; candidates stream past a chunk where they lie, so that no
vector is shuffled, only counts. Rounds of histograms over the integer scores narrow each query's k-th value until few
scores are left at or above its bin; a last round emits these, the smaller ids first among ties, and ranks them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import cut, forget, table

BINS = 256
#: Scores, and quantised components, beyond this count as this: what rounds of histograms over long numbers can hold.
LIMIT = 2**62 - 1
#: Most queries of a chunk, and bytes of their vectors; candidates scored at a time; scores that a task holds.
CHUNK, CHUNK_BYTES, STEP, HELD = 2048, 16 << 20, 1024, 1_000_000
#: Scores a query on average, in units of k, that are emitted without another round.
FEW = 16


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): floor(scale * x) of each component; rows with a null id, or a null vector or component, or one that is
    not finite, are left out. Of repeated ids one row stays, that with the smallest vector."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * c.cast("double")))).cast("long"))
    ints = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    return ints.groupBy("id").agg(F.min("v").alias("v"))


@dataclass
class Chunk:
    """Queries of a chunk: ids, vectors, the lowest score that can be the k-th, the bins' width and how many are needed."""

    ids: np.ndarray
    vectors: np.ndarray
    lo: np.ndarray
    width: int
    need: np.ndarray
    kind: type


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Vectors as rows, shorter ones padded with zeros."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(size) and (size == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < size[:, None]] = flat
    return out


def _scored(batches: Iterator[pa.RecordBatch], chunk: Chunk) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some candidates, their scores with every query of the chunk, exact, and which pairs count."""
    width = chunk.vectors.shape[1]
    for batch in batches:
        for at in range(0, len(batch), STEP):
            part = batch.slice(at, STEP)
            ids = part.column(0).to_numpy()
            c = _matrix(part.column(1), max(width, int(np.diff(part.column(1).offsets.to_numpy()).max(initial=0))), chunk.kind)
            s = np.clip(chunk.vectors.astype(chunk.kind) @ c[:, :width].T, -LIMIT, LIMIT).astype(np.int64)
            yield ids, s, chunk.ids[:, None] != ids[None, :]


def _histograms(sent: Broadcast):
    """Counts of scores by bin of each query's open range. Bins below a task's own k-th score hold no k-th score of all,
    and are not sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk = sent.value
        n = len(chunk.ids)
        total = np.zeros((n, BINS), np.int64)
        base = (np.arange(n) * BINS)[:, None]
        for _, s, other in _scored(batches, chunk):
            bins = (s - chunk.lo[:, None]) // chunk.width
            ok = other & (bins >= 0) & (bins < BINS)
            total += np.bincount((base + bins)[ok], minlength=n * BINS).reshape(n, BINS)
        above = total[:, ::-1].cumsum(axis=1)[:, ::-1] - total
        q, b = np.nonzero((total > 0) & (above < chunk.need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[q]), pa.array(b.astype(np.int64)), pa.array(total[q, b])], names=["id", "bin", "n"])

    return run


def _best(q: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each query's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -s, q))
    q, ids, s = q[order], ids[order], s[order]
    first = np.searchsorted(q, q)
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], s[keep]


def _emitted(sent: Broadcast, k: int):
    """Scores at or above each query's bound; of a task's, the best k of a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: Chunk = sent.value
        held = [np.empty(0, np.int64)] * 3
        new, size = [], 0
        for ids, s, other in _scored(batches, chunk):
            q, c = np.nonzero(other & (s >= chunk.lo[:, None]))
            new.append((q, ids[c], s[q, c]))
            size += len(q)
            if size > HELD:
                held = _best(*(np.concatenate([h, *x]) for h, x in zip(held, zip(*new, strict=True), strict=True)), k)
                new, size = [], 0
        if new:
            held = _best(*(np.concatenate([h, *x]) for h, x in zip(held, zip(*new, strict=True), strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(chunk.ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query_id", "vec_id", "score"])

    return run


def _chunk(rows: list, bound: int, most: int, n: int, k: int, present: set[int]) -> Chunk:
    ids = np.array([r.id for r in rows], np.int64)
    width = max([1, *(len(r.v) for r in rows)])
    vectors = np.zeros((len(rows), width), object if most >= LIMIT else np.int64)
    for i, r in enumerate(rows):
        vectors[i, : len(r.v)] = r.v
    reach = most * most * width
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64 if reach < 2**63 else object
    step = 1
    while step * BINS < 2 * bound + 1:
        step *= BINS
    need = np.array([min(k, n - (int(i) in present)) for i in ids], np.int64)  # a row isn't its own candidate
    keep = need > 0
    return Chunk(ids[keep], vectors[keep], np.full(int(keep.sum()), -bound, np.int64), step, need[keep], kind)


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products of the quantised vectors against
    all rows but its own, ties to the smaller id; all of them where there are fewer than k.

    Vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with
    zeros; a repeated id counts once, with its smallest vector; empty tables give no rows. Other columns are not read.
    Scores are exact up to LIMIT; finite components and scores beyond it count as LIMIT, so that they tie.

    A chunk has at most about ``chunk`` queries and CHUNK_BYTES of vectors, whatever the input; the driver holds one at a
    time. Candidates are read where they lie, a few times for each chunk.
    """
    spark = vectors.sparkSession
    every = cut(quantised(vectors, scale, id_col, vector_col))
    asked = quantised(queries, scale, id_col, vector_col)
    asked = cut(asked.join(every.select("id", F.lit(True).alias("own")), "id", "left"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    facts = [df.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm"), largest.alias("most"), F.max(F.size("v")).alias("size")).first() for df in (every, asked)]
    n, bound = facts[0].n, min(LIMIT, int(max(f.norm or 0.0 for f in facts) * (1 + 1e-9)) + 1)
    most, size = min(LIMIT, int(max(f.most or 0.0 for f in facts)) + 1), max(1, *(f.size or 0 for f in facts))
    chunks = max(1, -(-facts[1].n // max(1, min(chunk, CHUNK_BYTES // (8 * size)))))
    dealt = asked.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
    found = []
    for number in range(chunks):
        rows = dealt.where(F.col("chunk") == number).select("id", "v", "own").collect()
        now = _chunk(rows, bound, most, n, k, {r.id for r in rows if r.own})
        if not len(now.ids):
            continue
        while True:
            sent = spark.sparkContext.broadcast(now)
            counts = every.mapInArrow(_histograms(sent), "id long, bin long, n long").groupBy("id", "bin").agg(F.sum("n").alias("n"))
            at = counts.withColumn("above", F.sum("n").over(W.partitionBy("id").orderBy(F.desc("bin"))) - F.col("n"))
            need = spark.createDataFrame(list(zip(now.ids.tolist(), now.need.tolist(), strict=True)), "id long, need long")
            kth = at.join(F.broadcast(need), "id").where((F.col("above") < F.col("need")) & (F.col("above") + F.col("n") >= F.col("need"))).select("id", "bin", "n", "above").collect()
            by = {r.id: r for r in kth}
            bins, inside, above = (np.array([getattr(by[i], c) for i in now.ids.tolist()], np.int64) for c in ("bin", "n", "above"))
            now.lo, now.need = now.lo + bins * now.width, now.need - above
            sent.unpersist()
            if now.width == 1 or int((inside + above).sum()) <= FEW * k * len(now.ids):
                break
            now.width = max(1, now.width // BINS)
        found.append(cut(every.mapInArrow(_emitted(spark.sparkContext.broadcast(now), k), "query_id long, vec_id long, score long")))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    forget(asked)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


SQL = """
with v as (
  select vec_id as id, min(list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint))) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
  group by vec_id),
s as (
  select q.id as query_id, c.id as vec_id, cast(list_dot_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
  from v q join v c on q.id % 20 = 0 and q.id <> c.id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""
