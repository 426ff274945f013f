"""Vector codes: product quantisation with integer codebooks.

Components become integers and vectors are cut into equal parts. The codebooks of all parts, whose size does not depend on
the rows, are broadcast; Arrow batches find each part's nearest entry by |x|^2 - 2 x.c + |c|^2 with exact integer matrix
products; each task adds up its parts by entry, a grouped shuffle merges these sums, and entries become floored means.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import cut, join_spread, table
from queuelens.llm.topk import LIMIT, _matrix

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors compared at a time.
STEP = 2048
LONG_MAX = 2**63 - 1


def _as_long(total: Column) -> Column:
    """A decimal as a long; LONG_MAX if it is larger."""
    return F.least(total, F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): floor(scale * x) of each component of the rows that can be coded. label is null or a text."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    v = F.transform(x, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * c.cast("double")))).cast("long"))
    return vectors.where(x.isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry to each row, the lower of equals, and the squared distance."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, d[np.arange(len(x)), at]


def _cuts(batches: Iterator[pa.RecordBatch], column: int, books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of at most STEP rows, and their vectors as (rows, parts, components), padded with zeros."""
    parts, _, size = books.shape
    for batch in batches:
        for at in range(0, len(batch), STEP):
            part = batch.slice(at, STEP)
            yield part, _matrix(part.column(column), parts * size, books.dtype.type).reshape(len(part), parts, size)


def _sums(sent: Broadcast):
    """A task's sums of components by part, entry and position, and its counts at position -1, as decimal numerals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: np.ndarray = sent.value
        total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
        for _, x in _cuts(batches, 0, books):
            for p, book in enumerate(books):
                at, _ = nearest(x[:, p], book)
                np.add.at(total[p], at, x[:, p])
                count[p] += np.bincount(at, minlength=len(book))
        p, e = np.nonzero(count)
        both = np.concatenate([count[p, e].astype(books.dtype)[:, None], total[p, e]], axis=1)
        width = both.shape[1]
        keys = [np.repeat(p, width).astype(np.int32), np.repeat(e, width).astype(np.int32), np.tile(np.arange(-1, width - 1, dtype=np.int32), len(p))]
        yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array([str(t) for t in both.ravel().tolist()], pa.string())], names=["part", "entry", "at", "total"])

    return run


def _coded(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: np.ndarray = sent.value
        for part, x in _cuts(batches, 2, books):
            found = [nearest(x[:, p], book) for p, book in enumerate(books)]
            codes = np.stack([at for at, _ in found], axis=1).astype(np.int32)
            error = [min(int(e), LONG_MAX) for e in sum(d.astype(object) for _, d in found)]
            lists = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * len(books), codes.ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(error, pa.int64())], names=["id", "label", "codes", "error"])

    return run


def compress(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, codes, error) of every row of ``ints`` (id, label, v), and the codebooks (part, entry, position).

    Codebooks start as the parts of the first ``entries`` rows by id, then by vector, null ids last (of all rows, if they
    are fewer). Each round assigns every part to its nearest entry, ties to the lower index, and replaces entries by
    floored means; unused entries stay; a last pass gives the codes and the squared distances, summed over parts.
    Vectors shorter than the longest one, or whose length is no multiple of ``parts``, count as padded with zeros. All
    numbers are exact; sums of distances over LONG_MAX count as that. No rows give no rows and no codebooks.

    The driver and each task hold entries * length numbers, whatever the rows; ``ints`` is read once a round.
    """
    spark = ints.sparkSession
    reach = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    facts = ints.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("size"), reach.alias("most")).first()
    size = -(-(facts.size or 0) // parts)
    # products and a task's sums stay in 64 bits, or are Python's integers
    kind = np.int64 if (2 * (facts.most or 0) + 2) ** 2 * max(1, size) < 2**62 and (facts.most or 0) * max(1, facts.n) < 2**62 else object
    first = ints.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.zeros((parts, len(first), size), kind)
    for e, row in enumerate(first):
        books[:, e] = np.array([*row.v, *[0] * (parts * size - len(row.v))], kind).reshape(parts, size)
    schema = "id long, label string, codes array<int>, error long"
    if not first:
        return spark.createDataFrame([], schema), books
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        merged = ints.select("v").mapInArrow(_sums(sent), "part int, entry int, at int, total string").groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r.part, r.entry, r.at): int(r.total) for r in merged.collect()}  # as many as the codebooks have numbers
        sent.unpersist()
        books = books.copy()
        for (p, e, at), total in found.items():
            if at >= 0:
                books[p, e, at] = total // found[p, e, -1]
    return ints.select("id", "label", "v").mapInArrow(_coded(spark.sparkContext.broadcast(books)), schema), books


def decoded(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """codes with column ``vector``: the middle of the cell of each coded component."""
    entries = F.from_json(F.lit(json.dumps(((books.astype(float) + 0.5) / scale).tolist())), "array<array<array<double>>>")
    lookup = codes.sparkSession.range(1).select(entries.alias("entries"))  # one row
    return codes.crossJoin(F.broadcast(lookup)).withColumn("vector", F.flatten(F.transform("codes", lambda e, p: F.col("entries")[p][e]))).drop("entries")


def books_hash(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded.

    Null vectors, null and non-finite components: no row. Empty vectors count as zeros. Repeated rows and ids: a row each.
    Null ids keep their rows. Components of over 2^62 after scaling count as 2^62 - 1, sums over LONG_MAX as that. Equal
    labels may hold any share of the rows: their sums are joined back by join_spread. Other columns are not read.
    """
    ints = cut(integer_vectors(table(spark, sf_dir, "embeddings"), SCALE, "vec_id", "embedding", "label"))
    codes, books = compress(ints)
    coded = cut(codes.withColumn("of", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))))
    sums = coded.groupBy("of").agg(F.count(F.lit(1)).alias("rows"), _as_long(F.sum(F.col("error").cast("decimal(38,0)"))).alias("label_error"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return join_spread(coded, cut(sums), ["of"], "rows").select(F.col("id").alias("vec_id"), code.alias("code"), "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def _sql() -> str:
    """Distances of every part to every entry, for each assignment."""
    with_near = """
near{r} as (
  select id, part, entry, d from (
    select p.id, p.part, b.entry, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d,
      row_number() over (partition by p.id, p.part order by d, b.entry) as nth
    from parts p join book{r} b using (part)) where nth = 1)"""
    with_book = """
mean{r} as (
  select part, entry, list(m order by pos) as x from (
    select n.part, n.entry, pos, cast(floor(sum(cast(p.x[pos] as hugeint)) / count(*)) as bigint) as m
    from near{q} n join parts p using (id, part), (select unnest(range(1, cast(size + 1 as bigint))) as pos from shape) group by all) group by all),
book{r} as (select b.part, b.entry, coalesce(m.x, b.x) as x from book{q} b left join mean{r} m using (part, entry))"""
    steps = [with_near.format(r=0)]
    for r in range(1, ROUNDS + 1):
        steps += [with_book.format(r=r, q=r - 1), with_near.format(r=r)]
    return f"""
with kept as (
  select vec_id as id, label, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
shape as (select max(len(v)) // {PARTS} as size from kept),
parts as (
  select id, part, v[part * size + 1 : (part + 1) * size] as x
  from kept, shape, (select unnest(range(0, {PARTS})) as part)),
book0 as (
  select part, entry, x from parts join (select id, row_number() over (order by id) - 1 as entry from kept qualify entry < {ENTRIES}) using (id)),
{",".join(steps)},
coded as (
  select id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) as code, cast(sum(d) as bigint) as error
  from near{ROUNDS} group by id),
hash as (
  select sha256(string_agg(cast(x[pos] as varchar), ',' order by part, entry, pos)) as codebooks_sha256
  from book{ROUNDS}, shape, (select unnest(range(1, cast(size + 1 as bigint))) as pos from shape))
select id as vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join kept using (id), hash
"""


SQL = _sql()
