"""Self-join of documents by the Jaccard similarity of their word n-grams, with prefix trees.

1. Each document's set of shingle hashes. Linked sets share at least the bound's part of each one's shingles, so a set
   with fewer shingles that occur in other sets links with nothing: it is closed at once. Occurrences are counted over
   all documents; of equal sets, the one of the least document stands for all.
2. The global order of the shingles of what is left: ascending number of sets that hold a shingle, then its hash.
   Linked sets share a shingle of their prefixes, the first n - ceil(bound * n) + 1 of the order.
3. Sets that share a shingle of their prefixes, and whose sizes allow a link, go into one trie as ordered paths.
   All sets are probed together: partial overlaps are shared along the paths, and a subtree is left when no remaining
   length can reach the bound. A large trie is cut into tiles: first all against a pivot tile, then those pairs of tiles
   which are not one component yet.
Only spanning links leave a task, never all pairs of a group. Shingles that only one set holds take part as a number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm.common import cut, forget, join_spread, table, text_or_empty
from queuelens.llm.components import connected_components
from queuelens.llm.records import NULL_ID, bucket_count, gather, groups, ids_of, in_buckets, mix, pack, starts, unpack

#: Shingles, and sets, that a task deals together (a slot is a 16-bit number), and bytes of text that it reads at a time.
FLUSH, SLOTS, READ = 1_500_000, 60_000, 4 << 20
#: Bytes of text for each bucket of shingles.
BUCKET_BYTES = 8 << 20
#: Shingles of a tile.
TILE_SHINGLES = 1 << 20
FACT, TOKEN, SET, KEY, EDGE = range(5)
_LOW = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Bound:
    """Sets link when den * intersection >= num * union; shingles have n words."""

    n: int = 3
    num: int = 90
    den: int = 100

    def least(self, n):
        """The least intersection of a set of n shingles with any that it links with."""
        return -(-self.num * n // self.den)

    def needed(self, total):
        """The least intersection of linked sets whose sizes sum to total."""
        return -(-self.num * total // (self.num + self.den))


@cache
def size_classes(bound: Bound, most: int) -> np.ndarray:
    """Least size of each class. A set's partners are in its own class and the neighbouring ones."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(edges[-1] * bound.den // bound.num + 1)
    return np.array(edges)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's set of shingle hashes, sorted. Words are runs without ASCII white space; A-Z are lower-cased."""
    texts = texts.cast(pa.string())  # of sliced large strings, ascii_lower reads the wrong bytes
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    count = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    vocabulary = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in vocabulary), np.uint64, len(vocabulary))
    empty = np.fromiter((w == "" for w in vocabulary), bool, len(vocabulary))
    which = coded.indices.to_numpy(zero_copy_only=False)
    flat = hashes[which] if len(which) else np.empty(0, np.uint64)
    none = empty[which] if len(which) else np.empty(0, bool)
    end, out = count.cumsum(), []
    with np.errstate(over="ignore"):
        for e, c in zip(end.tolist(), count.tolist(), strict=True):
            w = flat[e - c : e]
            if c and none[e - c : e].any():
                w = w[~none[e - c : e]]
            if not len(w):
                out.append(np.empty(0, np.uint64))
                continue
            size = min(n, len(w))
            s = np.full(len(w) - size + 1, size, np.uint64)
            for i in range(size):
                s = mix(s + w[i : len(w) - size + 1 + i])
            out.append(np.unique(s))
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about READ bytes of text (column 1)."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + READ)))
            yield batch.slice(at, end - at)
            at = end


def _rows(rows: list[tuple], names: tuple[str, ...], kinds: tuple) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


_DEALT, _DEALT_KINDS = ("key", "kind", "data"), (pa.int64(), pa.int32(), pa.binary())


def _deal(bound: Bound, buckets: int, whole: bool):
    """Deals the shingles of sets to buckets, and the facts of documents to the place where the answers meet: the flush.

    ``whole``: with their hashes whole; else with the last 32 bits, which may take different shingles for the same, so
    that only counts of repeated shingles can be too large.
    """

    def flush(number: int, docs: list[int], sets: list[np.ndarray]) -> Iterator[tuple]:
        keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
        k1, k2 = (np.array([k >> shift & (2**63 - 1) for k in keys], np.int64) for shift in (0, 65))
        doc, n = np.array(docs, np.int64), np.array([len(s) for s in sets], np.int64)
        k1[n == 0], k2[n == 0] = doc[n == 0], 0  # documents without shingles are no copies of each other
        yield number, FACT, pack(doc, n, k1, k2)
        order = np.lexsort((doc, n, k2, k1))
        send = np.sort(order[starts(k1[order], k2[order], n[order])])  # of equal sets, that of the least document
        token, slot = np.concatenate([sets[i] for i in send.tolist()]), np.repeat(send, n[send]).astype(np.uint16)
        bucket = (token >> np.uint64(40)).astype(np.int64) * buckets >> 24
        order = np.argsort(bucket.astype(np.uint64) << np.uint64(32) | token & _LOW)
        token, slot, bucket = token[order], slot[order], bucket[order]
        edges = np.flatnonzero(starts(bucket))
        for a, b in zip(edges, np.append(edges[1:], len(bucket)), strict=False):
            body = token[a:b] if whole else (token[a:b] & _LOW).astype(np.uint32)
            yield int(bucket[a]), TOKEN, number.to_bytes(8, "little") + pack(body, slot[a:b])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        docs, sets, held = [], [], 0
        for part in _parts(batches):
            for doc, s in zip(ids_of(part.column(0)).tolist(), shingle_sets(part.column(1), bound.n), strict=True):
                docs.append(doc)
                sets.append(s)
                held += len(s)
                if held >= FLUSH or len(docs) >= SLOTS:
                    yield _rows(list(flush(number, docs, sets)), _DEALT, _DEALT_KINDS)
                    number, docs, sets, held = number + 1, [], [], 0
        if docs:
            yield _rows(list(flush(number, docs, sets)), _DEALT, _DEALT_KINDS)

    return run


def _gathered(blobs: list[bytes], kind: str) -> tuple[np.ndarray, ...]:
    """Tokens of a bucket in their order, with their flush's place among the flushes, and their slot; those flushes."""
    flushes = sorted({b[:8] for b in blobs})
    place = {f: i for i, f in enumerate(flushes)}
    parts = [unpack(b[8:], (kind, "u2")) for b in blobs]
    token, slot = (np.concatenate(c) for c in zip(*parts, strict=True))
    of = np.repeat(np.array([place[b[:8]] for b in blobs]), [len(p[0]) for p in parts])
    order = np.argsort(token, kind="stable")
    return token[order], of[order], slot[order], [int.from_bytes(f, "little") for f in flushes]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each flush with the number of repeated shingles of its slots."""
    for (key, kind), rows in groups(batches, 2):
        if kind == FACT:
            yield _rows([(key, FACT, r[0]) for r in rows], _DEALT, _DEALT_KINDS)
            continue
        token, of, slot, flushes = _gathered([r[0] for r in rows], "u4")
        again = ~starts(token)
        again[:-1] |= again[1:]
        where, n = np.unique((of[again].astype(np.int64) << 16) | slot[again], return_counts=True)
        edges = np.searchsorted(where, np.arange(len(flushes) + 1) << 16)
        yield _rows([(f, TOKEN, pack((where[a:b] & 0xFFFF).astype(np.uint16), n[a:b].astype(np.uint32))) for f, a, b in zip(flushes, edges, edges[1:], strict=False) if b > a], _DEALT, _DEALT_KINDS)


def _facts(bound: Bound):
    """Each document's size and set hash, and whether enough of its shingles are repeated for a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 1):
            doc, n, k1, k2 = gather([d for k, d in rows if k == FACT], ("i8", "i8", "i8", "i8"))
            slot, count = gather([d for k, d in rows if k == TOKEN], ("u2", "u4"))
            again = np.bincount(slot, weights=count, minlength=len(doc))
            open_ = (n > 0) & (again >= bound.least(n))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (doc, n, k1, k2, open_)], names=["doc", "n", "k1", "k2", "open"])

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each flush with the repeated shingles of its slots and the number of sets that hold them."""
    for (key, kind), rows in groups(batches, 2):
        if kind == FACT:
            yield _rows([(key, FACT, r[0]) for r in rows], _DEALT, _DEALT_KINDS)
            continue
        token, of, slot, flushes = _gathered([r[0] for r in rows], "u8")
        first = np.flatnonzero(starts(token))
        sets = np.repeat(np.diff(np.append(first, len(token))), np.diff(np.append(first, len(token))))
        again = sets > 1
        token, of, slot, sets = token[again], of[again], slot[again], sets[again].astype(np.uint32)
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(len(flushes) + 1))
        yield _rows([(f, TOKEN, pack(*(c[order[a:b]] for c in (token, slot, sets)))) for f, a, b in zip(flushes, edges, edges[1:], strict=False) if b > a], _DEALT, _DEALT_KINDS)


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1)[a != b], axis=0)
    return pairs[:, 0], pairs[:, 1]


def _stars(token: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of prefix shingles and the size classes of the sets that hold them: the least document of each shingle and class,
    and edges to it from the others."""
    order = np.lexsort((doc, cls, token))
    token, cls, doc = token[order], cls[order], doc[order]
    first = starts(token, cls)
    hub = doc[np.flatnonzero(first)[first.cumsum() - 1]] if len(doc) else doc
    return token[first], cls[first], doc[first], *_distinct_pairs(doc, hub)


_ORDERED, _ORDERED_KINDS = ("key", "kind", "doc", "n", "data"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())


def _order(bound: Bound, buckets: int):
    """Sets in the global order, their prefixes' shingles as keys for other tasks, and edges of sets that share one here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 1):
            doc, n, _, _ = gather([d for k, d in rows if k == FACT], ("i8", "i8", "i8", "i8"))
            token, slot, sets = gather([d for k, d in rows if k == TOKEN], ("u8", "u2", "u4"))
            order = np.lexsort((token, sets, slot))
            token, slot, sets = token[order], slot[order].astype(np.int64), sets[order]
            again = np.bincount(slot, minlength=len(doc))
            prefix = n - bound.least(n) + 1 - (n - again)  # after the shingles that no other set holds
            begin = again.cumsum() - again
            inside = np.arange(len(slot)) - begin[slot] < prefix[slot]
            out = []
            for i in np.flatnonzero((prefix > 0) & (again > 0)).tolist():
                a, b = begin[i], begin[i] + again[i]
                out.append((0, SET, int(doc[i]), int(n[i]), pack(token[a:b], sets[a:b])))
            cls = np.searchsorted(size_classes(bound, int(n.max(initial=1))), n, side="right") - 1
            token, cls, least, a, b = _stars(token[inside], cls[slot[inside]], doc[slot[inside]])
            out += [(bucket, KEY, 0, 0, blob) for bucket, blob in in_buckets(token, buckets, token, cls.astype(np.int16), least)]
            if len(a):
                out.append((0, EDGE, 0, 0, pack(a, b)))
            yield _rows(out, _ORDERED, _ORDERED_KINDS)

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges between sets that share a shingle of their prefixes and are in the same or neighbouring size classes."""
    for (_, kind), rows in groups(batches, 2):
        blobs = [r[0] for r in rows]
        if kind == EDGE:
            found = [_distinct_pairs(*gather(blobs, ("i8", "i8")))]
        else:
            token, cls, hub, a, b = _stars(*gather(blobs, ("u8", "i2", "i8")))
            near = np.flatnonzero((token[1:] == token[:-1]) & (cls[1:] - cls[:-1] == 1))
            found = [(a, b), _distinct_pairs(hub[near], hub[near + 1])]
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


class Trie:
    """Ordered sets as paths of shingles' ranks in the global order; each edge is a run that all sets below it share.
    A set's size counts shingles that only it holds too."""

    def __init__(self, paths: list[np.ndarray], sizes: list[int]) -> None:
        self.order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">i8").tobytes())
        self.paths = [paths[i] for i in self.order]
        self.sizes = np.array([sizes[i] for i in self.order])
        self.lengths = np.array([len(p) for p in self.paths])
        common = [0] * len(paths)
        for i in range(1, len(paths)):
            a, b = self.paths[i - 1], self.paths[i]
            n = min(len(a), len(b))
            apart = np.flatnonzero(a[:n] != b[:n])
            common[i] = int(apart[0]) if len(apart) else n
        self.common = np.array(common)

    def probe(self, paths: list[np.ndarray], sizes: list[int], ranks: int, bound: Bound) -> list[tuple[int, int]]:
        """(probe, set) of all linked pairs, a set and itself included, by their places in the input."""
        found: list[tuple[int, int]] = []
        step = max(1, 16_000_000 // ranks)
        for at in range(0, len(paths), step):
            some = paths[at : at + step]
            has = np.zeros((len(some), ranks), bool)
            for i, p in enumerate(some):
                has[i, p] = True
            upto = has.cumsum(axis=1, dtype=np.int32)
            size = np.array(sizes[at : at + step])
            stack = [(0, len(self.paths), 0, np.arange(len(some)), np.zeros(len(some), np.int64))]
            while stack:
                i, j, depth, active, overlap = stack.pop()
                below = self.sizes[i:j]
                end = int(self.lengths[i]) if j == i + 1 else int(self.common[i + 1 : j].min())
                shortest, longest, deepest = int(below.min()), int(below.max()), int(self.lengths[i:j].max())
                for at_depth in (depth, end):  # before and after this edge's shingles
                    if at_depth > depth:
                        overlap = overlap + has[active[:, None], self.paths[i][depth:end]].sum(axis=1)
                    rest = upto[active, -1] - (upto[active, self.paths[i][at_depth - 1]] if at_depth else 0)
                    n = size[active]
                    keep = overlap + np.minimum(rest, deepest - at_depth) >= bound.needed(n + np.clip(n * bound.num // bound.den, shortest, longest))
                    keep &= (bound.den * longest >= bound.num * n) & (bound.den * n >= bound.num * shortest)
                    active, overlap = active[keep], overlap[keep]
                if not len(active):
                    continue
                child = i
                while child < j and self.lengths[child] == end:  # equal paths, if any, end here together
                    linked = bound.den * overlap >= bound.num * (size[active] + self.sizes[child] - overlap)
                    found += [(at + int(p), self.order[child]) for p in active[linked]]
                    child += 1
                if child < j:
                    cuts = [child, *(child + 1 + np.flatnonzero(self.common[child + 1 : j] == end)).tolist(), j]
                    stack += [(a, b, end, active, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]
        return found


def ranked(sets: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], int]:
    """Paths of ranks of sets (shingles, numbers of sets that hold them), and how many ranks there are."""
    token, held = (np.concatenate(c) for c in zip(*sets, strict=True))
    names, at, which = np.unique(token, return_index=True, return_inverse=True)
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, held[at]))] = np.arange(len(names))
    return np.split(rank[which], np.cumsum([len(s[0]) for s in sets])[:-1]), len(names)


def _spanning(ids_a: list[int], ids_b: list[int], pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Links that join something new: a forest of the linked ids."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = set()
    for i, j in pairs:
        a, b = root(ids_a[i]), root(ids_b[j])
        if a != b:
            up[max(a, b)] = min(a, b)
            out.add((ids_a[i], ids_b[j]))
    return out


def _links(bound: Bound):
    """Spanning links of each task's sets: side 0 against itself, or 0 against 1 where there are two sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groups(batches, 3):
            rows.sort(key=lambda r: r[0])
            docs, sizes = [r[1] for r in rows], [r[2] for r in rows]
            paths, ranks = ranked([tuple(unpack(r[3], ("u8", "u4"))) for r in rows])
            first = sum(r[0] == 0 for r in rows)
            if not first:
                continue
            other = first if first < len(rows) else 0
            out = _spanning(docs[other:], docs[:first], Trie(paths[:first], sizes[:first]).probe(paths[other:], sizes[other:], ranks, bound))
            cols = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b"])

    return run


def _run_tasks(tasks: DataFrame, bound: Bound) -> DataFrame:
    """tasks: (block, i, j, side, doc, n, data)."""
    return tasks.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j").mapInArrow(_links(bound), "a long, b long")


def _buckets(pairs: DataFrame) -> int:
    """Buckets of about BUCKET_BYTES of text."""
    return bucket_count(pairs.sparkSession, pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_BYTES)


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def ngram_jaccard_components(docs: DataFrame, bound: Bound = Bound(), tile: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least id in reach by links, its own included), for every row.

    Null and empty texts have empty sets and link with nothing. Rows that share an id are one document: they share its
    component. A null id is an id like others, before all of them; its component is null. Empty tables give no rows;
    other columns are not read; texts of any length are read whole. A trie of up to ``tile`` sets and TILE_SHINGLES
    shingles is one task; larger ones are cut into tiles of about that size.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    buckets, schema = _buckets(pairs), "key long, kind int, data binary"
    counted = _dealt(pairs.mapInArrow(_deal(bound, buckets, False), schema), "key", "kind").mapInArrow(_count, schema)
    facts = cut(_dealt(counted, "key").mapInArrow(_facts(bound), "doc long, n long, k1 long, k2 long, open boolean"))
    # Equal sets: the least document stands for all. Documents of several sets tie these together.
    same = cut(facts.groupBy("k1", "k2", "n").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("rows")))
    several = facts.groupBy("doc").agg(F.min(F.struct("n", "k1", "k2")).alias("x"), F.max(F.struct("n", "k1", "k2")).alias("y")).where("x <> y").select("doc")
    ties = facts.join(several, "doc", "left_semi").distinct().join(same, ["k1", "k2", "n"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    # Sets that may link, in the global order of their shingles.
    left = facts.where("open").join(same.select("k1", "k2", "n", F.col("rep").alias("doc")), ["k1", "k2", "n", "doc"]).select("doc").distinct()
    texts = pairs.withColumn("doc", F.coalesce("doc", F.lit(NULL_ID))).join(left, "doc")
    known = _dealt(texts.select("doc", "text").mapInArrow(_deal(bound, buckets, True), schema), "key", "kind").mapInArrow(_frequencies, schema)
    ordered = cut(_dealt(known, "key").mapInArrow(_order(bound, buckets), "key long, kind int, doc long, n long, data binary"))
    keys = ordered.where(F.col("kind").isin(KEY, EDGE)).select(F.when(F.col("kind") == EDGE, F.xxhash64("data")).otherwise(F.col("key")).alias("key"), "kind", "data")
    blocks = cut(connected_components(_dealt(keys, "key", "kind").mapInArrow(_edges, "a long, b long")))
    sets = ordered.where(F.col("kind") == SET).select("doc", "n", "data").join(blocks.select(F.col("id").alias("doc"), F.col("component").alias("block")), "doc")
    sets = cut(sets)
    sizes = sets.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.ceil(F.greatest(F.count(F.lit(1)) / tile, F.sum(F.length("data") / 12) / TILE_SHINGLES)).cast("int").alias("tiles"))
    sets = join_spread(sets, sizes, ["block"], "rows")
    small = sets.where("tiles <= 1").select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "doc", "n", "data")
    links = cut(_run_tasks(small, bound))
    if sizes.where("tiles > 1").limit(1).count():
        large = cut(sets.where("tiles > 1"))
        links = cut(links.unionByName(_large_blocks(large, bound)))
        forget(large)
    found = cut(connected_components(links.unionByName(ties)))
    forget(ordered, blocks, links)
    named = cut(same.join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("k1", "k2", "n", "rows", F.coalesce("component", "rep").alias("component")))
    out = join_spread(facts.select("doc", "n", "k1", "k2"), named, ["k1", "k2", "n"], "rows")
    value = lambda c: F.when(c != NULL_ID, c)
    return out.select(value(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), value(F.col("component")).alias("component_id"))


def _large_blocks(large: DataFrame, bound: Bound) -> DataFrame:
    """Spanning links of blocks (block, doc, n, data, tiles) that are cut into tiles."""
    h = F.xxhash64("doc", "data")
    first = large.withColumn("tile", F.pmod(h, F.col("tiles")).cast("int"))
    # Tile 0 is the pivot: every tile meets it and itself.
    own = first.select("block", F.col("tile").alias("i"), F.col("tile").alias("j"), F.lit(0).alias("side"), "doc", "n", "data")
    against = first.where("tile > 0").select("block", F.lit(0).alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side"), "doc", "n", "data")
    pivot = first.where("tile = 0").withColumn("j", F.explode(F.expr("sequence(1, greatest(1, tiles - 1))"))).select("block", F.lit(0).alias("i"), "j", F.lit(0).alias("side"), "doc", "n", "data")
    links = cut(_run_tasks(own.unionByName(against).unionByName(pivot), bound))
    labels = connected_components(links).select(F.col("id").alias("doc"), "component")
    labelled = cut(large.join(labels, "doc", "left").withColumn("label", F.coalesce("component", "doc")).drop("component"))
    # Then tiles of one component each where components are large, and mixed tiles of the rest; two tiles of the same
    # component are not compared.
    per = F.ceil(F.col("rows") / F.col("tiles"))
    count = labelled.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c"), F.max(per).alias("per"))
    count = cut(count.withColumn("pool", F.when(F.col("c") >= F.col("per"), F.col("label"))))
    pools = count.groupBy("block", "pool").agg(F.sum("c").alias("c"), F.max("per").alias("per")).withColumn("parts", F.ceil(F.col("c") / F.col("per")).cast("int"))
    before = F.sum("parts").over(W.partitionBy("block").orderBy("pool").rowsBetween(W.unboundedPreceding, -1))
    pools = cut(pools.withColumn("before", F.coalesce(before, F.lit(0)).cast("int")))
    if not pools.groupBy("block").count().where("count > 1").unionByName(pools.where("pool is null and parts > 1").select("block", F.lit(2).alias("count"))).limit(1).count():
        return links  # each block is one component, or has no tiles to compare
    tiles = pools.select("block", "pool", F.explode(F.expr("sequence(before, before + parts - 1)")).alias("tile"))
    several = pools.groupBy("block").agg((F.count(F.lit(1)) > 1).alias("a"), F.max(F.col("pool").isNull() & (F.col("parts") > 1)).alias("b")).where("a or b").select("block")
    there = labelled.join(several, "block", "left_semi").join(count.select("block", "label", "pool"), ["block", "label"]).join(pools.select("block", F.col("pool").alias("p2"), "parts", "before"), "block")
    there = there.where(F.col("pool").eqNullSafe(F.col("p2"))).withColumn("tile", F.col("before") + F.pmod(h, F.col("parts")).cast("int"))
    there = there.select("block", "pool", "tile", "doc", "n", "data")
    other = tiles.select("block", F.col("pool").alias("pool2"), F.col("tile").alias("tile2"))
    met = there.join(other, "block").where(F.col("pool").isNull() & F.col("pool2").isNull() | ~F.col("pool").eqNullSafe(F.col("pool2")))
    i, j = F.least("tile", "tile2"), F.greatest("tile", "tile2")
    tasks = met.select("block", i.alias("i"), j.alias("j"), (F.col("tile") > F.col("tile2")).cast("int").alias("side"), "doc", "n", "data")
    return links.unionByName(_run_tasks(tasks, bound))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the query's rows: all pairs of documents that share a shingle, then the least id in reach.
SQL = """
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
n as (select doc_id, len(s) as n from s),
t as (select doc_id, unnest(s) as t from s),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as met from t a join t b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * met >= 90 * (x.n + y.n - met)),
reach(a, b) as (select doc_id, doc_id from n union select r.a, l.b from reach r join (select a, b from links union select b, a from links) l on l.a = r.b)
select doc_id, cast(n as bigint) as n_shingles, least(doc_id, (select min(b) from reach where reach.a = n.doc_id)) as component_id from n
"""

#: Near-duplicate stages on word shingles: five words, a similarity of 0.8.
NEAR = Bound(n=5, num=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have the least id of their component; of repeated rows with that id, each stays."""
    gone = ngram_jaccard_components(docs, NEAR).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
