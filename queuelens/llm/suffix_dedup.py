"""Removal of repeated 100-byte strings by sorting suffixes in ranges of their leading bytes.

1. Every string of ``length`` bytes has an anchor, the place of its least ``gram`` bytes long part, which depends on the
   string alone. Anchors are counted by the hash of this part over all documents. One that occurs once has no repeated
   strings: hashes only leave anchors out, and a collision only lets one more through.
2. The suffixes at the other anchors, each with the bytes that its strings cover, are dealt to ranges of their leading
   bytes. The splitters are quantiles of a sample of leading bytes. Equal leading bytes never straddle a splitter, so
   no comparison across ranges is left to do.
3. In a range, of equal covers all but the first are repeats whole. The strings of different covers with the same anchor
   are sorted by multikey quicksort, eight bytes a step, among those still equal; of equal strings all but the first are
   repeats. Bytes are compared, never hashes.

Covers that are equal within a group of documents leave it once. Anchors that occur very often (HOT) are dealt by their
single strings, whose ranges are as many as there are different surroundings, so no anchor's suffixes fill one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm.common import cut, table, text_or_empty
from queuelens.llm.records import NULL_ID, bucket_count, by_doc, doc_bucket, gather, groups, ids_of, in_buckets, mix, pack, starts, unpack

LENGTH, GRAM = 100, 48
#: Bytes that are hashed at a time, and the bits of a place among them.
PLACE_BITS = 19
CHUNK = 1 << PLACE_BITS
#: Anchors that a task holds before it sends them on, strings that are sorted at a time, and covers of an anchor from
#: which its strings are dealt one by one.
FLUSH, STRINGS, HOT = 200_000, 200_000, 5_000
#: Bytes of text for each range and each group of documents.
BUCKET_BYTES = 8 << 20
#: Sampled leading bytes for each range, and of each block of anchors.
SAMPLES, OF_BLOCK = 16, 32
ANCHOR, OPEN, SAMPLE, COVER, REMOVE = range(5)


@dataclass(frozen=True)
class Buckets:
    """How many buckets of hashes and ranges of bytes, and how many groups of documents, records are dealt to, and how
    many partitions these are spread over: small ones, as a task sorts its own."""

    ranges: int
    docs: int
    parts: int


_P = 0x9E3779B97F4A7C15


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for p in (_P, pow(_P, -1, 1 << 64)):
        a = np.full(n, p, np.uint64)
        a[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(a))
    return out[0], out[1]


def _prefix_hash(raw: np.ndarray) -> np.ndarray:
    powers, _ = _powers(1 << (len(raw) + 1).bit_length())
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[: len(raw)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from start to end, equal for equal bytes wherever they stand."""
    _, inverse = _powers(1 << (len(prefix)).bit_length())
    with np.errstate(over="ignore"):
        return mix((prefix[end] - prefix[start]) * inverse[start])


def anchors(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of the anchors of all strings of ``length`` bytes: hash and first eight bytes of the gram, text, first string's
    start in the text, strings less one, and the gram's place from that start. Texts together have at most CHUNK bytes."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.empty(0, np.int64)
    if len(raw) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none, none, none, none
    end = sizes.cumsum()
    prefix = _prefix_hash(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = _hash(prefix, at, at + gram)
    low = np.uint64(CHUNK - 1)
    least = (grams & ~low) | at.astype(np.uint64)
    width, span = length - gram + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    if span < width:
        rest = width - span
        least = np.minimum(least[: len(least) - rest], least[rest:])
    text = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    start = np.flatnonzero(np.arange(len(least)) + length <= end[text])
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint64), none, none, none, none
    place, text = (least[start] & low).astype(np.int64), text[start]
    new = np.flatnonzero(starts(place, text, start - np.arange(len(start))))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    place = place[new]
    return grams[place], words(raw, place), text[new], first - (end - sizes)[text[new]], last - first, place - first


def words(raw: np.ndarray, at: np.ndarray, n: int = 8) -> np.ndarray:
    """The n bytes from each place as a number that orders like them."""
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out << np.uint64(8) | raw[at + i]
    return out


def equal_strings(raw: np.ndarray, at: np.ndarray, length: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (as indexes into ``at``) of strings that occur more than once in their group, and numbers of the sets of
    equal ones: multikey quicksort with eight bytes as a character. What has become unique is left out of later steps."""
    index = np.arange(len(at))
    for step in range(0, length, 8):
        key = words(raw, at[index] + step, min(8, length - step))
        order = np.lexsort((key, group))
        index, group, key = index[order], group[order], key[order]
        new = starts(group, key)
        group = new.cumsum() - 1
        several = (np.bincount(group) > 1)[group] if len(group) else np.empty(0, bool)
        index, group = index[several], group[several]
    return index, group


def _encoded(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _pieces(ids: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Runs of texts of at most CHUNK bytes, with their ids and their starts in the text; longer texts in overlapping parts."""
    part, of, begin, size = [], [], [], 0
    for doc, t in zip(ids.tolist(), texts, strict=True):
        for at in range(0, max(1, len(t) - length + 1), CHUNK - length):
            x = t[at : at + CHUNK - 1] if at or len(t) >= CHUNK else t
            if size + len(x) >= CHUNK:
                yield part, np.array(of, np.int64), np.array(begin, np.int64)
                part, of, begin, size = [], [], [], 0
            part.append(x)
            of.append(doc)
            begin.append(at)
            size += len(x)
    if part:
        yield part, np.array(of, np.int64), np.array(begin, np.int64)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes of each document."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    head = starts(doc)
    # The furthest end so far within a document: documents are set apart by an offset.
    lift = (head.cumsum() - 1) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = head.copy()
    new[1:] |= (start + lift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return doc[first], start[first], (reach - lift)[np.append(first[1:], len(doc)) - 1]


def _removed(doc: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: Buckets) -> list[tuple[int, int, bytes]]:
    doc, start, end = _merged(doc, start, end)
    return [(b, REMOVE, blob) for b, blob in by_doc(doc, buckets.docs, doc, start, end)]


def _out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])


def _anchor_records(length: int, gram: int, buckets: Buckets):
    def flush(rows: list[tuple]) -> pa.RecordBatch:
        g, word, doc, start, more, delta = (np.concatenate(c) for c in zip(*rows, strict=True))
        order = np.argsort(g)
        out = [(b, ANCHOR, blob) for b, blob in in_buckets(g[order], buckets.ranges, (g & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], doc[order], start.astype(np.int32)[order], more.astype(np.uint16)[order], delta.astype(np.uint16)[order])]
        chance = mix(mix(g))
        some = np.argsort(chance)[:OF_BLOCK]
        out += [(int(c % np.uint64(buckets.ranges)), SAMPLE, int(c).to_bytes(8, "big") + int(w).to_bytes(8, "big")) for c, w in zip(chance[some], word[some], strict=True)]
        return _out(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            for texts, of, begin in _pieces(ids_of(batch.column(0)), _encoded(batch.column(1)), length):
                g, word, text, start, more, delta = anchors(texts, length, gram)
                rows.append((g, word, of[text], start + begin[text], more, delta))
                held += len(g)
                if held > FLUSH:
                    yield flush(rows)
                    rows, held = [], 0
        if held:
            yield flush(rows)

    return run


_ANCHOR = ("u4", "i8", "i4", "u2", "u2")


def _count(buckets: Buckets, often: int):
    """Anchors whose gram occurs again, and whether it does so very often, to their documents; samples as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, kind), rows in groups(batches, 2):
            if kind == SAMPLE:
                yield _out([(bucket, SAMPLE, r[0]) for r in rows])
                continue
            gram, doc, start, more, delta = gather([r[0] for r in rows], _ANCHOR)
            order = np.argsort(gram, kind="stable")
            of = starts(gram[order]).cumsum() - 1
            n = np.bincount(of)[of] if len(of) else of
            keep = n > 1
            order, hot = order[keep], n[keep] > often
            yield _out([(b, OPEN, blob) for b, blob in by_doc(doc[order], buckets.docs, doc[order], start[order], more[order], delta[order], hot)])

    return run


def _blob(docs: list[int], at: list[int], group: list[int], covers: list[bytes]) -> bytes:
    return pack(np.array(docs, np.int64), np.array(at, np.int32), np.array(group, np.uint64), np.array([len(c) for c in covers], np.uint16)) + b"".join(covers)


def _covers(length: int, gram: int, buckets: Buckets, splitters: np.ndarray):
    """Suffixes at a bucket's open anchors with what their strings cover, dealt to ranges of their leading bytes. Of
    equal covers the first is sent, the others are repeats."""

    def run(texts: pa.Table, records: pa.Table) -> pa.Table:
        open_ = _by_doc(gather(records.column("data").to_pylist(), ("i8", "i4", "u2", "u2", "?")))
        places: dict[bytes, list[tuple[int, int]]] = {}
        core: dict[bytes, bytes] = {}
        for doc, text in zip(ids_of(texts.column("doc").combine_chunks()).tolist(), _encoded(texts.column("text").combine_chunks()), strict=True) if open_ else ():
            for start, more, delta, hot in zip(*(x.tolist() for x in open_[doc]), strict=True) if doc in open_ else ():
                if start + more + length > len(text):  # rows that share an id may differ in length
                    continue
                if not hot:
                    cover = text[start : start + more + length]
                    places.setdefault(cover, []).append((doc, start))
                    core[cover] = cover[delta : delta + gram]
                    continue
                for s in range(start, start + more + 1):
                    cover = text[s : s + length]
                    places.setdefault(cover, []).append((doc, s))
                    core[cover] = cover
        gone, first = [], []
        for cover, where in places.items():
            least = min(where)
            first.append((cover, *least))
            if len(where) > 1:
                gone += [(d, s, s + len(cover)) for d, s in where if (d, s) != least]
        rows = _removed(*(np.array(c, np.int64) for c in zip(*gone, strict=True)), buckets) if gone else []
        if first:
            lead = np.array([int.from_bytes(core[c][:8], "big") for c, _, _ in first], np.uint64)
            bucket = np.searchsorted(splitters, lead, side="right")
            order = np.argsort(bucket, kind="stable").tolist()
            edges = np.flatnonzero(starts(bucket[order])).tolist()
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                part = [first[i] for i in order[a:b]]
                rows.append((int(bucket[order[a]]), COVER, _blob([x[1] for x in part], [x[2] for x in part], [xxhash.xxh3_64_intdigest(core[x[0]]) for x in part], [x[0] for x in part])))
        return pa.Table.from_batches([_out(rows)])

    return run


def _repeats(doc: np.ndarray, at: np.ndarray, group: np.ndarray, covers: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, start, end) of a range's repeats."""
    order = np.lexsort((at, doc))
    seen: dict[bytes, int] = {}
    gone, left = [], []
    for i in order.tolist():
        j = seen.setdefault(covers[i], i)
        if j == i:
            left.append(i)
        elif (doc[i], at[i]) != (doc[j], at[j]):
            gone.append((int(doc[i]), int(at[i]), int(at[i]) + len(covers[i])))
    left = np.array(left, np.int64)
    _, which = np.unique(group[left], return_inverse=True)
    several = np.bincount(which)[which] > 1 if len(left) else np.empty(0, bool)
    left, which = left[several], which[several]
    order = np.argsort(which, kind="stable")
    left, which = left[order], which[order]
    out = [np.array(c, np.int64) for c in zip(*gone, strict=True)] if gone else [np.empty(0, np.int64)] * 3
    out = [[x] for x in out]
    size = np.array([len(covers[i]) for i in left.tolist()], np.int64)
    many = (size - length + 1).cumsum()
    begin = 0
    while begin < len(left):  # whole groups, about STRINGS strings at a time
        end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + STRINGS)))
        end = int(np.searchsorted(which, which[end - 1], side="right"))
        part = left[begin:end]
        n = size[begin:end] - length + 1
        raw = np.frombuffer(b"".join(covers[i] for i in part.tolist()), np.uint8)
        offset = np.arange(int(n.sum())) - np.repeat(n.cumsum() - n, n)
        place = np.repeat(size[begin:end].cumsum() - size[begin:end], n) + offset
        d, a = np.repeat(doc[part], n), np.repeat(at[part], n) + offset
        index, same = equal_strings(raw, place, length, np.repeat(which[begin:end], n))
        order = np.lexsort((a[index], d[index], same))
        index, same = index[order], same[order]
        head = starts(same)
        lead = index[np.flatnonzero(head)[head.cumsum() - 1]] if len(index) else index
        again = (d[index] != d[lead]) | (a[index] != a[lead])
        for x, y in zip(out, (d[index][again], a[index][again], a[index][again] + length), strict=True):
            x.append(y)
        begin = end
    return tuple(np.concatenate(x) for x in out)


def _sorted_ranges(length: int, buckets: Buckets):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket, kind), rows in groups(batches, 2):
            if kind == REMOVE:
                yield _out([(bucket, REMOVE, r[0]) for r in rows])
                continue
            kinds, parts, covers = ("i8", "i4", "u8", "u2"), [], []
            for (blob,) in rows:
                doc, at, group, size = unpack(blob, kinds)
                parts.append((doc, at.astype(np.int64), group))
                end = len(blob) - int(size.sum()) + size.astype(np.int64).cumsum()
                covers += [blob[e - n : e] for e, n in zip(end.tolist(), size.tolist(), strict=True)]
            doc, at, group = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield _out(_removed(*_repeats(doc, at, group, covers, length), buckets))

    return run


def _by_doc(records: list[np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
    order = np.lexsort((records[1], records[0]))
    records = [r[order] for r in records]
    edges = np.flatnonzero(starts(records[0]))
    if not len(edges):
        return {}
    return {int(records[0][a]): tuple(r[a:b] for r in records[1:]) for a, b in zip(edges, [*edges[1:], len(order)], strict=True)}


def _kept(with_text: bool):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")

    def run(texts: pa.Table, records: pa.Table) -> pa.Table:
        doc, start, end = _merged(*gather(records.column("data").to_pylist(), ("i8", "i8", "i8")))
        removed = _by_doc([doc, start, end])
        rows = []
        for doc, text in zip(ids_of(texts.column("doc").combine_chunks()).tolist(), _encoded(texts.column("text").combine_chunks()), strict=True):
            at, kept, spans, gone = 0, [], 0, 0
            for s, e in zip(*(x.tolist() for x in removed.get(doc, (np.empty(0, np.int64),) * 2)), strict=True):
                e = min(e, len(text))
                if s < e:
                    kept.append(text[at:s])
                    at, spans, gone = e, spans + 1, gone + e - s
            left = b"".join([*kept, text[at:]])
            rows.append((None if doc == NULL_ID else doc, len(text), gone, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
        cols = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return run


def _buckets(pairs: DataFrame) -> Buckets:
    n = bucket_count(pairs.sparkSession, pairs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, BUCKET_BYTES)
    return Buckets(n, n, -(-n // 3))


def _splitters(samples: DataFrame, ranges: int) -> np.ndarray:
    """Quantiles of a sample of leading bytes, of at most SAMPLES values a range: those of the least random numbers."""
    rows = samples.select("data").sort("data").limit(ranges * SAMPLES).collect()
    found = np.sort(np.array([int.from_bytes(r.data[8:], "big") for r in rows], np.uint64))
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes left, if ``with_text``; else null): each text
    without the bytes of strings of ``length`` bytes that also start earlier, in a smaller id or before in the text.

    Null text counts as empty. A null id comes before all others. Of rows that share an id none is the earlier one:
    they are one document, and what repeats an earlier place in one of them goes from all. Empty tables give no rows;
    other columns are not read. Texts of any length are read whole, in overlapping parts. Strings of an anchor that occurs
    over ``hot`` times are dealt one by one.
    """
    pairs = docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    pairs = pairs.withColumn("doc", F.coalesce("doc", F.lit(NULL_ID)))
    buckets, schema = _buckets(pairs), "bucket int, kind int, data binary"
    deal = lambda df: df.repartition(buckets.parts, "bucket", "kind").sortWithinPartitions("bucket", "kind")
    first = cut(deal(pairs.mapInArrow(_anchor_records(length, gram, buckets), schema)).mapInArrow(_count(buckets, hot), schema))
    splitters = _splitters(first.where(F.col("kind") == SAMPLE), buckets.ranges)
    # One exchange of the texts serves both joins with them.
    texts = pairs.withColumn("bucket", doc_bucket(F.col("doc"), buckets.docs)).repartition(buckets.parts, "bucket").groupBy("bucket")
    covers = texts.cogroup(first.where(F.col("kind") == OPEN).groupBy("bucket")).applyInArrow(_covers(length, gram, buckets, splitters), schema)
    removed = deal(covers).mapInArrow(_sorted_ranges(length, buckets), schema)
    return texts.cogroup(removed.groupBy("bucket")).applyInArrow(_kept(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


#: DuckDB SQL for the query's rows: every 100-byte string of every text, as hexadecimal digits.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, c, substr(h, 400 * c + 1, 598) as h from (select doc_id, h, unnest(range(0, length(h) // 400 + 1)) as c from d)),
s as (select doc_id, 200 * c + j as i, substr(h, 2 * j + 1, 200) as s from (select *, unnest(range(0, least(200, greatest(0, length(h) // 2 - 99)))) as j from c)),
g as (select s, min(struct_pack(d := doc_id, i := i)) as first from s group by s having count(*) > 1),
r as (select doc_id, i from s join g using (s) where struct_pack(d := doc_id, i := i) > first),
m as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from r),
n as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from m),
runs as (select doc_id, run, min(i) as a, max(i) + 100 as b from n group by all),
gaps as (select *, coalesce(lag(b) over (partition by doc_id order by a), 0) as since from runs),
cut as (select doc_id, sum(b - a) as removed, count(*) as spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' order by a) as kept, max(b) as last from gaps join d using (doc_id) group by 1)
select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
  sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
from d left join cut using (doc_id)
"""
