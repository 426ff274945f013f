"""Vector best-fit packing of tokenised documents.

A piece's demands (tokens, one document, attention cost length squared) follow from its length, so the plan needs only
the counts of each length: at most ``capacity`` numbers. Bins are filled one pattern at a time; each step takes the
length that fits every residual capacity and scores best; a pattern is repeated as often as the counts allow. Pieces
get their places by their rank among pieces of their length.
"""

from __future__ import annotations

import math
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from queuelens.llm import mixing
from queuelens.llm.common import cut, table, text_or_empty

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a worker keeps, and the longest word that is kept.
MEMO_WORDS, MEMO_CHARS = 900_000, 64
_memo: dict[str, bytes] = {}
_tokenizers: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        _memo.clear()
    return _tokenizers[path]


@cache
def _word_ends(path: str) -> np.ndarray:
    """Which ids end a word."""
    vocabulary = _tokenizer(path).get_vocab(with_added_tokens=False)
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
    return out


def word_ids(words: list[str], path: str) -> list[bytes]:
    """Ids of words without white space, as little-endian 32-bit numbers; each distinct word is tokenised once."""
    tok = _tokenizer(path)
    if len(_memo) > MEMO_WORDS:
        _memo.clear()
    new = [w for w in words if w not in _memo]
    plain = [w for w in new if w.isascii() and w.isalpha()]
    got: dict[str, bytes] = {}
    for at in range(0, len(plain), 20_000):  # a word of letters ends with one id that ends a word
        some = plain[at : at + 20_000]
        ids = np.array(tok.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
        raw, ends = ids.tobytes(), (4 * (np.flatnonzero(_word_ends(path)[ids]) + 1)).tolist()
        got.update((w, raw[a:b]) for w, a, b in zip(some, [0, *ends], ends, strict=False))
    rest = [w for w in new if w not in got]
    for at in range(0, len(rest), 20_000):
        some = rest[at : at + 20_000]
        for w, e in zip(some, tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
            got[w] = array("I", e.ids).tobytes()
    out = [got[w] if w in got else _memo[w] for w in words]
    _memo.update((w, b) for w, b in got.items() if len(w) <= MEMO_CHARS)
    return out


def _prepared(texts: pa.Array) -> pa.Array:
    """Texts with their ASCII letters in lower case and a space before the punctuation that ends a word: the tokenizer
    does the one and cuts at the other itself. Texts with combining marks or special tokens stay as they are."""
    texts = texts.cast(pa.string())  # of sliced large strings, ascii_lower reads the wrong bytes
    simpler = pc.replace_substring_regex(pc.ascii_lower(texts), r"([0-9a-z])([!-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3")
    odd = pc.or_(pc.match_substring_regex(texts, r"\p{M}"), pc.match_substring(texts, "<|"))
    return pc.if_else(odd, texts, simpler) if pc.any(odd).as_py() else simpler


def tokenise(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in one array, each text's followed by END_ID, and the ends of the texts in it."""
    words = pc.ascii_split_whitespace(_prepared(texts))
    coded = words.flatten().dictionary_encode()
    known = word_ids(coded.dictionary.to_pylist(), path)
    lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), "<u4")
    which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n_words = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    count = lengths[which]
    ends = np.concatenate([[0], count.cumsum()])[n_words.cumsum()] if len(n_words) else np.empty(0, np.int64)
    first = np.concatenate([[0], lengths.cumsum()])[:-1]
    at = np.repeat(first[which] - (count.cumsum() - count), count) + np.arange(count.sum())
    ids = np.full(len(at) + len(ends), END_ID, "<u4")
    docs = np.arange(len(ends))
    ids[np.arange(len(at)) + np.repeat(docs, np.diff(ends, prepend=0))] = flat[at]
    return ids, ends + docs + 1


def _pieces(path: str, capacity: int, with_ids: bool, carry: tuple[str, ...] = (), chunk: int = 1500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), chunk):
                batch = whole.slice(at, chunk)
                ids, ends = tokenise(batch.column(1), path)
                rows, begin = [], 0
                for i, end in enumerate(ends.tolist()):
                    for piece, s in enumerate(range(begin, end, capacity)):
                        part = ids[s : min(s + capacity, end)]
                        rows.append((i, piece, s - begin, len(part), zlib.crc32(part.tobytes()), part if with_ids else None))
                    begin = end
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                arrays = [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:5])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    arrays.append(pa.array([x.astype(np.int64) for x in cols[5]], pa.list_(pa.int64())))
                    names.append("ids")
                arrays += [batch.column(2 + i).take(pa.array(cols[0], pa.int64())) for i in range(len(carry))]
                names += carry
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids of every document's pieces, and whole numbers in
    ``carry`` as their document has them."""
    pairs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), *[F.col(c).cast("long").alias(c) for c in carry])
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * with_ids + "".join(f", {c} long" for c in carry)
    return pairs.mapInArrow(_pieces(path or default_vocabulary(), capacity, with_ids, carry), schema)


def best_fit_patterns(
    counts: np.ndarray, capacities: tuple[float, float, float], weights: tuple[float, float, float] = (1.0, 0.05, 0.05), rule: str = "norm"
) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, pieces of it in a bin)]) of a packing of counts[length] pieces of each length.

    A bin takes the longest piece left first; then, of the lengths that fit under every residual capacity, the one
    with the least weighted norm of what stays free ("norm") or the largest weighted dot product of its demands with
    the residual capacities ("dot"), until none fits.
    """
    caps, w = np.array(capacities, float), np.array(weights, float)
    left = np.asarray(counts, dtype=np.int64).copy()
    lengths = np.flatnonzero(left)
    out = []
    while len(lengths):
        demand = np.stack([lengths, np.ones(len(lengths)), lengths.astype(float) ** 2], axis=1) / caps
        free, have = np.ones(3), left[lengths]
        used: dict[int, int] = {}
        pick = len(lengths) - 1
        if (demand[pick] > free + 1e-12).any():
            raise ValueError(f"a piece of {lengths[pick]} tokens exceeds a capacity")
        while pick >= 0:
            used[pick] = used.get(pick, 0) + 1
            free = free - demand[pick]
            top = int(np.searchsorted(lengths, free[0] * caps[0] + 1e-6, side="right"))
            fits = (demand[:top] <= free + 1e-12).all(axis=1) & (have[:top] > 0)
            for i, c in used.items():
                if i < top and have[i] <= c:
                    fits[i] = False
            if not fits.any():
                break
            value = -(((free - demand[:top]) ** 2) @ w) if rule == "norm" else demand[:top] @ (w * free)
            pick = int(np.flatnonzero(fits)[np.argmax(value[fits])])
        bins = min(int(have[i]) // c for i, c in used.items())
        out.append((bins, [(int(lengths[i]), c) for i, c in sorted(used.items(), reverse=True)]))
        for i, c in used.items():
            left[lengths[i]] -= bins * c
        if (left[lengths] == 0).any():
            lengths = lengths[left[lengths] > 0]
    return out


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces in a bin, offset in the bin), sorted."""
    rows, rank, bin0 = [], {}, 0
    for bins, inside in patterns:
        offset = 0
        for length, c in inside:
            at = rank.get(length, 0)
            rows.append((length, at, bin0, c, offset))
            rank[length] = at + bins * c
            offset += length * c
        bin0 += bins
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


class StreamPlaces:
    """Places of pieces that keep the order of a stream: the bins of each pattern are spread evenly over the stream, bin
    i of b at (i + 1/2) / b, and each length's pieces go to its bins in this order."""

    def __init__(self, patterns: list[tuple[int, list[tuple[int, int]]]]) -> None:
        self.bins = np.array([b for b, _ in patterns], np.int64)
        self.bin0 = self.bins.cumsum() - self.bins
        self.holding: dict[int, list[tuple[int, int, int]]] = {}
        for p, (_, inside) in enumerate(patterns):
            offset = 0
            for length, c in inside:
                self.holding.setdefault(length, []).append((p, c, offset))
                offset += length * c

    def of(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset) of a length's pieces of these ranks; only bins near the ranks are laid out."""
        p, c, offset = (np.array(x, np.int64) for x in zip(*self.holding[length], strict=True))
        bins = self.bins[p]
        n, slack = int((bins * c).sum()), int(c.sum())
        low, high = (int(ranks.min()) - slack) / n, (int(ranks.max()) + 1 + slack) / n
        first = np.clip(np.ceil(low * bins - 0.5).astype(np.int64), 0, bins)
        last = np.clip(np.floor(high * bins - 0.5).astype(np.int64) + 1, first, bins)
        which = np.repeat(np.arange(len(p)), last - first)
        i = np.arange(len(which)) - np.repeat((last - first).cumsum() - (last - first), last - first) + first[which]
        order = np.lexsort((p[which], (2 * i + 1) / bins[which]))
        which, i = which[order], i[order]
        ends = int((first * c).sum()) + c[which].cumsum()
        at = np.searchsorted(ends, ranks, side="right")
        inside = ranks - (ends[at] - c[which[at]])
        return self.bin0[p[which[at]]] + i[at], offset[which[at]] + inside * length


def pack(
    rows: DataFrame, capacity: int = CAPACITY, max_docs: int = CAPACITY, max_attention: int | None = None, rule: str = "norm", cell_rows: int = 250_000, stream: tuple[str, ...] = ()
) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...): at most ``capacity`` tokens, ``max_docs``
    pieces and ``max_attention`` summed squares of lengths in a sequence. With ``stream``, columns of whole numbers whose
    order is a stream's, sequences are numbered along the stream and hold pieces that stand near each other in it."""
    rows = cut(rows)
    hist = {r.length: r.n for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in hist.items():
        counts[length] = n
    patterns = best_fit_patterns(counts, (capacity, max_docs, max_attention or capacity**2), rule=rule)
    places = _places(patterns)
    key = (places[:, 0] << 44) | places[:, 1]
    # Ranks in two steps, so that no task holds all pieces of a common length.
    bits = max(6, math.ceil(math.log2(max([1, *hist.values()]) / cell_rows + 1)))
    h = F.xxhash64("doc_id", "piece")
    cell = F.shiftrightunsigned("h", 64 - bits)
    if stream:  # blocks of the stream are of equal size, so that equal ranges of it are even cells
        end = (rows.agg(F.max(stream[0])).first()[0] or 0) + 1
        cell = F.floor(F.col(stream[0]) * (1 << bits) / end)
    rows = rows.withColumn("h", h).withColumn("cell", cell)
    cells = rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1))
    cells = cells.select("length", "cell", F.coalesce(before, F.lit(0)).alias("before"))
    in_cell = W.partitionBy("length", "cell").orderBy(*stream, "h", "doc_id", "piece", "start", "ids_crc32")
    rows = rows.withColumn("rank", F.row_number().over(in_cell)).join(cells, ["length", "cell"])
    columns = [c for c in rows.columns if c not in ("h", "cell", "rank", "before")]
    rows = rows.select(*columns, (F.col("before") + F.col("rank") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            p = places[np.searchsorted(key, (length << 44) | rank, side="right") - 1] if len(b) else places[:0]
            inside = rank - p[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in columns), pa.array(p[:, 2] + inside // np.maximum(p[:, 3], 1)), pa.array(p[:, 4] + inside % np.maximum(p[:, 3], 1) * length)],
                names=[*columns, "sequence_id", "offset"],
            )

    along = StreamPlaces(patterns)

    def place_along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            bins, offsets = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            order = np.lexsort((rank, length))
            for some in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(b) else ():
                bins[some], offsets[some] = along.of(int(length[some[0]]), rank[some])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(bins), pa.array(offsets)], names=[*columns, "sequence_id", "offset"])

    if not stream:
        schema = rows.drop("rank").schema.simpleString()[7:-1]
        return rows.mapInArrow(place, f"{schema},sequence_id:bigint,offset:bigint")
    schema = rows.drop("rank").schema.simpleString()[7:-1]
    placed = cut(rows.mapInArrow(place_along, f"{schema},sequence_id:bigint,offset:bigint"))
    # Sequences are numbered by the mean place of their tokens, in two steps as well.
    mean = (F.sum(F.col(stream[0]) * F.col("length")) / F.sum("length")).alias("mean")
    bins = placed.groupBy("sequence_id").agg(mean).withColumn("cell", F.floor(F.col("mean") * (1 << bits) / end))
    cells = bins.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.select("cell", F.coalesce(F.sum("n").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.row_number().over(W.partitionBy("cell").orderBy("mean", "sequence_id")) + F.col("before") - 1
    bins = bins.join(cells, "cell").select("sequence_id", number.cast("long").alias("number"))
    return placed.join(bins, "sequence_id").select(*[c for c in columns if c not in stream], F.col("number").alias("sequence_id"), "offset")


def best_fit_pack(docs: DataFrame, path: str | None = None, with_ids: bool = False, **limits) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Null text counts as empty and gives a piece of the end id alone; null ids and repeated rows are packed like others;
    an empty table gives no rows; other columns are not read. Only documents beyond the capacity are cut.
    """
    return pack(pieces(docs, path, limits.get("capacity", CAPACITY), with_ids), **limits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences along the mixed stream: files keep no order, so the documents' slots in it are computed again."""
    mixed = mixing.pfair_mix(docs, carry=("doc_id", "text")).select("row.doc_id", "row.text", "slot", "in_block")
    return pack(pieces(mixed, carry=("slot", "in_block")), stream=("slot", "in_block"))
