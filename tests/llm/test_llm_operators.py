"""Small cases against brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from queuelens.llm import licenses, media, mixing, ngram_join, packing, pii, quality, sharding, suffix_dedup, topk, webp

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the", "and", "thnd", "ereha", "Is", "onre", "tion", "é", "ñoça", "12", "x.", "re,")


def make_texts(seed=3, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(WORDS) + rng.choice(("", "a", "en", "st", "ou"))
    passage = " ".join(word() for _ in range(50))
    texts = [None, "", " ", "a", "a b", "\t\n", "x" * 5000, "ab " * 3000, " ".join(word() for _ in range(30_000))]
    while len(texts) < n:
        base = [word() for _ in range(rng.choice((3, 20, 60, 200)))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            near = list(base)
            for _ in range(max(1, len(near) // rng.choice((40, 15, 60)))):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near))
        if rng.random() < 0.4:
            texts.append(f"{word()} {passage} {word()}")
        if rng.random() < 0.3:
            texts.append(rng.choice([t for t in texts if t]))
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = make_texts()
    return [(i * 3 + 1, t, "en", None if i % 7 == 0 else f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"lang": "key", "n_chars": "size"}).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids."""
    return spark.createDataFrame([(None, "a b c d e", "en", "s", 1), (5, "a b c d e", None, None, None), (5, "a b c d e", None, None, None), (None, None, None, None, None)], SCHEMA)


def shingles(text, n):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_components(rows, bound):
    sets = {r[0]: shingles(r[1], bound.n) for r in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if bound.den * both >= bound.num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("bound", [ngram_join.Bound(), ngram_join.Bound(n=5, num=80), ngram_join.Bound(n=1, num=70)])
@pytest.mark.parametrize("tile", [512, 6])
def test_ngram_join(docs, rows, bound, tile):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(docs, bound, tile=tile).collect()}
    assert got == brute_components(rows, bound)


def test_ngram_join_recall_of_all_sizes(spark):
    """Texts of 54 to 420 words with edits around both bounds, in clusters and alone: no link is lost."""
    rng = random.Random(9)
    rows = []
    for i in range(45):
        base = [f"w{rng.randrange(4000)}" for _ in range(54 + i * 8)]
        for edits in (0, len(base) // 60 + 1, len(base) // 40, len(base) // 25, len(base) // 12):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(len(near))] = rng.choice(("and", "the", f"x{rng.randrange(9999)}"))
            rows.append((len(rows), " ".join(near[: len(near) - rng.randrange(4)]), "en", "s", 1))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for bound in (ngram_join.Bound(), ngram_join.NEAR):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_components(df, bound).collect()}
        assert got == brute_components(rows, bound)


def test_trie_finds_all_links():
    """Against all pairs, for sets that share runs in any part of the order, with shingles of their own beside."""
    rng = np.random.default_rng(5)
    for bound in (ngram_join.Bound(), ngram_join.Bound(n=5, num=80), ngram_join.Bound(n=1, num=50)):
        for _ in range(40):
            base = rng.permutation(400)[: int(rng.integers(2, 200))]
            sets = [np.unique(np.append(base[rng.random(len(base)) > rng.choice((0.01, 0.05, 0.1, 0.3))], rng.integers(0, 400, int(rng.integers(0, 4))))) for _ in range(30)]
            sets = [s for s in sets if len(s)]
            sizes = [len(s) + int(rng.integers(0, 3)) for s in sets]
            got = set(ngram_join.Trie(sets, sizes).probe(sets, sizes, 400, bound))
            both = {(i, j): len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets)}
            assert got == {(i, j) for (i, j), n in both.items() if bound.den * n >= bound.num * (sizes[i] + sizes[j] - n)}


def test_ngram_join_odd(odd, empty):
    assert ngram_join.ngram_jaccard_components(empty).collect() == []
    got = sorted(map(str, (tuple(r) for r in ngram_join.ngram_jaccard_components(odd).collect())))
    assert got == sorted(map(str, [(None, 3, None), (None, 0, None), (5, 3, None), (5, 3, None)]))
    assert ngram_join.stage(None, odd, "").count() == 2  # rows with the least id of their component


def brute_repeats(rows, length):
    seen, out = set(), {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        left = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[doc] = (len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


@pytest.mark.parametrize(("length", "gram", "hot"), [(100, 48, 5000), (20, 8, 3)])
def test_suffix_dedup(docs, rows, length, gram, hot):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs, length, gram, hot=hot).collect()}
    assert got == brute_repeats(rows, length)


def test_suffix_dedup_long_texts():
    """A text beyond a chunk has each of its strings in one part."""
    text = np.random.default_rng(1).integers(97, 100, suffix_dedup.CHUNK * 2 + 500).astype(np.uint8).tobytes()
    found = 0
    for texts, _, _begin in suffix_dedup._pieces(np.array([1]), [text], 100):
        found += int((suffix_dedup.anchors(texts, 100, 48)[4] + 1).sum())
    assert found == len(text) - 99


def test_equal_strings():
    """Multikey quicksort against a dictionary, strings that differ late and early."""
    rng = np.random.default_rng(2)
    raw = np.concatenate([np.tile(rng.integers(97, 99, 60), 3), rng.integers(97, 99, 400)]).astype(np.uint8)
    for length in (3, 8, 20, 41):
        at = rng.permutation(len(raw) - length)
        group = at % 2
        index, same = suffix_dedup.equal_strings(raw, at, length, group)
        want = defaultdict(set)
        for i, p in enumerate(at.tolist()):
            want[group[i], raw[p : p + length].tobytes()].add(i)
        got = defaultdict(set)
        for i, g in zip(index.tolist(), same.tolist(), strict=True):
            got[g].add(i)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_suffix_dedup_odd(odd, empty, spark):
    assert suffix_dedup.remove_repeats(empty).collect() == []
    same = spark.createDataFrame([(None, "q" + "z" * 150), (4, "q" + "z" * 150), (4, "q" + "z" * 150)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(same).collect())
    assert got == [("4", 151, 1), ("4", 151, 1), ("None", 149, 1)]


def test_webp_round_trip(docs, rows):
    got = {r.doc_id: r for r in media.media_digests(media.to_media(docs)).collect()}
    for doc, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


def test_webp_writer_chooses():
    """Pictures, few colours, repeats and noise: each round trip, through both decoders, and what the writer chose."""
    rng = np.random.default_rng(1)
    y, x = np.mgrid[:50, :70]
    words = ["".join(rng.choice(list("etaoinshrdlucmf"), int(rng.integers(2, 9)))) for _ in range(300)]
    text = np.frombuffer(" ".join(words[min(299, int(rng.zipf(1.3)))] for _ in range(6000)).encode()[: 64 * 3 * 80].ljust(64 * 3 * 90), np.uint8).reshape(90, 64, 3)
    cases = [
        (np.stack([x * 2, y * 3, x + y], -1) % 256, {webp.PREDICTOR}),
        (np.stack([x * 2, x * 2 + rng.integers(0, 2, x.shape), x * 2], -1) % 256, None),
        (rng.integers(0, 256, (40, 33, 3)), set()),
        (rng.integers(0, 2, (20, 30, 1)).repeat(3, 2) * 255, {webp.PALETTE}),
        (rng.integers(0, 14, (20, 30, 1)).repeat(3, 2) * 7, {webp.PALETTE}),
        (rng.integers(0, 200, (60, 60, 1)).repeat(3, 2), {webp.PALETTE}),
        (np.full((5, 5, 3), 7), None),
        (np.zeros((1, 1, 3), int), None),
        (text, set()),
    ]
    for pixels, kinds in cases:
        image = np.full((*pixels.shape[:2], 4), 255, np.uint8)
        image[..., 1:] = pixels
        file = webp.encode(image)
        r = webp.Reader(webp._payload(file))
        undo = webp._transforms(r, *webp._head(r))[1]
        assert kinds is None or {u[0] for u in undo} >= kinds and (kinds or not undo)
        assert np.array_equal(webp.decode(file), image)
        assert all(np.array_equal(p, image[..., 1:].reshape(-1, 3)) for p in webp.decode_many([file, file]))
    r = webp.Reader(webp._payload(file))
    webp._transforms(r, *webp._head(r))
    assert r.bits(1) and len(file) < 0.5 * text.size  # the text has a colour cache, and its padding is a back-reference
    image[..., 0] = 9
    assert np.array_equal(webp.decode(webp.encode(image)), image)


def test_code_lengths_are_complete():
    rng = np.random.default_rng(4)
    for _ in range(400):
        counts = (rng.pareto(rng.uniform(0.2, 2), int(rng.integers(2, 600))) * 10).astype(np.int64) * (rng.random() < 0.9)
        lengths = webp.code_lengths(counts)
        used = np.flatnonzero(counts)
        assert (lengths[np.flatnonzero(counts == 0)] == 0).all()
        if len(used) > 1:
            assert lengths[used].min() >= 1 and lengths.max() <= webp.TABLE_BITS and (2.0 ** -lengths[used]).sum() == 1


def test_pixel_arrays(docs, rows):
    got = {r.doc_id: r for r in media.pixel_arrays(media.to_media(docs)).collect()}
    for doc, text, *_ in rows:
        assert got[doc].pixels == media.payload_of(text or "") and got[doc].width * got[doc].height * 3 == len(got[doc].pixels)


def test_media_odd(odd, empty):
    assert media.media_digests(media.to_media(empty)).collect() == []
    got = media.media_digests(media.to_media(odd)).collect()
    assert len(got) == 4 and len({r.media_sha256 for r in got if r.n_bytes}) == 1


def test_webp_files_side_by_side():
    """Images that are written together have the files that each has alone, also one of few symbols beside large ones."""
    rng = np.random.default_rng(5)
    images = []
    for i in range(300):
        h, w = rng.integers(1, 20), rng.integers(1, 70)
        rgb = (rng.integers(0, (2, 90, 256)[i % 3], (h, w, 3)) if i % 4 else np.full((h, w, 3), i % 251)).astype(np.uint8)
        rgb.reshape(-1)[rgb.size // 2 : rgb.size // 2 * 2] = rgb.reshape(-1)[: rgb.size // 2]  # back-references
        images.append(np.concatenate([np.full((h, w, 1), 255, np.uint8), rgb], axis=2))
    files = webp.encode_many(images)
    assert files == [webp.encode(i) for i in images]
    assert all(np.array_equal(p, i[..., 1:].reshape(-1, 3)) for p, i in zip(webp.decode_many(files), images, strict=True))
    assert all(np.array_equal(webp.decode(f), i) for f, i in zip(files[:40], images, strict=False))


def test_webp_code_lengths_of_many():
    rng = np.random.default_rng(6)
    counts = np.array([rng.integers(0, 3, 60) * 2 ** rng.integers(0, 18, 60) * (rng.random(60) < i / 50) for i in range(80)])
    assert np.array_equal(webp.code_lengths_of(counts), np.array([webp.code_lengths(c) for c in counts]))


class FullWriter(webp.Writer):
    """Writes streams with every feature of the format, with flat prefix codes."""

    def codes(self, cache_bits):
        self.alphabets = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
        self.made = []
        for n in self.alphabets:
            length = int(np.ceil(np.log2(n)))
            short = (1 << length) - n  # so many codes are a bit shorter
            lengths = np.array([length - 1] * short + [length] * (n - short))
            self.made.append((lengths, webp.canonical(lengths)))
            self.put(0, 1)
            self.put(15 - 4, 4)
            for s in webp.LENGTH_ORDER[:15]:
                self.put(3 if 3 <= s <= 10 else 0, 3)
            self.put(0, 1)
            cl = webp.canonical(np.array([3 if 3 <= s <= 10 else 0 for s in range(19)]))
            for x in lengths:
                self.put(cl[x], 3)

    def symbol(self, code, s):
        lengths, codes = self.made[code]
        self.put(codes[s], int(lengths[s]))

    def extended(self, value):
        """(symbol, extra value, extra bits) of a length or distance code's value."""
        for s in range(40):
            extra = 0 if s < 4 else (s - 2) >> 1
            least = s + 1 if s < 4 else ((2 + (s & 1)) << extra) + 1
            if least <= value < least + (1 << extra):
                return s, value - least, extra
        raise AssertionError

    def pixels(self, argb, width, cache_bits=0, main=False, references=False):
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        self.codes(cache_bits)
        kept, i = {}, 0
        slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)
        while i < len(argb):
            run = 0
            if references and i >= width:
                while i + run < len(argb) and run < 4000 and argb[i + run] == argb[i + run - width]:
                    run += 1
            if run >= 3:
                s, extra, bits = self.extended(run)
                self.symbol(0, 256 + s)
                self.put(extra, bits)
                near = webp.distance_map().index((0, 1)) + 1 if i % 2 else width + 120
                s, extra, bits = self.extended(near)
                self.symbol(4, s)
                self.put(extra, bits)
            else:
                run, p = 1, argb[i]
                if cache_bits and kept.get(slot(p)) == p:
                    self.symbol(0, 280 + slot(p))
                else:
                    self.symbol(0, p >> 8 & 255)
                    for code, shift in ((1, 16), (2, 0), (3, 24)):
                        self.symbol(code, p >> shift & 255)
            for p in argb[i : i + run]:
                if cache_bits:
                    kept[slot(p)] = p
            i += run


def numbers(image):
    return np.ascontiguousarray(image).view(">u4").reshape(-1).tolist()


@pytest.mark.parametrize("mode", range(14))
def test_webp_decoder_transforms(mode):
    rng = np.random.default_rng(mode)
    h, w, bits = 9, 13, 2
    image = (rng.integers(0, 256, (h, w, 4)) // 60 * 60).astype(np.uint8)
    image[4:] = image[:5]
    th, tw = -(-h // 4), -(-w // 4)
    tiles = rng.integers(0, 256, (th, tw, 4)).astype(np.uint8)
    modes = np.zeros((th, tw, 4), np.uint8)
    modes[..., 2] = mode
    x = FullWriter()
    webp._start(x, w, h, True)
    coded = image.copy()
    x.put(1, 1)
    x.put(webp.SUBTRACT_GREEN, 2)
    coded[..., 1] -= coded[..., 2]
    coded[..., 3] -= coded[..., 2]
    x.put(1, 1)
    x.put(webp.CROSS_COLOUR, 2)
    x.put(bits - 2, 3)
    x.pixels(numbers(tiles), tw)
    coded = webp.cross_coloured(coded, tiles[..., [3, 2, 1]], bits, forward=True)
    x.put(1, 1)
    x.put(webp.PREDICTOR, 2)
    x.put(bits - 2, 3)
    x.pixels(numbers(modes), tw)
    coded = webp.predicted(coded, modes[..., 2], bits, forward=True)
    x.put(0, 1)
    x.pixels(numbers(coded), w, cache_bits=mode % 4, main=True, references=True)
    file = webp._riff(x.bytes())
    assert (webp.decode(file) == image).all()
    assert (webp.decode_many([file])[0] == image[..., 1:].reshape(-1, 3)).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 9, 16, 17, 200])
def test_webp_decoder_palette(colours):
    rng = np.random.default_rng(colours)
    h, w = 7, 11
    palette = rng.integers(0, 256, (colours, 4)).astype(np.uint8)
    index = rng.integers(0, colours, (h, w))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    each = 8 >> bits
    across = (w + (1 << bits) - 1) >> bits
    bundled = np.zeros((h, across), np.int64)
    for i in range(w):
        bundled[:, i >> bits] |= index[:, i] << (i % (1 << bits) * each)
    x = FullWriter()
    webp._start(x, w, h, True)
    x.put(1, 1)
    x.put(webp.PALETTE, 2)
    x.put(colours - 1, 8)
    x.pixels(numbers(np.diff(palette.astype(np.int64), axis=0, prepend=0).astype(np.uint8)), colours)
    x.put(0, 1)
    x.pixels([int(b) << 8 | 0xFF000000 for b in bundled.reshape(-1)], across, main=True)
    assert (webp.decode(webp._riff(x.bytes())) == palette[index]).all()


def brute_top_k(vectors, queries, k):
    ints = {i: np.floor(64 * np.array(v, float)).astype(int) for i, v in vectors}
    out = []
    for q in queries:
        scored = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    same = rng.normal(size=8) * 0.3
    vectors = [(i, (same if i % 3 == 0 else rng.normal(size=8) * 0.3).astype(np.float32).tolist()) for i in range(200)]
    bad = [(300, None), (320, [1.0, None] * 4), (340, [float("nan")] * 8), (360, [float("inf")] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame(vectors + bad + vectors[:5], "vec_id long, embedding array<float>").withColumnRenamed("x", "y")
    got = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), k=20, chunk=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top_k(vectors, range(0, 200, 20), 20)
    few = df.where("vec_id < 7")
    assert sorted(tuple(r) for r in topk.exact_top_k(few, few.where("vec_id = 0")).collect()) == brute_top_k(vectors[:7], [0], 20)
    none = df.where("vec_id < 0")
    assert topk.exact_top_k(none, none).collect() == []
    large = spark.createDataFrame([(0, [1e6, -2e6]), (1, [3e6, 1e6]), (2, [5e5])], "vec_id long, embedding array<double>")
    huge = spark.createDataFrame([(0, [5e7, 1.0]), (1, [5e7, 2.0]), (2, [-1e300, 0.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    top = [(r.vec_id, r.score) for r in topk.exact_top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()]
    assert top == [(1, topk.LIMIT), (3, topk.LIMIT), (2, -topk.LIMIT)]
    assert [r.score for r in topk.exact_top_k(large, large.where("vec_id = 0")).orderBy("rank").collect()] == [4096 * 10**12, 4096 * 5 * 10**11]


def reference_base(text):
    """The four base patterns as they are stated, by re alone."""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(digits(m[0])) <= 15:
            out.append((m.start(), "phone", m.end()))
    return out


def test_pii_base_matches_the_patterns():
    rng = random.Random(4)
    for _ in range(4000):
        text = "".join(rng.choice(("a", "Z", "@", ".", "-", "+", " ", "0", "1", "4", "25", "255", "4111 1111 1111 1111", "a@b.co", "é", "(", "%", "+44 20 7946 0958", "4242424242424242")) for _ in range(rng.randrange(25)))
        assert pii._ordered(pii.base_spans(text)) == pii._ordered(reference_base(text)), text


def test_pii_long_runs():
    text = "1.1.1." + "0" * 5000 + "1"
    assert pii.base_spans(text) == [(0, "ip", len(text))]
    begin = time.perf_counter()
    assert pii.base_spans("." + "1" * 400_000 + " 1.2.3.4") == [(400_002, "ip", 400_009)]
    assert time.perf_counter() - begin < 5


def test_pii(odd, empty, spark):
    text = "write to ann@ex-ample.org or +1 (212) 555-0199; IBAN GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, 10.0.0.256, é 4111-1111-1111-1111"
    df = spark.createDataFrame([(1, text, 0), (2, None, 0)], "doc_id long, text string, spans int")
    r, n = pii.find_pii(df).orderBy("doc_id").collect()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 0, 1, 1)
    assert [s.split(":")[0] for s in r.spans.split(",")] == ["email", "phone", "iban", "ssn", "card"]
    assert n.spans == "" and n.base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(empty).collect() == [] and pii.find_pii(odd).count() == 4
    masked = pii.stage(spark, df, "").orderBy("doc_id").collect()
    assert masked[0].text.count("[") == 5 and "@" not in masked[0].text and masked[1].text is None


def test_quality(docs, empty, odd, spark):
    good = [(i, " ".join(["thnd ereha onre"] * (i % 9 + 2)) + ".", "en", "s", 1) for i in range(200)]
    bad = [(200 + i, "THND!! EREHA!! $$$ ### " * (i % 9 + 2), "en", "s", 1) for i in range(100)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 300)] + [(3, 0), (4, None), (None, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.score_documents(df, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    wrong = [d for d, r in out.items() if r.predicted != int(d < 200)]
    assert len(wrong) <= 3 and all(0 <= r.score <= 1 for r in out.values())
    assert quality.score_documents(empty, labels).collect() == []
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.score_documents(docs, labels).count() == docs.count()


def test_quality_against_the_density(spark):
    """Scores against class densities worked out from covariances, determinants and solved systems, and held-out accuracy."""
    rng = random.Random(8)
    kinds = ("thnd", "ereha", "onre"), ("$$$", "THND!!", "&&&", "thnd", "9")
    rows = [(i, " ".join(rng.choice(kinds[i % 3 == 0]) + rng.choice(("", ".", "a")) for _ in range(rng.randrange(1, 80))), "en", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    x = {i: quality.statistics(t) for i, t, *_ in rows}
    train = [i for i in x if zlib.crc32(str(i).encode()) % 5]
    every = np.array([x[i] for i in train])
    centre, scale = every.mean(axis=0), np.sqrt(np.maximum(every.var(axis=0), 1e-9))
    z = {i: (v - centre) / scale for i, v in x.items()}
    log = {}
    for c in (0, 1):
        own = np.array([z[i] for i in train if int(i % 3 > 0) == c])
        cov = np.cov(own.T, bias=True)
        cov = 0.9 * cov + 0.1 * max(np.trace(cov) / len(cov), 1e-3) * np.eye(len(cov))
        gap = {i: v - own.mean(axis=0) for i, v in z.items()}
        log[c] = {i: np.log(len(own) / len(train)) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * g @ np.linalg.solve(cov, g) for i, g in gap.items()}
    margin = {i: log[1][i] - log[0][i] for i in x}
    loss = {t: np.mean([np.logaddexp(0, -margin[i] / t if i % 3 else margin[i] / t) for i in train]) for t in (1, 2, 4, 8, 16)}
    t = min(loss, key=loss.get)
    got = {r.doc_id: r.score for r in quality.score_documents(df, labels).collect()}
    for i, m in margin.items():
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(m / t, -700, 700)))) < 1e-4
    held = [i for i in x if i not in train]
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.9


def test_packing(docs, rows, empty, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = packing.best_fit_pack(docs, with_ids=True).collect()
    whole = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    got = defaultdict(dict)
    for r in out:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert list(r.ids) == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        got[r.doc_id][r.piece] = r.length
    for d, ids in whole.items():
        sizes = [got[d][i] for i in range(len(got[d]))]
        assert sum(sizes) == len(ids) and all(x == 4096 for x in sizes[:-1])
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for inside in bins.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) == -(-sum(map(len, whole.values())) // 4096) or len(bins) <= -(-sum(map(len, whole.values())) // 4096) + 1
    assert packing.best_fit_pack(empty).collect() == [] and packing.best_fit_pack(odd).count() == 4


def test_words_of_the_tokenizer():
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(9)
    parts = ("a", "B", "don't", "'s", "'", ".", "...", "é", "é", "J̌", "ß", "İ", "Σ", "12", "½", "_", "-", "<|endoftext|>", "<|", "|>", " ", " ", "\n", "\x0b", "\x1c", " ", "日本", "!", "́", "🙂")
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    ids, ends = packing.tokenise(pa.array(texts), path)
    begin = 0
    for t, e in zip(texts, ends.tolist(), strict=True):
        assert ids[begin:e].tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1], repr(t)
        begin = e


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(3)
    counts = np.zeros(101, np.int64)
    for length in rng.integers(1, 101, 60):
        counts[length] += int(rng.integers(1, 50))
    patterns = packing.best_fit_patterns(counts, (100, 7, 5000 * 2), rule=rule)
    seen = np.zeros(101, np.int64)
    for bins, inside in patterns:
        assert bins > 0 and sum(n * c for n, c in inside) <= 100 and sum(c for _, c in inside) <= 7 and sum(n * n * c for n, c in inside) <= 10_000
        for n, c in inside:
            seen[n] += bins * c
    assert (seen == counts).all()


@pytest.mark.parametrize("cell_rows", [None, 3])
def test_sharding(docs, rows, empty, odd, cell_rows):
    out = sharding.histogram_sort_shards(docs, shards=4, cell_rows=cell_rows, carry=("text",)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for inside in by.values():
        assert sorted(r.slot for r in inside) == list(range(len(inside)))
    most = max(r.size for r in out)
    total = sum(r.size for r in out)
    assert all(abs(sum(r.size for r in x) - total / 4) <= most for x in by.values())
    assert sharding.histogram_sort_shards(empty).collect() == [] and sharding.histogram_sort_shards(odd).count() == 4


def test_sharding_cuts_a_large_group(spark):
    df = spark.createDataFrame([(i, "same text" if i % 3 else f"text {i}") for i in range(3000)], "doc_id long, text string")
    out = sharding.histogram_sort_shards(df).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in out]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.05 * max(sizes)


def test_ngram_join_id_with_two_texts(spark):
    """A repeated id, one text of which is a copy and one near another document, links both."""
    x, y = (" ".join(f"{c}{i}" for i in range(300)) for c in "xy")
    near = y.replace("y150 ", "z ")
    for tile in (192, 1):
        df = spark.createDataFrame([(3, x), (7, x), (7, y), (9, near), (12, "other words that stand alone here")], "doc_id long, text string").repartition(3)
        got = {(r.doc_id, r.component_id) for r in ngram_join.ngram_jaccard_components(df, tile=tile).collect()}
        assert got == {(3, 3), (7, 3), (9, 3), (12, 12)}


@pytest.mark.parametrize("weights", [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{i}": 1 + i * i for i in range(19)}])
def test_pfair_is_within_a_block(weights):
    blocks = {s: 40 + 13 * i for i, s in enumerate(weights)}
    plan = mixing.phases(blocks, weights, 256)
    slots = {}
    for p in plan:
        for k in range(p["n"]):
            slot = p["slot0"] + k // p["q"] * p["d"] + p["slots"][k % p["q"]]
            assert slot not in slots
            slots[slot] = (p["src"], p["block0"] + k)
    assert sorted(slots) == list(range(sum(blocks.values())))
    assert Counter(s for s, _ in slots.values()) == blocks
    begin = min(p["slot0"] for p in plan)
    first = [p for p in plan if p["slot0"] == begin]
    length = min([p["slot0"] for p in plan if p["slot0"] > begin], default=len(slots))
    seen = Counter()
    for t in range(length):
        seen[slots[t][0]] += 1
        for p in first:
            assert abs(seen[p["src"]] - (t + 1) * p["q"] / p["d"]) < 1


@pytest.mark.parametrize("weights", [{"a": 1.0, "b": 1.0, "c": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9999, "b": 0.0001}, {f"s{i}": (1 + i) ** 0.5 for i in range(23)}])
def test_pfair_keeps_to_the_weights(weights):
    """However long a phase, each source stays less than a block from its weight itself."""
    total, n = sum(weights.values()), 60_000
    plan = mixing.phases({s: max(1, int(n * w / total)) for s, w in weights.items()}, weights, 1024)
    owner = {p["slot0"] + x: p["src"] for p in plan for x in p["slots"]}
    seen, left, t = Counter(), {s: max(1, int(n * w / total)) for s, w in weights.items()}, 0
    while all(left.values()):
        s = owner[t]
        seen[s] += 1
        left[s] -= 1
        t += 1
        assert all(abs(seen[x] - t * w / total) < 1 + 1e-9 for x, w in weights.items())
    assert t > 0.99 * n / len(weights)


@pytest.mark.parametrize("cell_rows", [250_000, 3])
def test_mixing(docs, rows, empty, odd, spark, cell_rows):
    out = mixing.pfair_mix(docs, {"s0": 3.0, "s1": 1.0, None: 0.5}, block_bytes=512, cell_rows=cell_rows).collect()
    assert sorted(r.row.doc_id for r in out) == sorted(r[0] for r in rows)
    at = defaultdict(set)
    for r in out:
        at[r.slot].add((r.src, r.block))
    assert all(len(x) == 1 for x in at.values())
    for s in {r.src for r in out}:
        order = sorted((r.block, r.slot) for r in out if r.src == s)
        assert [x[1] for x in order] == sorted(x[1] for x in order)
    assert mixing.pfair_mix(empty).collect() == [] and mixing.pfair_mix(odd).count() == 4
    assert mixing.stage(spark, docs, "").columns == docs.columns


def test_blocks_grow_so_that_the_plan_is_bounded(docs, rows):
    sources = len({r[3] if len(r) > 3 else None for r in rows}) + 1
    small, few = (mixing.pfair_mix(docs, block_bytes=64, max_blocks=n, carry=("doc_id",)).collect() for n in (1 << 20, 6))
    assert max(r.slot for r in small) > 6 + sources >= max(r.slot for r in few)
    assert sorted(r.row.doc_id for r in few) == sorted(r[0] for r in rows)


def test_mixing_against_a_plain_schedule(docs, rows, spark):
    """Blocks by bytes in the order of the ids' hashes, slots by earliest deadlines taken one at a time."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    weights = {"s0": 3.0, "s1": 1.0, "s2": 2.0, "s3": 1.0, None: 0.5}
    sources = defaultdict(list)
    for i, text, _, source, _ in rows:
        sources[source].append((hashes[i] & (2**64 - 1), i, len((text or "").encode()) + 1))
    place, blocks = {}, {}
    for source, mine in sources.items():
        at = 0
        for _, i, size in sorted(mine):
            place[i] = (source, at // 512, at % 512)
            at += size
        blocks[source] = -(-at // 512)
    slot_of, left, done, now = {}, dict(blocks), dict.fromkeys(blocks, 0), 0
    while any(left.values()):  # a phase goes on until a source has no blocks left
        alive = [s for s in left if left[s]]
        share = {s: Fraction(weights[s]) / sum(Fraction(weights[x]) for x in alive) for s in alive}
        begin, k = now, dict.fromkeys(alive, 0)
        while all(left[s] for s in alive):
            ready = [s for s in alive if int(k[s] / share[s]) <= now - begin]
            s = min(ready, key=lambda s: (-(-(k[s] + 1) // share[s]), "null" if s is None else f"={s}"))
            assert now - begin < -(-(k[s] + 1) // share[s])
            slot_of[s, done[s]] = now
            k[s], done[s], left[s], now = k[s] + 1, done[s] + 1, left[s] - 1, now + 1
    got = mixing.pfair_mix(docs, weights, block_bytes=512).collect()
    assert {r.row.doc_id: (r.block, r.in_block, r.slot) for r in got} == {i: (b, o, slot_of[s, b]) for i, (s, b, o) in place.items()}


def test_sharding_keeps_equal_texts_together(spark):
    df = spark.createDataFrame([(i, f"text {i % 700} " * (1 + i % 5)) for i in range(7000)], "doc_id long, text string").repartition(4)
    out = sharding.histogram_sort_shards(df, tolerance=0.05, carry=("text",)).collect()  # no group is over the tolerance
    shards = defaultdict(set)
    for r in out:
        shards[r.text].add(r.shard)
    assert all(len(x) == 1 for x in shards.values())
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    group = max(Counter({t: sum(r.size for r in out if r.text == t) for t in list(shards)[:50]}).values())
    assert max(sizes.values()) - min(sizes.values()) <= 3 * group


def test_licenses(spark, empty, odd):
    df = spark.createDataFrame(
        [
            (1, "Released under the MIT License.", "a/LICENSE"),
            (2, "code code", "a/b/c/x.py"),
            (3, "words here\nLicensed under the Apache License, Version 2.0.\nmore words " + "and words " * 30, "a/b/y.py"),
            (4, "code", "z/w.py"),
            (5, None, "a/b/n.py"),
            (6, "the license of this is under the version", "q/r.py"),
            (7, "All rights\nreserved.", "a/b/c/COPYING"),
            (8, "x", None),
        ],
        "doc_id long, text string, path string",
    )
    from pyspark.sql import functions as F

    got = {r.doc_id: (r.own_license, r.license, r.from_dir) for r in licenses.scan_licenses(df, F.col("path")).collect()}
    assert got == {
        1: ("MIT", "MIT", None),
        2: (None, "proprietary", "a/b/c"),
        3: ("Apache-2.0", "Apache-2.0", None),
        4: (None, None, None),
        5: (None, "MIT", "a"),
        6: (None, None, None),
        7: ("proprietary", "proprietary", None),
        8: (None, None, None),
    }
    assert licenses.scan_licenses(empty, F.col("source")).collect() == [] and licenses.scan_licenses(odd, F.col("source")).count() == 4


def test_license_segments_against_all_lines():
    """Segments without a key can't reach the threshold: scoring every line finds the same licence."""
    matcher = licenses.Matcher.of(1000, {w: 900 if w in ("the", "is", "of", "to", "and", "in", "by", "this", "a") else 20 for w in licenses.VOCABULARY})
    rng = random.Random(8)
    for _ in range(3000):
        line = [rng.choice(licenses.VOCABULARY + ["zzz"]) for _ in range(rng.randrange(1, 9))]
        if matcher.best(line)[0] >= licenses.THRESHOLD:
            assert matcher.keys.intersection(line)


def test_license_weights_come_from_all_texts(spark):
    """One text is found on a small and on a large table, and each score is the cosine by the frequencies of all words."""
    from pyspark.sql import functions as F

    notices = ["This project is released under the MIT License.", "Licensed under CC BY-NC 4.0. Photo: Anna.", "Released, as all of it was, under the old MIT License."]
    for n in (40, 4000):
        texts = notices + [("as all of it was old " if i % 2 else "") + f"this project is number {i}" for i in range(n)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r for r in licenses.scan_licenses(df, F.lit(None)).where("own_license is not null").collect()}
        assert {d: r.own_license for d, r in got.items()} == {0: "MIT", 1: "CC-BY-NC-4.0", 2: "MIT"}
        held = Counter(w for t in texts for w in set(licenses._WORD.findall(t.lower())))
        idf = {w: np.log((len(texts) + 1) / (held[w] + 1)) + 1 for w in {*held, *licenses.VOCABULARY}}
        a, b = ({w: c * idf[w] for w, c in Counter(licenses._WORD.findall(t.lower())).items()} for t in (notices[2], "Released under the MIT License."))
        norm = lambda v: np.sqrt(sum(x * x for x in v.values()))
        assert abs(got[2].own_score - sum(a[w] * b[w] for w in b) / norm(a) / norm(b)) < 1e-8
        assert got[0].own_score == got[1].own_score == 1


def test_license_files(spark):
    """Full texts, wrapped headers, titles and tags; a file is known by all of its matching segments together."""
    from pyspark.sql import functions as F

    full = [(i, "Copyright 2020 by somebody\n\n" + t, f"d{i}/text") for i, (_, t) in enumerate(licenses.FULL_TEXTS)]
    lines = [
        (100, "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GPL-3.0"),
        (101, "it under the terms of the GNU General Public License as published by", "GPL"),
        (102, "Redistribution and use in source and binary forms, with or without", "BSD-3-Clause"),
        (103, "# SPDX-License-Identifier: MIT", "MIT"),
    ]
    two = (200, "Released under the MIT License.\nsome other words stand here\nReleased under the MIT License.", "e/text")
    rest = [(300 + i, f"the words of text {i} and of others", None) for i in range(500)] + [(1000 + i, "code", f"d{i}/x.py") for i in range(len(full))] + [(2000, "code", "e/x.py")]
    df = spark.createDataFrame(full + [(d, t, None) for d, t, _ in lines] + [two] + rest, "doc_id long, text string, path string")
    got = {r.doc_id: r.license for r in licenses.scan_licenses(df, F.col("path")).collect()}
    assert {d: got[d] for d, _, _ in lines} == {d: n for d, _, n in lines}
    assert got[2000] == "MIT"
    names = [n for n, _ in licenses.FULL_TEXTS]
    assert [got[1000 + i] for i in range(len(full))] == [got[i] for i in range(len(full))] and None not in [got[i] for i in range(len(full))]
    assert [got[i] for i in range(len(full))] == names
