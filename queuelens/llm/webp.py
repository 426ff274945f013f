"""Lossless WebP: a writer and a decoder for the VP8L bit stream, as its public specification gives it.

``encode`` picks for each image what makes it smallest: palette, subtracted green, cross-colour or predictor transform,
then back-references to earlier pixels and a colour cache, and prefix codes made for the image. ``decode`` reads any
still VP8L image. ``decode_many`` reads many images side by side with numpy, one pixel of each a step, back-references
and cache included; transforms are inverted for each image. An image with groups of prefix codes, varying alpha or codes
of over TABLE_BITS bits goes through ``decode``.
"""

from __future__ import annotations

import math
import struct
from functools import cache

import numpy as np

MAX_SIDE = 16384
#: Longest code that the writer uses, and the bits of decode_many's tables.
TABLE_BITS = 11
#: Fixed values of the format: the order in which lengths of the code-length code stand.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Bits of the side of a tile of the writer's transforms: the largest, as it has one mode for an image.
TILE = 9
#: The writer's fixed code-length code: lengths 1 to 11 and zero runs.
_CL = {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 4, 6: 3, 7: 3, 8: 4, 9: 4, 10: 4, 11: 4, 17: 4, 18: 4}


@cache
def distance_map() -> list[tuple[int, int]]:
    """The 120 near pixels (x, y) of short distance codes: by distance, then by width, right before left."""
    near = [(x, 0) for x in range(1, 9)] + [(x, y) for y in range(1, 8) for x in range(-7, 9)]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of given lengths, first bit lowest, as they stand in the stream."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    n = lengths[used].astype(np.int64)
    order = np.argsort(n, kind="stable")
    most = max(TABLE_BITS, int(n.max(initial=0)))
    share = np.left_shift(1, most - n[order])
    codes[used[order]] = _reversed(most)[share.cumsum() - share]  # the first window of bits that begins with the code
    return codes


def code_lengths(counts: np.ndarray, limit: int = TABLE_BITS) -> np.ndarray:
    """Lengths of a complete prefix code of at most ``limit`` bits: each symbol's information rounded up, then those made
    a bit shorter that lost most by it, until the code is complete. One symbol: no bits."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        return lengths
    c = counts[used].astype(float)
    ideal = np.log2(c.sum() / c)
    n = np.clip(np.ceil(ideal), 1, limit).astype(np.int64)
    free = (1 << limit) - int((1 << (limit - n)).sum())
    while free < 0:  # the limit cut the longest: the commonest symbols give way
        i = int(np.argmin(np.where(n < limit, n - ideal, np.inf)))
        free += 1 << (limit - n[i] - 1)
        n[i] += 1
    while free:
        share = np.where(n > 1, 1 << (limit - n), 1 << limit)
        order = np.argsort(ideal - n, kind="stable")
        order = order[share[order] <= free]
        taken = order[share[order].cumsum() <= free]
        free -= int(share[taken].sum())
        n[taken] -= 1
    lengths[used] = n
    return lengths


def code_lengths_of(counts: np.ndarray, limit: int = TABLE_BITS) -> np.ndarray:
    """code_lengths() of each row."""
    lengths = np.zeros(counts.shape, np.int64)
    row, col = np.nonzero(counts)
    several = (np.bincount(row, minlength=len(counts)) > 1)[row]
    row, col = row[several], col[several]
    c = counts[row, col].astype(float)
    ideal = np.log2(np.bincount(row, c, len(counts))[row] / c)
    n = np.clip(np.ceil(ideal), 1, limit).astype(np.int64)
    free = (1 << limit) - np.bincount(row, 1 << (limit - n), len(counts)).astype(np.int64)
    for over in np.flatnonzero((free < 0) & (np.bincount(row, minlength=len(counts)) > 0)).tolist():  # few codes come to the limit
        at = np.flatnonzero(row == over)
        while free[over] < 0:
            i = at[int(np.argmin(np.where(n[at] < limit, n[at] - ideal[at], np.inf)))]
            free[over] += 1 << (limit - n[i] - 1)
            n[i] += 1
    at = np.flatnonzero(free[row] > 0)
    while len(at):
        by = at[np.lexsort((ideal[at] - n[at], row[at]))]  # exact, so that no row's code depends on other rows
        share = np.where(n[by] > 1, 1 << (limit - n[by]), 1 << limit)
        fits = share <= free[row[by]]
        upto = np.where(fits, share, 0).cumsum()
        begin = np.flatnonzero(np.diff(row[by], prepend=-1))
        upto -= np.repeat(np.append(0, upto)[begin], np.diff(begin, append=len(by)))
        taken = np.flatnonzero(fits & (upto <= free[row[by]]))
        free -= np.bincount(row[by[taken]], share[taken], len(free)).astype(np.int64)
        n[by[taken]] -= 1
        at = at[free[row[at]] > 0]
    lengths[row, col] = n
    return lengths


class Writer:
    def __init__(self) -> None:
        self.value, self.n = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= int(value) << self.n
        self.n += bits

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


@cache
def _cl_codes() -> np.ndarray:
    return canonical(np.array([_CL.get(i, 0) for i in range(19)]))


@cache
def _zero_runs() -> tuple[np.ndarray, np.ndarray]:
    """Bits, and how many, that stand for 0 to 559 zero lengths."""
    codes, values, sizes = _cl_codes().tolist(), [], []
    for run in range(560):
        value = n = 0
        while run:
            for symbol, least, most, extra in ((18, 11, 138, 7), (17, 3, 10, 3), (0, 1, 1, 0)):
                if run >= least:
                    k = min(run, most)
                    value |= (codes[symbol] | (k - least) << _CL[symbol]) << n
                    n, run = n + _CL[symbol] + extra, run - k
                    break
        values.append(value)
        sizes.append(n)
    return np.array(values, np.uint64), np.array(sizes, np.uint64)


_Bits = tuple[np.ndarray, np.ndarray]


def _some(*pairs: tuple[int, int]) -> _Bits:
    values, sizes = zip(*pairs, strict=True)
    return np.array(values, np.uint64), np.array(sizes, np.uint64)


@cache
def _code_head() -> _Bits:
    return _some((0, 1), (15 - 4, 4), *((_CL.get(s, 0), 3) for s in LENGTH_ORDER[:15]), (0, 1))


@cache
def _only(symbol: int) -> _Bits:
    return _some((0b101, 3), (symbol, 8)) if symbol > 1 else _some((0b001, 3), (symbol, 1))  # simple, one symbol


def _code(lengths: np.ndarray, only: int) -> _Bits:
    """A prefix code: its lengths through the fixed code-length code, or the symbol ``only`` without bits."""
    used = np.flatnonzero(lengths)
    if not len(used):
        return _only(only)
    runs, sizes = _zero_runs()
    gaps = np.empty(len(used) + 1, np.int64)
    gaps[0], gaps[1:-1], gaps[-1] = used[0], used[1:] - used[:-1] - 1, len(lengths) - 1 - used[-1]
    n = lengths[used]
    value, bits = np.empty(2 * len(used) + 1, np.uint64), np.empty(2 * len(used) + 1, np.uint64)
    value[0::2], value[1::2] = runs[gaps], _cl_codes()[n]
    bits[0::2], bits[1::2] = sizes[gaps], _cl_bits()[n]
    head = _code_head()
    return np.concatenate([head[0], value]), np.concatenate([head[1], bits])


@cache
def _cl_bits() -> np.ndarray:
    return np.array([_CL.get(i, 0) for i in range(19)], np.uint64)


def _packed(value: np.ndarray, bits: np.ndarray, of: np.ndarray, n: int) -> list[tuple[np.ndarray, int]]:
    """The bits of each of ``n`` streams, lowest first, as bytes, and how many there are. ``of``: each part's stream,
    ascending. A part has up to 64 bits."""
    end = bits.cumsum()
    total = np.bincount(of, weights=bits, minlength=n).astype(np.int64)
    words = total // 64 + 2
    begin = words.cumsum() - words
    at = end - bits + (64 * begin - (total.cumsum() - total)).astype(np.uint64)[of]  # each stream begins with a word
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = np.zeros(int(words.sum()), "<u8")
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(value << shift, first)
    over = np.flatnonzero(shift + bits > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    raw = out.view(np.uint8)
    return [(raw[8 * i : 8 * i + -(-t // 8)], t) for i, t in zip(begin.tolist(), total.tolist(), strict=True)]


def _riff(data: bytes) -> bytes:
    pad = len(data) & 1
    return struct.pack("<4sI4s4sI", b"RIFF", 12 + len(data) + pad, b"WEBP", b"VP8L", len(data)) + data + b"\0" * pad


def _start(w: Writer, width: int, height: int, alpha: bool = False) -> None:
    w.put(0x2F, 8)
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(alpha, 1)
    w.put(0, 3)


@cache
def _prefix_table(most: int) -> np.ndarray:
    v = np.arange(-1, most)
    high = np.maximum(np.floor(np.log2(np.maximum(v, 1))).astype(np.int64), 1)
    small = v < 4
    extra = np.where(small, 0, high - 1)
    return np.stack([np.where(small, v, 2 * high + (v >> np.maximum(high - 1, 0) & 1)), extra, np.where(small, 0, v & ((1 << extra) - 1))])


def _prefixed(value: np.ndarray) -> np.ndarray:
    """Symbol, extra bits and their value of lengths and distance codes (from 1)."""
    return _prefix_table(1 << max(14, int(value.max(initial=0)).bit_length()))[:, value]


@cache
def _near_codes(width: int) -> dict[int, int]:
    """Short distance codes of distances in an image of this width."""
    out: dict[int, int] = {}
    for code, (x, y) in enumerate(distance_map(), 1):
        out.setdefault(max(1, x + y * width), code)
    return out


def _copies(argb: np.ndarray, of: np.ndarray, first: np.ndarray, sizes: np.ndarray, least: int = 5, most: int = 4096) -> list[tuple[int, int, int]]:
    """Back-references (place, pixels, distance) inside each image of over 16 pixels: runs of places whose three pixels
    occurred before at one distance. ``of``: each pixel's image; images begin at ``first``."""
    if len(argb) < 3:
        return []
    a = argb.astype(np.uint64)
    key = (a[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (a[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (a[2:] * np.uint64(0x165667B19E3779F9))
    inside = np.repeat(sizes > 16, sizes)[:-2] & (of[2:] == of[:-2])
    places = np.flatnonzero(inside)
    order = places[np.argsort(key[places], kind="stable")]
    new, old = order[1:], order[:-1]
    same = np.flatnonzero((key[new] == key[old]) & (of[new] == of[old]))
    new, old = new[same], old[same]
    for i in range(3):  # equal keys may be of different pixels
        equal = argb[new + i] == argb[old + i]
        new, old = new[equal], old[equal]
    back = np.zeros(len(argb), np.int64)
    back[new] = new - old
    edges = np.flatnonzero(np.diff(back, prepend=0, append=0))
    run = np.diff(edges)
    long = np.flatnonzero((back[edges[:-1]] > 0) & (run + 2 >= least))
    out, end = [], 0
    for start, size, d in zip(edges[long].tolist(), (run[long] + 2).tolist(), back[edges[long]].tolist(), strict=True):
        start, size = max(start, end), size - max(0, end - start)
        if size < least:
            continue
        while size >= least:
            out.append((start, min(size, most), d))
            start, size = start + min(size, most), size - min(size, most)
        end = start
    return out


def _entropy(*counts: np.ndarray) -> float:
    """Bits of symbols with these counts, each with a code of its own, and roughly what the codes cost."""
    bits = 0.0
    for c in counts:
        c = c[c > 0]
        n = int(c.sum())
        bits += n * math.log2(n) - float(c @ np.log2(c)) + 5 * len(c) if len(c) > 1 else 16
    return bits


def _entropies(counts: np.ndarray) -> np.ndarray:
    """_entropy() of each row."""
    n, used = counts.sum(axis=1), (counts > 0).sum(axis=1)
    bits = n * np.log2(np.maximum(n, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(axis=1) + 5 * used
    return np.where(used > 1, bits, 16.0)


def _tables(row: np.ndarray, symbol: np.ndarray, rows: int, size: int) -> np.ndarray:
    """How often each symbol occurs in each row."""
    return np.bincount(row * size + symbol, minlength=rows * size).reshape(rows, size)


def _codes_of(counts: np.ndarray, alphabet: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths and codes of a prefix code for each row of counts, and the rows, values and bits of the parts that write
    these codes; as _code() for a row of ``alphabet`` symbols, in which ``only`` is the one symbol of a row without two."""
    lengths = code_lengths_of(counts)
    codes = np.zeros(lengths.shape, np.uint64)
    row, col = np.nonzero(lengths)
    n = lengths[row, col]
    order = np.argsort(row * 16 + n, kind="stable")
    share = np.left_shift(1, TABLE_BITS - n[order])
    codes[row[order], col[order]] = _reversed()[(share.cumsum() - share) & ((1 << TABLE_BITS) - 1)]  # a row's shares fill its windows
    begins = np.flatnonzero(np.diff(row, prepend=-1))
    owner = row[begins]
    gap = np.diff(col, prepend=-1) - 1
    gap[begins] = col[begins]
    runs, sizes = _zero_runs()
    head_value, head_bits = _joined(_code_head())
    lone = np.setdiff1d(np.arange(len(counts)), owner)
    single = [_joined(_only(x)) for x in only[lone].tolist()]
    tail = alphabet[owner] - 1 - col[np.append(begins[1:], len(col))[: len(owner)] - 1] if len(owner) else np.zeros(0, np.int64)
    u = lambda x: np.asarray(x, np.uint64)
    rows = np.concatenate([owner, row, owner, lone])
    value = np.concatenate([u([head_value] * len(owner)), runs[gap] | _cl_codes()[n] << sizes[gap], runs[tail], u([v for v, _ in single])])
    bits = np.concatenate([u([head_bits] * len(owner)), sizes[gap] + _cl_bits()[n], sizes[tail], u([b for _, b in single])])
    return lengths, codes, rows, value, bits


def _joined(parts: _Bits) -> tuple[int, int]:
    value = at = 0
    for v, n in zip(*(x.tolist() for x in parts), strict=True):
        value, at = value | v << at, at + n
    return value, at


def _put_pixels(heads: list[Writer], images: list[np.ndarray], widths: list[int], main: bool) -> list[tuple[np.ndarray, int]]:
    """Entropy-coded images, each after its writer's bits; the streams' bytes and how many bits they have. Alpha is one
    value for all pixels of an image. All images go through each step together, as most are small."""
    k, sizes = len(images), np.array([len(i) for i in images])
    argb, of, first = np.concatenate(images), np.repeat(np.arange(k), sizes), sizes.cumsum() - sizes
    channel = lambda shift: (argb >> np.uint32(shift) & np.uint32(255)).astype(np.int64)
    red, green, blue = channel(16), channel(8), channel(0)
    copies = _copies(argb, of, first, sizes)
    length, distance, inner = np.zeros(len(argb), np.int64), np.zeros(len(argb), np.int64), np.zeros(len(argb) + 1, np.int64)
    if copies:
        at, size, d = np.array(copies).T
        near = [_near_codes(w) for w in widths]
        length[at], distance[at] = size, [near[i].get(x, x + 120) for i, x in zip(of[at].tolist(), d.tolist(), strict=True)]
        inner[at + 1] += 1
        np.subtract.at(inner, at + size, 1)
    where = np.flatnonzero(inner[:-1].cumsum() == 0)  # one symbol each
    of, length, distance, g, r, b = of[where], length[where], distance[where], green[where], red[where], blue[where]
    lit = length == 0
    # A colour cache, where it makes an image smaller.
    cache_bits = np.array([min(8, max(2, n.bit_length() - 3)) for n in sizes.tolist()])
    slots = ((argb.astype(np.uint32) * np.uint32(0x1E35A7BD)) >> np.repeat(32 - cache_bits, sizes).astype(np.uint32)).astype(np.int64)
    place = np.repeat(np.arange(k), sizes) << 8 | slots
    order = np.argsort(place.astype(np.uint16) if k <= 256 else place, kind="stable")
    hits = np.zeros(len(argb), bool)
    hits[order[1:]] = (place[order[1:]] == place[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])
    maybe, slot = hits[where] & lit, slots[where]
    both = lambda kept: _tables(of[kept], r[kept], k, 256) + _tables(of[kept], b[kept], k, 256)
    plain = _entropies(_tables(of[lit], g[lit], k, 280)) + _entropies(both(lit))
    cached = _entropies(_tables(of[lit], np.where(maybe, 280 + slot, g)[lit], k, 536)) + _entropies(both(lit & ~maybe))
    cache_bits = np.where((sizes >= 64) & (cached < plain), cache_bits, 0)
    hit = maybe & (cache_bits > 0)[of]
    symbol = np.where(hit, 280 + slot, g)
    copied = np.flatnonzero(~lit)
    ls, le, lx = _prefixed(length[copied])
    ds, de, dx = _prefixed(distance[copied])
    symbol[copied] = 256 + ls
    full = lit & ~hit
    starts = np.searchsorted(of, np.arange(k))
    one_red, one_far = np.zeros(k, np.int64), np.zeros(k, np.int64)
    one_red[of[full]], one_far[of[copied]] = r[full], ds  # counts where all are equal
    shared = both(full)
    gray = (shared > 0).sum(axis=1) < 2
    green_lengths, gc, *green_parts = _codes_of(_tables(of, symbol, k, 536), 280 + np.where(cache_bits > 0, 1 << cache_bits, 0), symbol[starts])
    rb_lengths, rc, *rb_parts = _codes_of(shared, np.full(k, 256), np.where(gray, one_red, 0))
    d_lengths, dc, *d_parts = _codes_of(_tables(of[copied], ds, k, 40), np.full(k, 40), one_far)
    u = lambda x: np.asarray(x, np.uint64)
    head = [(i, w.value >> at & 0xFFFFFFFF, min(32, w.n - at)) for i, w in enumerate(heads) for at in range(0, w.n, 32)]
    flags = np.where(cache_bits > 0, 1 | cache_bits << 1, 0), np.where(cache_bits > 0, 5, 1) + main  # then one group of codes
    alpha = [_joined(_only(x)) for x in (argb[first] >> np.uint32(24)).tolist()]
    gl, rl, bl = u(green_lengths[of, symbol]), u(rb_lengths[of, r]), u(rb_lengths[of, b])
    value, bits = gc[of, symbol], gl
    value = np.where(full, value | rc[of, r] << gl | rc[of, b] << (gl + rl), value)
    bits = np.where(full, gl + rl + bl, bits)
    at, v, i = gl[copied], value[copied], of[copied]
    v = v | u(lx) << at
    at = at + u(le)
    v |= dc[i, ds] << at
    at = at + u(d_lengths[i, ds])
    value[copied], bits[copied] = v | u(dx) << at, at + u(de)
    every = np.arange(k)
    sections = [
        tuple(np.array(c) for c in zip(*head, strict=True)) if head else (every[:0],) * 3,
        (every, *flags),
        green_parts, rb_parts, rb_parts,
        (every, [v for v, _ in alpha], [n for _, n in alpha]),
        d_parts,
        (of, value, bits),
    ]
    owner = np.concatenate([s[0] for s in sections])
    key = owner * len(sections) + np.repeat(np.arange(len(sections)), [len(s[0]) for s in sections])
    order = np.argsort(key.astype(np.uint16) if k <= 4096 else key, kind="stable")
    return _packed(np.concatenate([u(s[1]) for s in sections])[order], np.concatenate([u(s[2]) for s in sections])[order], owner[order], k)


def _sub_image(w: Writer, argb: np.ndarray, width: int) -> None:
    ((raw, w.n),) = _put_pixels([w], [argb], [width], False)
    w.value = int.from_bytes(raw.tobytes(), "little")


def _table_image(w: Writer, argb: np.ndarray) -> None:
    """A palette's image of one row, literals alone: here alphas may be of two values."""
    channels = [(argb >> np.uint32(shift) & np.uint32(255)).astype(np.int64) for shift in (8, 16, 0, 24)]  # G, R, B, A
    w.put(0, 1)
    made = []
    for c, size in zip(channels, (280, 256, 256, 256), strict=True):
        lengths = code_lengths(np.bincount(c, minlength=size))
        for bits in zip(*(x.tolist() for x in _code(lengths, int(c[0]))), strict=True):
            w.put(*bits)
        made.append((lengths.tolist(), canonical(lengths).tolist()))
    w.put(1, 4)  # one distance without bits, of a one-bit symbol 0
    for pixel in zip(*(c.tolist() for c in channels), strict=True):
        for (lengths, codes), v in zip(made, pixel, strict=True):
            w.put(codes[v], lengths[v])


def _pack(image: np.ndarray) -> np.ndarray:
    """Numbers of pixels (h, w, 4) in the order A, R, G, B."""
    return np.ascontiguousarray(image).view(">u4").reshape(-1).astype(np.uint32)


def _histograms(image: np.ndarray) -> list[np.ndarray]:
    return [np.bincount(image[..., c].reshape(-1), minlength=256) for c in (1, 2, 3)]


def encode(image: np.ndarray) -> bytes:
    """A WebP file of pixels (h, w, 4) in the order A, R, G, B; alpha is one value for all."""
    return encode_many([image])[0]


def encode_many(images: list[np.ndarray], most: int = 1 << 17) -> list[bytes]:
    """encode() of each image; up to 256 images, or about ``most`` pixels, are written together."""
    out, at = [], 0
    while at < len(images):
        end, size = at, 0
        while end < len(images) and end - at < 256 and (end == at or size + images[end][..., 0].size <= most):
            size += images[end][..., 0].size
            end += 1
        heads, pixels, widths = zip(*map(_transformed, images[at:end]), strict=True)
        out += [_riff(raw.tobytes()) for raw, _ in _put_pixels(list(heads), list(pixels), list(widths), True)]
        at = end
    return out


def _transformed(image: np.ndarray) -> tuple[Writer, np.ndarray, int]:
    """A file's bits before its pixels, the pixels that its transforms leave, and their width."""
    h, width, _ = image.shape
    w = Writer()
    _start(w, width, h, bool(image[0, 0, 0] != 255))
    argb = _pack(image)
    # A palette pays where colours are few, as the first pixels tell; other transforms where neighbours are alike.
    colours = np.unique(argb) if len(argb) <= 256 or len(np.unique(argb[:256])) < 160 else argb
    step = (image[:16, 1:, 1:] - image[:16, :-1, 1:]).view(np.int8)
    alike = width > 1 and float(np.abs(step.astype(np.int16)).mean()) < 20
    best = _entropy(*_histograms(image)) if alike or len(colours) <= 256 else 0.0
    if len(colours) <= 256 and len(argb) > 256 or len(colours) <= 16:
        index = np.searchsorted(colours, argb)
        rough = _entropy(np.bincount(index)) + 24 * len(colours) + 300
        if rough < 0.8 * best:
            bits = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
            w.put(1, 1)
            w.put(PALETTE, 2)
            w.put(len(colours) - 1, 8)
            steps = colours.astype(">u4").view(np.uint8).reshape(-1, 4)
            _table_image(w, _pack(np.diff(steps, axis=0, prepend=np.zeros((1, 4), np.uint8))))
            each, across = 8 >> bits, (width + (1 << bits) - 1) >> bits
            padded = np.zeros((h, across << bits), np.int64)
            padded[:, :width] = index.reshape(h, width)
            green = (padded.reshape(h, across, 1 << bits) << (np.arange(1 << bits) * each)).sum(axis=2).reshape(-1)
            w.put(0, 1)
            return w, np.uint32(0xFF000000) | green.astype(np.uint32) << np.uint32(8), across
    if not alike:
        w.put(0, 1)
        return w, argb, width
    choice, kept = None, image
    for mode in (1, 2) if image[0, 0, 0] == 255 else ():
        moved = residual(image, mode)
        cost = _entropy(*_histograms(moved))
        if cost < 0.97 * best:
            best, choice, kept = cost, mode, moved
    if choice is not None:
        w.put(1, 1)
        w.put(PREDICTOR, 2)
        w.put(TILE - 2, 3)
        tiles = ((width + (1 << TILE) - 1) >> TILE) * ((h + (1 << TILE) - 1) >> TILE)
        _sub_image(w, np.full(tiles, 0xFF000000 | choice << 8, np.uint32), (width + (1 << TILE) - 1) >> TILE)
    green, red, blue = (kept[..., c].astype(np.int8).astype(np.int64) for c in (2, 1, 3))
    spread = int((green * green).sum())
    lean = [int(np.clip(round(32 * int((green * x).sum()) / spread), -128, 127)) if spread else 0 for x in (red, blue)]
    plain = kept.copy()
    plain[..., 1] -= plain[..., 2]
    plain[..., 3] -= plain[..., 2]
    if (cost := _entropy(*_histograms(plain))) < 0.97 * best:
        best = cost
    else:
        plain = None
    if choice is not None and any(lean):
        tile = np.array([[[x & 255 for x in (*lean, 0)]]], np.uint8)
        crossed = cross_coloured(kept, np.broadcast_to(tile, (((h - 1) >> TILE) + 1, ((width - 1) >> TILE) + 1, 3)), TILE, forward=True)
        if _entropy(*_histograms(crossed)) < 0.97 * best:
            w.put(1, 1)
            w.put(CROSS_COLOUR, 2)
            w.put(TILE - 2, 3)
            across = ((width - 1) >> TILE) + 1
            _sub_image(w, np.full(across * (((h - 1) >> TILE) + 1), 0xFF000000 | (lean[1] & 255) << 8 | lean[0] & 255, np.uint32), across)
            kept, plain = crossed, None
    if plain is not None:
        w.put(1, 1)
        w.put(SUBTRACT_GREEN, 2)
        kept = plain
    w.put(0, 1)
    return w, _pack(kept), width


def encode_rgb_many(pixels: list[np.ndarray], width: int) -> list[bytes]:
    """A WebP file of each of these opaque pixels (n, 3)."""
    images = []
    for rgb in pixels:
        image = np.full((len(rgb) // width, width, 4), 255, np.uint8)
        image[..., 1:] = rgb.reshape(-1, width, 3)
        images.append(image)
    return encode_many(images)


def encode_rgb(rgb: np.ndarray, width: int) -> bytes:
    """A WebP file of opaque pixels (n, 3)."""
    return encode_rgb_many([rgb], width)[0]


class Reader:
    """Bits of a stream, lowest first, out of a window of whole words."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def bits(self, n: int) -> int:
        i = self.at
        self.at = i + n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        return int.from_bytes(self.data[i >> 3 : (self.at + 7) >> 3], "little") >> (i & 7) & ((1 << n) - 1)


class Code:
    """A prefix code as the map from (length, bits) to symbols."""

    def __init__(self, lengths: np.ndarray) -> None:
        self.lengths = lengths
        used = np.flatnonzero(lengths)
        self.only = int(used[0]) if len(used) == 1 else None
        if len(used) == 0:
            raise ValueError("an empty prefix code")
        if len(used) > 1 and (2.0 ** -lengths[used].astype(float)).sum() != 1:
            raise ValueError("a prefix code that isn't complete")
        self._map: dict[tuple[int, int], int] | None = None

    def read(self, r: Reader) -> int:
        if self.only is not None:
            return self.only
        if self._map is None:
            codes = canonical(self.lengths).tolist()
            self._map = {(int(n), codes[s]): s for s, n in enumerate(self.lengths) if n}
        got = 0
        for n in range(1, 16):
            got |= r.bits(1) << (n - 1)
            if (s := self._map.get((n, got))) is not None:
                return s
        raise ValueError("no such code")

    def table(self) -> np.ndarray | None:
        """symbol << 4 | length for each window of TABLE_BITS bits; None if a code is longer."""
        if self.only is not None:
            return np.full(1 << TABLE_BITS, self.only << 4, np.uint16)
        used = np.flatnonzero(self.lengths)
        n = self.lengths[used]
        if n.max() > TABLE_BITS:
            return None
        order = np.lexsort((used, n))
        straight = np.repeat((used[order] << 4 | n[order]).astype(np.uint16), 1 << (TABLE_BITS - n[order]))
        return straight[_reversed()]


@cache
def _reversed(bits: int = TABLE_BITS) -> np.ndarray:
    i, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for b in range(bits):
        out |= (i >> b & 1) << (bits - 1 - b)
    return out


@cache
def _length_steps(cl: bytes) -> list[tuple[int, int, int]]:
    """For a code-length code (its 19 lengths) and each window of 14 bits: the length (-1: the last one again), how often,
    and how many bits that takes."""
    code = Code(np.frombuffer(cl, np.uint8).astype(np.int64))
    entries, out = code.table().tolist(), []
    for window in range(1 << 14):
        e = entries[window & ((1 << TABLE_BITS) - 1)]
        n, v = e & 15 if code.only is None else 0, e >> 4
        if v < 16:
            out.append((v, 1, n))
        else:
            extra, least, value = ((2, 3, -1), (3, 3, 0), (7, 11, 0))[v - 16]
            out.append((value, least + (window >> n & ((1 << extra) - 1)), n + extra))
    return out


def read_code(r: Reader, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int64)
    if r.bits(1):
        n = r.bits(1) + 1
        lengths[r.bits(8 if r.bits(1) else 1)] = 1
        if n == 2:
            lengths[r.bits(8)] = 1
        return Code(lengths)
    cl = np.zeros(19, np.uint8)
    for s in LENGTH_ORDER[: 4 + r.bits(4)]:
        cl[s] = r.bits(3)
    steps = _length_steps(cl.tobytes())
    left = 2 + r.bits(2 + 2 * r.bits(3)) if r.bits(1) else alphabet
    out, last, pos = [], 8, r.at & 7
    window = int.from_bytes(r.data[r.at >> 3 : (r.at >> 3) + 2 * alphabet + 4], "little")
    r.at -= pos
    i = 0
    while i < alphabet and left:
        left -= 1
        v, run, bits = steps[window >> pos & 16383]
        pos += bits
        i += run
        if run == 1:
            out.append(v)
            last = v or last
        else:
            out += [last if v < 0 else v] * run
    r.at += pos
    if len(out) > alphabet:
        raise ValueError("a run beyond the alphabet")
    if r.at > 8 * len(r.data):
        raise ValueError("the stream ends too early")
    lengths[: len(out)] = out
    return Code(lengths)


def read_twin(r: Reader, begin: int, code: Code) -> Code:
    """The next code, which often has the same bits as ``code``, whose bits began at ``begin``."""
    n = r.at - begin
    bits = lambda at: int.from_bytes(r.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)
    if r.at + n <= 8 * len(r.data) and bits(begin) == bits(r.at):
        r.at += n
        return code
    return read_code(r, 256)


def _extended(r: Reader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.bits(extra) + 1


def _read_pixels(r: Reader, width: int, height: int, main: bool) -> list[int]:
    """ARGB numbers of an image in the stream; ``main``: it may have groups of codes."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    if cache_bits > 11:
        raise ValueError("too large a colour cache")
    group_of, prefix_bits, groups = None, 0, 1
    if main and r.bits(1):
        prefix_bits = r.bits(3) + 2
        w = (width + (1 << prefix_bits) - 1) >> prefix_bits
        h = (height + (1 << prefix_bits) - 1) >> prefix_bits
        group_of = [p >> 8 & 0xFFFF for p in _read_pixels(r, w, h, False)]
        groups, across = max(group_of) + 1, w
    size = 1 << cache_bits if cache_bits else 0
    codes = [[read_code(r, n) for n in (280 + size, 256, 256, 256, 40)] for _ in range(groups)]
    kept, pixels, total = [0] * size, [], width * height
    while len(pixels) < total:
        i = len(pixels)
        green, red, blue, alpha, far = codes[group_of[(i // width >> prefix_bits) * across + (i % width >> prefix_bits)] if group_of else 0]
        s = green.read(r)
        if s < 256:
            red_, blue_, alpha_ = red.read(r), blue.read(r), alpha.read(r)
            new = [alpha_ << 24 | red_ << 16 | s << 8 | blue_]
        elif s < 280:
            n = _extended(r, s - 256)
            d = _extended(r, far.read(r))
            if d > 120:
                d -= 120
            else:
                x, y = distance_map()[d - 1]
                d = max(1, x + y * width)
            if d > i or i + n > total:
                raise ValueError("a reference outside the image")
            new = (pixels[i - d :] * (n // d + 1))[:n]
        else:
            new = [kept[s - 280]]
        pixels += new
        if size:
            for p in new:
                kept[(0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return pixels


def _predict(mode: int, left: list[int], top: list[int], tr: list[int], tl: list[int]) -> list[int]:
    avg = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 11:
        pl = sum(abs(t - c) for t, c in zip(top, tl, strict=True))
        pt = sum(abs(x - c) for x, c in zip(left, tl, strict=True))
        return left if pl < pt else top
    if mode == 12:
        return [min(255, max(0, a + b - c)) for a, b, c in zip(left, top, tl, strict=True)]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(avg(left, top), tl, strict=True)]
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: tr, 4: lambda: tl, 5: lambda: avg(avg(left, tr), top), 6: lambda: avg(left, tl), 7: lambda: avg(left, top),
        8: lambda: avg(tl, top), 9: lambda: avg(top, tr), 10: lambda: avg(avg(left, tl), avg(top, tr)),
    }.get(mode, lambda: [255, 0, 0, 0])()


def predicted(image: np.ndarray, modes: np.ndarray, bits: int, forward: bool = False) -> np.ndarray:
    """Adds (or, ``forward``, takes away) the predictions of an image (h, w, 4) in the order A, R, G, B."""
    h, w, _ = image.shape
    given, done = image.reshape(-1, 4).tolist(), []
    known = given if forward else done
    for i, p in enumerate(given):
        y, x = divmod(i, w)
        if i == 0:
            guess = [255, 0, 0, 0]
        elif y == 0:
            guess = known[i - 1]
        elif x == 0:
            guess = known[i - w]
        else:
            guess = _predict(int(modes[y >> bits, x >> bits]), known[i - 1], known[i - w], known[i - w + 1], known[i - w - 1])
        done.append([(a - b if forward else a + b) & 255 for a, b in zip(p, guess, strict=True)])
    return np.array(done, np.uint8).reshape(h, w, 4)


def residual(image: np.ndarray, mode: int) -> np.ndarray:
    """What predictor 1 (left) or 2 (top) leaves of an image."""
    guess = np.zeros_like(image)
    guess[0, 0, 0] = 255
    guess[0, 1:], guess[1:, 0] = image[0, :-1], image[:-1, 0]
    guess[1:, 1:] = image[1:, :-1] if mode == 1 else image[:-1, 1:]
    return image - guess


def restored(image: np.ndarray, mode: int) -> np.ndarray:
    """Undoes residual(): running sums along the rows, or down the columns."""
    out = image.copy()
    out[0, 0, 0] += 255
    side = 1 if mode == 1 else 0
    edge = (slice(None), 0) if mode == 1 else (0, slice(None))
    out[edge] = out[edge].cumsum(axis=0, dtype=np.uint8)
    return out.cumsum(axis=side, dtype=np.uint8)


def cross_coloured(image: np.ndarray, tiles: np.ndarray, bits: int, forward: bool = False) -> np.ndarray:
    """Undoes (or does) the colour transform; tiles (h, w, 3): green to red, green to blue, red to blue."""
    h, w, _ = image.shape
    t = tiles.astype(np.int8).astype(np.int64)[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    out, sign = image.astype(np.int64), -1 if forward else 1
    signed = lambda a: a.astype(np.uint8).astype(np.int8).astype(np.int64)
    green, red0 = signed(out[..., 2]), signed(out[..., 1])
    red = out[..., 1] + sign * (t[..., 0] * green >> 5)
    out[..., 3] += sign * ((t[..., 1] * green >> 5) + (t[..., 2] * (red0 if forward else signed(red)) >> 5))
    out[..., 1] = red
    return (out & 255).astype(np.uint8)


def _argb(pixels: list[int], height: int) -> np.ndarray:
    return np.array(pixels, ">u4").view(np.uint8).reshape(height, -1, 4)


def _payload(file: bytes) -> bytes:
    riff, _, webp, kind, n = struct.unpack_from("<4sI4s4sI", file)
    if (riff, webp, kind) != (b"RIFF", b"WEBP", b"VP8L"):
        raise ValueError("not a lossless WebP file")
    return file[20 : 20 + n]


def _head(r: Reader) -> tuple[int, int]:
    if r.bits(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = r.bits(14) + 1, r.bits(14) + 1
    if r.bits(4) >> 1:
        raise ValueError("an unknown version")
    return width, height


def _transforms(r: Reader, width: int, height: int) -> tuple[int, list[tuple]]:
    """The main image's width in the stream, and the transforms to undo."""
    across, undo = width, []
    while r.bits(1):
        kind = r.bits(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = r.bits(3) + 2
            w, h = ((n + (1 << bits) - 1) >> bits for n in (across, height))
            undo.append((kind, bits, _argb(_read_pixels(r, w, h, False), h), across))
        elif kind == PALETTE:
            size = r.bits(8) + 1
            colours = _argb(_read_pixels(r, size, 1, False), 1)[0].astype(np.int64).cumsum(axis=0).astype(np.uint8)
            bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
            undo.append((kind, bits, colours, across))
            across = (across + (1 << bits) - 1) >> bits
        else:
            undo.append((kind, 0, None, across))
    return across, undo


def _undone(image: np.ndarray, undo: list[tuple]) -> np.ndarray:
    for kind, bits, data, before in reversed(undo):
        if kind == PREDICTOR:
            modes = data[..., 2] & 15
            one = int(modes.flat[0])
            image = restored(image, one) if one in (1, 2) and (modes == one).all() else predicted(image, modes, bits)
        elif kind == CROSS_COLOUR:
            image = cross_coloured(image, data[..., [3, 2, 1]], bits)
        elif kind == SUBTRACT_GREEN:
            image = image.copy()
            image[..., 1] += image[..., 2]
            image[..., 3] += image[..., 2]
        else:
            each = 8 >> bits
            index = (image[..., 2, None] >> (np.arange(1 << bits) * each) & ((1 << each) - 1)).reshape(len(image), -1)[:, :before]
            image = np.concatenate([data, np.zeros((256 - len(data), 4), np.uint8)])[index]
    return image


def decode(file: bytes) -> np.ndarray:
    """Pixels (height, width, 4) in the order A, R, G, B."""
    r = Reader(_payload(file))
    width, height = _head(r)
    across, undo = _transforms(r, width, height)
    return _undone(_argb(_read_pixels(r, across, height, True), height), undo)


@cache
def _near_pixels() -> tuple[np.ndarray, np.ndarray]:
    x, y = np.array([(0, 0), *distance_map()]).T
    return x, y


class _Lanes:
    """Images that are decoded side by side, the largest first."""

    def __init__(self) -> None:
        self.found: list[tuple] = []
        self.tables: list[np.ndarray] = []
        self.table_at: dict[bytes, int] = {}
        self.data: list[bytes] = []
        self.begin = 0

    def table(self, code: Code) -> int | None:
        key = code.lengths.tobytes()
        if key not in self.table_at:
            if (t := code.table()) is None:
                return None
            self.table_at[key] = len(self.tables)
            self.tables.append(t)
        return self.table_at[key]

    def add(self, k: int, file: bytes) -> bool:
        """Whether the image can be a lane."""
        r = Reader(_payload(file))
        width, height = _head(r)
        across, undo = _transforms(r, width, height)
        cache_bits = r.bits(4) if r.bits(1) else 0
        if r.bits(1) or cache_bits > TABLE_BITS:
            return False
        codes = [read_code(r, 280 + ((1 << cache_bits) if cache_bits else 0))]
        begin = r.at
        codes.append(read_code(r, 256))
        codes += [read_twin(r, begin, codes[1]), read_code(r, 256), read_code(r, 40)]
        ids = [self.table(codes[i]) for i in (0, 1, 2, 4)]
        if codes[3].only is None or None in ids:
            return False
        self.found.append((across * height, k, 8 * self.begin + r.at, ids, cache_bits, codes[3].only, across, undo))
        self.data.append(r.data + b"\0" * (-len(r.data) % 8))
        self.begin += len(self.data[-1])
        return True

    def pixels(self) -> np.ndarray:
        """ARGB numbers of all lanes, one after the other: a pixel of each lane a step, out of its next symbol, or out of
        the back-reference that it is in."""
        self.found.sort(key=lambda x: -x[0])
        column = lambda i: np.array([x[i] for x in self.found], np.int64)
        words = np.frombuffer(b"".join([*self.data, b"\0" * 24]), "<u8")
        table = np.concatenate(self.tables).astype(np.int64)
        sizes, pos, across = column(0), column(2), column(6)
        green, red, blue, far = (np.array([x[3][c] for x in self.found], np.int64) << TABLE_BITS for c in range(4))
        alpha, bits = column(5).astype(np.uint32) << np.uint32(24), column(4)
        first = sizes.cumsum() - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        pending, back = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        caches = bool(bits.any())
        kept = np.zeros(len(sizes) << int(bits.max(initial=0)), np.uint32)
        base = np.arange(len(sizes)) << int(bits.max(initial=0))
        shift = np.where(bits > 0, 32 - bits, 31).astype(np.uint32)
        mask, full, one = np.uint64((1 << TABLE_BITS) - 1), np.uint64(63), np.uint64(1)
        active = np.searchsorted(-sizes, -np.arange(int(sizes[0])), side="left")
        near_x, near_y = _near_pixels()
        copying = 0
        for step, n in enumerate(active.tolist()):
            p = pos[:n]
            at, s = p >> 6, (p & 63).astype(np.uint64)
            window = (words[at] >> s) | (words[at + 1] << one) << (full - s)
            e = table[green[:n] + (window & mask).astype(np.int64)]
            length, symbol = e & 15, e >> 4
            rest = window >> length.astype(np.uint64)
            e = table[red[:n] + (rest & mask).astype(np.int64)]
            used = length + (e & 15)
            pixel = alpha[:n] | (e >> 4 << 16 | symbol << 8 & 0xFF00).astype(np.uint32)
            rest >>= (e & 15).astype(np.uint64)
            e = table[blue[:n] + (rest & mask).astype(np.int64)]
            used += e & 15
            pixel |= (e >> 4).astype(np.uint32)
            odd = symbol > 255
            if copying:
                inside = pending[:n] > 0
                c = np.flatnonzero(inside)
                odd &= ~inside
                used[c] = 0
            else:
                c = None
            i = np.flatnonzero(odd)
            if len(i):
                symbol, length = symbol[i], length[i]
                used[i] = length
                cached = symbol >= 280
                j = i[cached]
                if len(j):
                    pixel[j] = kept[base[j] + symbol[cached] - 280]
                if len(j) < len(i):
                    j, symbol, length = i[~cached], symbol[~cached] - 256, length[~cached]
                    rest = window[j] >> length.astype(np.uint64)
                    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
                    low = (rest & ((one << extra.astype(np.uint64)) - one)).astype(np.int64)
                    pending[j] = np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + low) + 1
                    rest >>= extra.astype(np.uint64)
                    length = length + extra
                    e = table[far[j] + (rest & mask).astype(np.int64)]
                    rest >>= (e & 15).astype(np.uint64)
                    length = length + (e & 15)
                    symbol = e >> 4
                    extra = np.where(symbol < 4, 0, (symbol - 2) >> 1)
                    low = (rest & ((one << extra.astype(np.uint64)) - one)).astype(np.int64)
                    code = np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + low) + 1
                    used[j] = length + extra
                    close = np.minimum(code, 120)
                    back[j] = np.where(code > 120, code - 120, np.maximum(1, near_x[close] + near_y[close] * across[j]))
                    if (back[j] > step).any() or (pending[j] > sizes[j] - step).any():
                        raise ValueError("a reference outside the image")
                    copying += int(pending[j].sum())
                    c = j if c is None else np.concatenate([c, j])
            if c is not None and len(c):
                pixel[c] = flat[first[c] + step - back[c]]
                pending[c] -= 1
                copying -= len(c)
            flat[first[:n] + step] = pixel
            if caches:
                kept[base[:n] + (pixel * np.uint32(0x1E35A7BD) >> shift[:n])] = pixel
            p += used
            np.minimum(p, 64 * (len(words) - 3), out=p)
        return flat


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """RGB pixels (n, 3) of each file."""
    lanes = _Lanes()
    out: list[np.ndarray | None] = [None if lanes.add(k, file) else decode(file)[..., 1:].reshape(-1, 3) for k, file in enumerate(files)]
    if lanes.found:
        argb = lanes.pixels().astype(">u4").view(np.uint8).reshape(-1, 4)
        at = 0
        for size, k, _, _, _, _, across, undo in lanes.found:
            image = argb[at : at + size]
            out[k] = _undone(image.reshape(-1, across, 4), undo)[..., 1:].reshape(-1, 3) if undo else image[:, 1:]
            at += size
    return out
