"""Lossless WebP: a decoder of the whole format, an encoder, and a media column built on them.

decode() reads prefix codes, back-references, colour caches and meta prefix groups, and inverts the predictor,
cross-colour, subtract-green and colour-indexing transforms. Images whose only varying channel is one prefix-coded
green plane with back-references take a fast path: the place of the next symbol is found for every bit at once, and
the chain of places is followed by doubling. encode_plane() writes such images; encode() writes any ARGB image with
chosen transforms.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

# Fixed values of the lossless format: order of code-length codes, alphabet sizes, near distances (x, y).
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS, GREEN, INDEX = range(4)
#: Shortest back-reference that is looked for.
LEAST_MATCH = 12
CACHE_MULTIPLIER = 0x1E35A7BD
_REV8 = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], np.int64)


def _reverse(code: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bits of each code in reverse order (codes of up to 16 bits)."""
    code = np.asarray(code, np.int64)
    return ((_REV8[code & 255] << 8) | _REV8[code >> 8]) >> (16 - np.asarray(size, np.int64))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Canonical prefix codes of the given lengths, bits reversed as they are stored."""
    lengths = np.asarray(lengths, np.int64)
    count = np.bincount(lengths, minlength=17)
    count[0] = 0
    first = np.zeros(17, np.int64)
    for k in range(1, 17):
        first[k] = (first[k - 1] + count[k - 1]) << 1
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    rank = np.zeros(len(lengths), np.int64)
    sizes = lengths[order]
    start = np.cumsum(count) - count
    rank[order] = first[sizes] + np.arange(len(order)) - start[sizes]
    return _reverse(rank, lengths)


class Prefix:
    """A prefix code as a table over the next `bits` bits."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        used = np.flatnonzero(lengths)
        self.one = int(used[0]) if len(used) == 1 else 0 if not len(used) else None
        self.bits = 0 if self.one is not None else int(lengths.max())
        if self.one is None:
            if int((1 << (self.bits - lengths[used])).sum()) != 1 << self.bits:
                raise ValueError("prefix code is not complete")
            code = canonical(lengths)[used]
            self.symbol, self.size = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int32)
            for s, c, n in zip(used.tolist(), code.tolist(), lengths[used].tolist(), strict=True):
                self.symbol[c :: 1 << n] = s
                self.size[c :: 1 << n] = n
            self._lists = None

    def read(self, r: Reader) -> int:
        if self.one is not None:
            return self.one
        if self._lists is None:
            self._lists = self.symbol.tolist(), self.size.tolist()
        k = r.peek(self.bits)
        r.at += self._lists[1][k]
        return self._lists[0][k]


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data + b"\0" * 16, 0
        self.end = 8 * len(data)

    def peek(self, n: int) -> int:
        p = self.at >> 3
        return int.from_bytes(self.data[p : p + 8], "little") >> (self.at & 7) & ((1 << n) - 1)

    def bits(self, n: int) -> int:
        v = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("image data ends early")
        return v


class Writer:
    def __init__(self):
        self.value, self.at, self.done = 0, 0, []

    def bits(self, v: int, n: int) -> None:
        self.value |= v << self.at
        self.at += n

    def tobytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


def _read_prefix(r: Reader, size: int) -> Prefix:
    lengths = np.zeros(size, np.int64)
    if r.bits(1):
        two = r.bits(1)
        wide = 8 if r.bits(1) else 1
        lengths[r.bits(wide)] = 1
        if two:
            lengths[r.bits(8)] = 1
        return Prefix(lengths)
    n = 4 + r.bits(4)
    code = np.zeros(19, np.int64)
    for k in range(n):
        code[LENGTH_ORDER[k]] = r.bits(3)
    most = size
    if r.bits(1):
        most = 2 + r.bits(2 + 2 * r.bits(3))
        if most > size:
            raise ValueError("too many code lengths")
    if (code[:16] == 4).all() and not code[16:].any():
        # All lengths are stored as plain 4-bit codes.
        p = r.at >> 3
        chunk = np.frombuffer(r.data, np.uint8, min(most // 2 + 2, len(r.data) - p), p)
        bit = np.unpackbits(chunk, bitorder="little")[r.at & 7 :][: 4 * most].reshape(-1, 4)
        lengths[:most] = bit @ np.array([8, 4, 2, 1])
        r.at += 4 * most
        return Prefix(lengths)
    table, last, k = Prefix(code), 8, 0
    while k < size and most:
        most -= 1
        s = table.read(r)
        if s < 16:
            lengths[k] = s
            k += 1
            last = s or last
            continue
        times, v = (3 + r.bits(2), last) if s == 16 else (3 + r.bits(3), 0) if s == 17 else (11 + r.bits(7), 0)
        lengths[k : k + times] = v
        k += times
    return Prefix(lengths)


def _extra(r: Reader, s: int) -> int:
    """Value of a length or distance symbol with its extra bits."""
    if s < 4:
        return s + 1
    n = (s - 2) >> 1
    return ((2 + (s & 1)) << n) + r.bits(n) + 1


#: Number of extra bits of each length or distance symbol.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)], np.int32)


def _distance(r: Reader, dist: Prefix, w: int) -> int:
    d = _extra(r, dist.read(r))
    if d > 120:
        return d - 120
    dx, dy = NEAR[d - 1]
    return max(1, dx + dy * w)


def _copy(out: np.ndarray, at: int, size: int, d: int) -> None:
    """out[at:at+size] from d places before, where the copy may read what it has just written."""
    if d > at or at + size > len(out):
        raise ValueError("back-reference leaves the image")
    if d >= size:
        out[at : at + size] = out[at - d : at - d + size]
    else:
        out[at : at + size] = np.resize(out[at - d : at], size)


def _plane(r: Reader, green: Prefix, dist: Prefix, n: int, w: int) -> np.ndarray:
    """n green values, literals and back-references, by doubling along the chain of code places.

    Every bit is taken for the start of a code, with the extra bits and the distance code of a back-reference; so each
    place knows the next one, and the places on the true chain are found by jumps of 1, 2, 4 ... codes.
    """
    first = r.at >> 3
    copies = int(green.symbol.max()) > 255
    data = np.frombuffer(r.data, np.uint8, min(len(r.data) - first, (n * (green.bits + (30 if copies else 0)) >> 3) + 12), first).astype(np.uint32)
    word = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16)
    raw = (word[:, None] >> np.arange(8, dtype=np.uint32)).ravel()
    at = raw & np.uint32((1 << green.bits) - 1)
    step = green.size[at]
    m = len(step)
    if copies:
        k = np.flatnonzero(green.symbol[at] > 255).astype(np.int32)
        extra = _EXTRA[np.minimum(green.symbol[at[k]] - 256, 39)]
        q = np.minimum(k + step[k] + extra, m - 1)
        code = raw[q] & np.uint32((1 << dist.bits) - 1)
        d, size = (dist.one, 0) if dist.one is not None else (dist.symbol[code], dist.size[code])
        step = step.copy()
        step[k] += extra + size + _EXTRA[d]
    jump = [np.minimum(np.arange(m, dtype=np.int32) + step, m - 1)]
    while len(jump) < 6 and 1 << len(jump) < n:
        jump.append(jump[-1][jump[-1]])
    p, places = r.at & 7, []
    far = jump[-1]
    for _ in range(-(-n // (1 << (len(jump) - 1)))):
        places.append(p)
        p = int(far[p])
        if p == m - 1:
            break
    places = np.array(places, np.int32)
    for j in reversed(jump[:-1]):
        both = np.empty(2 * len(places), np.int32)
        both[::2], both[1::2] = places, j[places]
        places = both
    places = places[:n]
    symbol = green.symbol[at[places]]
    start = r.at - (r.at & 7)
    if symbol.max() < 256:
        if len(places) < n:
            raise ValueError("image data ends early")
        out, last = symbol, int(places[-1] + step[places[-1]])
    else:
        s = np.minimum(symbol - 256, 39)
        bits = _EXTRA[np.maximum(s, 0)]
        more = raw[np.minimum(places + green.size[at[places]], m - 1)].astype(np.int64) & ((1 << bits.astype(np.int64)) - 1)
        size = np.where(symbol < 256, 1, np.where(s < 4, s + 1, ((2 + (s & 1)) << bits) + more + 1))
        end = np.cumsum(size)
        stop = int(np.searchsorted(end, n))
        if stop == len(end) or end[stop] != n:
            raise ValueError("image data ends early")
        places, symbol, size, end = places[: stop + 1], symbol[: stop + 1], size[: stop + 1], end[: stop + 1]
        out = np.zeros(n, np.int32)
        plain = symbol < 256
        out[end[plain] - 1] = symbol[plain]
        for i in np.flatnonzero(~plain).tolist():
            r.at = start + int(places[i]) + int(green.size[at[places[i]]]) + int(_EXTRA[symbol[i] - 256])
            _copy(out, int(end[i] - size[i]), int(size[i]), _distance(r, dist, w))
        last = int(places[-1] + step[places[-1]])
    r.at = start + last
    if r.at > r.end:
        raise ValueError("image data ends early")
    return out


def _read_image(r: Reader, w: int, h: int, main: bool = False) -> np.ndarray:
    """ARGB pixels of one entropy-coded image."""
    cache_bits = r.bits(4) if r.bits(1) else 0
    groups, meta, block = 1, None, 0
    if main and r.bits(1):
        block = r.bits(3) + 2
        mw = (w + (1 << block) - 1) >> block
        meta = _read_image(r, mw, (h + (1 << block) - 1) >> block)
        meta = (meta >> 8 & 0xFFFF).astype(np.int64).tolist()
        groups = max(meta) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_read_prefix(r, s) for s in sizes] for _ in range(groups)]
    n = w * h
    g, red, blue, alpha, dist = codes[0]
    if meta is None and not cache_bits and red.one is not None and blue.one is not None and alpha.one is not None:
        base = np.uint32(alpha.one << 24 | red.one << 16 | blue.one)
        if g.one is not None and g.one < 256:
            return np.full(n, base | np.uint32(g.one << 8), np.uint32)
        if g.one is None:
            return _plane(r, g, dist, n, w).astype(np.uint32) << np.uint32(8) | base
    out = [0] * n
    cache = [0] * (1 << cache_bits)
    shift = 32 - cache_bits
    at = filled = 0
    while at < n:
        if meta is not None:
            y, x = divmod(at, w)
            g, red, blue, alpha, dist = codes[meta[(y >> block) * mw + (x >> block)]]
        s = g.read(r)
        if s < 256:
            out[at] = red.read(r) << 16 | s << 8 | blue.read(r) | alpha.read(r) << 24
            at += 1
        elif s < 280:
            size = _extra(r, s - 256)
            d = _distance(r, dist, w)
            if d > at or at + size > n:
                raise ValueError("back-reference leaves the image")
            for k in range(at, at + size):
                out[k] = out[k - d]
            at += size
        else:
            while filled < at:
                cache[(CACHE_MULTIPLIER * out[filled] & 0xFFFFFFFF) >> shift] = out[filled]
                filled += 1
            out[at] = cache[s - 280]
            at += 1
        if r.at > r.end:
            raise ValueError("image data ends early")
    return np.array(out, np.uint32)


def _channels(x: np.ndarray) -> np.ndarray:
    return np.stack([x >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _argb(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32) & np.uint32(255)
    return c[..., 0] << np.uint32(24) | c[..., 1] << np.uint32(16) | c[..., 2] << np.uint32(8) | c[..., 3]


def predicted(mode: int, left, top, top_right, top_left):
    """Prediction of a pixel's four channels from its neighbours'."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return avg(avg(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return avg(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return avg(avg(left, top_left), avg(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - q) for t, q in zip(top, top_left, strict=True))
        to_top = sum(abs(x - q) for x, q in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - q)) for x, t, q in zip(left, top, top_left, strict=True)]
    mid = avg(left, top)
    return [min(255, max(0, m + int((m - q) / 2))) for m, q in zip(mid, top_left, strict=True)]


def _predict(px: np.ndarray, modes: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Add (undo) or subtract predictions; px: height x width x 4, modes by block."""
    h, w, _ = px.shape
    src = px.tolist()
    out = [[None] * w for _ in range(h)]
    known = out if undo else src
    for y in range(h):
        for x in range(w):
            if not y:
                p = known[y][x - 1] if x else [255, 0, 0, 0]
            elif not x:
                p = known[y - 1][0]
            else:
                right = known[y - 1][x + 1] if x + 1 < w else known[y][0]
                p = predicted(int(modes[y >> bits][x >> bits]), known[y][x - 1], known[y - 1][x], right, known[y - 1][x - 1])
            out[y][x] = [(a + b if undo else a - b) & 255 for a, b in zip(src[y][x], p, strict=True)]
    return np.array(out, np.int64)


def _signed(x):
    return np.where(x > 127, x - 256, x)


def _cross(px: np.ndarray, elements: np.ndarray, bits: int, undo: bool) -> np.ndarray:
    """Colour correlation of green to red and blue, and of red to blue; elements by block: (-, red_to_blue, green_to_blue, green_to_red)."""
    h, w, _ = px.shape
    e = _signed(elements)[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    out = px.copy()
    green = _signed(px[..., 2])
    move = e[..., 3] * green >> 5
    out[..., 1] = (px[..., 1] + (move if undo else -move)) & 255
    red = _signed(out[..., 1] if undo else px[..., 1])
    move = (e[..., 2] * green >> 5) + (e[..., 1] * red >> 5)
    out[..., 3] = (px[..., 3] + (move if undo else -move)) & 255
    return out


def decode(data: bytes) -> np.ndarray:
    """ARGB pixels (height x width, uint32) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + (struct.unpack_from("<I", data, at + 4)[0] + 1 & ~1)
    size = struct.unpack_from("<I", data, at + 4)[0]
    r = Reader(data[at + 8 : at + 8 + size])
    if r.bits(8) != 0x2F:
        raise ValueError("bad signature")
    w, h = r.bits(14) + 1, r.bits(14) + 1
    r.bits(1)
    if r.bits(3):
        raise ValueError("unknown version")
    todo, width, seen = [], w, set()
    while r.bits(1):
        kind = r.bits(2)
        if kind in seen:
            raise ValueError("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS):
            bits = r.bits(3) + 2
            bw, bh = (width + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits
            todo.append((kind, bits, _channels(_read_image(r, bw, bh)).reshape(bh, bw, 4), width))
        elif kind == INDEX:
            n = r.bits(8) + 1
            palette = np.cumsum(_channels(_read_image(r, n, 1)), axis=0) & 255
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            todo.append((kind, bits, _argb(palette), width))
            width = (width + (1 << bits) - 1) >> bits
        else:
            todo.append((kind, 0, None, width))
    px = _read_image(r, width, h, main=True).reshape(h, width)
    for kind, bits, extra, wide in reversed(todo):
        if kind == PREDICTOR:
            px = _argb(_predict(_channels(px), extra[..., 2], bits, True))
        elif kind == CROSS:
            px = _argb(_cross(_channels(px), extra, bits, True))
        elif kind == GREEN:
            c = _channels(px)
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
            px = _argb(c)
        else:
            g = (px >> np.uint32(8) & np.uint32(255)).astype(np.int64)
            if bits:
                per = 8 >> bits
                g = (g[..., None] >> (per * np.arange(1 << bits)) & ((1 << per) - 1)).reshape(h, -1)[:, :wide]
            table = np.zeros(256, np.uint32)
            table[: len(extra)] = extra
            px = table[g]
    return px


def lengths_for(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; one symbol alone gets length 1."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64).tolist()
    while True:
        heap = [(c, k) for k, c in enumerate(weight)]
        heapq.heapify(heap)
        parent = [0] * (2 * len(weight) - 1)
        new = len(weight)
        while len(heap) > 1:
            a, i = heapq.heappop(heap)
            b, j = heap[0]
            parent[i] = parent[j] = new
            heapq.heapreplace(heap, (a + b, new))
            new += 1
        depth = [0] * new
        for k in range(new - 2, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[: len(weight)]) <= most:
            out[used] = depth[: len(weight)]
            return out
        weight = [(c >> 1) | 1 for c in weight]


def _write_prefix(wr: Writer, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        wr.bits(1 | 0 << 1 | 1 << 2, 3)
        wr.bits(int(used[0]) if len(used) else 0, 8)
        return
    if len(used) == 1:
        # A lone symbol beyond a byte: give it a partner that never occurs.
        lengths = lengths.copy()
        lengths[0] = 1
    last = max(2, int(np.flatnonzero(lengths)[-1]) + 1)
    wr.bits(0 | 15 << 1, 5)
    for s in LENGTH_ORDER:
        wr.bits(4 if s < 16 else 0, 3)
    wr.bits(1, 1)
    n = 2
    while last - 2 >= 1 << n:
        n += 2
    wr.bits((n - 2) // 2, 3)
    wr.bits(last - 2, n)
    nibbles = _REV8[lengths[:last]] >> 4
    wr.bits(int.from_bytes(np.packbits((nibbles[:, None] >> np.arange(4) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes(), "little"), 4 * last)


def _container(body: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _header(wr: Writer, w: int, h: int, alpha: int) -> None:
    if not (1 <= w <= 1 << 14 and 1 <= h <= 1 << 14):
        raise ValueError("image size out of range")
    wr.bits(0x2F, 8)
    wr.bits(w - 1, 14)
    wr.bits(h - 1, 14)
    wr.bits(alpha, 1)
    wr.bits(0, 3)


def _matches(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of back-references, in order and apart from each other.

    Places with equal eight bytes are neighbours in one sort; places whose last equal one lies equally far back, one
    after the other, make a run, and a run is one match. Greedy from the left.
    """
    n = len(flat)
    if n < 2 * LEAST_MATCH:
        return []
    key = np.ndarray((n - 7,), "<u8", flat.tobytes(), 0, (1,)).astype(np.uint64)
    # A short text's places are sorted by 16 bits of a hash, which is several times as fast; a clash hides a match.
    order = np.argsort(((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16) if n < 20_000 else key, kind="stable")
    again = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    far = np.zeros(len(key), np.int64)
    far[order[again + 1]] = order[again + 1] - order[again]
    edge = np.flatnonzero(np.r_[True, far[1:] != far[:-1], True])
    size = np.diff(edge) + 7
    good = (far[edge[:-1]] > 0) & (size >= LEAST_MATCH)
    out, at = [], 0
    for start, length in zip(edge[:-1][good].tolist(), size[good].tolist(), strict=True):
        end = start + length
        d = int(far[start])
        start = max(start, at)
        while end - start >= LEAST_MATCH:
            part = min(end - start, 4096)
            out.append((start, part, d))
            start = at = start + part
    return out


def encode_plane(plane: np.ndarray) -> bytes:
    """A grey image (height x width bytes) as its green channel, with back-references; red and blue 0, alpha 255."""
    h, w = plane.shape
    flat = plane.ravel()
    wr = Writer()
    _header(wr, w, h, 0)
    wr.bits(0, 3)  # no transform, no colour cache, no meta prefix codes
    found = _matches(flat)
    near = _near_codes(w)
    plain = np.ones(len(flat), bool)
    fields = np.zeros((len(found), 6), np.int64)
    for row, (start, length, d) in zip(fields, found, strict=True):
        plain[start : start + length] = False
        row[:3], row[3:] = _split(length), _split(near.get(d, d + 120))
    lengths = np.zeros(280, np.int64)
    lengths[:] = lengths_for(np.bincount(np.r_[flat[plain], 256 + fields[:, 0]], minlength=280))
    _write_prefix(wr, lengths)
    for only in (0, 0, 255):
        wr.bits(1 | 0 << 1 | 1 << 2, 3)
        wr.bits(only, 8)
    far = lengths_for(np.bincount(fields[:, 3], minlength=40))
    _write_prefix(wr, far)
    head, start = wr.tobytes(), wr.at
    if np.count_nonzero(lengths) == 1 and not found:
        return _container(head)
    if np.count_nonzero(lengths) == 1:  # a lone symbol beyond a byte has a partner, see _write_prefix
        lengths[0] = 1
    code, size = canonical(lengths), lengths
    far_code, far_size = (canonical(far), far) if np.count_nonzero(far) > 1 else (np.zeros(40, np.int64), np.zeros(40, np.int64))
    # Each literal is one value of so many bits, each back-reference four; in the order of their places.
    code, size = code.astype(np.int32), size.astype(np.int32)
    value, n = code[flat], size[flat]
    if found:
        g, d = 256 + fields[:, 0], fields[:, 3]
        place = np.repeat(np.cumsum(plain)[[m[0] for m in found]], 4)
        value = np.insert(value[plain], place, np.stack([code[g], fields[:, 1], far_code[d], fields[:, 4]], axis=1).ravel())
        n = np.insert(n[plain], place, np.stack([size[g], fields[:, 2], far_size[d], fields[:, 5]], axis=1).ravel())
    first = np.cumsum(n) - n
    within = np.arange(int(first[-1] + n[-1]), dtype=np.int32) - np.repeat(first.astype(np.int32), n)
    bit = (np.repeat(value, n) >> within).astype(np.uint8) & 1
    out = np.zeros(start + len(bit), np.uint8)
    out[:start] = np.unpackbits(np.frombuffer(head, np.uint8), bitorder="little")[:start]
    out[start:] = bit
    return _container(np.packbits(out, bitorder="little").tobytes())


@cache
def _near_codes(w: int) -> dict[int, int]:
    """Short codes of near distances in an image of width w."""
    near: dict[int, int] = {}
    for k, (dx, dy) in enumerate(NEAR):
        near.setdefault(max(1, dx + dy * w), k + 1)
    return near


def _symbols(px: list[int], w: int, cache_bits: int, refs: bool) -> list[tuple]:
    """Literals, back-references and cache hits that write the pixels."""
    near = _near_codes(w)
    out, seen, cache, at, filled = [], {}, {}, 0, 0
    while at < len(px):
        best = 0
        if refs and at + 3 <= len(px):
            from_ = seen.get(tuple(px[at : at + 3]))
            if from_ is not None:
                best = 3
                while at + best < len(px) and best < 4096 and px[from_ + best] == px[at + best]:
                    best += 1
        step = max(1, best)
        if cache_bits:
            while filled < at:
                cache[(CACHE_MULTIPLIER * px[filled] & 0xFFFFFFFF) >> (32 - cache_bits)] = px[filled]
                filled += 1
        if best:
            d = at - from_
            out.append(("copy", best, near.get(d, d + 120)))
        elif cache_bits and cache.get(k := (CACHE_MULTIPLIER * px[at] & 0xFFFFFFFF) >> (32 - cache_bits)) == px[at]:
            out.append(("cache", k))
        else:
            out.append(("pixel", px[at]))
        for k in range(at, at + step):
            if k >= 2:
                seen[tuple(px[k - 2 : k + 1])] = k - 2
        at += step
    return out


def _split(v: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their number) of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    n = top - 1
    return 2 * top + (v >> n & 1), v & ((1 << n) - 1), n


def _write_image(wr: Writer, px: np.ndarray, w: int, main: bool, cache_bits: int = 0, refs: bool = False) -> None:
    wr.bits(1 if cache_bits else 0, 1)
    if cache_bits:
        wr.bits(cache_bits, 4)
    if main:
        wr.bits(0, 1)
    todo = _symbols([int(v) for v in px.ravel()], w, cache_bits, refs)
    counts = [np.zeros(n, np.int64) for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]
    for kind, *v in todo:
        if kind == "pixel":
            for c, s in zip(counts, (8, 16, 0, 24), strict=False):
                c[v[0] >> s & 255] += 1
        elif kind == "copy":
            counts[0][256 + _split(v[0])[0]] += 1
            counts[4][_split(v[1])[0]] += 1
        else:
            counts[0][280 + v[0]] += 1
    sizes = [lengths_for(c) for c in counts]
    codes = []
    for n in sizes:
        _write_prefix(wr, n)
        if np.count_nonzero(n) == 1:
            lone = int(np.flatnonzero(n)[0])
            n = n.copy()
            n[0 if lone >= 256 else lone] = 1 if lone >= 256 else 0
        codes.append((canonical(n), n))
    put = lambda c, s: wr.bits(int(codes[c][0][s]) if codes[c][1][s] else 0, int(codes[c][1][s]))
    for kind, *v in todo:
        if kind == "pixel":
            for c, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                put(c, v[0] >> s & 255)
        elif kind == "copy":
            for c, base, value in ((0, 256, v[0]), (4, 0, v[1])):
                s, extra, n = _split(value)
                put(c, base + s)
                wr.bits(extra, n)
        else:
            put(0, 280 + v[0])


def encode(px: np.ndarray, transforms: tuple = (), cache_bits: int = 0, refs: bool = False, seed: int = 1, bits: int = 2) -> bytes:
    """Any ARGB image (height x width, uint32), with the given transforms in order; block parameters are drawn from seed."""
    h, w = px.shape
    rng = np.random.default_rng(seed)
    wr = Writer()
    _header(wr, w, h, 1)
    width = w
    for kind in transforms:
        wr.bits(1 | kind << 1, 3)
        bw, bh = (width + (1 << bits) - 1) >> bits, (h + (1 << bits) - 1) >> bits
        if kind == PREDICTOR:
            modes = rng.integers(0, 14, (bh, bw))
            wr.bits(bits - 2, 3)
            _write_image(wr, 0xFF000000 | modes << 8, bw, False)
            px = _argb(_predict(_channels(px), modes, bits, False))
        elif kind == CROSS:
            e = rng.integers(0, 256, (bh, bw, 4))
            wr.bits(bits - 2, 3)
            _write_image(wr, _argb(e), bw, False)
            px = _argb(_cross(_channels(px), e, bits, False))
        elif kind == GREEN:
            c = _channels(px)
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            px = _argb(c)
        else:
            palette, index = np.unique(px, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("too many colours for a palette")
            wr.bits(len(palette) - 1, 8)
            c = _channels(palette)
            _write_image(wr, _argb(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64))), len(palette), False)
            n = len(palette)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            index = index.reshape(h, width)
            if pack:
                per, more = 8 >> pack, -width % (1 << pack)
                index = np.pad(index, ((0, 0), (0, more))).reshape(h, -1, 1 << pack)
                index = (index << (per * np.arange(1 << pack))).sum(axis=2)
                width = index.shape[1]
            px = (0xFF000000 | index.astype(np.int64) << 8).astype(np.uint32)
    wr.bits(0, 1)
    _write_image(wr, px, width, True, cache_bits, refs)
    return _container(wr.tobytes())


def payload_of(text: str) -> tuple[int, bytes]:
    """(bytes of the text, payload filled with 0 to a positive multiple of 64)."""
    data = text.encode()
    return len(data), data + b"\0" * (64 if not data else -len(data) % 64)


def store(payload: bytes) -> bytes:
    """Payload as a grey image: rows of 64 bytes, or of a multiple if there are more than 2 ** 14 of them.

    A payload of at most 16 kinds of bytes is stored through a palette, two to eight pixels in one, any other one as
    its green channel; both with back-references.
    """
    wide = 64 * (-(-len(payload) // (64 << 14)))
    more = -len(payload) % wide
    grey = np.frombuffer(payload + b"\0" * more, np.uint8).reshape(-1, wide)
    if len(payload) <= 1 << 16 and np.count_nonzero(np.bincount(grey.ravel(), minlength=256)) <= 16:
        return encode(0xFF000000 | grey.astype(np.uint32) << np.uint32(8), (INDEX,), refs=True)
    return encode_plane(grey)


def _media(batches):
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for t in batch.column("text"):
            n, payload = payload_of(t.as_py() or "")
            media = store(payload)
            px = decode(media)
            grey = (px.ravel() >> np.uint32(8)).astype(np.uint8)
            back = grey[: len(payload)].tobytes()
            seen = np.bincount(grey[: len(payload)], minlength=256)
            total = int(seen @ np.arange(256))
            for c, v in zip(cols, (
                n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(),
                f"{px.shape[1]}x{px.shape[0]};mean={total / len(back):.4f};kinds={np.count_nonzero(seen)};top={int(seen.argmax())}",
            ), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], _COLS)


_COLS = ["rid", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the text stored as a lossless WebP, read back, and measured (see payload_of and store).

    One pass without a shuffle; rows are handled one by one, so memory holds one image. Null text is empty (one row of
    64 zero bytes); very long texts become larger images (up to 256 MiB, the format's limit, beyond which it raises);
    repeated rows give equal values; an empty table gives an empty result; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    schema = f"rid {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    rows = docs.select(F.col(id_col).alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_media, schema).withColumnRenamed("rid", id_col)


def _decode_rows(batches):
    for batch in batches:
        w, h, px, error = [], [], [], []
        for d in batch.column("data").to_pylist():
            try:
                image = decode(d) if d is not None else None
                w.append(None if image is None else image.shape[1])
                h.append(None if image is None else image.shape[0])
                px.append(None if image is None else image.ravel().tolist())
                error.append(None)
            except (ValueError, IndexError, struct.error) as e:
                w.append(None)
                h.append(None)
                px.append(None)
                error.append(str(e) or type(e).__name__)
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(w, pa.int32()), pa.array(h, pa.int32()), pa.array(px, pa.list_(pa.uint32())).cast(pa.list_(pa.int64())), pa.array(error, pa.string())], ["rid", "width", "height", "argb", "error"])


def decode_column(images: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, width, height, argb, error) of a binary column of lossless WebP files; broken files get an error, null stays null."""
    ship(images.sparkSession)
    kind = images.select(F.col(id_col)).dtypes[0][1]
    rows = images.select(F.col(id_col).alias("rid"), F.col(data_col).alias("data"))
    return rows.mapInArrow(_decode_rows, f"rid {kind}, width int, height int, argb array<long>, error string").withColumnRenamed("rid", id_col)
