"""Lossless WebP: a complete decoder, an encoder for byte payloads, and media columns.

The decoder reads the whole lossless format: normal and simple prefix codes, groups of
codes chosen by an entropy image, back-references with the two-dimensional distance map,
the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.
``write_webp`` chooses, by what the bytes need, among Huffman codes, back-references,
colour cache, palette and one predictor; equal bytes give equal files.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of

#: Order in which the lengths of code-length codes are stored (fixed values of the format).
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
MAX_SIDE = 16384
IMAGE_BYTES = 1 << 20
HASH = 0x1E35A7BD


def distance_map() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distance codes: nearest first, then by the format's tie order."""
    near = [(x, y) for y in range(8) for x in range(-7, 9) if (y > 0 or x > 0) and not (y == 0 and x < 0)]
    # squared length decides; among equals the more vertical offset comes first, positive x before negative
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))[:120]


class Bits:
    def __init__(self, data: bytes):
        self.data, self.pos, self.size = data, 0, len(data) * 8

    def peek(self, n: int) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 5], "little") >> (self.pos & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.pos += n
        if self.pos > self.size:
            raise ValueError("WebP stream ends early")
        return out


@functools.cache
def _turned(width: int) -> np.ndarray:
    """For each number of ``width`` bits the one with its bits in the opposite order."""
    out = np.zeros(1, np.int64)
    for _ in range(width):
        out = np.concatenate([out << 1, out << 1 | 1])
    return out


class Prefix:
    """A canonical prefix code; ``lengths`` by symbol.  ``table`` goes by the next ``width`` bits: the symbol above four bits of its length."""

    def __init__(self, lengths):
        n = np.frombuffer(bytes(lengths), np.uint8)
        used = n.nonzero()[0]
        if len(used) < 2:
            self.width, self.mask = 0, 0
            self.table = used << 4 if len(used) else np.zeros(1, np.int64)
            return
        n = n[used]
        order = n.argsort(kind="stable")
        used, n = used[order], n[order].astype(np.int64)
        self.width = int(n[-1])
        self.mask = (1 << self.width) - 1
        share = 1 << (self.width - n)
        if share.sum() != 1 << self.width:
            raise ValueError("prefix code is not complete")
        self.table = (used << 4 | n).repeat(share)[_turned(self.width)]

    def packed(self) -> list[int]:
        return self.table.tolist()


@functools.lru_cache(64)
def _meta_table(lengths: tuple[int, ...]) -> tuple[list[int], int]:
    code = Prefix(lengths)
    return code.packed(), code.mask


def _read_code(bits: Bits, size: int) -> Prefix:
    lengths = bytearray(size)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Prefix(lengths)
    meta = [0] * 19
    many = 4 + bits.read(4)
    value = int.from_bytes(bits.data[bits.pos >> 3 : (bits.pos >> 3) + 8], "little") >> (bits.pos & 7)
    for k in CODE_LENGTH_ORDER[:many]:
        meta[k] = value & 7
        value >>= 3
    bits.pos += 3 * many
    table, mask = _meta_table(tuple(meta))
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > size:
            raise ValueError("too many code lengths")
    s, before, have, value, end = 0, 8, 0, 0, bits.pos
    while s < size and left:
        if have < 16:
            at = end - have
            value, end = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 24], "little") >> (at & 7), (at >> 3 << 3) + 192
            have = end - at
        left -= 1
        e = table[value & mask]
        n, e = e >> 4, e & 15
        value >>= e
        have -= e
        if n < 16:
            lengths[s] = n
            s += 1
            before = n or before
            continue
        times, more = (3, 2) if n == 16 else (3, 3) if n == 17 else (11, 7)
        times += value & ((1 << more) - 1)
        value >>= more
        have -= more
        if s + times > size:
            raise ValueError("code lengths run over")
        if n == 16:
            lengths[s : s + times] = bytes([before]) * times
        s += times
    bits.pos = end - have
    if bits.pos > bits.size:
        raise ValueError("WebP stream ends early")
    return Prefix(lengths)


def _extended(value: int, symbol: int) -> tuple[int, int]:
    """A length or distance from its symbol and the extra bits that lead ``value``, and their number."""
    if symbol < 4:
        return symbol + 1, 0
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + (value & ((1 << extra) - 1)) + 1, extra


_MAP = distance_map()
_NEAR = np.array(_MAP).T
#: Images below which tokens are read one after the other, and tokens of each image that are read before looking which have ended.
FEW, RUN = 40, 32


class Stream:
    """The entropy-coded pixels of one image: its codes, and its tokens as far as they are read.

    A token is two numbers, ``count`` and ``value``: 0 and a pixel, -1 and a slot of the colour
    cache, or the length and the distance of a back-reference.
    """

    def __init__(self, bits: Bits, width: int, height: int, top: bool):
        self.bits, self.width, self.total = bits, width, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("colour cache too large")
        self.entropy, self.shift, groups = None, 0, 1
        if top and bits.read(1):
            self.shift = bits.read(3) + 2
            ew = (width + (1 << self.shift) - 1) >> self.shift
            eh = (height + (1 << self.shift) - 1) >> self.shift
            self.entropy = ((_pixels(bits, ew, eh, False) >> 8) & 0xFFFF).reshape(eh, ew)
            groups = int(self.entropy.max()) + 1
        size = 280 + (1 << self.cache_bits if self.cache_bits else 0)
        self.codes = [[_read_code(bits, n) for n in (size, 256, 256, 256, 40)] for _ in range(groups)]
        self.counts, self.values, self.done = [], [], 0

    def narrow(self) -> bool:
        """Whether one window of 57 bits holds any token, of one group of codes."""
        g, r, b, a, f = (c.width for c in self.codes[0])
        return self.entropy is None and g + max(r + b + a, 10 + f + 18) <= 57

    def read_on(self) -> None:
        """The tokens not yet read, one after the other."""
        bits, width, total, p, entropy, shift = self.bits, self.width, self.total, self.done, self.entropy, self.shift
        counts, values = [], []
        tables = [[(c.packed(), c.mask) for c in group] for group in self.codes]
        (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = tables[0]
        data, end, value, have = bits.data, bits.pos, 0, 0  # the lowest of the ``have`` bits in hand come next, ``end`` follows them
        while p < total:
            if have < 64:
                at = end - have
                value, end = int.from_bytes(data[at >> 3 : (at >> 3) + 40], "little") >> (at & 7), (at >> 3 << 3) + 320
                have = end - at
                if at > bits.size:
                    raise ValueError("WebP stream ends early")
            if entropy is not None:
                (green, gm), (red, rm), (blue, bm), (alpha, am), (far, fm) = tables[int(entropy[p // width >> shift, p % width >> shift])]
            e = green[value & gm]
            n = e & 15
            if e < 256 << 4:
                r = red[value >> n & rm]
                n += r & 15
                b = blue[value >> n & bm]
                n += b & 15
                a = alpha[value >> n & am]
                n += a & 15
                counts.append(0)
                values.append(a >> 4 << 24 | r >> 4 << 16 | e >> 4 << 8 | b >> 4)
                p += 1
            elif e < 280 << 4:
                value >>= n
                have -= n
                count, n = _extended(value, (e >> 4) - 256)
                e = far[value >> n & fm]
                n += e & 15
                d, more = _extended(value >> n, e >> 4)
                n += more
                counts.append(count)
                values.append(d)
                p += count
            else:
                counts.append(-1)
                values.append((e >> 4) - 280)
                p += 1
            value >>= n
            have -= n
        bits.pos = end - have
        if bits.pos > bits.size:
            raise ValueError("WebP stream ends early")
        self.counts.append(np.array(counts, np.int64))
        self.values.append(np.array(values, np.int64))
        self.done = p

    def pixels(self) -> np.ndarray:
        """ARGB pixels as unsigned 32-bit integers, row by row, from the tokens."""
        if self.done < self.total:
            self.read_on()
        n, v = np.concatenate(self.counts), np.concatenate(self.values)
        if not n.any() and len(n) >= self.total:
            return v[: self.total].astype(np.uint32)
        many = np.maximum(n, 1)
        start = many.cumsum() - many
        last = int(start.searchsorted(self.total))
        n, v, start = n[:last], v[:last], start[:last]
        ref, hit = n > 0, n < 0
        v[ref] = _in_pixels(v[ref], self.width)
        if int(start[-1] + max(n[-1], 1)) != self.total or (v > start)[ref].any():
            raise ValueError("back-reference outside the image")
        if (v[hit] >= (1 << self.cache_bits if self.cache_bits else 0)).any():
            raise ValueError("colour cache code outside the cache")
        if hit.any() and ref.any():
            return self._through_cache(n, v, start)
        if hit.any():
            # a slot holds the last pixel of its hash, and what it gives has the same hash
            slot = np.where(hit, v, (v * HASH & 0xFFFFFFFF) >> (32 - self.cache_bits))
            order = slot.argsort(kind="stable")
            plain, slot = ~hit[order], slot[order]
            source = np.maximum.accumulate(np.where(plain, np.arange(last), -1))
            kept = (source >= 0) & (slot[source] == slot)
            out = np.empty(last, np.uint32)
            out[order] = np.where(kept, v[order][source], 0)
            return out
        out, plain = np.empty(self.total, np.uint32), ~ref
        out[start[plain]] = v[plain]
        for i, n, d in zip(start[ref].tolist(), n[ref].tolist(), v[ref].tolist(), strict=True):
            out[i : i + n] = out[i - d : i - d + n] if d >= n else np.resize(out[i - d : i], n)
        return out

    def _through_cache(self, n, v, start) -> np.ndarray:
        out, cache, back = [0] * self.total, [0] * (1 << self.cache_bits), 32 - self.cache_bits
        slot = (v * HASH & 0xFFFFFFFF) >> back
        for p, n, v, s in zip(start.tolist(), n.tolist(), v.tolist(), slot.tolist(), strict=True):
            if not n:
                out[p] = cache[s] = v
            elif n < 0:
                out[p] = cache[v]
            else:
                for p in range(p, p + n):
                    x = out[p] = out[p - v]
                    cache[(HASH * x & 0xFFFFFFFF) >> back] = x
        return np.array(out, np.uint32)


def _in_pixels(d: np.ndarray, width: int) -> np.ndarray:
    """Distances in pixels of distance codes."""
    x, y = _NEAR
    return np.where(d > 120, d - 120, np.maximum(1, (x + y * width)[np.minimum(d, 120) - 1]))


def _extended_all(value: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_extended`` of many."""
    extra = np.maximum(symbol - 2, 0) >> 1
    return np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << extra) + (value & ((1 << extra) - 1))) + 1, extra


def read_together(streams: list[Stream]) -> None:
    """Read the tokens of many images, a step for the next token of each, until few images are left.

    An image that ends inside a run of steps reads what follows it; ``pixels`` leaves that out.
    """
    streams = [s for s in streams if s.narrow()]
    if len(streams) < FEW:
        return
    sizes = np.array([[len(c.table) for c in s.codes[0]] for s in streams])
    table = np.concatenate([c.table for s in streams for c in s.codes[0]]).astype(np.int32)
    offsets = (sizes.ravel().cumsum() - sizes.ravel()).reshape(sizes.shape).T.copy()
    masks = (sizes - 1).T.copy()
    blob = b"".join(s.bits.data for s in streams) + b"\0" * (RUN * 8 + 16)
    base = np.array([len(s.bits.data) for s in streams]).cumsum() - [len(s.bits.data) for s in streams]
    window = np.ndarray((len(blob) - 8,), "<i8", blob, 0, (1,)).copy()  # aligned, or each ``take`` copies it
    pos, left = base * 8 + [s.bits.pos for s in streams], np.array([s.total for s in streams])
    live = np.arange(len(streams))
    while len(live) >= FEW:
        (go, ro, bo, ao, fo), (gm, rm, bm, am, fm) = offsets, masks
        entries, other = np.empty((4, RUN, len(live)), np.int32), []
        for k in range(RUN):
            w = window.take(pos >> 3) >> (pos & 7)
            e = table.take((w & gm) + go, out=entries[0, k], mode="clip")
            n = e & 15
            x = w >> n
            for c, (m, o) in enumerate(((rm, ro), (bm, bo), (am, ao)), 1):
                more = table.take((x & m) + o, out=entries[c, k], mode="clip") & 15
                n += more
                x >>= more
            at = (e >= 256 << 4).nonzero()[0]
            if len(at):
                e = e[at]
                n[at] = e & 15
                count, v = np.full(len(at), -1), (e >> 4) - 280
                ref = (v < 0).nonzero()[0]
                if len(ref):
                    i = at[ref]
                    x = w[i] >> n[i]
                    count[ref], more = _extended_all(x, v[ref] + 24)
                    x >>= more
                    f = table.take((x & fm[i]) + fo[i])
                    more += f & 15
                    v[ref], far = _extended_all(x >> (f & 15), f >> 4)
                    n[i] += more + far
                other.append((np.full(len(at), k), at, count, v))
            pos += n
        e, r, b, a = (entries >> 4).astype(np.int64)
        v, count = (a << 24 | r << 16 | e << 8 | b).T.copy(), np.zeros((len(live), RUN), np.int64)
        if other:
            k, at, *far = (np.concatenate(x) for x in zip(*other, strict=True))
            count[at, k], v[at, k] = far
        for i, n, x in zip(live.tolist(), count, v, strict=True):
            streams[i].counts.append(n)
            streams[i].values.append(x)
        left = left - np.maximum(count, 1).sum(1)
        rest = left > 0
        if not rest.all():
            for i in live[~rest].tolist():
                streams[i].done = streams[i].total
            live, pos, left, offsets, masks = live[rest], pos[rest], left[rest], offsets[:, rest], masks[:, rest]
        if (pos > np.minimum(base[live] * 8 + [streams[i].bits.size for i in live], len(blob) * 8)).any():
            raise ValueError("WebP stream ends early")
    for i, p, n in zip(live.tolist(), pos.tolist(), left.tolist(), strict=True):
        streams[i].bits.pos, streams[i].done = p - int(base[i]) * 8, streams[i].total - n


def _pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    return Stream(bits, width, height, top).pixels()


def _channels(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(*x.shape, 4)  # blue, green, red, alpha


def _average(a, b):
    return (a + b) >> 1


def _predict(mode: int, left, up, upleft, upright):
    """The predicted pixel from its neighbours, as four small integers."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode == 11:
        return left if np.abs(up - upleft).sum() < np.abs(left - upleft).sum() else up
    if mode == 12:
        return np.clip(left + up - upleft, 0, 255)
    if mode == 13:
        a = _average(left, up)
        half = (a - upleft) / 2
        return np.clip(a + np.trunc(half).astype(np.int64), 0, 255)
    return (
        left,
        up,
        upright,
        upleft,
        _average(_average(left, upright), up),
        _average(left, upleft),
        _average(left, up),
        _average(upleft, up),
        _average(up, upright),
        _average(_average(left, upleft), _average(up, upright)),
    )[mode - 1]


def undo_predictor(img: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    height, width = img.shape
    if (modes >> 8 & 15 == 2).all():  # the pixel above: sums along the first row, then down the columns
        c = _channels(img).copy()
        c[0, 0, 3:] += np.uint8(255)
        c[0] = np.cumsum(c[0], 0, dtype=np.uint8)
        return np.cumsum(c, 0, dtype=np.uint8).reshape(height, width * 4).view("<u4").astype(np.uint32)
    out = _channels(img).astype(np.int64)
    for y in range(height):
        for x in range(width):
            if y == 0:
                guess = out[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif x == 0:
                guess = out[y - 1, 0]
            else:
                corner = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                guess = _predict(int(modes[y >> shift, x >> shift]) >> 8 & 15, out[y, x - 1], out[y - 1, x], out[y - 1, x - 1], corner)
            out[y, x] = (out[y, x] + guess) & 255
    return out.astype(np.uint8).reshape(height, width * 4).view("<u4").astype(np.uint32)


def undo_cross_colour(img: np.ndarray, tiles: np.ndarray, shift: int) -> np.ndarray:
    height, width = img.shape
    t = _channels(tiles).view(np.int8).astype(np.int64)
    t = t[np.arange(height)[:, None] >> shift, np.arange(width)[None, :] >> shift]
    c = _channels(img).copy()
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    green = signed(c[..., 1])
    red = (c[..., 2] + (t[..., 0] * green >> 5)) & 255
    blue = c[..., 0] + (t[..., 1] * green >> 5) + (t[..., 2] * signed(red) >> 5)
    c[..., 2], c[..., 0] = red, blue & 255
    return c.reshape(height, width * 4).view("<u4").astype(np.uint32)


def undo_subtract_green(img: np.ndarray) -> np.ndarray:
    c = _channels(img).copy()
    c[..., 0] += c[..., 1]
    c[..., 2] += c[..., 1]
    return c.reshape(img.shape[0], -1).view("<u4").astype(np.uint32)


def undo_palette(img: np.ndarray, palette: np.ndarray, shift: int, width: int) -> np.ndarray:
    green = (img >> 8) & 255
    x = np.arange(width)
    each = 8 >> shift
    index = green[:, x >> shift] >> ((x & ((1 << shift) - 1)) * each) & ((1 << each) - 1)
    return np.append(palette, np.zeros(256, np.uint32))[index]


def _opened(data: bytes):
    """The main stream of a lossless WebP file, and what turns its pixels into the image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8 + size + (size & 1)
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    bits = Bits(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("bad lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, inner = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind == 2:
            undo.append(undo_subtract_green)
        elif kind == 3:
            n = bits.read(8) + 1
            colours = _channels(_pixels(bits, n, 1, False).reshape(1, n))[0]
            palette = np.cumsum(colours, 0, dtype=np.uint8).reshape(-1).view("<u4").astype(np.uint32)
            shift = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append(lambda img, p=palette, s=shift, w=inner: undo_palette(img, p, s, w))
            inner = (inner + (1 << shift) - 1) >> shift
        else:
            shift = bits.read(3) + 2
            tw, th = (inner + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            tiles = _pixels(bits, tw, th, False).reshape(th, tw)
            undo.append(lambda img, t=tiles, s=shift, f=undo_cross_colour if kind else undo_predictor: f(img, t, s))
    return Stream(bits, inner, height, True), undo


def decode_webp(data: bytes) -> np.ndarray:
    """``height x width`` unsigned 32-bit ARGB pixels of a lossless WebP file."""
    return next(decode_all([data]))


def decode_all(files: list[bytes]):
    """The image of each file in turn."""
    opened = [_opened(x) for x in files]
    read_together([s for s, _ in opened])
    for s, undo in opened:
        img = s.pixels().reshape(-1, s.width)
        for f in reversed(undo):
            img = f(img)
        yield img


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.size + 7) // 8, "little")


def _lengths(counts: np.ndarray, most: int) -> np.ndarray:
    """Code lengths of a Huffman code with none above ``most``; counts are flattened until they fit."""
    out = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) < 2:
        out[used] = 1
        return out
    weight = counts[used]
    order = np.argsort(weight, kind="stable")
    n = len(used)
    while True:
        # leaves ascend, and so do the nodes, in the order in which they arise
        leaf, nodes, parent, i, j = [*weight[order].tolist(), 1 << 62], [1 << 62] * n, [0] * n, 0, 0
        above = [0] * n
        for k in range(n - 1):
            if leaf[i] <= nodes[j]:
                total, parent[i], i = leaf[i], k, i + 1
            else:
                total, above[j], j = nodes[j], k, j + 1
            if leaf[i] <= nodes[j]:
                nodes[k], parent[i], i = total + leaf[i], k, i + 1
            else:
                nodes[k], above[j], j = total + nodes[j], k, j + 1
        depth = [1] * n
        for k in range(n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if depth[parent[0]] <= most:
            out[used[order]] = [depth[k] for k in parent]
            return out
        weight = (weight + 1) >> 1


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The turned code of each symbol."""
    out = np.zeros(len(lengths), np.int64)
    used = lengths.nonzero()[0]
    if len(used) < 2:
        return out
    n = lengths[used]
    order = n.astype(np.uint8).argsort(kind="stable")
    used, n = used[order], n[order]
    width = int(n[-1])
    share = 1 << (width - n)
    first = share.cumsum() - share
    out[used] = _turned(width)[first]  # turned in the full width: its low bits are the code
    return out


def _put_code(w: BitWriter, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0]
    if len(used) < 2:
        only = int(used[0]) if len(used) else 0
        for value, n in ((1, 1), (0, 1), (1, 1), (only, 8)):
            w.put(value, n)
        return
    value, n = _meta_head()
    code, size, last = _META_CODES, META_LENGTHS, -1
    for s, length in zip([*used.tolist(), len(lengths)], [*lengths[used].tolist(), -1], strict=True):
        zeros = s - last - 1
        last = s
        while zeros >= 11:
            many = min(zeros, 138)
            value |= (code[18] | (many - 11) << size[18]) << n
            n += size[18] + 7
            zeros -= many
        if zeros >= 3:
            value |= (code[17] | (zeros - 3) << size[17]) << n
            n += size[17] + 3
        elif zeros:
            for _ in range(zeros):
                value |= code[0] << n
                n += size[0]
        if length >= 0:
            value |= code[length] << n
            n += size[length]
    w.put(value, n)


#: Lengths of the one code in which code lengths are written: four bits for zeros, runs of zeros and the lengths 2 to 12.
META_LENGTHS = [4, 5, *[4] * 11, 5, 5, 5, 0, 4, 4]
_META_CODES = _codes(np.array(META_LENGTHS)).tolist()


@functools.cache
def _meta_head() -> tuple[int, int]:
    """What leads each normal code: 0, the number of stored lengths less 4, these, and 0 as all lengths follow."""
    value, n = (19 - 4) << 1, 5
    for s in CODE_LENGTH_ORDER:
        value |= META_LENGTHS[s] << n
        n += 3
    return value, n + 1


def _split(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbol, extra bits and their number for lengths and distance codes."""
    v = v - 1
    high = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1, 1)
    n = np.where(v < 4, 0, high - 1)
    return np.where(v < 4, v, 2 * high + (v >> (high - 1) & 1)), v & ((1 << n) - 1), n


def _references(px: np.ndarray) -> list[tuple[int, int, int]]:
    """Greedy ``(start, length, distance)``: repeats of three pixels or more, from the last place before."""
    if len(px) < 4:
        return []
    v = px.astype(np.uint64)
    key = v[:-2] * np.uint64(0x9E3779B97F4A7C15) + v[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + v[2:] * np.uint64(0x165667B19E3779F9)
    order = np.argsort(key, kind="stable")
    here, before = order[1:], order[:-1]
    key = key[order]
    same = (key[1:] == key[:-1]).nonzero()[0]
    if not len(same):
        return []
    here, before = here[same], before[same]
    same = (px[here] == px[before]) & (px[here + 1] == px[before + 1]) & (px[here + 2] == px[before + 2]) & (here - before <= (1 << 20) - 120)
    here, before = here[same], before[same]
    order = np.argsort(here)
    out, free = [], 0
    for i, j in zip(here[order].tolist(), before[order].tolist(), strict=True):
        if i < free:
            continue
        n, most, look = 3, min(4096, len(px) - i), 32
        while n < most:
            m = min(look, most - n)
            differs = px[i + n : i + n + m] != px[j + n : j + n + m]
            k = int(differs.argmax())
            if differs[k]:
                n += k
                break
            n += m
            look *= 8
        out.append((i, n, i - j))
        free = i + n
    return out


def _cache_hits(px: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot of each pixel, and whether its slot holds that pixel when it comes."""
    slot = ((px.astype(np.uint64) * np.uint64(HASH) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = slot.astype(np.uint16).argsort(kind="stable")
    hit = np.zeros(len(px), bool)
    s, v = slot[order], px[order]
    hit[order[1:]] = (s[1:] == s[:-1]) & (v[1:] == v[:-1])
    return slot, hit


def _put_pixels(w: BitWriter, px: np.ndarray, width: int, top: bool) -> None:
    """Entropy-coded pixels in one group of codes, with back-references and a colour cache where it pays."""
    covered, is_ref = np.zeros(len(px), bool), np.zeros(len(px), bool)
    refs = _references(px)
    for i, n, _ in refs:
        covered[i + 1 : i + n] = True
        is_ref[i] = True
    at = (~covered).nonzero()[0]
    is_ref = is_ref[at]
    cache_bits = min(10, max(1, len(px).bit_length() - 2)) if top else 0
    hit = np.zeros(len(at), bool)
    if cache_bits:
        slot, every = _cache_hits(px, cache_bits)
        hit = every[at] & ~is_ref
        if hit.sum() * 8 < len(at):
            cache_bits, hit = 0, np.zeros(len(at), bool)
    v = (px[at] if refs else px).astype(np.int64)
    plain = (~(is_ref | hit)).nonzero()[0] if refs or cache_bits else slice(None)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    field, length = np.zeros((len(at), 4), np.int64), np.zeros((len(at), 4), np.int64)
    green, others = v >> 8 & 255, v[plain]
    others = [others >> 16 & 255, others & 255, others >> 24]
    if cache_bits:
        green[hit] = 280 + slot[at[hit]]
    far = np.zeros(0, np.int64)
    if refs:
        back = is_ref.nonzero()[0]
        n, d = np.array([r[1] for r in refs]), np.array([r[2] for r in refs])
        s, field[back, 1], length[back, 1] = _split(n)
        green[back] = 256 + s
        far, field[back, 3], length[back, 3] = _split(np.where(d == 1, 2, np.where(d == width, 1, d + 120)))
    counts = [np.bincount(green, minlength=sizes[0]), *(np.bincount(x, minlength=256) for x in others), np.bincount(far, minlength=40)]
    lens = [_lengths(c, 15) for c in counts]
    w.put(cache_bits and 1 | cache_bits << 1, 5 if cache_bits else 1)
    if top:
        w.put(0, 1)  # one group of codes
    for n in lens:
        _put_code(w, n)
    codes = [_codes(n) for n in lens]
    lens = [n if np.count_nonzero(n) > 1 else np.zeros_like(n) for n in lens]
    field[:, 0], length[:, 0] = codes[0].take(green), lens[0].take(green)
    for k, x in enumerate(others, 1):
        field[plain, k], length[plain, k] = codes[k].take(x), lens[k].take(x)
    if refs:
        field[back, 2], length[back, 2] = codes[4].take(far), lens[4].take(far)
    field, length = field.ravel(), length.ravel()
    end = np.cumsum(length)
    at = end - length
    # bits of different fields never meet, so sums stand for unions and stay exact below 2 ** 53
    shifted = (field & ((1 << length) - 1)) << (at & 31)
    words = np.bincount(at >> 5, shifted & 0xFFFFFFFF, int(end[-1] >> 5) + 2)
    words[1:] += np.bincount(at >> 5, shifted >> 32, len(words))[:-1]
    w.put(int.from_bytes(words.astype("<u4").tobytes(), "little"), int(end[-1]))


def _bits_needed(green: np.ndarray) -> float:
    """Bits a code of one channel takes at least: its entropy."""
    n = np.bincount(green.ravel(), minlength=256)
    n = n[n > 0]
    return float(green.size * np.log2(green.size) - (n * np.log2(n)).sum())


def write_webp(payload: bytes) -> bytes:
    """A lossless WebP whose pixels hold ``payload`` (a multiple of 64 bytes) as green, red, blue, alpha.

    Up to 256 colours, each met twice on average, become a palette; otherwise the pixel above
    predicts where green needs fewer bits then.  Equal bytes give equal files.
    """
    n = len(payload) // 4
    width = 16
    while -(-n // width) > MAX_SIDE:
        width *= 2
    height = -(-n // width)
    raw = np.frombuffer(payload.ljust(width * height * 4, b"\0"), np.uint8).reshape(-1, 4)
    img = np.ascontiguousarray(raw[:, [2, 0, 1, 3]]).view("<u4").astype(np.uint32).reshape(height, width)
    w = BitWriter()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(value, bits)
    colours = np.sort(img, None)
    colours = colours[np.append(True, colours[1:] != colours[:-1])]
    inner = width
    if len(colours) <= min(256, img.size // 2):
        index = np.searchsorted(colours, img)
        shift = 3 if len(colours) <= 2 else 2 if len(colours) <= 4 else 1 if len(colours) <= 16 else 0
        inner = -(-width // (1 << shift))
        w.put(1 | 3 << 1 | (len(colours) - 1) << 3, 11)
        c = _channels(colours)
        delta = np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8))
        _put_pixels(w, np.ascontiguousarray(delta).view("<u4").ravel().astype(np.uint32), len(colours), False)
        index = index.reshape(height, inner, 1 << shift) << (np.arange(1 << shift) * (8 >> shift))
        img = (index.sum(2) << 8).astype(np.uint32)
    else:
        c = _channels(img)
        left = c.copy()
        left[1:] -= c[:-1]
        left[0, 1:] -= c[0, :-1]
        left[0, 0, 3:] -= np.uint8(255)
        if _bits_needed(left[..., 1]) < _bits_needed(c[..., 1]):
            w.put(1 | 7 << 3, 6)
            tw, th = -(-width // 512), -(-height // 512)
            _put_pixels(w, np.full(tw * th, 0xFF000200, np.uint32), tw, False)
            img = left.reshape(height, width * 4).view("<u4").astype(np.uint32)
    w.put(0, 1)
    _put_pixels(w, img.ravel(), inner, True)
    chunk = w.bytes()
    chunk += b"\0" * (len(chunk) & 1)
    return b"RIFF" + (len(chunk) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk


def read_payloads(media: list[bytes], sizes: list[int]):
    """The first ``size`` payload bytes of each row of one file or of several in a row."""
    files, of = [], []
    for i, m in enumerate(media):
        at = 0
        while at < len(m):
            n = int.from_bytes(m[at + 4 : at + 8], "little") + 8
            files.append(m[at : at + n])
            of.append(i)
            at += n
    parts = [[] for _ in media]
    for i, img in zip(of, decode_all(files), strict=True):
        parts[i].append(_channels(img)[..., [1, 2, 0, 3]].tobytes())
    return [b"".join(p)[:n] for p, n in zip(parts, sizes, strict=True)]


def read_payload(media: bytes, size: int) -> bytes:
    return read_payloads([media], [size])[0]


def _store(batches):
    import pyarrow as pa

    for b in batches:
        rows = []
        for t in b.column("text"):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            n = len(raw)
            payload = raw + b"\0" * ((-n) % 64 or (64 if n == 0 else 0))
            media = b"".join(write_webp(payload[i : i + IMAGE_BYTES]) for i in range(0, len(payload), IMAGE_BYTES))
            rows.append((n, len(payload), media))
        cols = [b.column("doc_id"), *(pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)), pa.array([r[2] for r in rows], pa.large_binary()).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "payload_bytes", "media"])


def _described(payload: bytes, media: bytes, n: int) -> tuple:
    x = np.frombuffer(payload, np.uint8)[:n]
    share = np.bincount(x, minlength=256) / max(1, n)
    share = share[share > 0]
    entropy = -float((share * np.log2(share)).sum()) + 0.0
    feature = f"entropy={entropy:.4f};mean={float(x.mean()) if n else 0.0:.4f};high={int((x > 127).sum())};images={-(-len(payload) // IMAGE_BYTES)}"
    return hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def _features(batches):
    import pyarrow as pa

    for b in batches:
        out = []
        media, bytes_, sizes = ([m.as_buffer().to_pybytes() for m in b.column("media")], b.column("n_bytes").to_pylist(), b.column("payload_bytes").to_pylist())
        for i, j in pieces_of(np.cumsum([0, *map(len, media)]), 1 << 21):
            for k, payload in enumerate(read_payloads(media[i:j], sizes[i:j]), i):
                out.append(_described(payload, media[k], bytes_[k]))
        kinds = (("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))
        cols = [pa.array([r[k] for r in out], t) for k, (_, t) in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), b.column("payload_bytes"), *cols], names=["doc_id", "n_bytes", "payload_bytes", *(k for k, _ in kinds)])


def store_media(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, payload_bytes, media`` with each whole text as lossless WebP.

    A null text counts as empty; an empty one is stored as 64 zero bytes.  Texts over 1 MB
    become several images in a row.  Rows are independent; other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode the media column and describe the bytes that were read back."""
    out = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(_features, out)
