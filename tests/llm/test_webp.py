"""The full decoder on streams with prefix codes, back-references, colour cache and transforms."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from bandwalk.llm import media

CACHE_BITS = 4


def code_of(used):
    """``symbol -> (bits turned, length)`` and lengths of a complete code whose lengths differ by one at most."""
    used = sorted(used)
    if len(used) == 1:
        return {used[0]: (0, 0)}, {used[0]: 1}
    width = (len(used) - 1).bit_length()
    short = (1 << width) - len(used)
    lengths = {s: width - (k < short) for k, s in enumerate(used)}
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in lengths.items()):
        code <<= n - last
        out[s], last = (int(format(code, f"0{n}b")[::-1], 2), n), n
        code += 1
    return out, lengths


def split(v):
    """Symbol, extra bits and their number of a length or distance."""
    v -= 1
    if v < 4:
        return v, 0, 0
    h = v.bit_length() - 1
    return 2 * h + (v >> (h - 1) & 1), v & ((1 << (h - 1)) - 1), h - 1


def put_image(w, pixels, width, top):
    """Entropy-coded pixels; the main image also uses a colour cache and back-references."""
    tokens, cache, p = [], {}, 0
    slot = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    while p < len(pixels):
        best = (0, 0)
        for d in (1, width, 7 * width + 3) if top else ():
            n = 0
            while d <= p and p + n < len(pixels) and pixels[p + n] == pixels[p + n - d]:
                n += 1
            best = max(best, (n, d))
        n, d = best
        if n > 2:
            tokens.append(("far", split(n), split({1: 2, width: 1}.get(d, d + 120))))
        elif top and cache.get(slot(pixels[p])) == pixels[p]:
            n = 1
            tokens.append(("cache", 280 + slot(pixels[p])))
        else:
            n, v = 1, pixels[p]
            tokens.append(("pixel", v >> 8 & 255, v >> 16 & 255, v & 255, v >> 24))
        for v in pixels[p : p + n]:
            cache[slot(v)] = v
        p += n
    w.put(int(top), 1)
    if top:
        w.put(CACHE_BITS, 4)
        w.put(0, 1)  # one group of codes
    used = [{0} for _ in range(5)]
    for t in tokens:
        if t[0] == "pixel":
            for k in range(4):
                used[k].add(t[1 + k])
        elif t[0] == "cache":
            used[0].add(t[1])
        else:
            used[0].add(256 + t[1][0])
            used[4].add(t[2][0])
    codes = []
    for k, size in enumerate((280 + (top << CACHE_BITS), 256, 256, 256, 40)):
        code, lengths = code_of(used[k])
        codes.append(code)
        w.put(0, 1)
        w.put(15, 4)
        for s in media.CODE_LENGTH_ORDER:
            w.put(4 if s < 16 else 0, 3)
        w.put(0, 1)
        for s in range(size):
            w.put(int(format(lengths.get(s, 0), "04b")[::-1], 2), 4)
    for t in tokens:
        if t[0] == "pixel":
            for k in range(4):
                w.put(*codes[k][t[1 + k]])
        elif t[0] == "cache":
            w.put(*codes[0][t[1]])
        else:
            w.put(*codes[0][256 + t[1][0]])
            w.put(*t[1][1:])
            w.put(*codes[4][t[2][0]])
            w.put(*t[2][1:])
    return Counter(t[0] for t in tokens)


def file_of(width, height, body):
    w = media.BitWriter()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        w.put(v, n)
    kinds = body(w)
    chunk = w.bytes()
    chunk += b"\0" * (len(chunk) & 1)
    return b"RIFF" + (len(chunk) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(chunk).to_bytes(4, "little") + chunk, kinds


def picture(width, height, colours, seed=1):
    rng = np.random.default_rng(seed)
    img = rng.choice(rng.integers(0, 2**32, colours, dtype=np.uint64), (height, width)).astype(np.uint32)
    img[height // 2 :, : width // 2] = img[: height - height // 2, : width // 2]
    img[3] = img[2]
    img[5, 4:] = img[5, 4]
    return img


def parts(v):
    return [v >> s & 255 for s in (0, 8, 16, 24)]  # blue, green, red, alpha


def whole(c):
    return sum((x & 255) << s for x, s in zip(c, (0, 8, 16, 24)))


def guess(mode, left, up, corner, right):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clip = lambda c: [min(255, max(0, x)) for x in c]
    if mode == 11:
        by_left = sum(abs(x + y - z - x) for x, y, z in zip(left, up, corner))
        by_up = sum(abs(x + y - z - y) for x, y, z in zip(left, up, corner))
        return left if by_left < by_up else up
    if mode == 12:
        return clip([x + y - z for x, y, z in zip(left, up, corner)])
    if mode == 13:
        return clip([x + int((x - z) / 2) for x, z in zip(mean(left, up), corner)])
    return {0: [0, 0, 0, 255], 1: left, 2: up, 3: right, 4: corner, 5: mean(mean(left, right), up), 6: mean(left, corner), 7: mean(left, up), 8: mean(corner, up), 9: mean(up, right), 10: mean(mean(left, corner), mean(up, right))}[mode]


def signed(x):
    return (x & 255) - 256 if x & 128 else x & 255


def test_back_references_and_cache():
    img = picture(21, 33, 12)
    raw, kinds = file_of(21, 33, lambda w: (w.put(0, 1), put_image(w, img.ravel().tolist(), 21, True))[1])
    assert min(kinds[k] for k in ("pixel", "cache", "far")) > 3
    assert (media.decode_webp(raw) == img).all()


def test_transforms():
    width, height = 37, 30
    img = picture(width, height, 40)
    rng = np.random.default_rng(6)
    tw, th = -(-width // 4), -(-height // 4)
    modes, cross = (np.arange(tw * th) % 14).tolist(), rng.integers(0, 256, (tw * th, 3)).tolist()
    at = lambda y, x: (y >> 2) * tw + (x >> 2)
    rows = []
    for y in range(height):
        for x in range(width):
            b, g, r, a = parts(int(img[y, x]))
            r, b = r - g & 255, b - g & 255
            to_red, to_blue, red_blue = map(signed, cross[at(y, x)])
            rows.append([b - (to_blue * signed(g) >> 5) - (red_blue * signed(r) >> 5) & 255, g, r - (to_red * signed(g) >> 5) & 255, a])
    left = []
    for y in range(height):
        for x in range(width):
            p = y * width + x
            if not p:
                g = [0, 0, 0, 255]
            elif not y:
                g = rows[p - 1]
            elif not x:
                g = rows[p - width]
            else:
                g = guess(modes[at(y, x)], rows[p - 1], rows[p - width], rows[p - width - 1], rows[p - width + 1])
            left.append(whole([i - j for i, j in zip(rows[p], g)]))

    def body(w):
        w.put(1, 1)
        w.put(2, 2)  # subtract green
        for kind, tiles in ((1, [whole([*c, 255]) for c in cross]), (0, [m << 8 for m in modes])):
            w.put(1, 1)
            w.put(kind, 2)
            w.put(0, 3)
            put_image(w, tiles, tw, False)
        w.put(0, 1)
        return put_image(w, left, width, True)

    assert (media.decode_webp(file_of(width, height, body)[0]) == img).all()


@pytest.mark.parametrize("colours", [2, 4, 13, 60])
def test_palette(colours):
    width, height = 27, 19
    img = picture(width, height, colours)
    palette = np.unique(img).tolist()
    shift = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    index = np.searchsorted(palette, img)
    inner = -(-width // (1 << shift))
    packed = [sum(int(index[y, x]) << (x & ((1 << shift) - 1)) * (8 >> shift) for x in range(i << shift, min(width, (i + 1) << shift))) << 8 for y in range(height) for i in range(inner)]

    def body(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(len(palette) - 1, 8)
        c = [parts(v) for v in palette]
        put_image(w, [whole(a if k == 0 else [i - j for i, j in zip(a, c[k - 1])]) for k, a in enumerate(c)], len(palette), False)
        w.put(0, 1)
        return put_image(w, packed, inner, True)

    assert (media.decode_webp(file_of(width, height, body)[0]) == img).all()


def payloads():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 256, (400, 4), dtype=np.uint8)
    text = b" ".join(b"word%d of line %d" % (i * i % 37, i) for i in range(900))
    yield "noise", rng.integers(0, 256, 6400, dtype=np.uint8).tobytes()
    for k in (1, 2, 3, 5, 17, 200, 400):
        yield f"{k} colours", words[rng.integers(0, k, 2000)].tobytes()
    yield "repeats", (text[:4000] * 3)[:11968]
    yield "text", text[: len(text) // 64 * 64]
    yield "slope", ((rng.integers(0, 256, 64) + np.arange(300)[:, None] * 3) & 255).astype(np.uint8).tobytes()
    yield "zeros", bytes(64)
    yield "long run", b"abcd" * 40000
    yield "skewed", b"".join(bytes([i]) * (4 << i) for i in range(18))[: (4 << 18) // 64 * 64 - 64]


@pytest.mark.parametrize("name,payload", list(payloads()), ids=lambda x: x if isinstance(x, str) else "")
def test_written_files_read_back(name, payload):
    payload = payload[: len(payload) // 64 * 64]
    raw = media.write_webp(payload)
    assert media.read_payload(raw, len(payload)) == payload
    assert raw == media.write_webp(payload)
    if name not in ("noise", "zeros"):
        assert len(raw) < len(payload)


def test_written_files_use_the_method(monkeypatch):
    seen = Counter()
    for name in ("undo_predictor", "undo_palette"):
        real = getattr(media, name)
        monkeypatch.setattr(media, name, lambda *a, name=name, real=real: (seen.update([name]), real(*a))[1])
    for _, payload in payloads():
        payload = payload[: len(payload) // 64 * 64]
        assert media.read_payload(media.write_webp(payload), len(payload)) == payload
    assert seen["undo_predictor"] and seen["undo_palette"] > 3
    px = np.frombuffer(dict(payloads())["text"][:13312], "<u4").astype(np.uint32)
    assert media._references(px) and media._cache_hits(px, 8)[1].any()


def test_text_of_several_images(spark):
    text = "".join(f"{i} lies in line {i % 97}\n" for i in range(60000))
    raw = text.encode()
    row = media.media_features(media.store_media(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    padded = raw + bytes(-len(raw) % 64)
    assert row.feature.endswith("images=2") and row.payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert row.media_bytes < len(raw) / 2


def test_cut_streams_are_refused():
    raw = media.write_webp(dict(payloads())["noise"])
    at = len(raw) // 2
    with pytest.raises(ValueError):
        media.decode_webp(raw[:12] + b"VP8L" + (at - 20).to_bytes(4, "little") + raw[20:at])


def test_many_files_are_read_together(monkeypatch):
    """Tokens of many images come a step for each; few are left to be read one after the other, and all bytes come back."""
    source = [p for _, p in payloads()]
    all_ = [p[i * 64 : i * 64 + 64 * (1 + 7 * i % 90)].ljust(64, b"x") for i in range(40) for p in source]
    raw = [media.write_webp(p) for p in all_]
    alone = []
    real = media.Stream.read_on
    monkeypatch.setattr(media.Stream, "read_on", lambda s: (alone.append(s.total - s.done), real(s))[1])
    assert media.read_payloads(raw, [len(p) for p in all_]) == all_
    assert sum(alone) < sum(map(len, all_)) / 4 / 2
    cut = raw[5][:12] + b"VP8L" + (len(raw[5]) // 2 - 20).to_bytes(4, "little") + raw[5][20 : len(raw[5]) // 2]
    with pytest.raises(ValueError):
        list(media.decode_all([*raw, cut]))
