"""Brute-force versions and a fixture with the awkward cases."""

import hashlib
import random
import re

LONG = " ".join(f"w{i}" for i in range(120))


def documents(seed=3, n=60):
    """Rows (doc_id, text, n, lang): copies, near copies, repeats, nulls, empties and a long text."""
    rng = random.Random(seed)
    vocabulary = ["of", "the", "on", "an"] + ["".join(rng.choices("abcdeö", k=rng.randint(3, 9))) for _ in range(300)]
    line = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))
    shared = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(n):
        text = "\n".join(line() for _ in range(rng.randint(1, 6)))
        if i % 7 == 3:
            text = rows[-1][1]
        if i % 7 == 4 and rows[-1][1]:
            words = rows[-1][1].split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        if i % 6 == 0:
            text += " " + shared + " " + line()
        if i % 9 == 0:
            text += f"\nReleased under the MIT License. Apache-License, version 2; CC BY-NC 4.0. token = \"{'%040x' % rng.getrandbits(160)}\""
        rows.append((i * 3 + 1, text, i, "de" if i % 2 else "en"))
    rows += [(1000, None, 1, None), (1001, "", 2, "en"), (1002, " \t\n ", 3, "en"), (1003, "the of", 4, "en"), (1004, "The OF", 5, "en"), (1005, "ab " * 400, 6, "en"), (1006, "ab " * 300, 6, "en")]
    rows += [(1007, (LONG + "\n") * 30, 7, "en"), (1008, LONG, 8, "en"), (1009, "é" * 500, 9, "fr"), (1009, "é" * 500, 9, "fr"), (None, "lonely text without an id", 10, "en")]
    return rows


SCHEMA = "doc_id long, text string, n int, lang string"


def fold(b):
    return b.translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))


def groups(nodes, links):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def shingles(text, width=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", fold((text or "").encode()))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_duplicates(rows, percent=75):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    comp = groups(ids, links)
    return {d: (len(sets[d]), comp[d], comp[d] == d) for d in ids}


def repeats(rows, length=200):
    texts = [(r[1] or "").encode() for r in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for r, t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def similar_lines(rows, percent=90):
    """(doc_id, text) -> numbers of lines to remove."""
    lines = []
    for d, t in sorted({(r[0] if r[0] is not None else 2**63 - 1, r[1] or "") for r in rows}):
        lines += [(d, t, k, frozenset(x for x in re.split(r"[ \t\n\r\x0b\f]+", s.lower()) if x)) for k, s in enumerate(t.split("\n"))] if t else []
    gone = {}
    for i, (d, t, k, s) in enumerate(lines):
        if s and any(100 * len(s & o[3]) >= percent * len(s | o[3]) for o in lines[:i] if o[3]):
            gone.setdefault((d, t), set()).add(k)
    return gone


def license_bases(text):
    w = [x.decode() for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold((text or "").encode()))]
    found = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        found += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), len(found), min((i for _, i in found), default=None), max((i for _, i in found), default=None), ",".join(sorted({x for x, _ in found}))
