"""Filter audit, Merkle manifest and token files against brute force."""

import hashlib
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwalk.llm import filter_audit, merkle, token_files
from bandwalk.llm.queries import tokenizer

from . import plain

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, part string, bit int, before int, n int, pos long, root string"


@pytest.fixture(scope="module")
def rows():
    out = [(r[0], r[1], [None, "", "a", "b"][i % 4], r[3] if i % 5 else None, None if i % 6 == 0 else len(r[1] or "")) for i, r in enumerate(plain.documents())]
    extra = ["CAPITALS and small ones", "fee of $5", "a|b " * 120, "many " * 250 + "words", "x" * 3000, "é" * 400 + " É", " ".join(f"w{i}" for i in range(220)), " ".join(f"W{i % 90}" for i in range(220))]
    out += [(2000 + i, t, "b", "fr", 1) for i, t in enumerate(extra + extra[:4])]
    out += [(2001, "fee of $5", "b", "fr", 1)] * 2 + [(None, "fee of $5", None, None, None), ((1 << 60) + 1, "A% " * 300, "hot", "zz", 1 << 62)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3, 4, "r") for r in rows], SCHEMA).repartition(5).cache()


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def test_distinct_words_are_verified(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["", " ", "a", "a a", "é é ê", "x" * 9 + " " + "x" * 8, " ".join(rng.choice(["ab", "abcdefgh", "abcdefghi", "abcdefghj", "b" * 40, "b" * 39 + "c"], 200)), "y\x0bY\ty\ny", "l" * 5000 + " " + "l" * 5000]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = [re.findall(rb"[^\x20\x09-\x0D]+", r) for r in raw]
    for slice_ in (1 << 20, 64):
        monkeypatch.setattr(filter_audit, "SLICE", slice_)
        n, distinct = filter_audit.words_of(data, offsets)
        assert n.tolist() == [len(w) for w in want] and distinct.tolist() == [len(set(w)) for w in want]
    monkeypatch.setattr(filter_audit, "_word_hashes", lambda data, start, end: np.zeros(len(start), np.uint64))  # nothing but collisions
    assert filter_audit.words_of(data, offsets)[1].tolist() == [len(set(w)) for w in want]


def failed(row, rows):
    text = row[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    copy = row[0] is not None and any(o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in rows)
    tests = (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
    return {f for f, t in zip("ABCDE", tests, strict=True) if t}


def test_filter_audit(spark, docs, rows):
    labels = [(r[0], i % 2, int(i % 3 == 0)) for i, r in enumerate(rows) if i % 4 and r[0] is not None] + [(rows[1][0], None, 1), (None, 1, 1), (99999, 1, 1)]
    table = spark.createDataFrame([(*x, "s", 1) for x in labels], "doc_id long, quality int, toxic int, source string, n int").repartition(3)
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    sets = [(r, failed(r, rows)) for r in rows]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in filter_audit.audit(docs, table).collect()}
    parts = {r[2] or "" for r in rows}
    assert len(got) == len(parts) * 600
    for part in parts:
        mine = [(r[0], s) for r, s in sets if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                here = [i for i, (_, s) in enumerate(mine) if f in s and i not in gone]
                old = sum(f in s and i in gone for i, (_, s) in enumerate(mine))
                gone |= set(here)
                total[f] += len(here)
                r, ids = got[part, "".join(order), k + 1], [mine[i][0] for i in here]
                assert (r["kept"], r["removed"], r["redundant"]) == (len(mine) - len(gone), len(here), old)
                assert r["unique_fails"] == sum(s == {f} for _, s in mine)
                assert (r["good_lost"], r["toxic_lost"]) == (sum(i in good for i in ids if i is not None), sum(i in toxic for i in ids if i is not None))
        assert all(r["shapley"] == total[order[step - 1]] for (p, order, step), r in got.items() if p == part)


def test_filter_audit_of_nothing(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs.where("doc_id = 1000"), labels).agg(F.sum("removed")).first()[0] == 120
    hot = spark.createDataFrame([(i, "one text", f"s{i % 3}") for i in range(400)], "doc_id long, text string, source string")
    r = filter_audit.audit(hot, labels).where("filter_order = 'EABCD' and step = 1").agg(F.sum("kept"), F.sum("removed")).first()
    assert tuple(r) == (1, 399)


def tree(nodes, fanout):
    layers = [nodes]
    while len(layers[-1]) > 1:
        layers.append([sha(*layers[-1][i : i + fanout]) for i in range(0, len(layers[-1]), fanout)])
    return layers


def siblings(layers, i, fanout):
    out = []
    for layer in layers[:-1]:
        run = i - i % fanout
        out += [x for k, x in enumerate(layer[run : run + fanout], run) if k != i]
        i //= fanout
    return out


def plain_leaf(row, n_chars):
    values = [row[0], row[2], row[3], n_chars, row[1]]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


@pytest.mark.parametrize(("fanout", "levels"), [(2, 3), (3, 2)])
def test_manifest(docs, rows, fanout, levels):
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    claimed = merkle.leaf_hash(*[F.col(c) if c != "n_chars" else F.col(c) + 1 for c in columns])
    proofs = merkle.manifest(docs.withColumn("claimed", claimed), columns, keep=("claimed", "n_chars"), fanout=fanout, levels=levels)
    got = merkle.verify(proofs, "claimed", fanout).collect()
    leaves = [(r[3], r[0], plain_leaf(r, r[4]), r) for r in rows]
    by_lang = {}
    for lang, i, leaf, r in sorted(leaves, key=lambda x: (x[0] is not None, x[0] or "", x[1] is not None, x[1] or 0, x[2])):
        by_lang.setdefault(lang, []).append((i, leaf, r))
    trees = {lang: tree([leaf for _, leaf, _ in x], fanout) for lang, x in by_lang.items()}
    over = tree([t[-1][0] for t in trees.values()], fanout)
    want = []
    for p, (lang, x) in enumerate(by_lang.items()):
        for k, (i, leaf, r) in enumerate(x):
            proof = "".join(siblings(trees[lang], k, fanout) + siblings(over, p, fanout))
            same = r[4] is None
            other = merkle.fold(plain_leaf(r, None if same else r[4] + 1), proof, k, len(x), p, len(by_lang), fanout)
            assert merkle.fold(leaf, proof, k, len(x), p, len(by_lang), fanout) == over[-1][0]
            want.append((i, r[4], leaf, trees[lang][-1][0], over[-1][0], proof, other, same))
    key = lambda t: str(t)
    assert sorted([(r["doc_id"], r["n_chars"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded_root"], r["verified"]) for r in got], key=key) == sorted(want, key=key)


def test_manifest_of_little(docs):
    assert merkle.verify(merkle.manifest(docs.limit(0), ["doc_id"])).count() == 0
    one = merkle.verify(merkle.manifest(docs.where("doc_id = 1003"), ["doc_id", "text"])).collect()
    leaf = sha("4:1003", "6:the of")
    assert [(r["leaf"], r["subroot"], r["root"], r["proof"], r["verified"]) for r in one] == [(leaf, leaf, leaf, "", True)]


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_token_files(spark, docs, rows, tmp_path):
    odd = [(3000, "a<|endoftext|>b"), (3001, "   x　 y  \r\n\r\n z "), (3002, "it's 12345 I'LL \U0001f600‍!!  "), (3003, "tab\t\ttwo  spaces   three"), (3004, "LONG " * 3000)]
    both = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(*x, 1) for x in odd], "doc_id long, text string, n int"))
    texts = [(r[0], r[1]) for r in rows] + odd
    files = token_files.write_tokens(both, tokenizer("byte_bpe_50k.json"), f"{tmp_path}/out", shard_tokens=2000).cache()
    assert files.count() > 5 and files.where("n_tokens > 2000").count() == files.where("n_tokens > 2000 and n_docs = 1").count()
    docs_read = sorted(token_files.read_tokens(files).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in docs_read]
    assert ids == [None] * 2 + sorted(i for i, _ in texts if i is not None)
    whole = [t for r in docs_read for t in r["ids"]]
    ends = np.cumsum([len(r["ids"]) for r in docs_read]).tolist()
    assert [r["start"] for r in docs_read] == [0, *ends[:-1]]
    want = sorted(zip([i for i, _ in texts], ids_of([t for _, t in texts]), strict=True), key=str)
    assert sorted([(r["doc_id"], list(r["ids"])) for r in docs_read], key=str) == want
    digests = sorted(tuple(r) for r in token_files.digest_tokens(files).where("doc_id is not null").collect())
    assert digests == sorted((r["doc_id"], r["start"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in docs_read if r["doc_id"] is not None)

    arr = np.array(whole)
    assert {r["token"]: r["n"] for r in token_files.count_tokens(files).collect()} == dict(zip(*[x.tolist() for x in np.unique(arr, return_counts=True)], strict=True))
    rare = int(arr[777])
    found = sorted((r["token"], r["position"], r["doc_id"]) for r in token_files.locate_tokens(files, [rare, 50000]).where("doc_id is not null").collect())
    owner = np.repeat(np.arange(len(docs_read)), [len(r["ids"]) for r in docs_read])
    assert found == [(t, int(p), docs_read[owner[p]]["doc_id"]) for t in sorted({rare, 50000}) for p in np.flatnonzero(arr == t) if docs_read[owner[p]]["doc_id"] is not None]
    for at in (0, 1, 4321, len(whole), len(whole) + 9):
        assert token_files.count_before(files, rare, at).first()["n"] == int((arr[:at] == rare).sum())
    at = [0, 5, 5, 1999, 2000, len(whole) - 1, len(whole), -1]
    asked = spark.createDataFrame([(x,) for x in at], "position long")
    assert sorted((r["position"], r["token"]) for r in token_files.tokens_at(files, asked).collect()) == [(x, whole[x]) for x in sorted(at) if 0 <= x < len(whole)]
    assert files.agg(F.sum("n_bytes")).first()[0] > 0
    empty = token_files.write_tokens(both.limit(0), tokenizer("byte_bpe_50k.json"), f"{tmp_path}/none")
    assert empty.count() == 0 and token_files.digest_tokens(empty).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, m in ((0, 5), (1, 5), (7, 1), (600, 3), (3000, 50), (5000, 2000), (90, 64)):
        t = (rng.zipf(1.3, n) % m).astype(np.int32) if m > 1 else np.full(n, 9, np.int32)
        if m == 64:  # Fibonacci-like counts: deep codes
            t = np.repeat(np.arange(11), [1, 1, 2, 3, 5, 8, 13, 21, 34, 1, 1]).astype(np.int32)
            n = len(t)
        s = token_files.Shard.load(token_files.Shard.of([1, 2], [False, True], [n // 2, n - n // 2], t).dump())
        assert (s.tokens() == t).all() and s.doc_ids.tolist() == [1, 2] and s.null_id.tolist() == [False, True]
        if n:
            at = rng.integers(0, n, 50)
            assert (s.access(at) == t[at]).all()
            for x in {int(t[0]), int(t[-1]), 77777}:
                assert (s.locate(x) == np.flatnonzero(t == x)).all()
                e = rng.integers(0, n + 1, 20)
                assert (s.rank(x, e) == [(t[:k] == x).sum() for k in e]).all()
    with pytest.raises(ValueError, match="token file"):
        token_files.Shard.load(b"x" * 100)
