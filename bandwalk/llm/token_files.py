"""Token ids in compressed files that answer queries: one Huffman-shaped wavelet matrix per shard.

A shard holds the ids of consecutive documents.  Every symbol has a Huffman code; plane d
holds bit d of the codes longer than d, in the order that stable partitions by the bits
before give.  Codes are dealt so that the symbols which end at a depth stand last there,
so a plane's partition needs no correction.  Each plane carries the number of ones before
every 512 bits, from which rank and select follow without unpacking the plane.

File, little-endian: magic, eight 64-bit counts (documents, tokens, symbols, planes, bytes
of the document block, 0, 0, 0), document block (zlib: ids, whether an id is null, token
counts), symbols (u4), their counts (u4), code lengths (u1, padded to 8), and for each
plane its number of bits and of zeros (i8), words (u8) and ones before each 512 bits (u4,
padded to 8).
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, discard, shared_dir
from .packing import _ENCODERS, ByteBpe

MAGIC = b"BWWM0001"
SHARD_TOKENS = 4 << 20
TASK_BYTES = 64 << 20
BLOCK = 512


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code lengths of symbols with these (positive) counts; one symbol has length 0."""
    n = len(counts)
    if n < 2:
        return np.zeros(n, np.int64)
    order = np.argsort(counts, kind="stable")
    weight = counts[order].tolist() + [0] * (n - 1)
    parent, leaf, inner = [0] * (2 * n - 1), 0, n
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                pick, leaf = leaf, leaf + 1
            else:
                pick, inner = inner, inner + 1
            total += weight[pick]
            parent[pick] = new
        weight[new] = total
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


def code_bits(lengths: np.ndarray) -> list[np.ndarray]:
    """For each plane the bit of every symbol's code; symbols that end at a depth are its last nodes."""
    top = int(lengths.max(initial=0))
    leaves = np.bincount(lengths, minlength=top + 1)
    inner = [1 - int(leaves[0])]
    for d in range(1, top + 1):
        inner.append(2 * inner[-1] - int(leaves[d]))
    bits, at = [np.zeros(len(lengths), np.uint8) for _ in range(top)], np.full(len(lengths), -1, np.int64)
    for d in range(top, 0, -1):
        ends = np.flatnonzero(lengths == d)
        at[ends] = inner[d] + np.arange(len(ends))
        own = at >= 0
        one = own & (at >= inner[d - 1])
        bits[d - 1][one] = 1
        at[one] -= inner[d - 1]
    return bits


class Plane:
    """A bit vector with the number of ones before each block."""

    def __init__(self, n: int, zeros: int, words: np.ndarray, before: np.ndarray):
        self.n, self.zeros, self.words, self.before = n, zeros, words, before

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(-(-len(bits) // BLOCK) * (BLOCK // 64), "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        ones = np.bitwise_count(words).reshape(-1, BLOCK // 64).sum(1, dtype=np.int64)
        before = np.zeros(len(ones) + 1, "<u4")
        np.cumsum(ones, out=before[1:])
        return cls(len(bits), len(bits) - int(before[-1]), words, before)

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little")

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        out, word = self.before[i // BLOCK].astype(np.int64), (i // BLOCK) * (BLOCK // 64)
        padded = np.append(self.words, np.zeros(BLOCK // 64, "<u8"))
        for k in range(BLOCK // 64):
            left = np.clip(i - (word + k) * 64, 0, 64)
            mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            out += np.bitwise_count(padded[word + k] & mask).astype(np.int64)
        return out

    def find(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the k-th (from 0) ones or zeros."""
        start = self.before.astype(np.int64)
        if not bit:
            start = np.arange(len(start)) * BLOCK - start
        block = np.searchsorted(start, k, "right") - 1
        each = np.unpackbits(self.words.reshape(-1, BLOCK // 64)[block].view(np.uint8), axis=1, bitorder="little") == bit
        return block * BLOCK + (np.cumsum(each, 1) > (k - start[block])[:, None]).argmax(1)


@dataclass
class Shard:
    """Documents and wavelet matrix of one file."""

    doc_ids: np.ndarray
    null_id: np.ndarray
    sizes: np.ndarray
    symbols: np.ndarray
    counts: np.ndarray
    lengths: np.ndarray
    planes: list[Plane]

    @classmethod
    def of(cls, doc_ids, null_id, sizes, tokens: np.ndarray) -> Shard:
        seen = np.bincount(tokens) if len(tokens) else np.zeros(0, np.int64)
        symbols = np.flatnonzero(seen)
        counts = seen[symbols]
        lengths, planes = code_lengths(counts), []
        bits = code_bits(lengths)
        kind, top = (np.int32, 31) if len(bits) <= 32 else (np.int64, 63)
        codes = np.zeros(len(symbols), np.uint64)
        for d, bit in enumerate(bits):
            codes |= bit.astype(np.uint64) << np.uint64(top - d)
        table = np.zeros(len(seen), kind)
        table[symbols] = codes.astype(np.uint32 if top == 31 else np.uint64).view(kind)
        rest = table[tokens]  # a code's next bit is the sign
        for d in range(len(bits)):
            rest = rest[: int(counts[lengths > d].sum())]
            one = rest < 0
            planes.append(Plane.of(one))
            rest = np.concatenate([rest[np.flatnonzero(~one)], rest[np.flatnonzero(one)]])
            rest <<= 1
        return cls(np.asarray(doc_ids, np.int64), np.asarray(null_id, bool), np.asarray(sizes, np.int64), symbols, counts, lengths, planes)

    def tokens(self) -> np.ndarray:
        """All ids, by undoing the partitions from the deepest plane up."""
        out, by_depth = np.zeros(0, np.uint32), [np.flatnonzero(self.lengths == d) for d in range(len(self.planes) + 1)]
        for d in range(len(self.planes), -1, -1):
            ends = by_depth[d]
            out = np.concatenate([out, np.repeat(self.symbols[ends].astype(np.uint32), self.counts[ends])])
            if d:
                plane = self.planes[d - 1]
                one = plane.bits().view(bool)
                up = np.empty(plane.n, np.uint32)
                up[np.flatnonzero(~one)], up[np.flatnonzero(one)] = out[: plane.zeros], out[plane.zeros :]
                out = up
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Ids at these positions, plane by plane."""
        at, out, own = np.array(at, np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
        for d in range(len(self.planes) + 1):
            ends = np.flatnonzero(self.lengths == d)
            inner = self.planes[d].n if d < len(self.planes) else 0
            done = at >= inner
            tail = np.cumsum(self.counts[ends])
            out[own[done]] = self.symbols[ends[np.searchsorted(tail, at[done] - inner, "right")]] if done.any() else 0
            own, at = own[~done], at[~done]
            if not len(own):
                break
            plane = self.planes[d]
            b, before = plane.get(at), plane.ones(at)
            at = np.where(b == 1, plane.zeros + before, at - before)
        return out

    def _code(self, token: int) -> tuple[int, list[int]]:
        k = int(np.searchsorted(self.symbols, token))
        if k == len(self.symbols) or self.symbols[k] != token:
            return -1, []
        return k, [int(b[k]) for b in code_bits(self.lengths)[: int(self.lengths[k])]]

    def rank(self, token: int, ends: np.ndarray) -> np.ndarray:
        """How often the id stands before each position."""
        ends = np.asarray(ends, np.int64)
        k, code = self._code(token)
        if k < 0:
            return np.zeros(len(ends), np.int64)
        at = np.append(ends, 0)
        for plane, b in zip(self.planes, code, strict=False):
            before = plane.ones(at)
            at = plane.zeros + before if b else at - before
        return at[:-1] - at[-1]

    def locate(self, token: int) -> np.ndarray:
        """All positions of the id, in order."""
        k, code = self._code(token)
        if k < 0:
            return np.zeros(0, np.int64)
        start = np.zeros(1, np.int64)
        for plane, b in zip(self.planes, code, strict=False):
            before = plane.ones(start)
            start = plane.zeros + before if b else start - before
        at = start[0] + np.arange(self.counts[k])
        for plane, b in reversed(list(zip(self.planes, code, strict=False))):
            at = plane.find(at - plane.zeros if b else at, b)
        return at

    def dump(self) -> bytes:
        docs = zlib.compress(b"".join(x.tobytes() for x in (np.diff(self.doc_ids, prepend=0).astype("<i8"), self.null_id.astype("u1"), self.sizes.astype("<i8"))), 1)
        head = np.array([len(self.sizes), int(self.sizes.sum()), len(self.symbols), len(self.planes), len(docs), 0, 0, 0], "<i8")
        parts = [MAGIC, head.tobytes(), _eight(docs), _eight(self.symbols.astype("<u4").tobytes()), _eight(self.counts.astype("<u4").tobytes()), _eight(self.lengths.astype("u1").tobytes())]
        for p in self.planes:
            parts += [np.array([p.n, p.zeros], "<i8").tobytes(), p.words.tobytes(), _eight(p.before.tobytes())]
        return b"".join(parts)

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        if raw[:8] != MAGIC:
            raise ValueError("not a token file")
        n_docs, _, n_symbols, n_planes, n_zip = np.frombuffer(raw, "<i8", 5, 8).tolist()
        at = 72

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += -(-out.nbytes // 8) * 8
            return out

        docs = zlib.decompress(take("u1", n_zip).tobytes())
        doc_ids = np.cumsum(np.frombuffer(docs, "<i8", n_docs))
        null_id = np.frombuffer(docs, "u1", n_docs, 8 * n_docs).astype(bool)
        sizes = np.frombuffer(docs, "<i8", n_docs, 9 * n_docs)
        symbols, counts, lengths = (take(kind, n_symbols).astype(np.int64) for kind in ("<u4", "<u4", "u1"))
        planes = []
        for _ in range(n_planes):
            n, zeros = take("<i8", 2).tolist()
            blocks = -(-n // BLOCK)
            planes.append(Plane(n, zeros, take("<u8", blocks * (BLOCK // 64)), take("<u4", blocks + 1)))
        return cls(doc_ids, null_id, sizes, symbols, counts, lengths, planes)


def _eight(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % 8)


def _write(path: str, raw: bytes) -> None:
    """Through a temporary name, so that a file is whole or absent."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    store.create_dir(posixpath.dirname(at), recursive=True)
    with store.open_output_stream(f"{at}.part") as out:
        out.write(raw)
    store.move(f"{at}.part", at)


def _read(path: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with store.open_input_file(at) as f:
        return f.read()


def _ids(encoder: ByteBpe, text: str) -> np.ndarray:
    """A whole text at once: a cache by chunk costs more than it saves where words are many."""
    if any(s in text for s in encoder.special):
        return np.array(encoder.whole.encode(text, add_special_tokens=False).ids, np.int32)
    return np.array(encoder.bpe.encode_ordinary(text), np.int32)


def _writer(folder: str, tokenizer: str, end_id: int, most: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = ByteBpe(tokenizer)
        encoder, task = _ENCODERS[tokenizer], TaskContext.get()
        part, attempt, seq = task.partitionId() if task else 0, uuid.uuid4().hex[:12], 0
        ids: list = []
        texts: list[np.ndarray] = []
        held = 0

        def flush():
            sizes = np.array([len(x) for x in texts], np.int64)
            raw = Shard.of([i or 0 for i in ids], [i is None for i in ids], sizes, np.concatenate(texts)).dump()
            path = f"{folder}/{part:06d}-{seq:05d}-{attempt}.wm"
            _write(path, raw)
            row = [[part], [seq], [path], [len(ids)], [int(sizes.sum())], [len(raw)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "seq", "path", "n_docs", "n_tokens", "n_bytes"])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = np.append(_ids(encoder, text or ""), np.int32(end_id))
                if held and held + len(tokens) > most:
                    yield flush()
                    ids, texts, held, seq = [], [], 0, seq + 1
                ids.append(i)
                texts.append(tokens)
                held += len(tokens)
        if held:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the ids of ``docs(doc_id, text)`` in ascending ``doc_id`` order; returns the table of the files.

    ``part, seq, path, n_docs, n_tokens, n_bytes, base``: ``base`` counts the ids of all files
    before.  Documents are ranged by id (and the text's hash, which splits rows of one id) into
    partitions; each is written as files of at most ``shard_tokens`` ids, a longer document
    alone in one.  ``tokenizer`` names a byte-level BPE file; ``end_id`` ends every document.
    A null text is empty and holds the end id alone; null ids come first; rows of the same id
    are all written, next to each other; no rows give no files.  Other columns, of any name,
    are ignored.  A task's files have names of its own attempt and count only if their rows
    are committed, so repeated tasks leave no doubles.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/bandwalk/tokens-{uuid.uuid4().hex}"
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    src = src.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "part long, seq long, path string, n_docs long, n_tokens long, n_bytes long"
    files = cut(src.mapInArrow(_writer(folder, tokenizer, end_id, shard_tokens), schema), "files")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    out = cut(files.join(before, "part").withColumn("base", F.col("before") + own).drop("before"), "token-files")
    discard(files)
    return out


def open_tokens(spark: SparkSession, table: str) -> DataFrame:
    """The table of files that ``write_tokens`` returned, if it was written to ``table``."""
    return spark.read.parquet(table)


def _spread(files: DataFrame) -> DataFrame:
    """Rows dealt out by their files' size: the table itself is too small to be split."""
    n, size = files.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    slots = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.repartition(max(1, -(-size // TASK_BYTES), min(n, slots)))


def _each(files: DataFrame, schema: str, answer) -> DataFrame:
    """``answer(shard, base)`` gives the columns of each file's rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                cols = answer(Shard.load(_read(path)), base)
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in cols], names=names)

    return _spread(files.select("path", "base", "n_bytes")).mapInArrow(run, schema)


def _documents(shard: Shard, base: int):
    import pyarrow as pa

    ends = np.cumsum(shard.sizes)
    return pa.array(shard.doc_ids, pa.int64(), mask=shard.null_id), base + ends - shard.sizes, ends


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document, read from the files."""

    def answer(shard: Shard, base: int):
        import pyarrow as pa

        ids, start, ends = _documents(shard, base)
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(shard.tokens().astype(np.int32))).cast(pa.list_(pa.int32()))
        return ids, start, lists

    return _each(files, "doc_id long, start long, ids array<int>", answer)


def digest_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the ids read from the files."""

    def answer(shard: Shard, base: int):
        ids, start, ends = _documents(shard, base)
        raw = memoryview(shard.tokens().astype("<u4", copy=False).tobytes())
        crc = np.fromiter((zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), shard.sizes.tolist(), strict=True)), np.int64, len(ends))
        return ids, start, shard.sizes, crc

    return _each(files, "doc_id long, start long, n_tokens long, ids_crc32 long", answer)


def count_tokens(files: DataFrame) -> DataFrame:
    """``token, n``: how often each id stands in the files, from their headers."""
    each = _each(files, "token long, n long", lambda shard, base: (shard.symbols, shard.counts))
    return each.groupBy("token").agg(F.sum("n").alias("n"))


def locate_tokens(files: DataFrame, tokens: list[int]) -> DataFrame:
    """``token, position, doc_id``: every place of the given ids, by select on the planes of their codes."""
    wanted = sorted({int(t) for t in tokens})

    def answer(shard: Shard, base: int):
        import pyarrow as pa

        found = [shard.locate(t) for t in wanted]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        doc = np.searchsorted(np.cumsum(shard.sizes), at, "right")
        return np.repeat(np.array(wanted, np.int64), [len(f) for f in found]), base + at, pa.array(shard.doc_ids[doc], pa.int64(), mask=shard.null_id[doc])

    return _each(files, "token long, position long, doc_id long", answer)


def count_before(files: DataFrame, token: int, position: int) -> DataFrame:
    """``n``: how often an id stands before a position of the whole sequence, by rank."""

    def answer(shard: Shard, base: int):
        return ([int(shard.rank(token, np.array([min(max(position - base, 0), int(shard.sizes.sum()))]))[0])],)

    return _each(files.where(F.col("base") < position), "n long", answer).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def tokens_at(files: DataFrame, positions: DataFrame) -> DataFrame:
    """``position, token`` for each row of ``positions(position)`` inside the sequence; repeated positions are kept.

    Positions meet their file by a cut of the sequence into steps of a shard: a file is listed under
    each step that it touches, and both sides join by equality.
    """
    step = SHARD_TOKENS
    spans = files.where("n_tokens > 0").select("path", "base", (F.col("base") + F.col("n_tokens")).alias("stop"), F.explode(F.sequence(F.floor(F.col("base") / step), F.floor((F.col("base") + F.col("n_tokens") - 1) / step))).alias("step"))
    want = positions.select(F.col("position").cast("long").alias("position")).withColumn("step", F.floor(F.col("position") / step))
    met = want.join(spans, "step").where("position >= base and position < stop")

    def run(pdf):
        import pandas as pd

        at = pdf["position"].to_numpy()
        return pd.DataFrame({"position": at, "token": Shard.load(_read(pdf["path"].iloc[0])).access(at - int(pdf["base"].iloc[0]))})

    return met.select("path", "base", "position").groupBy("path").applyInPandas(run, "position long, token long")
