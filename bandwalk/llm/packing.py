"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A piece of n tokens costs ``linear * n + quadratic * n * n`` in attention.  Pieces go, in
descending order, to the sequence of lowest cost that still has room for them.  Whole
sequences' worth of a long document stand alone; the room offered to the rest of a batch
is exactly its tokens: sequences of full length, then powers of two for what is over, so
that no padding is left.  A piece that fits nowhere is cut.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pre-tokeniser's pattern that the byte-level vocabulary was made for (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 300_000
_ODD_GAP = re.compile(r" (?:\s|\Z)")


class ByteBpe:
    """Ids of a byte-level BPE file, with a bounded cache by space-delimited chunk.

    A chunk with the space before it is tokenised alone unless white space follows that
    space; such texts, and texts that spell a special token, take the whole-text path.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.special}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.reset()

    def reset(self) -> None:
        encoder, flat, ends = self.bpe.encode_ordinary, array("i"), array("q", [0])

        class Chunks(dict):
            def __missing__(self, chunk: str) -> int:
                flat.extend(encoder(" " + chunk))
                ends.append(len(flat))
                self[chunk] = k = len(ends) - 2
                return k

        self.chunks, self.flat, self.ends = Chunks(), flat, ends

    def encode(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.int32)
        if _ODD_GAP.search(text):
            return np.array(self.bpe.encode_ordinary(text), np.int32)
        if len(self.chunks) > CACHE:
            self.reset()
        first, *rest = text.split(" ")
        head = np.array(self.bpe.encode_ordinary(first), np.int32)
        if not rest:
            return head
        k = np.fromiter(map(self.chunks.__getitem__, rest), np.int64, len(rest))
        ends, flat = np.frombuffer(self.ends, np.int64), np.frombuffer(self.flat, np.int32)
        size = ends[k + 1] - ends[k]
        at = np.cumsum(size)
        return np.concatenate([head, flat[np.repeat(ends[k + 1] - at, size) + np.arange(at[-1])]])


def place(sizes: list[int], limit: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` for documents of these token counts."""
    out, rest, n_seq = [], [], 0
    for d, n in enumerate(sizes):
        for s in range(0, n - n % limit, limit):
            out.append((d, s, limit, n_seq, 0))
            n_seq += 1
        if n % limit:
            rest.append((n % limit, d, n - n % limit))
    total = sum(r[0] for r in rest)
    rooms = [limit] * (total // limit) + [1 << b for b in reversed(range(limit.bit_length())) if total % limit >> b & 1]
    heaps: list[list] = [[] for _ in range(limit)]  # (cost, sequence) by free room less one
    for k, room in enumerate(rooms):
        heaps[room - 1].append((0.0, k))
    none = (float("inf"), -1)
    tree = [none] * limit + [h[0] if h else none for h in heaps]  # lowest of each range of rooms
    for i in range(limit - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def renew(room: int) -> None:
        i = room - 1 + limit
        tree[i] = heaps[room - 1][0] if heaps[room - 1] else none
        while i := i >> 1:
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    free = rooms[:]
    rest.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rest:
        while n:
            i = n - 1 + limit
            pick = tree[i]
            while i > 1:
                if not i & 1 and tree[i + 1] < pick:
                    pick = tree[i + 1]
                i >>= 1
            if pick is none:  # no sequence has room: the roomiest takes what it can
                i = 1
                while i < limit:
                    i = 2 * i + (tree[2 * i + 1] is not none)
                pick = tree[i]
            cost, k = pick
            room = free[k]
            take = min(n, room)
            out.append((d, start, take, n_seq + k, rooms[k] - room))
            heapq.heappop(heaps[room - 1])
            renew(room)
            free[k] = room - take
            if free[k]:
                heapq.heappush(heaps[free[k] - 1], (cost + linear * take + quadratic * take * take, k))
                renew(free[k])
            n, start = n - take, start + take
    return out


_ENCODERS: dict[str, ByteBpe] = {}


def _packer(path: str, limit: int, linear: float, quadratic: float):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if path not in _ENCODERS:
            _ENCODERS[path] = ByteBpe(path)
        encoder, task, used = _ENCODERS[path], TaskContext.get(), 0
        base = (task.partitionId() if task else 0) << 40
        for b in batches:
            texts = b.column("text").to_pylist()
            ids = [np.append(encoder.encode(t or ""), np.int32(0)).astype("<u4") for t in texts]
            placed = place([len(x) for x in ids], limit, linear, quadratic)
            if not placed:
                continue
            d, start, length, seq, offset = map(np.array, zip(*placed, strict=True))
            crc = [zlib.crc32(ids[i][s : s + n]) for i, s, n, _, _ in placed]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            tokens = np.array([len(x) for x in ids])[d]
            cols = [b.column("doc_id").take(pa.array(d)), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens, base + used + seq, offset))]
            used += int(seq.max()) + 1
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, limit: int = 1024, linear: float = 1.0, quadratic: float = 1 / 512) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``docs(doc_id, text)``; a null text is empty and has the end id 0 alone.  Repeated rows
    and null ids are packed like any other row.  ``limit`` is a power of two.  Nothing is
    shuffled: each Arrow batch of a partition is packed by itself, which bounds the memory,
    and leaves neither padding nor a dependence on the other batches.  Other columns are
    ignored.
    """
    if limit & (limit - 1):
        raise ValueError("limit must be a power of two")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return src.mapInArrow(_packer(tokenizer, limit, linear, quadratic), out)
