"""Removal of long repeated byte strings by a logarithmic family of sparse suffix arrays.

A suffix array over every byte costs several microseconds a byte outside native code, so
the arrays here are sparse.  A window of ``length`` bytes belongs to the smallest hash
among its k-grams; equal windows thus have equal keys.  Neighbouring windows with the same
key form a run, and a run's entry stands for the suffixes that start in it: (key, hash of
all the bytes its windows cover).  A level is a table of such entries in key order with the
number of places of each.  A batch becomes a level of its own, and levels of equal rank are
merge-scanned into one of the next rank.

An entry with several places is repeated as a whole.  Where a key has several entries (the
edges of a repeat), the windows themselves are compared: as rows of bytes for ordinary
keys.  Keys with very many entries are shared by any number of tasks: their windows form blocks
by where the key's k-gram stands in them.  A block whose bytes occur elsewhere repeats as a
whole, one without another that has the bytes common to its windows not at all; only windows of
the blocks between, at the ends of repeats, become rows.  Every comparison uses 64-bit hashes
of the bytes together with the key's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, cut, discard, mix64, pieces_of, prefix_hash, range_hash

GRAM = 40
HOT = 2000
#: Windows in a block of a hot key.
SPAN = 16


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by block-wise running minima."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = (-len(x)) % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    fwd = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], fwd[w - 1 : w - 1 + n])


def runs_of(buf: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Runs over the rows that ``at`` cuts ``buf`` into.

    Gives per run: row, key, hash of its bytes, first window in the row, number of windows,
    and whether the key's k-gram stands in it more than once (its windows may then repeat
    inside the run).
    """
    empty = np.zeros(0, np.int64)
    if len(buf) < length:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty.astype(bool)
    w = length - gram + 1
    h = prefix_hash(buf)
    at0 = np.arange(len(buf) - gram + 1)
    g = range_hash(h, at0, at0 + gram)
    m = sliding_min(g, w)
    valid = np.zeros(len(m) + 1, bool)
    turn = np.zeros(len(buf) + 2, np.int32)
    long = np.flatnonzero(np.diff(at) >= length)
    np.add.at(turn, at[long], 1)
    np.add.at(turn, at[long + 1] - length + 1, -1)
    valid[1:] = np.cumsum(turn)[: len(m)] > 0
    first = np.flatnonzero(valid[1:] & ~(valid[:-1] & np.concatenate(([False], m[1:] == m[:-1]))))
    stop = np.flatnonzero(valid[1:] & ~(np.append(valid[2:], False) & np.append(m[1:] == m[:-1], False))) + 1
    masked = np.where(valid[1:], m, np.uint64(0))
    pad = np.zeros(w - 1, np.uint64)
    least = np.flatnonzero(~sliding_min(~np.concatenate([pad, masked, pad]), w) == g)
    lo, hi = np.searchsorted(least, first), np.searchsorted(least, stop + w - 1)
    n = hi - lo
    flat = np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())
    same = g[least[flat]] == np.repeat(m[first], n)
    total = np.concatenate(([0], np.cumsum(same)))
    ends = np.cumsum(n)
    recurs = total[ends] - total[ends - n] > 1
    row = np.searchsorted(at, first, "right") - 1
    return row, m[first], range_hash(h, first, stop + length - 1), first - at[row], stop - first, recurs


def _runs(length: int, gram: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, at = column_bytes(b.column("text"))
            for i, j in pieces_of(at):
                row, key, ctx, start, count, recurs = runs_of(data[at[i] : at[j]], at[i : j + 1] - at[i], length, gram)
                if not len(row):
                    continue
                row = pa.array(row + i)
                cols = [b.column("doc_id").take(row), b.column("th").take(row), pa.array(key.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(recurs)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "key", "ctx", "start", "count", "recurs"])

    return run


def _fields(structs) -> dict:
    return {f.name: c for f, c in zip(structs.type, structs.flatten(), strict=True)}


def _contexts(length: int):
    """The bytes of the runs asked for in each document."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, at = column_bytes(b.column("text"))
            asked = b.column("asked")
            row = np.repeat(np.arange(b.num_rows), np.diff(asked.offsets.to_numpy()))
            x = _fields(asked.flatten())
            start, count = x["start"].to_numpy(), x["count"].to_numpy()
            raw = data.tobytes()
            pieces = [raw[at[r] + s : at[r] + s + c + length - 1] for r, s, c in zip(row, start, count, strict=True)]
            row = pa.array(row)
            cols = [b.column("doc_id").take(row), b.column("th").take(row), *(x[f] for f in ("key", "ctx", "start", "places", "hot")), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "key", "ctx", "start", "places", "hot", "bytes"])

    return run


def _window_hashes(b, length: int):
    data, at = column_bytes(b.column("bytes"))
    n = np.diff(at) - length + 1
    row = np.repeat(np.arange(b.num_rows), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    h = prefix_hash(data)
    s = at[row] + offset
    key = b.column("key").to_numpy().view(np.uint64)[row]
    return row, offset, mix64(range_hash(h, s, s + length) ^ mix64(key))


def _spans(b, row: np.ndarray, offset: np.ndarray, repeated: np.ndarray):
    """Neighbouring repeated windows as rows (doc_id, th, start, count)."""
    import pyarrow as pa

    row, offset = row[repeated], offset[repeated]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(row))).astype(np.int32)
    at = pa.array(row[first])
    start = (b.column("start").to_numpy()[row[first]] + offset[first]).astype(np.int32)
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("th").take(at), pa.array(start), pa.array(count)], names=["doc_id", "th", "start", "count"])


def _compare(length: int, block: int = 20_000):
    """Over rows in key order: the windows of single entries that occur in another place of their key."""

    def settle(table):
        b = table.combine_chunks().to_batches()[0]
        row, offset, h = _window_hashes(b, length)
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        many = np.zeros(len(times), bool)
        many[inverse[b.column("places").to_numpy()[row] > 1]] = True
        alone = b.column("places").to_numpy()[row] == 1
        return _spans(b, row, offset, alone & ((times > 1) | many)[inverse])

    def run(batches):
        import pyarrow as pa

        held = None
        for b in batches:
            for i in range(0, b.num_rows, block):
                t = pa.Table.from_batches([b.slice(i, block)])
                held = t if held is None else pa.concat_tables([held, t])
                key = held.column("key").to_numpy()
                end = int(np.searchsorted(key, key[-1], "left"))
                if end:
                    yield settle(held.slice(0, end))
                    held = held.slice(end)
        if held is not None and held.num_rows:
            yield settle(held)

    return run


def _blocks(length: int, gram: int):
    """Blocks of windows of hot keys: hash of the bytes all windows of such a block have, hash of all its bytes, the bytes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 5000):
                c = b.slice(i, 5000)
                data, at = column_bytes(c.column("bytes"))
                n = np.diff(at) - length + 1
                row = np.repeat(np.arange(c.num_rows), n)
                s = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + at[row]
                h, key = prefix_hash(data), c.column("key").to_numpy().view(np.uint64)
                g = np.arange(len(data) - gram + 1)
                owner = np.searchsorted(at, g, "right") - 1
                spots = np.flatnonzero((range_hash(h, g, g + gram) == key[owner]) & (g + gram <= at[owner + 1]))
                spot = spots[np.searchsorted(spots, s)]  # every window holds the k-gram of its key
                block = (spot - s) // SPAN
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (spot[1:] != spot[:-1]) | (block[1:] != block[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(row)))
                row, spot, block, lo = row[first], spot[first], block[first], s[first]
                core = spot - SPAN * block
                mark = mix64(key[row] + block.astype(np.uint64))
                raw = data.tobytes()
                up = pa.array(row)
                hashes = [mix64(range_hash(h, core, core + length - SPAN + 1) ^ mark), mix64(range_hash(h, lo, lo + count + length - 1) ^ ~mark)]
                cols = [*(c.column(f).take(up) for f in ("doc_id", "th", "key", "places")), pa.array((c.column("start").to_numpy()[row] + lo - at[row]).astype(np.int32)), pa.array(count.astype(np.int32))]
                cols += [pa.array(x.view(np.int64)) for x in hashes] + [pa.array([raw[x : x + k + length - 1] for x, k in zip(lo, count, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "key", "places", "start", "count", "core", "whole", "bytes"])

    return run


def _windows(length: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 5000):
                c = b.slice(i, 5000)
                row, offset, h = _window_hashes(c, length)
                at = pa.array(row)
                cols = [*(c.column(f).take(at) for f in ("doc_id", "th", "places", "unsure")), pa.array((c.column("start").to_numpy()[row] + offset).astype(np.int32)), pa.array(h.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "places", "unsure", "start", "h"])

    return run


def _hot_spans(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, th, start, count`` of the repeated windows of single entries of hot keys."""
    blocks = contexts.mapInArrow(_blocks(length, gram), "doc_id long, th long, key long, places int, start int, count int, core long, whole long, bytes binary")
    blocks = cut(blocks, "blocks")
    several = lambda by: blocks.groupBy(by).agg(F.count("*").alias("t"), F.max("places").alias("p")).where("t > 1 or p > 1").select(by)
    known = blocks.select("doc_id", "th", "places", "start", "count", "core", "whole").join(several("core"), "core", "left_semi")
    known = known.join(several("whole").withColumn("same", F.lit(True)), "whole", "left").withColumn("same", F.coalesce("same", F.lit(False)))
    known = cut(known, "known")
    sure = known.where("same and places = 1").select("doc_id", "th", "start", "count")
    unsure = known.where("not same and places = 1").select("core").distinct()
    rows = blocks.join(unsure, "core", "left_semi").join(known.where("not same").select("doc_id", "th", "start", F.lit(True).alias("unsure")).distinct(), ["doc_id", "th", "start"], "left")
    hashes = rows.select("doc_id", "th", "key", "places", F.coalesce("unsure", F.lit(False)).alias("unsure"), "start", "bytes")
    hashes = cut(hashes.mapInArrow(_windows(length), "doc_id long, th long, places int, unsure boolean, start int, h long"), "windows")
    twice = hashes.groupBy("h").agg(F.count("*").alias("t"), F.max("places").alias("p")).where("t > 1 or p > 1").select("h")
    edge = hashes.where("unsure and places = 1").join(twice, "h", "left_semi").select("doc_id", "th", "start", F.lit(1).alias("count"))
    return sure.unionByName(edge)


def _remove(length: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, at = column_bytes(b.column("text"))
            spans = b.column("spans")
            off, x = spans.offsets.to_numpy(), _fields(spans.flatten())
            off = off - off[0]
            start, count = x["start"].to_numpy(), x["count"].to_numpy()
            n_removed, n_spans, sha, kept = [], [], [], []
            for i in range(b.num_rows):
                d = data[at[i] : at[i + 1]]
                turn = np.zeros(len(d) + 1, np.int64)
                s, c = start[off[i] : off[i + 1]], count[off[i] : off[i + 1]]
                np.add.at(turn, s, 1)
                np.add.at(turn, s + c + length - 1, -1)
                gone = np.cumsum(turn[:-1]) > 0
                n_removed.append(int(gone.sum()))
                n_spans.append(int((gone & ~np.concatenate(([False], gone[:-1]))).sum()))
                kept.append(d[~gone].tobytes())
                sha.append(hashlib.sha256(kept[-1]).hexdigest())
            cols = [b.column("doc_id"), pa.array(np.diff(at)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


class SuffixIndex:
    """Levels of entries ``(key, ctx, places, recurs)``; each batch of runs is added once."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, runs: DataFrame) -> None:
        """Aggregate a batch to a level of rank 0, then merge levels of equal rank."""
        level, rank = cut(runs.groupBy("key", "ctx").agg(F.count("*").alias("places"), F.max("recurs").alias("recurs")), "level0"), 0
        while self.levels and self.levels[-1][0] == rank:
            parts = [self.levels.pop()[1], level]
            rank += 1
            level = cut(self._merged(parts), f"level{rank}")
            for x in parts:
                discard(x)
        self.levels.append((rank, level))

    @staticmethod
    def _merged(levels: list[DataFrame]) -> DataFrame:
        both = levels[0]
        for other in levels[1:]:
            both = both.unionByName(other)
        return both.groupBy("key", "ctx").agg(F.sum("places").alias("places"), F.max("recurs").alias("recurs"))

    def entries(self) -> DataFrame:
        """All entries, as one level."""
        if len(self.levels) > 1:
            parts = [x for _, x in self.levels]
            self.levels = [(self.levels[0][0] + 1, cut(self._merged(parts), "entries"))]
            for x in parts:
                discard(x)
        return self.levels[0][1]


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = GRAM, batches: int = 2, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` (binary) per row of ``docs(doc_id, text)``.

    A byte goes if any ``length``-byte string over it also starts elsewhere in the input,
    in the same row or another.  Null texts are empty.  Texts shorter than ``length`` stay
    whole.  Rows that repeat both id and text are places like any other, so each loses all
    that repeats.  Null ids are rows like any other.  Other columns are ignored.
    """
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    src = src.withColumn("th", F.xxhash64("text"))
    runs = cut(src.select("doc_id", "th", "text").mapInArrow(_runs(length, gram), "doc_id long, th long, key long, ctx long, start int, count int, recurs boolean"), "runs")
    index = SuffixIndex()
    for k in range(batches):
        index.add(runs.where(F.pmod(F.xxhash64("doc_id", "th"), F.lit(batches)) == k) if batches > 1 else runs)
    entries = index.entries()
    single = F.sum((F.col("places") == 1).cast("long"))
    per_key = entries.groupBy("key").agg(F.count("*").alias("n"), single.alias("single"), F.max("recurs").alias("again"))
    per_key = per_key.where("single > 0 and (n > 1 or again)").select("key", (F.col("n") > hot).alias("hot"))
    open_ = entries.join(per_key, "key", "left").where("places > 1 or hot is not null").select("key", "ctx", F.least("places", F.lit(2)).cast("int").alias("places"), "hot")
    found = cut(runs.drop("recurs").join(open_, ["key", "ctx"]), "found")
    discard(runs)
    discard(entries)
    spans = found.where("places > 1").select("doc_id", "th", "start", "count")
    asked = found.where("hot is not null")
    place = F.struct("doc_id", "th", "start", "count")
    several = asked.where("places > 1").groupBy("key", "ctx", "places", "hot").agg(F.min(place).alias("at")).select("key", "ctx", "places", "at.*", "hot")
    asked = several.unionByName(asked.where("places = 1"))
    asked = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("key", "ctx", "start", "count", "places", "hot")).alias("asked"))
    one = src.select("doc_id", "th", "text").join(asked, ["doc_id", "th"])
    contexts = one.mapInArrow(_contexts(length), "doc_id long, th long, key long, ctx long, start int, places int, hot boolean, bytes binary")
    contexts = cut(contexts, "contexts")
    plain = contexts.where("not hot").repartition("key").sortWithinPartitions("key")
    edge = plain.mapInArrow(_compare(length), "doc_id long, th long, start int, count int")
    wide = _hot_spans(contexts.where("hot"), length, gram)
    spans = spans.unionByName(cut(edge, "edge")).unionByName(cut(wide, "wide"))
    spans = spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "count")).alias("spans"))
    none = F.array().cast("array<struct<start:int,count:int>>")
    out = src.join(spans, ["doc_id", "th"], "left").withColumn("spans", F.coalesce("spans", none))
    out = out.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text", "spans")
    return out.mapInArrow(_remove(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary")
