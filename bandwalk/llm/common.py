"""Shared pieces: written tables that cut lineage, connected components, word hashes."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a test session that names none gets one of its own."""
    base = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        base = "/tmp/bandwalk-shared"
        spark.conf.set(CHECKPOINT_KEY, base)
    return base.rstrip("/")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/bandwalk/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of what is now written
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many leading underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    return ["_" * next(k for k in range(1, len(taken) + 2) if "_" * k + x not in taken) + x for x in names]


def hash_sample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows at most, by a threshold on the hash of ``keys``: what is sent does not grow with the partitions."""
    n = df.count()
    share = 1.0 if n <= most else most / n
    return df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(share * (1 << 30)))


def discard(df: DataFrame) -> None:
    """Delete the table of a ``cut`` whose successor is written."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an undirected edge list, component = smallest node.

    Each round joins every node's neighbours, and the node itself, to the smallest id
    among them.  Rounds end when the edge set is a set of stars and stops changing.
    Only two numbers a round reach the driver.  An edge list without rows gives no rows.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e, "edges")
    digest = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    last = digest(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hop = both.join(low, "u")
        old, e = e, hop.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(e, "edges")
        discard(old)
        now = digest(e)
        if now == last:
            break
        last = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n at least; kept by process."""
    if len(_POWERS[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, p in enumerate((_P, _P_INV)):
            full = np.full(n, p, np.uint64)
            full[0] = 1
            _POWERS[k] = np.multiply.accumulate(full)
    return _POWERS[0], _POWERS[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = sum of byte codes times P**position over buf[i:j]; len(buf)+1 entries."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * powers(len(buf) + 1)[0][: len(buf)], out=out[1:])
    return out


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes in [start, end), the same wherever they stand."""
    return mix64((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(np.uint64))


def column_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column; null counts as empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if col.null_count:
        col = col.fill_null(b"")
    wide = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(table, size: int = 1 << 20):
    """Runs [i, j) of rows of about ``size`` bytes by the offsets given; a longer row stands alone."""
    i, n = 0, len(table) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(table, table[i] + size, "right")) - 1)
        yield i, j
        i = j


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space (space and bytes 9-13)."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = _SPACE[buf]
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    return turn[::2], turn[1::2]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's ``width``-word shingles: values and row offsets.

    A-Z are folded; a row with fewer words has its whole word sequence as the one shingle.
    """
    parts, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in pieces_of(offsets):
        lo, hi = offsets[i], offsets[j]
        ends = offsets[i + 1 : j + 1] - lo + np.arange(1, j - i + 1)
        buf = np.full(hi - lo + (j - i), 0x20, np.uint8)  # a gap after each row
        keep = np.ones(len(buf), bool)
        keep[ends - 1] = False
        buf[keep] = _FOLD[data[lo:hi]]
        ws, we = words(buf)
        wh = range_hash(prefix_hash(buf), ws, we)
        first = np.searchsorted(ws, np.concatenate(([0], ends)))
        for k in range(j - i):
            w = wh[first[k] : first[k + 1]]
            if not len(w):
                continue
            n = min(width, len(w))
            h = np.full(len(w) - n + 1, n, np.uint64)
            for t in range(n):
                h = h * np.uint64(0xD6E8FEB86659FD93) + w[t : t + len(h)]
            h = np.unique(mix64(h))
            sizes[i + k] = len(h)
            parts.append(h)
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), out
