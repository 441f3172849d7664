"""Vector files, label and range lists, parameter tables and result sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandwalk.sources.blocks import BLOCK_BYTES, KINDS, VectorSource

def read_vectors(spark: SparkSession, path: str, keep_bytes: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``vec_id, embedding`` from .fvecs, .u8bin, .i8bin or Parquet, chosen by the extension.

    A packed file, or a folder ``x.fvecs`` of such files in name order, is read in partitions of about
    ``block_bytes`` of whole records, so a file may be of any size; ids run on from file to file.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind not in KINDS:
        raise ValueError(f"unknown vector file: {path}")
    spark.dataSource.register(VectorSource)
    out = spark.read.format("packed_vectors").option("kind", kind).option("block_bytes", block_bytes).load(path)
    return out.withColumn("embedding", F.col("embedding").cast("array<tinyint>")) if keep_bytes and kind == "i8bin" else out


def write_fvecs(vectors: DataFrame, path: str) -> None:
    """One local file in id order; for exchange of samples, not of large tables."""
    with open(path, "wb") as f:
        for r in vectors.orderBy("vec_id").select("embedding").toLocalIterator():
            x = np.asarray(r[0], "<f4")
            f.write(np.int32(len(x)).tobytes() + x.tobytes())


def check_fvecs(vectors: DataFrame) -> DataFrame:
    """Histogram of dimensions."""
    return vectors.groupBy(F.size("embedding").alias("dim")).count()


def read_uints(spark: SparkSession, path: str) -> DataFrame:
    """``pos, value`` of a JSON list of non-negative integers."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<bigint>").alias("v"))
    out = raw.select(F.posexplode("v").alias("pos", "value"))
    if raw.where("v is null").count() or out.where("value is null or value < 0").count():
        raise ValueError(f"{path}: not a list of non-negative integers")
    return out


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, ql, qr`` of a flat list of closed ranges."""
    v = read_uints(spark, path).withColumn("query_id", F.floor(F.col("pos") / 2).cast("long"))
    high = F.max(F.when(F.col("pos") % 2 == 1, F.col("value")))
    high = F.coalesce(high, F.raise_error(F.lit("the length of a list of ranges is no multiple of 2")).cast("long"))
    return v.groupBy("query_id").agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("value"))).alias("ql"), high.alias("qr"))


def _nested(spark: SparkSession, path: str, width: int) -> DataFrame:
    text = spark.read.text(path, wholetext=True)
    flat = F.from_json("value", "array<bigint>")
    nested = F.from_json("value", "array<array<bigint>>")
    is_nested = F.col("value").rlike(r"^\s*\[\s*\[")
    pieces = F.transform(F.filter(F.sequence(F.lit(0), F.size(flat)), lambda i: (i % width == 0) & (i < F.size(flat))), lambda i: F.slice(flat, i + 1, width))
    pieces = F.when(F.size(flat) % width == 0, pieces).otherwise(F.raise_error(F.lit(f"the length of a flat list is no multiple of {width}")))
    return text.select(F.posexplode(F.when(is_nested, nested).otherwise(pieces)).alias("pos", "v"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """``pos, x, y`` from nested or flat label pairs."""
    return _nested(spark, path, 2).select("pos", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


def read_boxes(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, lx, rx, ly, ry`` from nested or flat boxes; reversed bounds are put right."""
    v = _nested(spark, path, 4)
    a = [F.col("v")[i] for i in range(4)]
    return v.select(F.col("pos").cast("long").alias("query_id"), F.least(a[0], a[1]).alias("lx"), F.greatest(a[0], a[1]).alias("rx"), F.least(a[2], a[3]).alias("ly"), F.greatest(a[2], a[3]).alias("ry"))


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """A sweep's parameter table: CSV with a header, # comments and quotes."""
    return spark.read.csv(path, header=True, comment="#", quote='"', escape='"')


#: Columns of a sweep's row that have to hold positive integers.
RUN_NUMBERS = ("topk", "beam_size", "trunc_size")


def check_runs(params: DataFrame, lists: DataFrame, n_queries: int) -> DataFrame:
    """``params`` (all text) with numbers, ``status`` (ok or failed) and ``reason``: a bad row fails alone.

    A row needs a range file, positive integers in ``topk, beam_size, trunc_size``, at least as many ranges as
    queries, and, if it names a ground truth file, ``topk`` ids a query in it.  ``lists(file, length)`` gives the
    lengths of the lists.  The first failing test, in this order, is the reason.  A beam below ``topk`` is raised to it.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    number = {c: F.expr(f"try_cast(trim({c}) AS long)") for c in RUN_NUMBERS}
    of = lambda c, name: lists.groupBy(F.col("file").alias(c)).agg(F.max("length").alias(name))
    rows = params.withColumns({f"{c}_": number[c] for c in RUN_NUMBERS}).join(of("qrange_file", "ranges_"), "qrange_file", "left").join(of("groundtruth_file", "truth_"), "groundtruth_file", "left")
    reason = F.when(blank("qrange_file"), "no qrange_file")
    for c in RUN_NUMBERS:
        reason = reason.when(blank(c), f"no {c}").when(F.col(f"{c}_").isNull() | (F.col(f"{c}_") <= 0), f"bad {c}")
    reason = reason.when(F.coalesce("ranges_", F.lit(0)) < 2 * n_queries, "too few ranges")
    reason = reason.when(~blank("groundtruth_file") & (F.coalesce("truth_", F.lit(0)) < F.col("topk_") * n_queries), "too few ids")
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed"))
    rows = rows.withColumn("beam_size_", F.greatest("beam_size_", "topk_"))
    return rows.select(*[F.col(f"{c}_").alias(c) if c in RUN_NUMBERS else F.col(c) for c in params.columns], "status", "reason")


def beam_grid(spec: str) -> list[tuple[int, int]]:
    """Pairs of a grid such as ``24:8,32:12``."""
    out = [tuple(int(x) for x in p.split(":")) for p in spec.split(",") if p.strip()]
    if any(len(p) != 2 or min(p) <= 0 for p in out):
        raise ValueError(f"bad grid: {spec}")
    return out


def write_results(hits: DataFrame, path: str) -> None:
    """One JSON row a query: its ids, best first."""
    hits.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rk", "id"))), lambda x: x["id"]).alias("ids")).write.json(path)


def write_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    """CSV with a header; blanks for nulls."""
    rows.write.mode(mode).csv(path, header=True)


def save_index(vectors: DataFrame, edges: DataFrame, headers: DataFrame, path: str) -> None:
    """Vectors clustered by position, so that a label range reads few row groups, with edges and headers."""
    vectors.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{path}/vectors")
    edges.repartitionByRange("src").sortWithinPartitions("src", "rank").write.parquet(f"{path}/edges")
    headers.write.parquet(f"{path}/headers")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("vectors", "edges", "headers"))

