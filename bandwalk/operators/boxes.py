"""Two ordered labels: entry grid, box candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandwalk.functions.kernels import grid_coordinate


def entry_grid(vectors: DataFrame, cells: int) -> DataFrame:
    """``gx, gy, ids`` of a regular grid over both labels."""
    ends = vectors.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    lit = {k: F.lit(ends[k]) for k in ("x0", "x1", "y0", "y1")}
    v = vectors.select("vec_id", grid_coordinate(F.col("x"), lit["x0"], lit["x1"], cells).alias("gx"), grid_coordinate(F.col("y"), lit["y0"], lit["y1"], cells).alias("gy"))
    return v.groupBy("gx", "gy").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def grid_candidates(vectors: DataFrame, queries: DataFrame, cells: int) -> DataFrame:
    """``query_id, vec_id`` in the query's box: cells are joined by equality, then the box is tested."""
    ends = vectors.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    at = lambda v, a: grid_coordinate(v, F.lit(ends[f"{a}0"]), F.lit(ends[f"{a}1"]), cells)
    v = vectors.select("vec_id", "x", "y", at(F.col("x"), "x").alias("gx"), at(F.col("y"), "y").alias("gy"))
    q = queries.select("query_id", "lx", "rx", "ly", "ry", F.explode(F.sequence(at(F.col("lx"), "x"), at(F.col("rx"), "x"))).alias("gx"))
    q = q.withColumn("gy", F.explode(F.sequence(at(F.col("ly"), "y"), at(F.col("ry"), "y"))))
    return q.join(v, ["gx", "gy"]).where("x between lx and rx and y between ly and ry").select("query_id", "vec_id")
