"""Approximate k-NN graphs by neighbours of neighbours, and bridges found by searches from seeds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.functions.kernels import squared_l2
from bandwalk.operators import graph, search


def _local_join(batches):
    """Each row lists the members of one node; pairs with a fresh member that are nearer than a member's bound."""
    import pyarrow as pa

    for b in batches:
        members = b.column("members")
        if isinstance(members, pa.ChunkedArray):
            members = members.combine_chunks()
        ends = members.offsets.to_numpy()
        flat = members.values
        ids, fresh, bound = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("m", "fresh", "worst"))
        vectors = flat.field("embedding")
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
        src, dst, d2 = [], [], []
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            y, f = x[lo:hi], fresh[lo:hi].astype(bool)
            sq = (y * y).sum(1)
            d = np.maximum(sq[:, None] + sq[None, :] - 2 * (y @ y.T), 0)
            near = (f[:, None] | f[None, :]) & (d < bound[lo:hi, None])
            np.fill_diagonal(near, False)
            i, j = np.nonzero(near)
            src.append(ids[lo + i])
            dst.append(ids[lo + j])
            d2.append(d[i, j])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (src, dst, d2)], names=["src", "dst", "d2"])


def nn_descent(vectors: DataFrame, k: int, pool: int | None = None, sample: int | None = None, rounds: int = 15, share: float = 0.002) -> DataFrame:
    """``src, rank, dst, d2`` like the exact k-NN graph, approximately: no block of pairs, no broadcast.

    ``vectors(pos, embedding)``, positions from 0 without gaps.  Every node keeps ``pool`` neighbours (twice
    ``k`` unless given), drawn by hash at first.  A round joins, at each node, at most ``sample`` of its fresh
    neighbours and of the nodes that list it freshly with each other and with its other neighbours; a pair
    counts only if it is nearer than one end's worst neighbour.  Rounds end after ``rounds``, or when less
    than ``share`` of all lists changed.  A round shuffles each vector at most ``pool + 3 * sample`` times, so the work
    grows in proportion to the rows; a node that many list is met by ``sample`` of them, chosen by hash.
    Distances of the result are exact; of a table with at most ``pool`` + 1 rows so is the graph.
    """
    spark, n = vectors.sparkSession, vectors.count()
    pool = max(0, min(pool or 2 * k, n - 1))
    sample = sample or max(4, pool // 2)
    v, v_path = tables.cut(vectors.select("pos", "embedding"), "vectors")
    x, y = v.toDF("src", "ex"), v.toDF("dst", "ey")
    if n <= pool + 1 or pool == 0:
        drawn = F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))
    else:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(2 * pool)), lambda i: F.pmod(F.xxhash64("pos", i), F.lit(n)))
    first = v.select(F.col("pos").alias("src"), F.explode(F.array_distinct(drawn)).alias("dst")).where("src <> dst").where(F.lit(n > 1))
    near = first.join(x, "src").join(y, "dst").select("src", "dst", squared_l2("ey", "ex").alias("d2"), F.lit(True).alias("fresh"), F.lit(True).alias("came"))
    place = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    near, path = tables.cut(near.withColumn("place", place).where(F.col("place") <= max(pool, 1)).drop("place"), "near")
    for r in range(rounds if n > pool + 1 else 0):
        lot = F.row_number().over(Window.partitionBy("src", "fresh").orderBy(F.xxhash64("src", "dst", F.lit(r)), "dst"))
        lists = near.withColumn("used", F.col("fresh") & (lot <= sample))
        ahead = lists.where("used or not fresh").select(F.col("src").alias("u"), F.col("dst").alias("m"), "fresh")
        lot = F.row_number().over(Window.partitionBy("u", "fresh").orderBy(F.xxhash64("u", "m", F.lit(r)), "m"))
        back = ahead.select(F.col("m").alias("u"), F.col("u").alias("m"), "fresh").withColumn("lot", lot).where(F.col("lot") <= sample).drop("lot")
        members = ahead.unionByName(back).groupBy("u", "m").agg(F.max("fresh").alias("fresh"))
        worst = near.groupBy(F.col("src").alias("pos")).agg(F.when(F.count("*") < pool, F.lit(float("inf"))).otherwise(F.max("d2")).alias("worst"))
        node = v.join(worst, "pos", "left").select(F.col("pos").alias("m"), "embedding", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        met = members.join(node, "m").groupBy("u").agg(F.collect_list(F.struct("m", "fresh", "worst", "embedding")).alias("members"))
        found = met.select("members").mapInArrow(_local_join, "src long, dst long, d2 double").groupBy("src", "dst").agg(F.min("d2").alias("d2"))
        both = lists.select("src", "dst", "d2", (F.col("fresh") & ~F.col("used")).alias("fresh"), F.lit(False).alias("came")).unionByName(found.withColumn("fresh", F.lit(True)).withColumn("came", F.lit(True)))
        both = both.groupBy("src", "dst").agg(*[F.min(c).alias(c) for c in ("d2", "fresh", "came")])
        last, (near, path) = path, tables.cut(both.withColumn("place", place).where(F.col("place") <= pool).drop("place"), "near")
        tables.drop(spark, last)
        if near.where("came").count() < share * n * pool:
            break
    exact = near.select("src", "dst").join(x, "src").join(y, "dst").select("src", "dst", squared_l2("ey", "ex").alias("d2"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst")) - 1
    out, _ = tables.cut(exact.withColumn("rank", rank.cast("long")).where(F.col("rank") < k).select("src", "rank", "dst", "d2"), "knn")
    tables.drop(spark, path, v_path)
    return out


def seed_chains(vectors: DataFrame, scored: DataFrame, limit: int = 6, policy: str = "near") -> DataFrame:
    """``src, side, turn, seed``: from each node's neighbour along the chain of previous (side 0) or next (1) smaller ones.

    ``near`` takes the first ``limit`` of a chain in order, ``far`` its last ones, last first; 0 takes all.
    A whole chain is as long as the records of a random order: walks end when no chain goes on.
    """
    spark = vectors.sparkSession
    step, step_path = tables.cut(graph.smaller_neighbours(scored), "steps")
    v, paths, done = vectors.select("pos"), [step_path], []
    for side, name, start in ((0, "prev", -1), (1, "next", 1)):
        at = v.select(F.col("pos").alias("src"), (F.col("pos") + start).alias("seed")).join(step.select(F.col("pos").alias("seed")), "seed").select("src", "seed")
        turn = 0
        while True:
            at, p = tables.cut(at, "chain")
            paths.append(p)
            if at.isEmpty():
                break
            done.append(at.select("src", F.lit(side).alias("side"), F.lit(turn).cast("long").alias("turn"), "seed"))
            turn += 1
            if policy == "near" and limit and turn == limit:
                break
            at = at.join(step.select(F.col("pos").alias("seed"), F.col(name).alias("to")), "seed").where("to >= 0").select("src", F.col("to").alias("seed"))
    out = None
    for d in done:
        out = d if out is None else out.unionByName(d)
    if out is None:
        out = spark.createDataFrame([], "src long, side int, turn long, seed long")
    if policy == "far":
        back = F.row_number().over(Window.partitionBy("src", "side").orderBy(F.col("turn").desc())) - 1
        out = out.withColumn("turn", back.cast("long"))
        out = out.where(F.col("turn") < limit) if limit else out
    out, _ = tables.cut(out, "chains")
    tables.drop(spark, *paths)
    return out


def seed_search(vectors: DataFrame, knn: DataFrame, seeds: DataFrame, mode: str = "beam", collect: str = "discovered", batch: int = 4, keep: int = 0, expand: int = 32, beam: int = 256, degree: int = 128, width: int = 16) -> DataFrame:
    """``src, side, batch, dst, turn``: what a search towards ``src`` from each batch of its seeds collects.

    ``seeds(src, side, turn, seed)`` are searched ``batch`` at a time over the first ``degree`` k-NN edges of a node,
    with a budget of ``expand`` expansions for each seed (0: no end).  ``beam`` keeps that many candidates
    (0: as many as the budget), ``queue`` all of them.  Collected is what entered the candidates (``discovered``), what was evaluated
    or what was expanded, at most ``keep`` for each seed (0: all), in order of ``turn``: rounds of ``width`` expansions, nearest first.
    ``src`` itself is never met.  All batches of all nodes are one relational search.
    """
    if mode not in ("beam", "queue") or collect not in ("discovered", "evaluated", "expanded"):
        raise ValueError(f"unknown way to search or collect: {mode}, {collect}")
    n = vectors.count()
    q = seeds.where("seed <> src").withColumn("batch", F.floor(F.col("turn") / batch)).groupBy("src", "side", "batch").agg(F.sort_array(F.collect_set("seed")).alias("seed_ids"))
    most = q.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0] + 1
    size = F.size("seed_ids").cast("long")
    held = F.lit(1 << 40) if mode == "queue" else F.lit(beam or expand or 1024)
    q = q.join(vectors.select(F.col("pos").alias("src"), F.col("embedding").alias("qv")), "src")
    q = q.select(((F.col("src") * 2 + F.col("side")) * most + F.col("batch")).alias("query_id"), "qv", F.lit(0).cast("long").alias("first_pos"), F.lit(n).cast("long").alias("end_pos"), "seed_ids", F.col("src").alias("skip"), held.cast("long").alias("beam_size"), (size * expand).alias("max_expand"))
    index = search.Index(vectors, knn.where(F.col("rank") < degree))
    o = search.Options(k=1, trunc=degree, width=width)
    if collect == "expanded":
        got = search.search(index, q, o, "expansions").select("query_id", F.col("pos").alias("dst"), "round", F.col("d2").alias("dist"))
    else:
        got = search.search(index, q, o, "events")
        got = got.where("was_inserted or expansion_round = 0") if collect == "discovered" else got
        got = got.select("query_id", F.col("neighbor_node").alias("dst"), F.col("expansion_round").alias("round"), "dist")
    index.release()
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("round", "dist", "dst")) - 1
    got = got.withColumn("turn", turn.cast("long"))
    if keep:
        got = got.join(q.select("query_id", (size * keep).alias("keep")), "query_id").where("turn < keep")
    key = F.col("query_id")
    lane = F.floor(key / most)
    return got.select(F.floor(lane / 2).alias("src"), (lane % 2).cast("int").alias("side"), (key % most).alias("batch"), "dst", "turn")


def seed_bridges(vectors: DataFrame, knn: DataFrame, scored: DataFrame, limit: int = 6, policy: str = "near", **options) -> DataFrame:
    """``src, dst, support``: the seeds of both chains and what their searches collect; ``support`` counts the batches that reached a node, and once more its place in a chain."""
    seeds = seed_chains(vectors, scored, limit, policy)
    found = seed_search(vectors, knn, seeds, **options)
    both = seeds.select("src", F.col("seed").alias("dst")).unionByName(found.select("src", "dst")).where("src <> dst")
    return both.groupBy("src", "dst").agg(F.count("*").alias("support"))
