"""Relational operators over edge tables ``(src, rank, dst, d2)`` in label-order positions."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.functions.kernels import jump_level, squared_l2
from bandwalk.operators import ranges


#: Distances held at once in a comparison of neighbours.
PAIRS = 1 << 21


def _rank(*order, by=("src",)):
    return (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long")


def band(vectors: DataFrame, step: int) -> DataFrame:
    """``src, dst`` with positions at most ``step`` apart: neighbours are enumerated and joined by equality."""
    near = vectors.select(F.col("pos").alias("src"), F.explode(F.sequence(F.col("pos") - step, F.col("pos") + step)).alias("dst"))
    return near.where("src <> dst").join(vectors.select(F.col("pos").alias("dst")), "dst").select("src", "dst")


def band_capped(vectors: DataFrame, step: int, cap: int) -> DataFrame:
    """Of a window of more than ``cap`` positions, evenly spaced ones: half of ``cap`` a side, room one side can't use goes to the other.

    Positions run from 0 without gaps, so a window's members are computed, not joined.
    """
    n = vectors.count()
    v = vectors.select(F.col("pos").alias("src")).withColumn("ln", F.least("src", F.lit(step))).withColumn("rn", F.least(F.lit(step), n - 1 - F.col("src")))
    v = v.withColumn("l", F.least("ln", F.lit((cap + 1) // 2))).withColumn("r", F.least("rn", cap - F.col("l")))
    v = v.withColumn("l", F.least("ln", cap - F.col("r"))).withColumn("r", F.least("rn", cap - F.col("l")))
    spread = "if({q} = 1 and {n} > 1, array({b} + {n} div 2), if({q} < 1, array(), transform(sequence(0, {q} - 1), k -> {b} + if({q} >= {n}, k, k * ({n} - 1) div ({q} - 1)))))"
    left, right = F.expr(spread.format(q="l", n="ln", b="(src - ln)")), F.expr(spread.format(q="r", n="rn", b="(src + 1)"))
    return v.select("src", F.explode(F.concat(left, right).cast("array<bigint>")).alias("dst"))


def even_sample(rows: DataFrame, want: int, *by: str) -> DataFrame:
    """Rows whose place ``i`` of ``n`` is one of ``want`` evenly spaced places."""
    picks = F.transform(F.sequence(F.lit(0), F.lit(want - 1)), lambda j: F.floor(j * (F.col("n") - 1) / F.lit(max(1, want - 1))))
    return rows.where((F.col("n") <= want) | F.array_contains(picks, F.col("i").cast("long")))


def remap(knn_by_id: DataFrame, vectors: DataFrame, cap: int) -> DataFrame:
    """Edges by id to edges by position, without self and duplicates, the first ``cap`` a node."""
    ids = vectors.select("vec_id", "pos")
    e = knn_by_id.join(ids.toDF("src_id", "src"), "src_id").join(ids.toDF("dst_id", "dst"), "dst_id").where("src <> dst")
    e = e.groupBy("src", "dst").agg(F.min("rank").alias("r"))
    return e.withColumn("rank", _rank("r", "dst")).where(F.col("rank") < cap).select("src", "rank", "dst")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def reciprocal(edges: DataFrame, depth: int) -> DataFrame:
    """Edges whose source stands among the first ``depth`` neighbours of their target."""
    back = edges.where(F.col("rank") < depth).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi")


def _dominated(batches):
    """Each row lists the neighbours of one node; nodes of equal degree are compared together, ``PAIRS`` distances at once."""
    import pyarrow as pa

    for b in batches:
        members = b.column("members")
        if isinstance(members, pa.ChunkedArray):
            members = members.combine_chunks()
        nodes, ends, flat = b.column("src").to_numpy(zero_copy_only=False), members.offsets.to_numpy(), members.flatten()
        ends = ends - ends[0]
        dst, d2 = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("dst", "d2"))
        x = flat.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(dst), -1) if len(dst) else np.zeros((0, 1))
        degree, found = np.diff(ends), []
        for m in np.unique(degree[degree > 1]):
            same, strip = np.flatnonzero(degree == m), max(1, min(m, PAIRS // m))
            for lo in range(0, len(same), max(1, PAIRS // (m * m))):
                of = same[lo : lo + max(1, PAIRS // (m * m))]
                at = ends[of][:, None] + np.arange(m)
                y, d, ids = x[at], d2[at], dst[at]
                for i in range(0, m, strip):
                    between = np.zeros((len(of), len(range(m)[i : i + strip]), m))
                    for c in range(x.shape[1]):
                        between += np.square(y[:, i : i + strip, None, c] - y[:, None, :, c])
                    mine = d[:, i : i + strip, None]
                    node, to, by = np.nonzero((between < mine) & (d[:, None, :] < mine) & (ids[:, i : i + strip, None] != ids[:, None, :]))
                    found.append((nodes[of[node]], ids[node, to + i], ids[node, by]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=["src", "dst", "by"])


def dominators(knn: DataFrame, vectors: DataFrame) -> DataFrame:
    """``src, dst, by``: sibling ``by`` is closer to the source, and to ``dst`` than the source is.

    A node's neighbours are gathered with their vectors once and compared there, so what is shuffled grows with the edges, not their pairs.
    """
    near = knn.select("src", "dst", "d2").join(vectors.select(F.col("pos").alias("dst"), "embedding"), "dst")
    lists = near.groupBy("src").agg(F.collect_list(F.struct("dst", "d2", "embedding")).alias("members"))
    return lists.mapInArrow(_dominated, "src long, dst long, by long")


def strict_rng(knn: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges that no sibling dominates, ranked by distance."""
    kept = knn.join(dominators(knn, vectors).select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return kept.withColumn("rank", _rank("d2", "dst")).select("src", "rank", "dst", "d2")


def as_of_header(headers: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, label``: the largest header label not above ``qr``."""
    return ranges.as_of(headers, queries, "label", "qr")


def headers(scored: DataFrame, limit: int = 20) -> DataFrame:
    """``label, ord, node``: per label boundary the strict suffix minima of ``d`` so far, newest first.

    ``scored(pos, label, d)``.  They are the chain of previous smaller places from the boundary's last
    place; ``limit`` nodes of it are kept, 0 keeps all.  (A stack that forgets its oldest node beyond the
    limit for good differs once it was full.)
    """
    spark = scored.sparkSession
    step, step_path = tables.cut(smaller_neighbours(scored).select(F.col("pos").alias("node"), "prev"), "steps")
    at, paths, done = scored.groupBy("label").agg(F.max("pos").alias("n0")), [step_path], []
    stride = min(limit, 8) or 8  # steps of the walk between two tables
    while not limit or len(done) * stride < limit:
        for i in range(stride):
            at = at.join(step.select(F.col("node").alias(f"n{i}"), F.when(F.col("prev") >= 0, F.col("prev")).alias(f"n{i + 1}")), f"n{i}", "left")
        at, path = tables.cut(at, "header")
        paths.append(path)
        if at.isEmpty():
            break
        walked = F.filter(F.transform(F.array(*[F.col(f"n{i}") for i in range(stride)]), lambda x, i: F.struct((i + len(done) * stride).cast("long").alias("ord"), x.alias("node"))), lambda x: x["node"].isNotNull())
        done.append(at.select("label", F.inline(walked)))
        at = at.where(f"n{stride} is not null").select("label", F.col(f"n{stride}").alias("n0"))
    out = spark.createDataFrame([], "label long, ord long, node long")
    for d in done:
        out = out.unionByName(d)
    out, _ = tables.cut(out.where(F.col("ord") < limit) if limit else out, "headers")
    tables.drop(spark, *paths)
    return out


def _nearest(key, values, asks):
    """Of one block's ``values(pos, d)``, for each ask the nearest place left (side 0) or right (1) of ``rel`` with a smaller value."""
    values = values.sort_values("pos")
    v, first = values["d"].tolist(), int(values["pos"].iloc[0]) if len(values) else 0
    asks = asks.reset_index(drop=True)
    found = [None] * len(asks)
    for side in (0, 1):
        mine = asks[asks["side"] == side]
        seq = v if side == 0 else v[::-1]
        rel = (mine["rel"] if side == 0 else len(v) - 1 - mine["rel"]).clip(0, len(v))  # in the direction walked
        order, stack, places, j = rel.sort_values(kind="stable"), [], [], 0
        for i, at in order.items():
            while j < at:  # what stands behind an equal or smaller value is never the nearest
                while stack and stack[-1] >= seq[j]:
                    stack.pop()
                    places.pop()
                stack.append(seq[j])
                places.append(j)
                j += 1
            k = bisect_left(stack, asks.at[i, "d"]) - 1
            if k >= 0:
                found[i] = first + (places[k] if side == 0 else len(v) - 1 - places[k])
    return asks[["id", "side", "d", "at"]].assign(found=pd.array(found, dtype="Int64"))


def smaller_neighbours(scored: DataFrame, block: int = 4096) -> DataFrame:
    """``pos, prev, next``: nearest places on either side with strictly smaller ``d``, -1 if none.

    Positions run from 0 without gaps.  Blocks of ``block`` places answer what they can; what is left
    asks among the minima of the blocks, of blocks of blocks, and so on, and is then led down again into
    the block that holds its answer.  A group is a block and the asks that reach it.
    """
    spark, paths = scored.sparkSession, []
    scored, path = tables.cut(scored.select("pos", "d"), "scored")
    paths.append(path)
    levels, size = [scored], (scored.agg(F.max("pos")).first()[0] or 0) + 1
    while size > block:
        size = -(-size // block)
        low = levels[-1].groupBy(F.expr(f"pos div {block}").alias("pos")).agg(F.min("d").alias("d"))
        low, path = tables.cut(low, "minima")
        paths.append(path)
        levels.append(low)

    def ask(level: int, asks: DataFrame) -> DataFrame:
        """``id, side, d, at, found`` for ``asks(id, side, d, at, g, rel)`` in block ``g`` of a level."""
        values = levels[level].withColumn("g", F.expr(f"pos div {block}"))
        values, asks = values.toDF(*values.columns), asks.toDF(*asks.columns)
        met = values.groupBy("g").cogroup(asks.groupBy("g")).applyInPandas(_nearest, "id long, side int, d double, at long, found long")
        out, path = tables.cut(met, "asked")
        paths.append(path)
        return out

    sides = F.explode(F.array(F.lit(0), F.lit(1))).alias("side")
    asks, found = scored.select(F.col("pos").alias("id"), sides, "d", F.col("pos").alias("at")), []
    for level in range(len(levels)):
        got = ask(level, asks.withColumns({"g": F.expr(f"at div {block}"), "rel": F.expr(f"at % {block}")}))
        found.append(got.where("found is not null"))
        asks = got.where("found is null").select("id", "side", "d", F.expr(f"at div {block}").alias("at"))
    down = found[-1]
    for level in range(len(levels) - 1, 0, -1):
        inner = down.select("id", "side", "d", "at", F.col("found").alias("g"), F.when(F.col("side") == 0, F.lit(block)).otherwise(-1).cast("long").alias("rel"))
        down = found[level - 1].unionByName(ask(level - 1, inner))
    near = down.groupBy(F.col("id").alias("pos")).agg(F.max(F.when(F.col("side") == 0, F.col("found"))).alias("prev"), F.max(F.when(F.col("side") == 1, F.col("found"))).alias("next"))
    out, _ = tables.cut(scored.select("pos").join(near, "pos", "left").select("pos", F.coalesce("prev", F.lit(-1)).alias("prev"), F.coalesce("next", F.lit(-1)).alias("next")), "smaller")
    tables.drop(spark, *paths)
    return out


def reorder(edges: DataFrame, key, pinned: int = 8) -> DataFrame:
    """New ranks by ``key``, the first ``pinned`` edges of a node in place."""
    fixed = F.col("rank") < pinned
    order = (F.when(fixed, F.col("rank")).otherwise(pinned), F.when(fixed, F.lit(0.0)).otherwise(key), "rank")
    return edges.withColumn("rank", _rank(*order)).select("src", "rank", "dst")


def rank_fusion(edges: DataFrame, alpha: float) -> DataFrame:
    """``alpha * distance rank + (1 - alpha) * gap rank``."""
    gap = F.abs(F.col("src") - F.col("dst"))
    e = edges.withColumn("dr", _rank("d2", "dst")).withColumn("gr", _rank(gap, "dst"))
    return e.withColumn("score", alpha * F.col("dr") + (1 - alpha) * F.col("gr")).select("src", "dst", "score")


def alternate_sides(edges: DataFrame, order=("d2", "dst")) -> DataFrame:
    """Left and right neighbours in turn, each side in order, left first."""
    e = edges.withColumn("side", (F.col("dst") > F.col("src")).cast("int")).withColumn("k", _rank(*order, by=("src", "side")))
    return e.withColumn("rank", _rank(F.col("k") * 2 + F.col("side"))).select("src", "rank", "dst")


def round_robin(edges: DataFrame, limit: int) -> DataFrame:
    """Log-gap bins by side take turns, long gaps first."""
    e = edges.withColumn("side", (F.col("dst") > F.col("src")).cast("int")).withColumn("lvl", jump_level(F.abs(F.col("src") - F.col("dst"))).cast("int"))
    e = e.withColumn("k", _rank("d2", "dst", by=("src", "side", "lvl")))
    return e.withColumn("rank", _rank("k", F.col("lvl").desc(), "side")).where(F.col("rank") < limit).select("src", "rank", "dst")


def jump_score(edges: DataFrame, alpha: float) -> DataFrame:
    """Rank minus ``alpha`` times the rank by jump level."""
    lvl = jump_level(F.abs(F.col("src") - F.col("dst")))
    e = edges.withColumn("jr", _rank(lvl.desc(), "rank"))
    return e.withColumn("rank", _rank(F.col("rank") - alpha * F.col("jr"), "rank")).select("src", "rank", "dst")


def survival(edges: DataFrame, doms: DataFrame, vectors: DataFrame) -> DataFrame:
    """``src, dst, l_drop, r_drop``: labels of the nearest dominating sibling on either side, null if none.

    Nodes of degree 2 or less keep all edges.
    """
    lab = vectors.select("pos", "label")
    d = doms.join(lab.toDF("by", "lb"), "by").join(lab.toDF("src", "lu"), "src")
    d = d.groupBy("src", "dst").agg(F.max(F.when(F.col("lb") < F.col("lu"), F.col("lb"))).alias("l_drop"), F.min(F.when(F.col("lb") > F.col("lu"), F.col("lb"))).alias("r_drop"))
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"))
    out = edges.join(deg, "src").join(d, ["src", "dst"], "left")
    return out.select("src", "rank", "dst", *(F.when(F.col("deg") > 2, F.col(c)).alias(c) for c in ("l_drop", "r_drop")))


def survival_gate(annotated: DataFrame, vectors: DataFrame, queries: DataFrame, skeleton: int = 8) -> DataFrame:
    """``query_id, src, dst``: in-range edges, beyond the skeleton only those no in-range sibling replaces."""
    spans = ranges.label_interval(vectors, queries).join(queries.select("query_id", "ql", "qr"), "query_id")
    dropped = F.coalesce(F.col("ql") <= F.col("l_drop"), F.lit(False)) | F.coalesce(F.col("qr") >= F.col("r_drop"), F.lit(False))
    kept = (F.col("rank") < skeleton) | ~dropped  # asked once for an edge and a list of queries
    return ranges.inside(annotated, spans, "dst", ("ql", "qr"), kept).select("query_id", "src", "dst")


def roles(edges: DataFrame, n: int, depth: int = 8, bridge: float = 0.3, useful: float = 0.1) -> DataFrame:
    """``src, rank, dst, role, label_gap``: skeleton, bridge, useful or reserve."""
    back = reciprocal(edges, depth).select("src", "dst", F.lit(True).alias("mutual"))
    gap = F.abs(F.col("src") - F.col("dst")) / F.lit(float(n))
    e = edges.join(back, ["src", "dst"], "left").withColumn("label_gap", gap)
    role = F.when(F.col("mutual") | (F.col("rank") < depth), "skeleton").when(F.col("label_gap") > bridge, "bridge").when(F.col("label_gap") <= useful, "useful").otherwise("reserve")
    return e.select("src", "rank", "dst", role.alias("role"), "label_gap")


def role_gate(with_roles: DataFrame, quotas: dict[str, int]) -> DataFrame:
    """Per role the edges of smallest gap within its quota, in rank order."""
    k = _rank("label_gap", "rank", by=("src", "role"))
    quota = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])[F.col("role")]
    kept = with_roles.withColumn("k", k).where(F.col("k") < quota)
    return kept.withColumn("rank", _rank("rank")).select("src", "rank", "dst", "role")


def degree_stats(edges: DataFrame) -> DataFrame:
    d = edges.groupBy("src").agg(F.count("*").alias("n"))
    return d.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("largest"))


def summary(rows: DataFrame, value: str) -> DataFrame:
    """min, max, mean and the interpolated 50th, 90th and 99th percentile."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p")
    r = rows.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.avg(value).alias("mean"), p)
    return r.select("low", "high", "mean", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), F.col("p")[2].alias("p99"))


def prefix_stats(edges: DataFrame, k: int) -> DataFrame:
    """Over the first k edges: mean gap, share of left edges, share of side switches, distinct levels over k."""
    e = edges.where(F.col("rank") < k).withColumn("gap", F.abs(F.col("src") - F.col("dst"))).withColumn("left", (F.col("dst") < F.col("src")).cast("int"))
    e = e.withColumn("turn", F.coalesce((F.col("left") != F.lag("left").over(Window.partitionBy("src").orderBy("rank"))).cast("int"), F.lit(0)))
    e = e.withColumn("lvl", jump_level(F.col("gap")))
    per = e.groupBy("src").agg(F.avg("gap").alias("g"), F.avg("left").alias("l"), (F.sum("turn") / F.greatest(F.count("*") - 1, F.lit(1))).alias("t"), (F.countDistinct("lvl") / F.lit(float(k))).alias("v"))
    return per.agg(*(F.round(F.avg(c), 9).alias(a) for c, a in (("g", "mean_gap"), ("l", "left_share"), ("t", "switch_share"), ("v", "level_share"))))


def pareto(rows: DataFrame, by: str = "selectivity_label") -> DataFrame:
    """Rows that no row of the same group beats in recall and qps: a running maximum, no self join."""
    levels = rows.groupBy(by, "recall").agg(F.max("qps").alias("top"))
    above = F.max("top").over(Window.partitionBy(by).orderBy(F.col("recall").desc()).rowsBetween(Window.unboundedPreceding, -1))
    front = levels.withColumn("above", above).where("above is null or top > above").select(by, "recall", F.col("top").alias("qps"))
    return rows.join(front, [by, "recall", "qps"], "left_semi")


def completed(rows: DataFrame) -> DataFrame:
    """Rows of runs that ended well: ``completed`` or ``ok`` in any case, or no status (empty or null)."""
    return rows.where(F.lower(F.coalesce("status", F.lit(""))).isin("", "completed", "ok"))


def even_rows(front: DataFrame, most: int, by: str = "selectivity_label") -> DataFrame:
    """At most ``most`` rows of each group of a front, evenly spaced by recall; all of them if ``most`` is 0 or less."""
    if most <= 0:
        return front
    order = Window.partitionBy(by).orderBy("recall", F.col("qps").desc(), "run_id")
    rows = front.withColumn("i", F.row_number().over(order) - 1).withColumn("n", F.count("*").over(Window.partitionBy(by)))
    last = F.col("n") - 1
    picks = F.array(last) if most == 1 else F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * last / F.lit(most - 1)).cast("long"))
    return rows.where((F.col("n") <= most) | F.array_contains(picks, F.col("i").cast("long"))).drop("i", "n")


def set_equality(a: DataFrame, b: DataFrame, by: str = "query_id", key: str = "id") -> DataFrame:
    """For each group, how many rows only one side has, and whether there are none: counts of both sides, no join."""
    sides = a.select(by, key, F.lit(1).alias("n")).unionByName(b.select(by, key, F.lit(-1).alias("n")))
    left = sides.groupBy(by, key).agg(F.sum("n").alias("n")).groupBy(by)
    out = left.agg(F.sum(F.greatest("n", F.lit(0))).alias("only_a"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("only_b"))
    return out.withColumn("equal", F.expr("only_a = 0 and only_b = 0"))


def permute(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Row ``pos`` of the result is row ``source`` of ``rows``, for each ``(pos, source)`` of ``order``."""
    return rows.withColumnRenamed("pos", "source").join(order.select("pos", "source"), "source").drop("source")
