"""Edge orders learned from searches: rows of the graph search for themselves, edges that helped come first."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.operators import search


@dataclass(frozen=True)
class Weights:
    """What an edge earns when its target is evaluated, enters the beam or its top, becomes the best, or stays to the end."""

    evaluated: int = 0
    inserted: int = 1
    entered_topk: int = 4
    improved: int = 8
    kept: int = 1
    kept_topk: int = 4


#: Targets of a search at most, and tables of scores before they are summed into one.
LOT, TABLES = 1 << 16, 8


def _targets(vectors: DataFrame, starts: list[int], n: int, share: float) -> DataFrame:
    targets = vectors.where(F.pmod(F.xxhash64("pos"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return targets.select(F.col("pos").alias("query_id"), F.col("embedding").alias("qv"), F.lit(0).cast("long").alias("first_pos"), F.lit(n).cast("long").alias("end_pos"), F.array(*[F.lit(s).cast("long") for s in starts]).alias("seed_ids"))


def teach(index: search.Index, vectors: DataFrame, starts: list[int], options: search.Options, share: float = 1.0) -> DataFrame:
    """Events of searches over the whole graph from ``starts`` (one header: a bounded list) towards the graph's own rows.

    ``share`` of the rows, by hash of their position, are targets.
    """
    return search.search(index, _targets(vectors, starts, vectors.count(), share), options, "events")


def learned(index: search.Index, vectors: DataFrame, starts: list[int], options: search.Options, share: float = 1.0) -> DataFrame:
    """``src, dst, score``: the scores of ``teach``'s events, whose rows are never all there.

    Targets search in lots of about ``LOT``, each of which leaves its sums alone, so rounds, shuffles and events on disk
    are a lot's, whatever the table's size.
    """
    spark, n = vectors.sparkSession, vectors.count()
    targets, parts = _targets(vectors, starts, n, share), []
    lots = max(1, -(-int(n * share) // LOT))
    for i in range(lots):
        parts.append(search.search(index, targets.where(F.pmod("query_id", F.lit(lots)) == i), options, "events", fold=edge_scores))
        if len(parts) == TABLES or (i + 1 == lots and len(parts) > 1):
            all_, paths = reduce(DataFrame.unionByName, parts), [p for d in parts for p in d.inputFiles()]
            parts = [tables.cut(all_.groupBy("src", "dst").agg(F.sum("score").alias("score")), "scores")[0]]
            tables.drop(spark, *{p.rsplit("/", 1)[0] for p in paths})
    return parts[0]


def edge_scores(events: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """``src, dst, score``: the sum of what an edge earned over all events that came through it."""
    w, hit = weights, lambda c, x: F.when(F.col(c), F.lit(x)).otherwise(0)
    earned = F.lit(w.evaluated) + hit("was_inserted", w.inserted) + F.when(F.col("entered_topk") & F.col("was_inserted"), w.entered_topk).otherwise(0) + hit("improved_best", w.improved) + hit("in_final_beam", w.kept) + hit("in_final_topk", w.kept_topk)
    return events.where("current_node is not null").groupBy(F.col("current_node").alias("src"), F.col("neighbor_node").alias("dst")).agg(F.sum(earned).cast("long").alias("score"))


def reorder_by_score(edges: DataFrame, scores: DataFrame, warm: int = 8, cap: int = 0) -> DataFrame:
    """New ranks: the first ``warm`` edges of a node in place, then by score, highest first, ties by rank; ``cap`` edges a node (0: all)."""
    e = edges.select("src", "rank", "dst").join(scores, ["src", "dst"], "left").fillna(0, ["score"])
    fixed = F.col("rank") < warm
    order = Window.partitionBy("src").orderBy(F.when(fixed, F.col("rank")).otherwise(warm), F.when(fixed, 0).otherwise(-F.col("score")), "rank")
    out = e.withColumn("rank", (F.row_number().over(order) - 1).cast("long"))
    return (out.where(F.col("rank") < cap) if cap else out).select("src", "rank", "dst", "score")


def coverage(edges: DataFrame, events: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """One row: edges, and shares of nodes that were a source, of nodes with a scored edge, and of scored edges."""
    sources = events.where("current_node is not null").agg(F.count_distinct("current_node").alias("expanded")).withColumn("one", F.lit(1))
    signal = edges.select("src", "dst").join(scores.where("score > 0"), ["src", "dst"], "left_semi")
    signal = signal.agg(F.count("*").alias("signal"), F.count_distinct("src").alias("nodes")).withColumn("one", F.lit(1))
    total = edges.agg(F.count("*").alias("edges")).withColumn("one", F.lit(1))
    nodes = F.lit(float(max(n, 1)))
    ratio = F.when(F.col("edges") > 0, F.col("signal") / F.col("edges")).otherwise(0.0)
    return total.join(sources, "one").join(signal, "one").select("edges", (F.col("expanded") / nodes).alias("expanded_node_share"), (F.col("nodes") / nodes).alias("signal_node_share"), ratio.alias("signal_edge_share"))
