"""Beam search over a range graph as relations, for all queries at once.

A round sends the best open nodes of every query's beam, with the query's vector, to the
groups of nodes that hold their adjacency and their neighbours' vectors; what comes back are
the neighbours inside the range with their distances.  Groups of queries then leave what was
seen, choose among the rest, and rank old and new together.  Both sides are cogroups of Arrow
tables, so a round is two exchanges of the beams' rows; the index is partitioned once and
nothing is gathered or broadcast.  A round is written as one table, a row a query: its beam,
evaluations and counters; hits, counters, traces and events are read from these rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.functions.kernels import jump_level, squared_l2
from bandwalk.operators import exact


@dataclass(frozen=True)
class Options:
    """Width of the beam, neighbours a step, and the ways to choose and stop.

    ``width`` nodes of a query are expanded in one round; 1 is the sequential order.  ``stall``
    counts expansions since the best distance last fell: below ``stall_rounds`` a node gets
    ``nav_degree`` neighbours (if not 0) instead of ``trunc``; from ``early_stop`` on (if not 0) a query ends
    once the first third of its beam is expanded; from ``fallback_stall`` on (if not 0) a node gets
    twice as many in adjacency order.  ``max_expand`` bounds a query's expansions, 0 does not.
    """

    k: int = 10
    beam: int = 64
    trunc: int = 24
    width: int = 16
    nav_degree: int = 0
    stall_rounds: int = 8
    early_stop: int = 0
    pick: str = "prefix"  # prefix, even, sides, reciprocal, corebridge
    prefix: int = 32
    core_share: float = 0.6
    rescue: int = 0
    rescue_by: str = "prefix"  # or gap
    fallback_stall: int = 0
    max_expand: int = 0
    seeds: str = "header"


#: Nodes (queries) of a group and most groups of an index (search); squared distances taken at once.
GROUP, GROUPS, CHUNK = 256, 1024, 4096


def _groups(n: int) -> int:
    return max(1, min(GROUPS, n // GROUP))


class Index:
    """Vectors ``(pos, vec_id, embedding)`` and adjacency ``(src, near, y, b)``, each partitioned once and kept.

    ``near`` lists ``(dst, mutual)`` by rank; ``mutual``: the source is among the first
    ``depth`` neighbours of ``dst``.  ``y`` strings together the vectors of ``near``; ``b`` is the node's group.
    """

    def __init__(self, vectors: DataFrame, edges: DataFrame, depth: int = 32):
        spark = vectors.sparkSession
        most = int(spark.conf.get("spark.sql.shuffle.partitions"))
        back = edges.where(F.col("rank") < depth).select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct().withColumn("mutual", F.lit(True))
        e = edges.select("src", "rank", "dst").join(back, ["src", "dst"], "left")
        v, v_path = tables.cut(vectors.select("pos", "vec_id", "embedding"), "vectors")
        self.groups = _groups(v.count())
        parts = min(most, self.groups)
        e = e.join(v.select(F.col("pos").alias("dst"), "embedding"), "dst")
        near = F.sort_array(F.collect_list(F.struct("rank", "dst", F.coalesce("mutual", F.lit(False)).alias("mutual"), "embedding")))
        lists = e.groupBy("src").agg(near.alias("e")).select("src", F.transform("e", lambda x: F.struct(x["dst"].alias("dst"), x["mutual"].alias("mutual"))).alias("near"), F.flatten(F.col("e.embedding")).alias("y"))
        links, l_path = tables.cut(lists.withColumn("b", F.pmod("src", F.lit(self.groups)).cast("int")), "links")
        self.vectors = v.repartition(parts, "pos").persist(StorageLevel.MEMORY_AND_DISK)
        self.links = links.repartition(parts, "b").sortWithinPartitions("b").persist(StorageLevel.MEMORY_AND_DISK)
        self.paths = (v_path, l_path)

    def release(self) -> None:
        """Give back memory and delete the tables."""
        self.vectors.unpersist()
        self.links.unpersist()
        tables.drop(self.vectors.sparkSession, *self.paths)


#: A query's row in a round's table: its counters, all it has seen, and its nodes by place, nearest first.
_NODES = "pos array<long>, d2 array<double>, open array<boolean>, next array<boolean>, new array<boolean>, expanded array<boolean>, src array<long>, rank array<int>, selected array<int>, raw array<int>"
_ROUND = "g int, query_id long, qv array<float>, lo long, hi long, beam long, trunc long, budget long, skip long, stall long, best double, spent long, active boolean, seen array<long>, " + _NODES
_FOUND = "g int, query_id long, src array<long>, rank array<int>, dst array<long>, mutual array<boolean>, d2 array<double>"


def _chosen(o: Options) -> Column:
    """Of the rows ``i`` of ``n`` (adjacency order) of a node, those to evaluate; ``want`` many at most."""
    if o.pick == "even":
        head = F.least(F.lit(o.prefix).cast("long"), F.col("want"))
        spaced = F.expr(f"transform(sequence(0L, greatest(want - {o.prefix}L, 1L) - 1L), j -> j * (n - {o.prefix}L - 1L) div greatest(1L, want - {o.prefix}L - 1L))")
        return (F.col("i") < head) | ((F.col("want") > o.prefix) & F.array_contains(spaced, F.col("i") - o.prefix))
    node = Window.partitionBy("query_id", "src")
    gap = F.abs(F.col("dst") - F.col("src"))
    if o.pick == "sides":
        left = F.col("dst") < F.col("src")
        at = F.row_number().over(Window.partitionBy("query_id", "src", left).orderBy("i")) - 1
        n_left = F.count(F.when(left, 1)).over(node)
        half = F.least(n_left, F.floor(F.col("want") / 2))
        room = F.col("want") - half
        return F.when(left, at < half + F.greatest(room - (F.col("n") - n_left), F.lit(0))).otherwise(at < room)
    if o.pick == "reciprocal":
        return F.row_number().over(node.orderBy(F.col("mutual").desc(), gap.desc(), "i")) <= F.col("want")
    if o.pick == "corebridge":
        core = F.bround(F.col("want") * o.core_share).cast("long")
        far = F.row_number().over(Window.partitionBy("query_id", "src", F.col("i") < core).orderBy(gap.desc(), "i"))
        return (F.col("i") < core) | (far <= F.col("want") - core)
    return F.col("i") < F.col("want")


def _neighbours(beams: DataFrame, index: Index, seen: DataFrame, o: Options) -> DataFrame:
    """``query_id, pos, src, rank, selected, raw`` to evaluate: each new node once, for the first source that chose it.

    The choice as joins and windows; searches take ``_picked``, and only a test reads this form's plan.
    """
    front = beams.where("next").select("query_id", F.col("pos").alias("src"), "place", "lo", "hi", "trunc", "skip", "stall")
    rows = front.join(index.links, "src").select(*front.columns, F.posexplode("near").alias("rank", "e"))
    rows = rows.withColumn("dst", F.col("e.dst")).withColumn("mutual", F.col("e.mutual")).drop("e")
    rows = rows.where("dst >= lo and dst < hi and not (dst <=> skip)")
    # one exchange by query serves what follows: seen nodes come along as marks instead of an anti join
    marks = seen.select("query_id", F.col("pos").alias("dst"), F.lit(True).alias("old"))
    rows = rows.unionByName(marks, allowMissingColumns=True).repartition("query_id")
    rows = rows.withColumn("old", F.max("old").over(Window.partitionBy("query_id", "dst"))).where("old is null")
    node = Window.partitionBy("query_id", "src")
    rows = rows.withColumn("i", F.row_number().over(node.orderBy("rank")).cast("long") - 1).withColumn("n", F.count("*").over(node))
    want = F.col("trunc")
    if o.nav_degree:
        want = F.when(F.col("stall") < o.stall_rounds, F.least(want, F.lit(o.nav_degree).cast("long"))).otherwise(want)
    rows = rows.withColumn("want", want)
    chosen = (F.col("n") <= F.col("want")) | _chosen(o)
    if o.fallback_stall:
        chosen = F.when(F.col("stall") >= o.fallback_stall, F.col("i") < 2 * F.col("want")).otherwise(chosen)
    rows = rows.withColumn("chosen", chosen)
    if o.rescue:
        order = (F.abs(F.col("dst") - F.col("src")).desc(), "i") if o.rescue_by == "gap" else ("i",)
        rows = rows.withColumn("chosen", F.col("chosen") | (F.row_number().over(Window.partitionBy("query_id", "src", "chosen").orderBy(*order)) <= o.rescue))
    rows = rows.where("chosen").withColumn("selected", F.row_number().over(node.orderBy("i")).cast("int") - 1)
    first = F.min(F.struct("place", "i", "src", "rank", "selected", F.col("n").cast("int").alias("raw"))).alias("f")
    return rows.groupBy("query_id", F.col("dst").alias("pos")).agg(first).select("query_id", "pos", "f.src", "f.rank", "f.selected", "f.raw")


def _distances(old: DataFrame | None, found: DataFrame, index: Index, queries: DataFrame) -> DataFrame:
    """The rows of a round with ``d2``: found ones meet their vectors by position, then all meet their query."""
    rows = found.join(index.vectors.select("pos", "embedding"), "pos").withColumn("d2", F.lit(None).cast("double"))
    if old is not None:
        rows = rows.unionByName(old.withColumn("embedding", F.lit(None).cast("array<float>")))
    rows = rows.repartition("query_id").join(queries.select("query_id", "qv"), "query_id")
    return rows.withColumn("d2", F.coalesce("d2", squared_l2("embedding", "qv"))).drop("embedding", "qv")


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _lists(table, name: str):
    """Lengths of a column's lists, and all their values in an Arrow array."""
    col = table.column(name).combine_chunks()
    return np.diff(col.offsets.to_numpy()).astype(np.int64), col.flatten()


def _values(table, name: str) -> np.ndarray:
    return _lists(table, name)[1].to_numpy(zero_copy_only=False)


def _places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows whose equal ``keys`` are neighbours: place inside the group from 0, and the group's size."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    return np.arange(n) - np.repeat(start, size), np.repeat(size, size)


def _turns(order: tuple, *keys: np.ndarray) -> np.ndarray:
    """Place of each row inside the group of equal ``keys`` in ``order``, from 0."""
    at = np.lexsort((*reversed(order), *reversed(keys)))
    out = np.empty(len(at), np.int64)
    out[at] = _places(*(k[at] for k in keys))[0]
    return out


def _nested(lengths: np.ndarray, values):
    """A list column of ``values`` in order, ``lengths`` each."""
    import pyarrow as pa

    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), values)


def _expand(fronts, links):
    """The neighbours inside the range of the nodes that queries expand, with their distances: a row a query."""
    import pyarrow as pa

    src, (degree, near), y = _column(links, "src"), _lists(links, "near"), _values(links, "y")
    dst, mutual = near.field("dst").to_numpy(), near.field("mutual").to_numpy(zero_copy_only=False)
    (many, asked), qv = _lists(fronts, "srcs"), _values(fronts, "qv")
    wide = max(len(y) // max(1, len(dst)), len(qv) // max(1, fronts.num_rows), 1)  # either side may be empty
    y, qv = y.reshape(-1, wide), qv.reshape(-1, wide)
    at = np.argsort(src)
    asked, row = asked.to_numpy(), np.repeat(np.arange(fronts.num_rows), many)
    spot = np.minimum(np.searchsorted(src, asked, sorter=at), max(len(src) - 1, 0))
    if len(src):
        hit = src[at[spot]] == asked
        node, row, asked = at[spot[hit]], row[hit], asked[hit]
    else:
        node, row, asked = np.zeros(0, np.int64), row[:0], asked[:0]
    n = degree[node]
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    edge = np.repeat((np.cumsum(degree) - degree)[node], n) + rank
    row, of = np.repeat(row, n), np.repeat(asked, n)
    lo, hi, skip = (_column(fronts, c)[row] for c in ("lo", "hi", "skip"))
    fits = (dst[edge] >= lo) & (dst[edge] < hi) & (dst[edge] != skip)
    edge, row, of, rank = edge[fits], row[fits], of[fits], rank[fits]
    d2 = np.concatenate([np.zeros(0), *(exact.in_order(y[edge[i : i + CHUNK]].astype(np.float64), qv[row[i : i + CHUNK]].astype(np.float64)) for i in range(0, len(edge), CHUNK))])
    n = np.bincount(row, minlength=fronts.num_rows)
    lists = {"src": of, "rank": rank.astype(np.int32), "dst": dst[edge], "mutual": mutual[edge].astype(bool), "d2": d2}
    return pa.table({"g": fronts.column("g"), "query_id": fronts.column("query_id")} | {c: _nested(n, x) for c, x in lists.items()})


def _choice(o: Options, e: dict, want: np.ndarray, stall: np.ndarray) -> np.ndarray:
    """Which of a round's unseen rows to evaluate: ``i`` of ``n`` in adjacency order of node ``q, place``."""
    i, n, node = e["i"], e["n"], (e["q"], e["place"])
    gap = np.abs(e["dst"] - e["src"])
    if o.pick == "even":
        m, steps, rest = i - o.prefix, np.maximum(1, want - o.prefix - 1), np.maximum(1, n - o.prefix - 1)
        j = -(-m * steps // rest)  # the first step that reaches this place
        chosen = (i < np.minimum(o.prefix, want)) | ((want > o.prefix) & (m >= 0) & (j < want - o.prefix) & (j * rest // steps == m))
    elif o.pick == "sides":
        left = e["dst"] < e["src"]
        at = _turns((i,), *node, left)
        n_left = np.add.reduceat(left, np.flatnonzero(i == 0)).astype(np.int64)[np.cumsum(i == 0) - 1] if len(i) else i
        half = np.minimum(n_left, want // 2)
        room = want - half
        chosen = np.where(left, at < half + np.maximum(room - (n - n_left), 0), at < room)
    elif o.pick == "reciprocal":
        chosen = _turns((~e["mutual"], -gap, i), *node) < want
    elif o.pick == "corebridge":
        core = np.rint(want * o.core_share).astype(np.int64)
        chosen = (i < core) | (_turns((-gap, i), *node, i < core) < want - core)
    else:
        chosen = i < want
    chosen = (n <= want) | chosen
    if o.fallback_stall:
        chosen = np.where(stall >= o.fallback_stall, i < 2 * want, chosen)
    if o.rescue:
        chosen = chosen | (_turns((-gap, i) if o.rescue_by == "gap" else (i,), *node, chosen) < o.rescue)
    return chosen


def _picked(o: Options, found, ids: np.ndarray, own: dict, trunc: np.ndarray, stall: np.ndarray) -> dict:
    """The rows to evaluate, each new node once, for the first source that chose it; ``own`` has the queries' nodes and what they saw."""
    many, src = _lists(found, "src")
    e = {"q": np.repeat(np.searchsorted(ids, _column(found, "query_id")), many), "src": src.to_numpy()} | {c: _values(found, c) for c in ("rank", "dst", "mutual", "d2")}
    base = max((int(x.max()) for x in (e["dst"], e["src"], own["seen"], own["pos"]) if len(x)), default=0) + 1
    fresh = ~np.isin(e["q"] * base + e["dst"], own["seen_q"] * base + own["seen"])
    e = {c: x[fresh] for c, x in e.items()}
    at = own["q"] * base + own["pos"]
    order = np.argsort(at)
    e["place"] = own["place"][order[np.searchsorted(at, e["q"] * base + e["src"], sorter=order)]]
    order = np.lexsort((e["rank"], e["place"], e["q"]))
    e = {c: x[order] for c, x in e.items()}
    e["i"], e["n"] = _places(e["q"], e["place"])
    want, calm = trunc[e["q"]], stall[e["q"]]
    if o.nav_degree:
        want = np.where(calm < o.stall_rounds, np.minimum(want, o.nav_degree), want)
    chosen = _choice(o, e, want, calm)
    e = {c: x[chosen] for c, x in e.items()}
    e["selected"], e["raw"] = _places(e["q"], e["place"])[0], e["n"]
    first = np.sort(np.unique(e["q"] * base + e["dst"], return_index=True)[1])  # rows are in order of place
    return {c: e[c][first] for c in ("q", "d2", "src", "rank", "selected", "raw")} | {"pos": e["dst"][first]}


def _advance(o: Options, seeding: bool = False):
    """A round's rows of a group of queries, from the rows of the round before and what was found."""

    def run(state, found):
        import pyarrow as pa

        state = state.take(pa.array(np.argsort(_column(state, "query_id"))))
        ids, beam, budget, trunc, stall, spent = (_column(state, c) for c in ("query_id", "beam", "budget", "trunc", "stall", "spent"))
        many, pos = _lists(state, "pos")
        sights, seen = _lists(state, "seen")
        count, each = len(ids), np.arange(len(ids))
        q, seen_q, seen = np.repeat(each, many), np.repeat(each, sights), seen.to_numpy()
        own = {"q": q, "place": np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many), "pos": pos.to_numpy()} | {c: _values(state, c) for c in ("d2", "open", "next")}
        held = own["place"] < beam[q]
        own = {c: x[held] for c, x in own.items()} | {"seen": seen, "seen_q": seen_q}
        if seeding:
            at, e = _lists(found, "dst")
            e = {"q": np.repeat(np.searchsorted(ids, _column(found, "query_id")), at), "pos": e.to_numpy(), "d2": _values(found, "d2")}
        else:
            e = _picked(o, found, ids, own, trunc, stall)
        old, new = len(own["q"]), len(e["q"])
        gone = own["next"].astype(bool)
        rows = {c: np.r_[own[c], e[c]] for c in ("q", "pos", "d2")}
        rows |= {"new": np.arange(old + new) >= old, "expanded": np.r_[gone, np.zeros(new, bool)], "open": np.r_[own["open"].astype(bool) & ~gone, np.ones(new, bool)]}
        order = np.lexsort((rows["pos"], rows["d2"], rows["q"]))
        rows = {c: x[order] for c, x in rows.items()}
        q, now = rows["q"], np.bincount(own["q"][gone], minlength=count)
        place, many = _places(q)[0], np.bincount(q, minlength=count)
        least, before = np.full(count, np.nan), state.column("best")
        least[q[place == 0]] = rows["d2"][place == 0]
        better = before.is_null().to_numpy() | (least < before.to_numpy())
        stall, spent = np.where(better, 0, stall + now), spent + now
        open_ = rows["open"] & (place < beam[q])
        if o.early_stop:
            cursor = np.full(count, np.iinfo(np.int64).max)
            np.minimum.at(cursor, q[open_], place[open_])
            open_ &= ~((stall >= o.early_stop) & (cursor >= beam // 3))[q]
        turn = np.cumsum(open_) - 1
        turn -= (np.cumsum(np.bincount(q[open_], minlength=count)) - np.bincount(q[open_], minlength=count))[q]
        room = np.where(budget > 0, np.minimum(o.width, budget - spent), o.width)
        next_ = open_ & (turn < room[q])
        lists = {"pos": rows["pos"], "d2": rows["d2"], "open": open_, "next": next_, "new": rows["new"], "expanded": rows["expanded"]}
        for c, kind in (("src", pa.int64()), ("rank", pa.int32()), ("selected", pa.int32()), ("raw", pa.int32())):
            x = np.r_[np.zeros(old, np.int64), e.get(c, np.zeros(new, np.int64))][order]
            lists[c] = pa.array(x, kind, mask=~rows["new"] | seeding)
        seen_q, seen = np.r_[seen_q, e["q"]], np.r_[seen, e["pos"]]
        seen = seen[np.argsort(seen_q, kind="stable")]
        kept = {c: state.column(c) for c in ("g", "query_id", "qv", "lo", "hi", "beam", "trunc", "budget", "skip")}
        kept |= {"stall": pa.array(stall, pa.int64()), "best": pa.array(least), "spent": pa.array(spent, pa.int64()), "active": np.bincount(q[next_], minlength=count) > 0}
        return pa.table(kept | {"seen": _nested(np.bincount(seen_q, minlength=count), seen)} | {c: _nested(many, x) for c, x in lists.items()})

    return run


def _meet(left: DataFrame, right: DataFrame, by: str, f, schema: str) -> DataFrame:
    """``f(left, right)`` for each group ``by``; the left side's columns get ids of their own."""
    return left.toDF(*left.columns).groupBy(by).cogroup(right.groupBy(by)).applyInArrow(f, schema)


def _search(index: Index, queries: DataFrame, o: Options, max_rounds: int) -> tuple[DataFrame, str]:
    """The rows of all rounds, with their ``round``, and where they are; ``last``: the query's last round."""
    spark = queries.sparkSession
    width = lambda name, default: F.coalesce(F.col(name), F.lit(default)).cast("long") if name in queries.columns else F.lit(default).cast("long")
    at = queries.where("end_pos > first_pos").select("query_id", F.col("qv").cast("array<float>").alias("qv"), F.col("first_pos").cast("long").alias("lo"), F.col("end_pos").cast("long").alias("hi"), F.greatest(width("beam_size", o.beam), F.lit(o.k)).alias("beam"), width("trunc_size", o.trunc).alias("trunc"), width("max_expand", o.max_expand).alias("budget"), (F.col("skip") if "skip" in queries.columns else F.lit(None)).cast("long").alias("skip"), "seed_ids")
    at, at_path = tables.cut(at, "queries")
    inside = F.filter(F.array_distinct("seed_ids"), lambda s: (s >= F.col("lo")) & (s < F.col("hi")) & ~s.eqNullSafe(F.col("skip")))
    inside = F.when(F.size(inside) > 0, inside).when(F.col("skip").isNull(), F.array("lo")).otherwise(F.filter(F.array("lo"), lambda s: s != F.col("skip")))
    group = F.pmod(F.xxhash64("query_id"), F.lit(_groups(at.count()))).cast("int").alias("g")
    seeds_ = _distances(None, at.select("query_id", F.explode(inside.cast("array<bigint>")).alias("pos")), index, at)
    seeds_ = seeds_.groupBy("query_id").agg(F.collect_list(F.struct("pos", "d2")).alias("e")).select(group, "query_id", F.col("e.pos").alias("dst"), F.col("e.d2").alias("d2"))
    none = {c: kind for c, kind in (x.rsplit(" ", 1) for x in ("seen array<long>, " + _NODES).split(", "))}
    start = {"stall": F.lit(0).cast("long"), "best": F.lit(None).cast("double"), "spent": F.lit(0).cast("long")} | {c: F.array().cast(kind) for c, kind in none.items()}
    own = ["g", *at.drop("seed_ids").columns, "stall", "best", "spent", "seen", "pos", "d2", "open", "next"]
    held = [*own[:-4], *[F.slice(c, F.lit(1), F.col("beam").cast("int")).alias(c) for c in own[-4:]]]  # what left the beam is not sent on
    state = at.join(seeds_.select("query_id"), "query_id", "left_semi").select("*", group).withColumns(start).select(*own)
    path, r = tables.shared_path(spark, "search"), 0
    rows = _meet(state, seeds_, "g", _advance(o, True), _ROUND)
    while True:
        state = tables.put(rows, f"{path}/round={r}").where("active").select(*held)
        if r == max_rounds or state.isEmpty():
            break
        turn = F.filter(F.arrays_zip("pos", "next"), lambda x: x["next"])["pos"]
        b = lambda x: F.pmod(x, F.lit(index.groups)).cast("int")
        fronts = state.select("g", "query_id", "qv", "lo", "hi", F.coalesce("skip", F.lit(-1)).alias("skip"), turn.alias("turn"))
        fronts = fronts.select("*", F.explode(F.array_distinct(F.transform("turn", b))).alias("b")).withColumn("srcs", F.filter("turn", lambda x: b(x) == F.col("b"))).drop("turn")
        found = _meet(fronts, index.links, "b", _expand, _FOUND)
        rows, r = _meet(state, found, "g", _advance(o), _ROUND), r + 1
    tables.drop(spark, at_path)
    written = spark.read.schema(_ROUND + ", round int").parquet(path)
    nodes = [x.split()[0] for x in _NODES.split(", ")]
    flat = written.select("query_id", "lo", "hi", "beam", "stall", "best", "round", (~F.col("active") | (F.col("round") == r)).alias("last"), F.posexplode(F.arrays_zip(*nodes)).alias("place", "e"))
    return flat.select(*flat.columns[:-2], (F.col("place") + 1).alias("place"), *[F.col(f"e.{c}").alias(c) for c in nodes]), path


def _final(rounds: DataFrame) -> DataFrame:
    """The last beam of every query: finished queries leave the rounds."""
    return rounds.where("last and place <= beam")


def _events(rounds: DataFrame, k: int) -> DataFrame:
    """A row for each evaluation; seeds have no ``current_node``."""
    final = _final(rounds).select("query_id", F.col("pos").alias("neighbor_node"), (F.col("place") <= k).alias("in_final_topk"), F.lit(True).alias("in_final_beam"))
    e = rounds.where("new").select(
        "query_id",
        F.col("round").cast("long").alias("expansion_round"),
        F.col("src").alias("current_node"),
        F.col("pos").alias("neighbor_node"),
        F.col("rank").cast("long").alias("edge_rank"),
        F.col("selected").cast("long").alias("selected_rank"),
        (F.col("place") <= F.col("beam")).alias("was_inserted"),
        (F.col("place") <= k).alias("entered_topk"),
        ((F.col("d2") == F.col("best")) & (F.col("place") == 1)).alias("improved_best"),
        F.col("d2").alias("dist"),
    )
    e = e.join(final, ["query_id", "neighbor_node"], "left")
    return e.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_final_beam", "in_final_topk")})


def _trace(rounds: DataFrame, index: Index) -> DataFrame:
    """A row for each expansion in order: the nodes of a round by their place, with that round's beam."""
    gone = rounds.where("expanded").select("query_id", "round", F.col("pos").alias("src"), "d2", "lo", "hi")
    near = F.col("near")
    inside = F.size(F.filter(near, lambda e: (e["dst"] >= F.col("lo")) & (e["dst"] < F.col("hi"))))
    gone = gone.join(index.links, "src", "left").withColumns({"degree": F.when(near.isNull(), 0).otherwise(F.size(near)), "inside": F.when(near.isNull(), 0).otherwise(inside)}).drop("near")
    new = rounds.where("new and src is not null").groupBy("query_id", "round", "src").agg(F.count("*").alias("selected_count"), F.max("raw").alias("raw"), F.count(F.when(F.col("place") <= F.col("beam"), 1)).alias("insertions"))
    of_round = rounds.groupBy("query_id", "round").agg(F.min("d2").alias("best_dist"), F.max("stall").alias("stall_rounds"), F.max(F.when(F.col("place") <= F.col("beam"), F.col("pos"))).alias("top"), F.min(F.when(F.col("place") <= F.col("beam"), F.col("pos"))).alias("bottom"))
    seeds = rounds.where("round = 0").groupBy("query_id").agg(F.count("*").alias("seeds"))
    t = gone.join(new, ["query_id", "round", "src"], "left").join(of_round, ["query_id", "round"]).join(seeds, "query_id")
    t = t.fillna(0, ["selected_count", "insertions", "raw"])
    order = Window.partitionBy("query_id").orderBy("round", "d2", "src")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return t.select(
        "query_id",
        F.row_number().over(order).cast("long").alias("round"),
        F.col("src").alias("expanded_node"),
        "insertions",
        F.sum("insertions").over(upto).alias("cumulative_insertions"),
        "best_dist",
        "stall_rounds",
        (F.col("top") - F.col("bottom")).alias("beam_label_span"),
        F.col("raw").cast("long").alias("raw_count"),
        "selected_count",
        (F.col("degree") - F.col("inside")).cast("long").alias("range_filtered"),
        (F.col("seeds") + F.sum("selected_count").over(upto)).alias("dist_eval_count"),
        F.col("degree").cast("long").alias("degree"),
    )


def _stats(rounds: DataFrame, index: Index) -> DataFrame:
    t = _trace(rounds, index).groupBy("query_id").agg(F.count("*").alias("expanded_nodes"), F.sum("degree").alias("raw_neighbors_scanned"), F.sum("range_filtered").alias("range_filtered_out_neighbors"), F.sum("insertions").alias("beam_insertions"))
    ahead = rounds.groupBy("query_id", "round").agg(F.max(F.when(F.col("expanded"), F.col("place"))).alias("cursor"))
    back = rounds.where("new and round > 0").join(ahead, ["query_id", "round"]).groupBy("query_id").agg(F.count(F.when(F.col("place") < F.col("cursor"), 1)).alias("beam_rewinds"))
    cost = rounds.groupBy("query_id").agg(F.count(F.when(F.col("new"), 1)).alias("distance_computations"))
    out = cost.join(t, "query_id", "left").join(back, "query_id", "left").fillna(0)
    return out.select("query_id", *STATS)


#: Column names of the search's counters and of its trace.
STATS = ("expanded_nodes", "raw_neighbors_scanned", "range_filtered_out_neighbors", "distance_computations", "beam_insertions", "beam_rewinds")
TRACE = ("query_id", "round", "expanded_node", "insertions", "cumulative_insertions", "best_dist", "stall_rounds", "beam_label_span", "raw_count", "selected_count", "range_filtered", "dist_eval_count")


def search(index: Index, queries: DataFrame, options: Options, what: str = "hits", max_rounds: int = 10_000, fold: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Answers, counters, traces or events of ``queries(query_id, qv, first_pos, end_pos, seed_ids)``.

    hits: ``query_id, rk, id, d2``; stats: a row per query; trace: a row per expansion; events:
    a row per evaluation; expansions: ``query_id, pos``.  Positions run from ``first_pos`` to before
    ``end_pos``; an empty range has no rows; a query without a seed in its range starts at its first position.
    Optional columns ``beam_size, trunc_size, max_expand`` overrule the options for a query, ``skip`` is
    a position that it must not meet.  With ``fold``, what it makes of these rows is written instead of them.
    """
    spark = queries.sparkSession
    rounds, path = _search(index, queries, options, max_rounds)
    if what == "stats":
        out = _stats(rounds, index)
    elif what == "trace":
        out = _trace(rounds, index).select(*TRACE)
    elif what == "events":
        out = _events(rounds, options.k)
    elif what == "expansions":
        out = rounds.where("expanded").select("query_id", "pos", F.col("round").cast("long").alias("round"), "d2")
    else:
        best = _final(rounds).where(F.col("place") <= options.k).join(index.vectors.select("pos", "vec_id"), "pos")
        order = Window.partitionBy("query_id").orderBy("d2", "vec_id")
        out = best.select("query_id", F.row_number().over(order).cast("long").alias("rk"), F.col("vec_id").alias("id"), "d2")
    out, _ = tables.cut(fold(out) if fold else out, what)
    tables.drop(spark, path)
    return out


def seeds(kind: str, queries: DataFrame, vectors: DataFrame, headers: DataFrame, count: int = 4, sample: int = 64) -> DataFrame:
    """``query_id, seed`` in positions: header, anchors, spread, oracle_query_seed or cheap_query_seed.

    ``queries`` has ``first_pos`` and ``end_pos``; a query without seeds gets its first position.
    """
    q = queries.select("query_id", "qv", "ql", "qr", "first_pos", "end_pos")
    n = F.col("end_pos") - F.col("first_pos")
    spaced = lambda c: F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda i: F.col("first_pos") + F.floor(i * (n - 1) / max(1, c - 1)))
    if kind == "header":
        from .graph import as_of_header

        at = as_of_header(headers, q).join(headers, "label").select("query_id", F.col("node").alias("seed"))
        out = at.join(q, "query_id").where("seed >= first_pos and seed < end_pos").select("query_id", "seed")
    elif kind in ("anchors", "spread"):
        out = q.select("query_id", F.explode(F.array_distinct(spaced(count))).alias("seed"))
    elif kind == "oracle_query_seed":
        # block by block: no row for each query and position
        span = q.select("query_id", "qv", "first_pos", (F.col("end_pos") - 1).alias("last_pos"))
        out = exact.topk(vectors, span, count, [("pos", "first_pos", "last_pos")], key="pos").select("query_id", F.col("id").alias("seed"))
    else:
        pool = q.select("query_id", "qv", F.explode(F.array_distinct(spaced(sample))).alias("seed"))
        d = pool.join(vectors.select(F.col("pos").alias("seed"), "embedding"), "seed").withColumn("d2", squared_l2("embedding", "qv"))
        out = d.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "seed"))).where(F.col("r") <= count).select("query_id", "seed")
    filled = q.select("query_id", "first_pos").join(out, "query_id", "left")
    return filled.select("query_id", F.coalesce("seed", "first_pos").cast("long").alias("seed"))


def with_seeds(queries: DataFrame, chosen: DataFrame) -> DataFrame:
    return queries.join(chosen.groupBy("query_id").agg(F.sort_array(F.collect_set("seed")).alias("seed_ids")), "query_id")


def sweep(index: Index, queries: DataFrame, truth: DataFrame, params: list[tuple[int, int]], k: int = 10, options: Options = Options()) -> DataFrame:
    """``beam_size, trunc_size, recall, distance_computations`` per setting: all settings are one search."""
    m = len(params)
    runs = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("run"), F.lit(max(b, k)).cast("long").alias("beam_size"), F.lit(t).cast("long").alias("trunc_size")) for i, (b, t) in enumerate(params)])).alias("p")
    q = queries.select("query_id", "qv", "first_pos", "end_pos", "seed_ids", runs).select((F.col("query_id") * m + F.col("p.run")).alias("query_id"), "qv", "first_pos", "end_pos", "seed_ids", "p.beam_size", "p.trunc_size")
    run = F.pmod(F.col("neighbor_query"), F.lit(m))
    events = search(index, q, replace(options, k=k), "events").withColumnRenamed("query_id", "neighbor_query").withColumn("run", run)
    ids = index.vectors.select(F.col("pos").alias("neighbor_node"), F.col("vec_id").alias("id"))
    hits = events.where("in_final_topk").join(ids, "neighbor_node").select(((F.col("neighbor_query") - F.col("run")) / m).cast("long").alias("query_id"), "run", "id", F.lit(1).alias("hit"))
    asked = truth.select("query_id", "id").withColumn("run", F.explode(F.array(*[F.lit(i).cast("long") for i in range(m)])))
    recall = asked.join(hits, ["query_id", "id", "run"], "left").groupBy("run").agg((F.count("hit") / F.count("*")).alias("recall"))
    cost = events.groupBy("run", "neighbor_query").agg(F.count("*").alias("n")).groupBy("run").agg(F.avg("n").alias("distance_computations"))
    named = F.create_map(*[F.lit(x) for i, p in enumerate(params) for x in (i, F.struct(F.lit(p[0]).alias("beam_size"), F.lit(p[1]).alias("trunc_size")))])
    out = recall.join(cost, "run").withColumn("p", named[F.col("run").cast("int")])
    return out.select("p.beam_size", "p.trunc_size", "recall", "distance_computations").orderBy("beam_size", "trunc_size")


def benefit(events: DataFrame, by: Column, name: str) -> DataFrame:
    """Evaluations, insertions into the beam and new best distances by ``by``, with their three rates."""
    e = events.where("current_node is not null").groupBy(by.alias(name)).agg(F.count("*").alias("evals"), F.count(F.when(F.col("was_inserted"), 1)).alias("inserts"), F.count(F.when(F.col("improved_best"), 1)).alias("bests"))
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return e.withColumns({"insert_rate": rate("inserts", "evals"), "best_rate": rate("bests", "evals"), "best_given_insert_rate": rate("bests", "inserts")})


def gap_bucket() -> Column:
    """Jump level of the edge of an event."""
    return jump_level(F.abs(F.col("neighbor_node") - F.col("current_node"))).cast("long")
