"""Order-dependent graph operators: one list of candidates per source node, folded in Arrow batches.

A node's candidates are bounded by the caps of the joins before (k-NN degree, window cap),
so a list fits a task whatever the size of the graph.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.functions.kernels import jump_level
from bandwalk.operators import exact, graph

EDGES = "src long, rank long, dst long, d2 double"


#: Arrow's names of the types that folds return.
_TYPES = {"long": "int64", "double": "double", "array<long>": "list"}


def _fold(rows: DataFrame, vectors: DataFrame | None, fold, order=("d2", "dst"), schema: str = EDGES) -> DataFrame:
    """``fold(src, e)`` for each source; ``e`` has its rows' columns in ``order``, and ``y``, the rows' vectors, if ``vectors`` are given.

    It returns the columns of ``schema`` after ``src``.  With vectors ``d2`` is the distance to the source,
    summed over the dimensions in order; the vectors of the rows come by ``dst``, that of the source once.
    """
    names, own = [c for c in rows.columns if c != "src"], vectors is not None
    if own:
        v = vectors.select("pos", "embedding")
        rows = rows.join(v.toDF("dst", "y"), "dst")
    lists = rows.groupBy("src").agg(F.collect_list(F.struct(*names, *(["y"] if own else []))).alias("e"))
    if own:
        lists = lists.join(v.toDF("src", "x"), "src")
    types = [c.split()[1] for c in schema.split(", ")]

    def run(batches):
        import pyarrow as pa

        types_ = [pa.list_(pa.int64()) if _TYPES[t] == "list" else pa.type_for_alias(_TYPES[t]) for t in types]
        for b in batches:
            if not b.num_rows:
                continue
            members = b.column("e")
            if isinstance(members, pa.ChunkedArray):
                members = members.combine_chunks()
            ends, flat, src = members.offsets.to_numpy(), members.flatten(), b.column("src").to_numpy(zero_copy_only=False)
            ends = ends - ends[0]
            node = np.repeat(np.arange(len(src)), np.diff(ends))
            cols = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in names}
            if own:
                y, x = (m.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) for m, n in ((flat.field("y"), len(node)), (b.column("x"), len(src))))
                cols["d2"] = np.zeros(len(node))
                for d in range(y.shape[1]):
                    cols["d2"] += np.square(y[:, d].astype(np.float64) - x[node, d].astype(np.float64))
            at = np.lexsort((*(cols[c] for c in reversed(order)), node))
            cols, out = {c: a[at] for c, a in cols.items()}, []
            for s, lo, hi in zip(src.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                e = {c: a[lo:hi] for c, a in cols.items()}
                if own:
                    e["y"] = y[at[lo:hi]].astype(np.float64)
                got = fold(s, e)
                out.append((np.full(len(got[0]), s), *got))
            arrays = [pa.array(list(chain.from_iterable(c)) if pa.types.is_list(t) else np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types_, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in schema.split(", ")])

    return lists.mapInArrow(run, schema)


def _once(e: dict) -> dict:
    """Rows of a node without further ones of the same target."""
    at = np.unique(e["dst"], return_index=True)[1]
    return e if len(at) == len(e["dst"]) else {c: a[np.sort(at)] for c, a in e.items()}


def _pairwise(e: dict) -> np.ndarray:
    """Squared distances of a node's rows, summed over the dimensions in order."""
    m = e["y"]
    if len(m) > 128:
        return exact.distances(m, m)
    t = np.ascontiguousarray(m.T)
    return np.add.reduce(np.square(t[:, :, None] - t[:, None, :]), axis=0)


def _accept(order: np.ndarray, d: np.ndarray, between: np.ndarray, limit: int | None = None, witness=None) -> list[int]:
    """Greedy relative-neighbourhood choice: a candidate falls to an accepted one nearer to both ends.

    ``witness(k)`` says for every candidate whether the accepted ``k`` may exclude it.
    """
    kept: list[int] = []
    out = np.zeros(len(d), bool)
    for c in order:
        if limit is not None and len(kept) >= limit:
            break
        if out[c]:
            continue
        kept.append(int(c))
        falls = (d > d[c]) & (d > between[:, c])
        out |= falls if witness is None else falls & witness(c)
    return kept


def _emit(e: dict, kept) -> tuple:
    kept = np.asarray(kept, int)
    return np.arange(len(kept)), e["dst"][kept], e["d2"][kept]


def prune(candidates: DataFrame, vectors: DataFrame, cap: int, by_side: bool = True) -> DataFrame:
    """Pruned edges: per side by label proximity, half of ``cap`` to the left and the right up to what is left of it, or all by distance."""

    def run(src, e):
        e = _once(e)
        d, between = e["d2"], _pairwise(e)
        if by_side:
            gap = e["dst"] - src
            kept: list[int] = []
            for side, upto in ((gap < 0, cap // 2), (gap > 0, cap)):
                at = np.flatnonzero(side)
                kept += _accept(at[np.argsort(np.abs(gap[at]), kind="stable")], d, between)[: upto - len(kept)]
            kept.sort()
        else:
            kept = _accept(np.arange(len(d)), d, between)[:cap]
        return _emit(e, kept)

    return _fold(candidates.select("src", "dst"), vectors, run)


def quota_merge(core: DataFrame, bridge: DataFrame, vectors: DataFrame, cap: int, core_share: float = 0.6) -> DataFrame:
    """Per side a core budget, then bridges, then what room is left for either; then both sides and all leftovers together.

    Within a side, and again across sides, an edge has to be valid beside those chosen before.
    """
    yes, no = F.lit(True), F.lit(False)
    both = core.select("src", "dst", yes.alias("core"), no.alias("bridge")).unionByName(bridge.select("src", "dst", no.alias("core"), yes.alias("bridge")))
    both = both.groupBy("src", "dst").agg(F.max("core").alias("core"), F.max("bridge").alias("bridge"))

    def run(src, e):
        d, between = e["d2"], _pairwise(e)
        is_core, is_bridge, left = e["core"].astype(bool), e["bridge"].astype(bool), e["dst"] < src

        def extend(chosen: list[int], pool, upto: int) -> None:
            for c in pool:
                if len(chosen) >= upto:
                    return
                k = np.array(chosen, int)
                if c not in chosen and not ((d[c] > d[k]) & (d[c] > between[c, k])).any():
                    chosen.append(int(c))

        kept: list[int] = []
        for side, room in ((left, cap // 2), (~left, cap - cap // 2)):
            mine: list[int] = []
            near, far = np.flatnonzero(side & is_core), np.flatnonzero(side & is_bridge)
            for pool, upto in ((near, _nearest(room * core_share)), (far, room), (near, room), (far, room)):
                extend(mine, pool, upto)
            extend(kept, mine, cap)
        extend(kept, range(len(d)), cap)
        return _emit(e, sorted(kept))

    return _fold(both, vectors, run)


def _nearest(x: float) -> int:
    """Rounded, halves up."""
    return int(x + 0.5)


#: The names of the prefix policies.
POLICIES = ("dist", "labelg", "tierbal", "balmix", "bridgefirst", "thinbridge", "switchband", "balance", "mix", "cover", "scoreg", "score")


class Lanes:
    """Left and right candidates of a node, each side in an order of its own.

    The head of lower distance rank is next, unless its side had the last turn and the other
    head is at most ``tolerance`` ranks behind.
    """

    def __init__(self, left: list[int], right: list[int], tolerance: int):
        self.sides, self.tolerance = (left[::-1], right[::-1]), tolerance

    def take(self, last: int | None) -> tuple[int, int] | None:
        """The next candidate and its side, given the side of the last one; None if both are empty."""
        heads = [(side[-1], k) for k, side in enumerate(self.sides) if side]
        if not heads:
            return None
        (rank, k), other = min(heads), max(heads)
        if k == last and len(heads) == 2 and other[0] <= rank + self.tolerance:
            k = other[1]
        return self.sides[k].pop(), k


def _alternate(lanes: Lanes) -> list[int]:
    out, last = [], None
    while (step := lanes.take(last)) is not None:
        out.append(step[0])
        last = step[1]
    return out


def _level(gap: int) -> int:
    return 0 if gap < 2 else min(30, int(gap).bit_length() - 1)


def _sides(xs: list[int], gaps: list[int]) -> tuple[list[int], list[int]]:
    return [x for x in xs if gaps[x] < 0], [x for x in xs if gaps[x] >= 0]


def _side_order(side: list[int], size: list[int], policy: str, alpha: float) -> list[int]:
    if policy == "labelg":
        return sorted(side, key=lambda x: (size[x], x))
    if len(side) <= 2 or policy == "balance":
        return side
    if policy == "balmix":
        by_gap = {x: k for k, x in enumerate(sorted(side, key=lambda x: (size[x], x)))}
        return sorted(side, key=lambda x: (x + alpha * by_gap[x], x))
    most, first = max(4, min(8, _nearest(len(side) ** 0.5))), {}  # tierbal
    for x in side:
        if len(first) < most:
            first.setdefault(_level(size[x]), x)
    front = list(first.values())
    return front + [x for x in side if x not in front]


def _bridges(gaps: list[int], size: list[int], policy: str, ratio: float | None, w: int, min_gap: int) -> list[int]:
    """The bridge family: far edges spread through the pool, after some near ones, or first."""
    n = len(gaps)
    share = ratio or {"bridgefirst": 0.35, "thinbridge": 0.20, "switchband": 0.25}[policy]
    banded, thin = policy == "switchband", policy == "thinbridge"
    if banded:
        reach = max(24, min(n - w, max(4 * w, _nearest((n - w) * max(0.35, share)))))
    else:
        reach = max(16, _nearest((n - w) * max(0.5, share)))
    end = min(n, w + reach)
    slots, low = end - w, max(1, min_gap)
    if slots <= 1:
        return list(range(n))
    high = max(low + 1, 8 * min_gap) if banded else None
    far = [x for x in range(w, end) if size[x] >= low and (high is None or size[x] < high)]
    near_lanes = Lanes(*_sides([x for x in range(w, end) if x not in set(far)], gaps), -1 if banded else 6)
    if banded:
        far.sort(key=lambda x: (size[x] - low, x))
    far_lanes = Lanes(*_sides(far, gaps), 6)
    opening = min(slots, max(8, w)) if thin else 0
    rest = slots - opening
    goal = min(slots, max(4, min(12, _nearest(slots * share)))) if banded else min(rest, max(1 if thin else 2, _nearest(rest * share)))
    out, last, used, opened = list(range(w)), None, 0, 0
    for slot in range(slots):
        if opened < opening:
            turn = (near_lanes, far_lanes)
        elif banded:
            turn = (far_lanes, near_lanes) if used < goal else (near_lanes, far_lanes)
        else:
            due = used < goal and rest > 0 and (slot - min(slot, opening)) * goal < (used + 1) * rest
            turn = (far_lanes, near_lanes) if due else (near_lanes, far_lanes)
        for lanes in turn:
            if (step := lanes.take(last)) is not None:
                out.append(step[0])
                last = step[1]
                used += lanes is far_lanes
                opened += lanes is near_lanes and opened < opening
                break
    return out + list(range(end, n))


def prefix_order(gaps: list[int], policy: str, ratio: float | None = None, warm: int = 8, min_gap: int = 64, alpha: float = 0.35) -> list[int]:
    """New order of a node's distance-sorted edges; ``gaps`` are signed (target minus source).

    Without ``ratio`` a policy takes its own; ``mix`` and ``cover`` then change nothing.
    """
    n = len(gaps)
    w, size = min(warm, n), [abs(g) for g in gaps]
    whole = list(range(n))
    end = min(n, w + max(16, _nearest((n - w) * (ratio or 0.5))))
    if policy in ("labelg", "tierbal", "balmix", "balance"):
        left, right = (_side_order(s, size, policy, alpha) for s in _sides(whole[w:end], gaps))
        return whole[:w] + _alternate(Lanes(left, right, 4)) + whole[end:]
    if policy in ("bridgefirst", "thinbridge", "switchband"):
        return _bridges(gaps, size, policy, ratio, w, min_gap)
    if policy == "mix" and ratio:
        every = max(1, _nearest(1 / ratio))
        far = iter(sorted((x for x in whole[w:] if size[x] >= min_gap), key=lambda x: (-size[x], x)))
        out, taken = whole[:w], set(whole[:w])
        near = (x for x in whole[w:] if x not in taken)
        for k in range(n - w):
            pick = next((x for x in far if x not in taken), None) if k % every == 0 else None
            pick = next(near) if pick is None else pick
            taken.add(pick)
            out.append(pick)
        return out
    if policy == "cover" and ratio:
        quota = _nearest((n - w) * ratio)
        bins: dict[tuple[int, bool], list[int]] = {}
        for x in whole[w : min(n, w + max(16, 4 * quota))]:
            bins.setdefault((-_level(size[x]), gaps[x] >= 0), []).append(x)
        picked = [x for _, _, x in sorted((k, b, x) for b, xs in bins.items() for k, x in enumerate(xs))][:quota]
        return whole[:w] + picked + [x for x in whole[w:] if x not in picked]
    if policy in ("score", "scoreg"):
        scope = whole if policy == "score" else whole[w:end]
        by_jump = {x: k for k, x in enumerate(sorted(scope, key=lambda x: (-_level(size[x]), x)))}
        ordered = [x for _, x in sorted((k - alpha * by_jump[x], x) for k, x in enumerate(scope))]
        return ordered if policy == "score" else whole[:w] + ordered + whole[end:]
    return whole


def reorder_prefix(edges: DataFrame, policy: str, **options) -> DataFrame:
    """Edges ``(src, rank, dst, d2)`` re-ranked by a prefix policy; unknown names mean distance order."""
    policy = policy.lower()
    if policy not in POLICIES[1:]:
        return edges.withColumn("rank", graph._rank("d2", "dst")).select("src", "rank", "dst", "d2")

    return _fold(edges.select("src", "dst", "d2"), None, lambda src, e: _emit(e, prefix_order((e["dst"] - src).tolist(), policy, **options)))


def survival_key(d: np.ndarray, between: np.ndarray, labels: np.ndarray, source: int, top: int, relax: float = 1.0) -> np.ndarray:
    """How wide a label range each edge survives in when siblings enter by label gap: from its left to its right drop."""
    low, high = np.zeros(len(d), np.int64), np.full(len(d), top, np.int64)

    def drop(x: int, by: int) -> None:
        if labels[by] < labels[x]:
            low[x] = max(low[x], labels[by])
        else:
            high[x] = min(high[x], labels[by])

    active: list[int] = []
    for x in np.lexsort((np.arange(len(d)), np.abs(labels - source))):
        by = next((y for y in active if d[y] < d[x] and between[y, x] < relax * d[x]), None)
        if by is not None:
            drop(x, by)
            continue
        beaten = [y for y in active if d[x] < d[y] and between[x, y] < relax * d[y]]
        for y in beaten:
            drop(y, x)
        active = [y for y in active if y not in beaten] + [int(x)]
    return high - low


def reorder_survival(edges: DataFrame, vectors: DataFrame, core_first: bool = False, pinned: int = 8) -> DataFrame:
    """Widest survival first, or greedy core first and by distance; the first ``pinned`` edges stay in place."""
    top = vectors.agg(F.max("label")).first()[0]
    lab = vectors.select("pos", "label")
    e = edges.select("src", "rank", "dst").join(lab.toDF("src", "lu"), "src").join(lab.toDF("dst", "lv"), "dst")

    def run(src, e):
        d, between = e["d2"], _pairwise(e)
        if core_first:
            core = np.zeros(len(d), bool)
            core[_accept(np.argsort(d, kind="stable"), d, between)] = True
            keys = (d, ~core)
        else:
            keys = (-survival_key(d, between, e["lv"], int(e["lu"][0]), top),)
        order = np.lexsort((np.arange(len(d)), *keys))
        return _emit(e, [*range(min(pinned, len(d))), *(x for x in order.tolist() if x >= pinned)])

    return _fold(e, vectors, run, ("rank",))


def conflicts(edges: DataFrame, vectors: DataFrame, mode: str = "exact") -> DataFrame:
    """``src, rank, dst, conflicts``: ranks of accepted siblings that exclude an edge (first or all of them)."""

    def run(src, e):
        d, between, rank = e["d2"], _pairwise(e), e["rank"]
        accepted, lists = [], [[] for _ in range(len(d))]
        for c in np.lexsort((rank, d)):
            hits = [k for k in accepted if d[c] > d[k] and d[c] > between[c, k]]
            lists[c] = [int(rank[k]) for k in (hits[:1] if mode == "pairwise" else hits)]
            if not hits:
                accepted.append(c)
        return rank, e["dst"], lists

    return _fold(edges.select("src", "rank", "dst"), vectors, run, ("rank",), "src long, rank long, dst long, conflicts array<long>")


def conflict_gate(annotated: DataFrame, low: int, high: int) -> DataFrame:
    """Of the edges into ``[low, high]``, in rank order, those without an accepted conflicting sibling: a fold in SQL."""
    inside = annotated.where(F.col("dst").between(low, high)).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rank", "dst", "conflicts"))).alias("e"))
    fold = "aggregate(e, cast(array() AS array<struct<rank:bigint,dst:bigint>>), (acc, x) -> if(arrays_overlap(transform(acc, a -> a.rank), x.conflicts), acc, concat(acc, array(struct(x.rank AS rank, x.dst AS dst)))))"
    return inside.selectExpr("src", f"inline({fold})").select("src", "rank", "dst")


def build(vectors: DataFrame, knn: DataFrame, step: int = 32, cap: int = 24, window_cap: int | None = None, policy: str = "dist", refine: bool = True, bridges: DataFrame | None = None) -> DataFrame:
    """Range graph: k-NN, window and bridge candidates, pruned by side; a second pass over the first and its reverse."""
    window = graph.band(vectors, step) if window_cap is None else graph.band_capped(vectors, step, window_cap)
    candidates = knn.select("src", "dst").unionByName(window)
    if bridges is not None:
        candidates = candidates.unionByName(bridges.select("src", "dst"))
    first = prune(candidates.distinct(), vectors, cap)
    if refine:
        first = first.persist()  # read twice below
        pairs = first.select("src", "dst")
        first = prune(pairs.unionByName(graph.transpose(pairs)).distinct(), vectors, cap)
    return reorder_prefix(first, policy)


def build_profile(vectors: DataFrame, knn: DataFrame, step: int = 32, cap: int = 24, window_cap: int | None = None, policy: str = "dist", refine: bool = True, bridges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The graph of ``build``, and one row of its stages' counts and their means a node.

    ``nodes, knn, window, bridge, candidates, first_edges, merged, edges`` and ``*_per_node``: rows are
    counted by observations while the stages run, each of which is written once.
    """
    spark, seen, paths = vectors.sparkSession, {}, []

    def watched(name: str, df: DataFrame) -> DataFrame:
        seen[name] = Observation()
        return df.observe(seen[name], F.count(F.lit(1)).alias("rows"))

    def staged(name: str, df: DataFrame) -> DataFrame:
        out, path = tables.cut(watched(name, df), name)
        paths.append(path)
        return out

    sources = {"knn": knn, "window": graph.band(vectors, step) if window_cap is None else graph.band_capped(vectors, step, window_cap)}
    if bridges is not None:
        sources["bridge"] = bridges
    pool = None
    for name, df in sources.items():
        df = watched(name, df.select("src", "dst"))
        pool = df if pool is None else pool.unionByName(df)
    first = staged("first_edges", prune(staged("candidates", pool.distinct()), vectors, cap))
    if refine:
        pairs = first.select("src", "dst")
        first = prune(staged("merged", pairs.unionByName(graph.transpose(pairs)).distinct()), vectors, cap)
    edges, _ = tables.cut(watched("edges", reorder_prefix(first, policy)), "edges")
    tables.drop(spark, *paths)
    names = ("knn", "window", "bridge", "candidates", "first_edges", "merged", "edges")
    counts = {n: seen[n].get["rows"] if n in seen else 0 for n in names}
    n = vectors.count()
    row = (n, *counts.values(), *(c / n if n else 0.0 for c in counts.values()))
    schema = ", ".join(["nodes long", *(f"{c} long" for c in names), *(f"{c}_per_node double" for c in names)])
    return edges, spark.createDataFrame([row], schema)


def chain_bridges(vectors: DataFrame, scored: DataFrame, limit: int = 6) -> DataFrame:
    """``src, dst``: walk from each node's neighbour along the previous (next) smaller chain, ``limit`` steps a side."""
    step = graph.smaller_neighbours(scored)
    out = None
    for side, start in (("prev", -1), ("next", 1)):
        at = vectors.select(F.col("pos").alias("src"), (F.col("pos") + start).alias("dst"))
        at = at.join(step.select(F.col("pos").alias("dst")), "dst")
        for _ in range(limit):
            out = at.select("src", "dst") if out is None else out.unionByName(at.select("src", "dst"))
            at = at.join(step.select(F.col("pos").alias("dst"), F.col(side).alias("to")), "dst").where("to >= 0").select("src", F.col("to").alias("dst"))
    return out.where("src <> dst").distinct()


def support_reserve(found: DataFrame, knn: DataFrame, room: int, min_gap: int = 0) -> DataFrame:
    """``src, rank, dst``: by how often a node was found, then distance, sides in turn; with ``min_gap`` far levels come first."""
    gap = F.abs(F.col("src") - F.col("dst"))
    votes = found.groupBy("src", "dst").agg(F.count("*").alias("support")).where(gap >= min_gap)
    e = votes.join(knn.select("src", "dst", "d2"), ["src", "dst"])
    far = (jump_level(gap).desc(),) if min_gap else ()
    out = graph.alternate_sides(e, (*far, F.col("support").desc(), "d2", "dst"))
    return out.where(F.col("rank") < room)


def box_prune(candidates: DataFrame, vectors: DataFrame, cap: int) -> DataFrame:
    """Two labels: a witness also has to lie in the label box between the source and the candidate."""
    lab = vectors.select("pos", F.col("x").alias("lx"), F.col("y").alias("ly"))
    c = candidates.join(lab.toDF("src", "sx", "sy"), "src").join(lab.toDF("dst", "dx", "dy"), "dst")

    def run(src, e):
        e = _once(e)
        sx, sy, dx, dy = (e[k] for k in ("sx", "sy", "dx", "dy"))
        inside = lambda k: (np.minimum(sx, dx) <= dx[k]) & (dx[k] <= np.maximum(sx, dx)) & (np.minimum(sy, dy) <= dy[k]) & (dy[k] <= np.maximum(sy, dy))
        return _emit(e, _accept(np.arange(len(e["dst"])), e["d2"], _pairwise(e), cap, inside))

    return _fold(c, vectors, run)
