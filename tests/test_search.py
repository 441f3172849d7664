"""The relational search, NN-descent, seed searches and range statistics against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwalk.operators import approximate, exact, folds, graph, ranges, search

from .test_operators import dist, knn, ordered, table  # noqa: F401


@pytest.fixture(scope="module")
def edges(table, knn):  # noqa: F811
    return folds.build(table, knn, step=8, cap=24).cache()


@pytest.fixture(scope="module")
def index(table, edges):  # noqa: F811
    return search.Index(table, edges, depth=4)


@pytest.fixture(scope="module")
def queries(table):  # noqa: F811
    q = table.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"), (F.col("label") * 0 + F.col("vec_id") % 3).alias("ql"), (F.col("label") * 0 + 3).alias("qr"))
    q = q.join(ranges.label_interval(table, q), "query_id")
    return search.with_seeds(q, search.seeds("anchors", q, table, None, 3)).cache()


def adjacency(edges):
    out = {}
    for r in sorted(edges.select("src", "rank", "dst").collect()):
        out.setdefault(r["src"], []).append(r["dst"])
    return out


def choose(raw, u, want, o, near):
    """Plain choice among ``raw``, in adjacency order."""
    if len(raw) <= want:
        return set(raw)
    gap = lambda v: abs(v - u)
    if o.pick == "even":
        head, rest, room = raw[: min(o.prefix, want)], raw[min(o.prefix, want) :], max(0, want - o.prefix)
        return set(head) | {rest[j * (len(rest) - 1) // max(1, room - 1)] for j in range(room)}
    if o.pick == "sides":
        left, right = [v for v in raw if v < u], [v for v in raw if v > u]
        half = min(len(left), want // 2)
        room = want - half
        return set(left[: half + max(0, room - len(right))]) | set(right[:room])
    if o.pick == "reciprocal":
        return set(sorted(raw, key=lambda v: (u not in near.get(v, [])[:4], -gap(v), raw.index(v)))[:want])
    if o.pick == "corebridge":
        core = round(want * o.core_share)
        return set(raw[:core]) | set(sorted(raw[core:], key=lambda v: (-gap(v), raw.index(v)))[: want - core])
    return set(raw[:want])


def plain_search(x, near, q, lo, hi, seeds, o, skip=None, budget=0):
    """Final beam, evaluations ``(round, src, pos)`` and expansions in order."""
    seeds = sorted({s for s in seeds if lo <= s < hi and s != skip}) or [lo]
    beam = sorted((dist(x[s], q), s) for s in seeds)
    log, seen, closed, gone = [(0, None, s) for s in seeds], set(seeds), set(), []
    beam, stall, best, r = beam[: max(o.beam, o.k)], 0, beam[0][0], 0
    while True:
        open_ = [(k, v) for k, (_, v) in enumerate(beam) if v not in closed]
        if not open_ or o.early_stop and stall >= o.early_stop and open_[0][0] >= max(o.beam, o.k) // 3:
            break
        room = min(o.width, budget - len(gone)) if budget else o.width
        turn = [v for _, v in open_[:room]]
        if not turn:
            break
        r, picked = r + 1, {}
        for u in turn:
            raw = [v for v in near.get(u, []) if lo <= v < hi and v not in seen and v != skip]
            want = min(o.trunc, o.nav_degree) if o.nav_degree and stall < o.stall_rounds else o.trunc
            mine = choose(raw, u, want, o, near)
            if o.fallback_stall and stall >= o.fallback_stall and len(raw) > 0:
                mine = set(raw[: 2 * want])
            rest = [v for v in raw if v not in mine]
            rest.sort(key=lambda v: (-abs(v - u), raw.index(v)) if o.rescue_by == "gap" else raw.index(v))
            mine |= set(rest[: o.rescue])
            for v in raw:
                if v in mine:
                    picked.setdefault(v, u)
        gone += turn
        closed |= set(turn)
        seen |= set(picked)
        log += [(r, u, v) for v, u in picked.items()]
        beam = sorted(beam + [(dist(x[v], q), v) for v in picked])[: max(o.beam, o.k)]
        stall = 0 if beam[0][0] < best else stall + len(turn)
        best = beam[0][0]
    return beam, log, gone


OPTIONS = [
    search.Options(k=5, beam=14, trunc=6, width=5),
    search.Options(k=5, beam=14, trunc=6, width=5, pick="even", prefix=3, early_stop=6),
    search.Options(k=5, beam=14, trunc=5, width=5, pick="sides", rescue=2, rescue_by="gap"),
    search.Options(k=5, beam=14, trunc=6, width=5, pick="reciprocal", fallback_stall=4),
    search.Options(k=5, beam=14, trunc=7, width=5, pick="corebridge", nav_degree=3, stall_rounds=4, rescue=1),
]


@pytest.mark.parametrize("o", OPTIONS, ids=lambda o: o.pick)
def test_search_against_plain(table, edges, index, queries, o):  # noqa: F811
    x, near = ordered(table), adjacency(edges)
    got = {}
    for r in search.search(index, queries, o, "events").collect():
        got.setdefault(r["query_id"], []).append(r)
    for q in queries.collect():
        beam, log, _ = plain_search(x, near, q["qv"], q["first_pos"], q["end_pos"], q["seed_ids"], o)
        mine = got[q["query_id"]]
        assert sorted((r["expansion_round"], r["neighbor_node"]) for r in mine) == sorted((r, v) for r, _, v in log)
        assert {(r["current_node"], r["neighbor_node"]) for r in mine} == {(u, v) for _, u, v in log}
        assert {r["neighbor_node"] for r in mine if r["in_final_topk"]} == {v for _, v in beam[:5]}
        assert {r["neighbor_node"] for r in mine if r["in_final_beam"]} == {v for _, v in beam}


def test_answers_counters_and_sweep(spark, table, edges, index, queries):  # noqa: F811
    truth = exact.topk(table, queries, 5, [("label", "ql", "qr")]).select("query_id", "rk", "id").cache()
    wide = search.search(index, queries, search.Options(k=5, beam=120, trunc=64, width=50))
    assert {tuple(r)[:3] for r in wide.collect()} == {tuple(r) for r in truth.collect()}
    x, near, o = ordered(table), adjacency(edges), OPTIONS[0]
    stats = {r["query_id"]: r for r in search.search(index, queries, o, "stats").collect()}
    trace = {}
    for r in search.search(index, queries, o, "trace").orderBy("query_id", "round").collect():
        trace.setdefault(r["query_id"], []).append(r)
    for q in queries.collect():
        beam, log, gone = plain_search(x, near, q["qv"], q["first_pos"], q["end_pos"], q["seed_ids"], o)
        s, t = stats[q["query_id"]], trace[q["query_id"]]
        assert [r["expanded_node"] for r in t] == gone and [r["round"] for r in t] == list(range(1, len(gone) + 1))
        assert s["expanded_nodes"] == len(gone) and s["distance_computations"] == len(log) == t[-1]["dist_eval_count"]
        assert s["raw_neighbors_scanned"] == sum(len(near.get(u, [])) for u in gone)
        assert s["range_filtered_out_neighbors"] == sum(not q["first_pos"] <= v < q["end_pos"] for u in gone for v in near.get(u, []))
        assert s["beam_insertions"] == t[-1]["cumulative_insertions"] and t[-1]["best_dist"] == beam[0][0]
    runs = search.sweep(index, queries, truth.select("query_id", "id"), [(6, 2), (40, 24)], 5).collect()
    assert [(r["beam_size"], r["trunc_size"]) for r in runs] == [(6, 2), (40, 24)]
    assert runs[0]["recall"] <= runs[1]["recall"] and runs[1]["recall"] > 0.95 and runs[0]["distance_computations"] < runs[1]["distance_computations"]
    hits = search.search(index, queries, search.Options(k=5, beam=40, trunc=24)).join(truth, ["query_id", "id"]).count()
    assert runs[1]["recall"] == pytest.approx(hits / truth.count(), abs=0.03)
    nothing = queries.limit(1).withColumn("end_pos", F.col("first_pos"))
    assert search.search(index, nothing, o).count() == 0
    blind = queries.limit(1).withColumn("seed_ids", F.array(F.lit(9999).cast("long")))
    assert search.search(index, blind, search.Options(k=3)).count() == 3


def test_benefit_counts_events(index, queries):
    e = search.search(index, queries, OPTIONS[0], "events").cache()
    rows = e.where("current_node is not null").collect()
    by_rank = {r["selected_rank"]: r for r in search.benefit(e, F.col("selected_rank"), "selected_rank").collect()}
    assert sum(r["evals"] for r in by_rank.values()) == len(rows)
    for k, r in by_rank.items():
        mine = [x for x in rows if x["selected_rank"] == k]
        ins, best = sum(x["was_inserted"] for x in mine), sum(x["improved_best"] for x in mine)
        assert (r["evals"], r["inserts"], r["bests"]) == (len(mine), ins, best)
        assert r["insert_rate"] == ins / len(mine) and r["best_given_insert_rate"] == (best / ins if ins else 0)


def test_a_round_moves_no_index(spark, index):
    beams = spark.range(9).selectExpr("id AS query_id", "id AS pos", "1 AS place", "0L AS lo", "90L AS hi", "4L AS trunc", "CAST(NULL AS LONG) AS skip", "0L AS stall", "true AS next")
    plan = search._distances(None, search._neighbours(beams, index, beams, OPTIONS[0]), index, beams.selectExpr("query_id", "array(1.0F) AS qv"))._jdf.queryExecution().executedPlan().toString()
    plan = "\n".join(x for x in plan.split("\n") if not x.strip(" :|").startswith("+- InMemoryRelation"))
    assert "NestedLoop" not in plan.split("InMemoryRelation")[0] and "Cartesian" not in plan.split("InMemoryRelation")[0]


def test_nn_descent(spark, table):  # noqa: F811
    truth = exact.knn_graph(table, 6).cache()
    assert {tuple(r) for r in approximate.nn_descent(table, 6, pool=200).collect()} == {tuple(r) for r in truth.collect()}  # a pool of all
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(v) for v in centres[i % 12] + 0.6 * rng.normal(size=16)]) for i in range(900)]
    big = spark.createDataFrame(rows, "pos long, embedding array<float>").cache()
    got = approximate.nn_descent(big, 8)
    want = exact.knn_graph(big, 8).cache()
    assert got.groupBy("src").count().agg(F.min("count"), F.max("count")).first() == (8, 8)
    assert got.where("src = dst").count() == 0
    assert got.join(want, ["src", "dst"]).count() >= 0.95 * want.count()
    both = got.join(want.withColumnRenamed("d2", "exact"), ["src", "dst"])
    assert both.where("d2 <> exact").count() == 0  # distances are those of the exact graph
    assert approximate.nn_descent(big.limit(0), 8).count() == 0 and approximate.nn_descent(big.where("pos = 0"), 8).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "pos long, embedding array<float>")
    assert approximate.nn_descent(same, 3, pool=5).groupBy("src").count().where("count <> 3").count() == 0


def test_seed_chains_and_searches(table, knn):  # noqa: F811
    x, near, n = ordered(table), adjacency(knn), 120
    mean = np.mean([x[i] for i in range(n)], 0)
    d = [float(dist(x[i], mean)) for i in range(n)]
    scored = table.sparkSession.createDataFrame([(i, 0, d[i]) for i in range(n)], "pos long, label long, d double").cache()

    def chain(src, side):
        at, out = (src - 1 if side == 0 else src + 1), []
        while 0 <= at < n:
            out.append(at)
            step = [j for j in (range(at - 1, -1, -1) if side == 0 else range(at + 1, n)) if d[j] < d[at]]
            at = step[0] if step else -1
        return out

    chains = {(s, side): chain(s, side) for s in range(n) for side in (0, 1)}
    for policy, limit in (("near", 3), ("far", 2)):
        got = {}
        for r in approximate.seed_chains(table, scored, limit, policy).orderBy("turn").collect():
            got.setdefault((r["src"], r["side"]), []).append(r["seed"])
        want = {k: (c[:limit] if policy == "near" else c[::-1][:limit]) for k, c in chains.items() if c}
        assert got == want
    few = approximate.seed_chains(table, scored, 3).where("src % 12 = 0").cache()
    o = search.Options(k=1, beam=9, trunc=5, width=4)
    for collect, mode in (("discovered", "beam"), ("expanded", "queue")):
        got = {}
        for r in approximate.seed_search(table, knn, few, mode, collect, batch=2, keep=4, expand=3, beam=9, degree=5, width=4).collect():
            got.setdefault((r["src"], r["side"], r["batch"]), {})[r["turn"]] = r["dst"]
        want = {}
        for src in range(0, n, 12):
            for side in (0, 1):
                mine = chains[src, side][:3]
                for b in range(0, len(mine), 2):
                    seeds = mine[b : b + 2]
                    wide = o if mode == "beam" else search.Options(k=1, beam=1 << 40, trunc=5, width=4)
                    _, log, gone = plain_search(x, {u: v[:5] for u, v in near.items()}, x[src], 0, n, seeds, wide, src, 3 * len(seeds))
                    if collect == "expanded":
                        found = gone
                    else:
                        held, found = [], []
                        for r in range(max(k for k, _, _ in log) + 1):
                            fresh = sorted((dist(x[v], x[src]), v) for k, _, v in log if k == r)
                            held = sorted(held + fresh)[:9]
                            found += [v for e, v in fresh if (e, v) in held or r == 0]
                    want[src, side, b // 2] = dict(enumerate(found[: 4 * len(seeds)]))
        assert got == want
    bridges = approximate.seed_bridges(table, knn, scored, 2, expand=1, beam=6, degree=4)
    rows = bridges.collect()
    assert all(r["src"] != r["dst"] and r["support"] >= 1 for r in rows)
    assert {(s, v) for (s, _), c in chains.items() for v in c[:2]} <= {(r["src"], r["dst"]) for r in rows}


@pytest.mark.parametrize("block", [5, 4096])
def test_smaller_neighbours_and_headers(spark, block):
    rng = np.random.default_rng(block)
    for d in ([float(x) for x in rng.integers(0, 30, 130)], [float(-i) for i in range(40)]):
        n = len(d)
        scored = spark.createDataFrame([(i, i // 25, d[i]) for i in range(n)], "pos long, label long, d double").repartition(3)
        for r in graph.smaller_neighbours(scored, block).collect():
            left = [j for j in range(r["pos"]) if d[j] < d[r["pos"]]]
            right = [j for j in range(r["pos"] + 1, n) if d[j] < d[r["pos"]]]
            assert (r["prev"], r["next"]) == (left[-1] if left else -1, right[0] if right else -1)
    if block == 4096:
        up = spark.createDataFrame([(i, i // 8, float(i)) for i in range(16)], "pos long, label long, d double")  # every place is a minimum
        for limit, want in ((5, 5), (0, 8)):
            got = {r["ord"]: r["node"] for r in graph.headers(up, limit).where("label = 0").collect()}
            assert got == {k: 7 - k for k in range(want)}
        assert graph.headers(up, 0).where("label = 1").count() == 16
        assert graph.smaller_neighbours(up.limit(0)).count() == 0 and graph.headers(up.limit(0)).count() == 0


def test_sums_inside_ranges(spark):
    rng = np.random.default_rng(7)
    n = 300
    e = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (900, 2)) if a != b} | {(0, v) for v in range(1, n)})  # a hot end
    spans = [(i, int(min(a, b)), int(max(a, b)) + 1) for i, (a, b) in enumerate(rng.integers(0, n, (60, 2)))] + [(98, 0, n), (99, 7, 8)]
    edges = spark.createDataFrame([(a, b, a % 5) for a, b in e], "src long, dst long, w long").repartition(5)
    asked = spark.createDataFrame(spans, "query_id long, first_pos long, end_pos long")
    got = {r["query_id"]: (r["n"], r["w"]) for r in ranges.inside_sums(edges, asked, {"n": "1L", "w": "w"}, n).collect()}
    for q, lo, hi in spans:
        inside = [a for a, b in e if lo <= a < hi and lo <= b < hi]
        assert got[q] == (len(inside), sum(a % 5 for a in inside))
    vectors = spark.createDataFrame([(i, i // 40) for i in range(n)], "pos long, label long")
    headers = spark.createDataFrame([(t, p) for t in range(8) for p in range(5, min(n, 40 * (t + 1)), 30)], "label long, node long")
    deg = {i: 0 for i in range(n)}
    for a, _ in e:
        deg[a] += 1
    for r in ranges.range_stats(edges, vectors, asked, headers).collect():
        _, lo, hi = next(s for s in spans if s[0] == r["query_id"])
        own = {i: 0 for i in range(lo, hi)}
        for a, b in e:
            if lo <= a < hi and lo <= b < hi:
                own[a] += 1
        top = (hi - 1) // 40
        assert r["header_size"] == sum(lo <= p < hi for p in range(5, min(n, 40 * (top + 1)), 30))
        assert r["degree"] == pytest.approx(sum(deg[i] for i in own) / (hi - lo)) and r["in_range_degree"] == pytest.approx(sum(own.values()) / (hi - lo))
        ratios = [own[i] / deg[i] for i in own if deg[i]]
        assert r["keep_ratio"] == pytest.approx(sum(ratios) / len(ratios) if ratios else 0) and r["share"] == pytest.approx(r["kept"] / len(e))


def test_running_sums_split_a_hot_key(spark):
    rows = spark.createDataFrame([("hot", i, 1) for i in range(500)] + [("cold", i, 2) for i in range(3)], "k string, i int, w long").repartition(7)
    out = ranges.running(rows, ["k"], ["i"], ["w"])
    assert sorted((r["k"], r["i"], r["w"]) for r in out.collect()) == [("cold", i, 2 * i + 2) for i in range(3)] + [("hot", i, i + 1) for i in range(500)]
