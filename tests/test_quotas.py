"""Role quotas, reserves, edge scores and run checks against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from bandwalk.operators import quotas, trace
from bandwalk.sources import vectors as src


def take(left, right, quota, out):
    """Turns of two sorted sides until ``out`` has ``quota`` entries."""
    left, right, last = [v for v in left if v not in out], [v for v in right if v not in out], 1
    while len(out) < quota and (left or right):
        side = left if left and (last == 1 or not right) else right
        last = int(side is right)
        out.append(side.pop(0))


def plain_roles(cands, u, target, warm, mid_gap, far_gap, mid_share, far_share):
    cands = sorted(cands)
    if len(cands) <= target:
        return [v for _, v, _ in cands]
    warm = min(warm, target)
    out, remain = [v for _, v, _ in cands[:warm]], target - warm
    roles = {"local": [], "mid": [], "far": []}
    for d, v, s in cands[warm:]:
        g = abs(u - v)
        roles["far" if g >= far_gap else "mid" if g >= mid_gap else "local"].append((d, v, s, g))
    keys = {"local": lambda c: (c[0], c[1]), "mid": lambda c: (-c[2], c[0], -c[3], c[1]), "far": lambda c: (-c[2], -c[3], c[0], c[1])}
    sides = {r: [[c[1] for c in sorted(x, key=keys[r]) if (c[1] > u) == right] for right in (False, True)] for r, x in roles.items()}
    half_up = lambda x: int(x + 0.5)
    far, mid = min(len(roles["far"]), half_up(remain * far_share)), min(len(roles["mid"]), half_up(remain * mid_share))
    take(*sides["local"], len(out) + remain - mid - far, out)
    take(*sides["mid"], len(out) + mid, out)
    take(*sides["far"], len(out) + far, out)
    for r in ("local", "mid", "far"):
        take(*sides[r], target, out)
    return out


def candidates(spark, seed):
    rng, rows = np.random.default_rng(seed), []
    for u in (0, 40, 77, 199, 300):
        for v in rng.choice(400, int(rng.integers(3, 60)), replace=False).tolist():
            if v != u:
                rows.append((u, v, float(rng.integers(0, 30)), int(rng.integers(0, 4))))
    return spark.createDataFrame(rows, "src long, dst long, d2 double, support long").repartition(3), rows


def lists(df):
    out = {}
    for r in df.orderBy("src", "rank").collect():
        assert r["rank"] == len(out.setdefault(r["src"], []))
        out[r["src"]].append(r["dst"])
    return out


def test_role_quotas(spark):
    for seed, args in ((1, (20, 4, 40, 120, 0.22, 0.08)), (2, (12, 8, 15, 60, 0.5, 0.4)), (3, (25, 0, 200, 300, 0.22, 0.08))):
        df, rows = candidates(spark, seed)
        got = lists(quotas.select_roles(df, *args))
        for u in got:
            assert got[u] == plain_roles([(d, v, s) for a, v, d, s in rows if a == u], u, *args)


def test_reserves(spark):
    df, rows = candidates(spark, 4)
    chosen = quotas.select_roles(df, 6)
    first = lists(chosen)
    got = lists(quotas.append_support(chosen, df, 5, 30))
    tail = lists(quotas.tail_reserve(chosen, df.withColumn("core", F.col("support") > 1), 7))
    for u, mine in first.items():
        rest = [(v, d, s, abs(u - v)) for a, v, d, s in rows if a == u and v not in mine]
        want, order = list(mine), lambda c: (-c[2], -c[3], c[1], c[0])
        take(*[[c[0] for c in sorted(rest, key=order) if c[3] >= 30 and (c[0] > u) == right] for right in (False, True)], len(mine) + 5, want)
        assert got[u] == want
        bins = {}
        for v, d, s, g in sorted(rest, key=lambda c: (c[2] <= 1, c[1], c[0])):
            bins.setdefault((-(g.bit_length() - 1), v > u), []).append(v)
        want = list(mine)
        while len(want) < len(mine) + 7 and any(bins.values()):
            for key in sorted(bins):
                if bins[key] and len(want) < len(mine) + 7:
                    want.append(bins[key].pop(0))
        assert tail[u] == want


def test_edge_scores_and_order(spark):
    schema = "query_id long, current_node long, neighbor_node long, was_inserted boolean, entered_topk boolean, improved_best boolean, in_final_beam boolean, in_final_topk boolean"
    events = spark.createDataFrame([(1, None, 5, True, True, True, True, True), (1, 5, 6, True, True, True, True, True), (2, 5, 6, True, False, False, False, False), (2, 5, 7, False, False, False, False, False), (2, 6, 5, True, True, False, True, False)], schema)
    scores = trace.edge_scores(events)
    assert {(r["src"], r["dst"]): r["score"] for r in scores.collect()} == {(5, 6): 1 + 4 + 8 + 1 + 4 + 1, (5, 7): 0, (6, 5): 1 + 4 + 1}
    edges = spark.createDataFrame([(5, 0, 9), (5, 1, 7), (5, 2, 8), (5, 3, 6), (6, 0, 1), (6, 1, 5)], "src long, rank long, dst long")
    assert lists(trace.reorder_by_score(edges, scores, 1)) == {5: [9, 6, 7, 8], 6: [1, 5]}
    assert lists(trace.reorder_by_score(edges, scores, 0, 2)) == {5: [6, 9], 6: [5, 1]}
    assert tuple(trace.coverage(edges, events, scores, 10).first()) == (6, 0.2, 0.2, 2 / 6)


def test_runs_fail_alone(spark):
    rows = [("a", "q", "10", "5", "8", ""), ("b", "q", None, "5", "8", ""), ("c", "q", "10", "x", "8", ""), ("d", "q", "10", "5", "0", ""), ("e", "", "10", "5", "8", ""), ("f", "short", "10", "5", "8", ""), ("g", "q", "10", "50", "8", "t"), ("h", "q", "4", "50", "8", "t"), ("i", "none", "4", "5", "8", None), ("j", "q", "99999999999999999999", "5", "8", None)]
    runs = spark.createDataFrame(rows, "run_id string, qrange_file string, topk string, beam_size string, trunc_size string, groundtruth_file string")
    lengths = spark.createDataFrame([("q", 200), ("short", 199), ("t", 500)], "file string, length long")
    got = {r["run_id"]: (r["beam_size"], r["status"], r["reason"]) for r in src.check_runs(runs, lengths, 100).collect()}
    assert got["a"] == (10, "ok", None) and got["h"] == (50, "ok", None)
    assert {k: v[2] for k, v in got.items() if v[1] == "failed"} == {"b": "no topk", "c": "bad beam_size", "d": "bad trunc_size", "e": "no qrange_file", "f": "too few ranges", "g": "too few ids", "i": "too few ranges", "j": "bad topk"}
