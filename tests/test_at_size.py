"""What only larger tables show."""

import glob
import os
import tempfile
import time

import numpy as np
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.functions import kernels as K
from bandwalk.operators import exact, graph, ranges, search, trace


def test_tags_of_large_shares(spark):
    shares = {1.001: "sel100p1pct", 1.0: "sel100pct", 12.345: "sel1234p5pct", 0.0005: "sel0p05pct"}
    df = spark.createDataFrame([(t,) for t in shares], "t double")
    assert {r["t"]: r["s"] for r in df.select("t", K.selectivity_tag(F.col("t"), 3).alias("s")).collect()} == shares
    shares = {1.045: "sel104pct", 1.065: "sel106pct", 12.345: "sel1p23e+03pct", 0.25: "sel25pct", None: None}
    df = spark.createDataFrame([(t,) for t in shares], "t double")
    assert {r["t"]: r["s"] for r in df.select("t", K.selectivity_tag(F.col("t")).alias("s")).collect()} == shares


def test_nearest_against_plain_on_odd_rows():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(150, 7)), rng.normal(size=(5000, 7))
    y[100:160] = y[7]  # copies: ties by id
    y[200], y[201, 3], x[4, 0] = 1e30, np.nan, np.inf
    x[5], x[6] = y[7], 1e-20
    ids = rng.permutation(5000)
    fits = rng.random((150, 5000)) < 0.5
    fits[9] = False
    with np.errstate(all="ignore"):
        d = exact.distances(x, y)
    for k, allowed in ((1, None), (16, lambda r: fits[r]), (6000, None)):
        rows, cols, d2 = exact.nearest(x, y, ids, k, allowed)
        for i in range(150):
            able = [j for j in range(5000) if np.isfinite(d[i, j]) and (allowed is None or fits[i, j])]
            want = sorted(able, key=lambda j: (d[i, j], ids[j]))[:k]
            assert cols[rows == i].tolist() == want and d2[rows == i].tolist() == d[i, want].tolist()


def test_knn_is_made_once(spark):
    v = spark.range(300).select(F.col("id").alias("pos"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    knn = exact.knn_graph(v, 3)
    assert "InArrow" not in knn._jdf.queryExecution().toString() and knn.count() == 900


def test_meetings_are_a_row_a_query_and_a_task_each(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact, "BLOCK", 50)
    monkeypatch.setattr(exact, "MERGED", 16, raising=False)
    at = [[float(i // 2 % 17), float(i % 5)] for i in range(300)]  # copies and ties
    at[7], at[8] = [float("nan"), 0.0], [1e30, 1.0]
    base = pa.table({"id": list(range(300)), "embedding": pa.array(at, pa.list_(pa.float64()))})
    met = exact._block(4, [], True)(base, pa.table({"query_id": [0, 7, 34], "qv": pa.array([at[0], at[7], at[34]], pa.list_(pa.float64()))}))
    able = [j for j in range(300) if j != 7]
    nearest = lambda i: sorted((j for j in able if j != i), key=lambda j: ((at[i][0] - at[j][0]) ** 2 + (at[i][1] - at[j][1]) ** 2, j))[:4]
    assert met.column("query_id").to_pylist() == [0, 34] and met.column("id").to_pylist() == [nearest(0), nearest(34)]  # 7 has no distances
    v = spark.createDataFrame(list(enumerate(at)), "pos long, embedding array<double>")
    got = exact.topk(v, v.selectExpr("pos AS query_id", "embedding AS qv"), 4, exclude_self=True, key="pos")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Window" not in plan
    rows = sorted((r["query_id"], r["rk"], r["id"]) for r in got.collect())
    assert rows == [(i, k + 1, j) for i in able for k, j in enumerate(nearest(i))]


def test_shared_ranges_and_dominators(spark):
    rng = np.random.default_rng(4)
    v = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 4, 3)]) for i in range(90)], "pos long, embedding array<float>").cache()
    at = {r["pos"]: np.asarray(r["embedding"], float) for r in v.collect()}
    d = lambda a, b: float(((at[a] - at[b]) ** 2).sum())
    edges = [(a, b, d(a, b)) for a in range(90) for b in range(90) if a != b and (a * 31 + b * 17) % 7 < 1 + a % 3]
    knn = spark.createDataFrame(edges, "src long, dst long, d2 double")
    want = {(a, b, c) for a, b, x in edges for e, c, y in edges if e == a and c != b and y < x and d(c, b) < x}
    got = graph.dominators(knn, v)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]  # pairs of siblings are not joined
    spans = spark.createDataFrame([(q, q % 3 * 10, 60 + q % 3) for q in range(12)], "query_id long, first_pos long, end_pos long")
    plan = ranges.inside(v.select("pos"), spans)
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["query_id"], r["pos"]) for r in plan.collect()) == [(q, p) for q in range(12) for p in range(q % 3 * 10, 60 + q % 3)]


def test_oracle_seeds_by_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 13), float(i % 7)]) for i in range(200)], "pos long, embedding array<float>")
    q = spark.createDataFrame([(0, [3.0, 3.0], 0, 0, 20, 150), (1, [0.0, 0.0], 0, 0, 150, 152)], "query_id long, qv array<float>, ql long, qr long, first_pos long, end_pos long")
    got = search.seeds("oracle_query_seed", q, v, None)
    near = sorted(range(20, 150), key=lambda i: ((i % 13 - 3) ** 2 + (i % 7 - 3) ** 2, i))[:4]
    assert {(r["query_id"], r["seed"]) for r in got.collect()} == {(0, i) for i in near} | {(1, 150), (1, 151)}
    assert "sequence(first_pos" not in got._jdf.queryExecution().toString()


def test_a_round_of_groups_of_queries():
    """A round over Arrow tables: neighbours inside the range with distances, then choice and ranking for a group of queries."""
    import pyarrow as pa

    near = [[(2, True), (5, False)], [], [(0, False), (4, False), (9, True)]]
    flat = [float(d) for e in near for d, _ in e for _ in range(3)]
    links = pa.table({"src": [7, 8, 3], "near": [[{"dst": d, "mutual": m} for d, m in e] for e in near], "y": pa.array([flat[:6], [], flat[6:]], pa.list_(pa.float32()))})
    fronts = pa.table({"g": pa.array([0, 0], pa.int32()), "query_id": [11, 10], "qv": pa.array([[1.0] * 3, [4.0] * 3], pa.list_(pa.float32())), "lo": [0, 1], "hi": [9, 10], "skip": [-1, 4], "srcs": [[7, 3, 6], [3, 8]]})
    found = search._expand(fronts, links)
    assert found.select(["query_id", "src", "rank", "dst", "mutual", "d2"]).to_pylist() == [
        {"query_id": 11, "src": [7, 7, 3, 3], "rank": [0, 1, 0, 1], "dst": [2, 5, 0, 4], "mutual": [True, False, False, False], "d2": [3.0, 48.0, 3.0, 27.0]},
        {"query_id": 10, "src": [3], "rank": [2], "dst": [9], "mutual": [True], "d2": [75.0]},
    ]
    assert search._expand(fronts.slice(0, 0), links).num_rows == 0 and search._expand(fronts, links.slice(0, 0)).column("src").to_pylist() == [[], []]
    longs, flags = pa.list_(pa.int64()), pa.list_(pa.bool_())
    scalars = {c: pa.array(x, pa.int64()) for c, x in {"beam": [2, 2], "trunc": [1, 9], "budget": [0, 0], "stall": [3, 0], "spent": [3, 1]}.items()}
    state = pa.table({"query_id": [11, 10], **{c: fronts.column(c) for c in ("g", "qv", "lo", "hi", "skip")}, **scalars, "best": pa.array([2.5, 80.0]), "seen": pa.array([[7, 3, 0], [3]], longs), "pos": pa.array([[7, 3, 1], [3]], longs), "d2": pa.array([[2.5, 3.0, 50.0], [80.0]]), "open": pa.array([[True, True, False], [True]], flags), "next": pa.array([[True, True, False], [True]], flags)})
    rows = {r["query_id"]: r for r in search._advance(search.Options(k=1, width=1))(state, found).to_pylist()}
    a, b = rows[11], rows[10]
    assert (a["pos"], a["src"], a["selected"], a["raw"]) == ([7, 2, 3, 4], [None, 7, None, 3], [None, 0, None, 0], [None, 2, None, 1])
    assert (a["open"], a["next"], a["stall"], a["spent"], a["active"], sorted(a["seen"])) == ([False, True, False, False], [False, True, False, False], 5, 5, True, [0, 2, 3, 4, 7])
    assert (b["pos"], b["new"], b["expanded"], b["stall"], b["best"], b["spent"], b["active"]) == ([9, 3], [True, False], [False, True], 0, 75.0, 2, True)


def test_lots_of_targets_earn_what_all_together_do(spark, monkeypatch):
    """Searches for edge scores run in lots whose rounds and events are gone before the next; tables leave no shuffle files."""
    rng = np.random.default_rng(6)
    v = spark.createDataFrame([(i, i, [float(x) for x in rng.normal(size=4)]) for i in range(60)], "pos long, vec_id long, embedding array<float>").cache()
    edges = exact.knn_graph(v, 6)
    index, o = search.Index(v, edges), search.Options(k=2, beam=4, trunc=6, width=8)
    want = trace.edge_scores(trace.teach(index, v, [3, 50], o)).collect()  # the form of before
    monkeypatch.setattr(trace, "LOT", 25)
    monkeypatch.setattr(trace, "TABLES", 2)
    asked, plain = [], search.search
    monkeypatch.setattr(search, "search", lambda index, q, *a, **k: asked.append(q.count()) or plain(index, q, *a, **k))
    shared = tables.shared_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    there, files = set(os.listdir(shared)), lambda: {f for at in glob.glob(f"{tempfile.gettempdir()}/blockmgr-*") for _, _, names in os.walk(at) for f in names if f.startswith("shuffle_")}
    got = trace.learned(index, v, [3, 50], o)
    assert len(asked) == 3 and sum(asked) == 60 and max(asked) <= 25
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and sum(r["score"] for r in want)
    assert {n.split("-")[0] for n in set(os.listdir(shared)) - there} == {"scores"}
    made = files()
    tables.put(v.groupBy("vec_id").count(), tables.shared_path(spark, "counted"))
    deadline = time.time() + 20
    while files() - made and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - made


def test_ranges_open_lists_of_queries_last(spark, monkeypatch):
    """Queries of one range meet blocks of rows as lists, opened after all exchanges and written one after the other."""
    monkeypatch.setattr(ranges, "SPAN", 16, raising=False)
    monkeypatch.setattr(ranges, "LOT", 8, raising=False)
    monkeypatch.setattr(ranges, "ASKED", 5, raising=False)
    rows = spark.createDataFrame([(i, i * 7 % 90, i % 5) for i in range(120)] + [(i, 33, 9) for i in range(40)], "src long, dst long, rank long")  # 33 is hot
    spans = spark.createDataFrame([(q, q % 3 * 10, 61 + q % 3, q % 2) for q in range(50)] + [(50, 33, 34, 0)], "query_id long, first_pos long, end_pos long, odd int")
    got = ranges.inside(rows, spans, "dst")
    want = sorted((r["src"], r["dst"], r["rank"], s["query_id"]) for r in rows.collect() for s in spans.collect() if s["first_pos"] <= r["dst"] < s["end_pos"])
    assert sorted(tuple(r) for r in got.select("src", "dst", "rank", "query_id").collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(ids_" in plan.split("Exchange")[0]
    gated = ranges.inside(rows, spans, "dst", ("odd",), (F.col("rank") > 2) | (F.col("odd") == 1))
    assert sorted(tuple(r) for r in gated.select("src", "dst", "rank", "query_id").collect()) == [w for w in want if w[2] > 2 or (w[3] < 50 and w[3] % 2)]
    assert ranges.inside(rows, spans.limit(0), "dst").count() == 0 and ranges.inside(rows.limit(0), spans, "dst").count() == 0


def test_survival_is_gated_before_lists_open(spark):
    v = spark.createDataFrame([(i, i, i // 10) for i in range(40)], "pos long, vec_id long, label long")
    kept = spark.createDataFrame([(i, i % 6, i * 3 % 40, i % 4 if i % 3 else None, 2 if i % 5 else None) for i in range(40)], "src long, rank long, dst long, l_drop long, r_drop long")
    q = spark.createDataFrame([(i, i % 3, i % 3 + 1) for i in range(9)], "query_id long, ql long, qr long")
    got = graph.survival_gate(kept, v, q, 2)
    gone = lambda e, a: (e["l_drop"] is not None and a["ql"] <= e["l_drop"]) or (e["r_drop"] is not None and a["qr"] >= e["r_drop"])
    want = sorted((a["query_id"], e["src"], e["dst"]) for a in q.collect() for e in kept.collect() if a["ql"] <= e["dst"] // 10 <= a["qr"] and (e["rank"] < 2 or not gone(e, a)))
    assert sorted(map(tuple, got.collect())) == want
    assert "Generate explode(ids_" in got._jdf.queryExecution().executedPlan().toString().split("Join")[0]  # no join after queries are opened


def test_dominators_come_along_with_edges(spark):
    from bandwalk import catalog

    rng = np.random.default_rng(8)
    v = spark.createDataFrame([(i, [float(x) for x in rng.integers(0, 5, 3)]) for i in range(80)], "pos long, embedding array<float>").cache()
    knn = exact.knn_graph(v, 7).cache()
    spans = spark.createDataFrame([(q, q % 4 * 11, 40 + q % 4 * 9) for q in range(14)], "query_id long, first_pos long, end_pos long")
    by = {}
    for r in graph.dominators(knn, v).collect():
        by.setdefault((r["src"], r["dst"]), []).append(r["by"])
    want = sorted((s["query_id"], e["src"], e["dst"]) for s in spans.collect() for e in knn.collect() if s["first_pos"] <= e["dst"] < s["end_pos"] and (e["rank"] < 3 or not any(s["first_pos"] <= b < s["end_pos"] for b in by.get((e["src"], e["dst"]), []))))
    got = catalog._local_and_unruled(knn, v, spans)
    assert sorted(map(tuple, got.collect())) == want
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString().split("Join")[0]  # nothing is made distinct for each range
