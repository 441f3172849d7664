import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandwalk.functions import kernels as K
from bandwalk.operators import exact, folds, graph
from bandwalk.sources import vectors as src
from bandwalk.streaming.query_stream import answer_stream


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], int(i * 7 % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")
    return exact.label_order(df).withColumn("x", F.col("label")).withColumn("y", F.col("vec_id") * 13 % 31).cache()


@pytest.fixture(scope="module")
def knn(table):
    return exact.knn_graph(table, 12).cache()


def ordered(table):
    return {r["pos"]: np.asarray(r["embedding"], np.float64) for r in table.collect()}


def dist(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += (x - y) * (x - y)
    return out


def test_label_order(table):
    rows = sorted((r["label"], r["vec_id"], r["pos"]) for r in table.collect())
    assert [r[2] for r in rows] == list(range(len(rows)))


def test_topk_edge_cases(spark, table):
    q = [(1, -1, -1), (2, 3, 3), (3, 0, 4), (4, 90, 95)]
    e = table.where("vec_id = 7").first()["embedding"]
    queries = spark.createDataFrame([(a, e, b, c) for a, b, c in q], "query_id long, qv array<float>, ql long, qr long")
    got = exact.topk(table, queries, 50, [("label", "ql", "qr")]).collect()
    assert {r["query_id"] for r in got} == {2, 3}
    assert sum(r["query_id"] == 2 for r in got) == 24 and sum(r["query_id"] == 3 for r in got) == 50
    assert [r["id"] for r in got if r["query_id"] == 3 and r["rk"] == 1] == [7]


def test_prune_against_plain(table, knn):
    x = ordered(table)
    got = {}
    for r in folds.prune(knn.select("src", "dst"), table, 99, by_side=False).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    cand = {}
    for r in knn.collect():
        cand.setdefault(r["src"], []).append((r["d2"], r["dst"]))
    for u, c in cand.items():
        kept = []
        for d, v in sorted(c):
            if not any(d > dk and d > dist(x[v], x[k]) for dk, k in kept):
                kept.append((d, v))
        assert [v for _, v in sorted(got[u])] == [v for _, v in kept]


def test_prefix_policies_are_permutations():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 40, 90):
        gaps = [int(g) for g in rng.integers(-400, 400, n)]
        for p in folds.POLICIES:
            for ratio in (0.2, 0.5, 1.0):
                assert sorted(folds.prefix_order(gaps, p, ratio=ratio)) == list(range(n)), (p, n)
    assert folds.prefix_order([1, 2, 3], "unknown") == [0, 1, 2]
    # worked by hand
    assert folds.prefix_order([5, 6, -7], "balance", warm=0) == [0, 2, 1]
    assert folds.prefix_order([-1, 2, -3, -4, -5, -6, -7, -8, 9], "balance", warm=0) == [0, 1, 2, 3, 8, 4, 5, 6, 7]
    assert folds.prefix_order([9, -2, 3, -8], "labelg", warm=0) == [1, 2, 3, 0]
    assert folds.prefix_order([1, 2, 90, 3, 80, 4], "mix", ratio=0.5, warm=1, min_gap=50) == [0, 2, 1, 4, 3, 5]
    assert folds.prefix_order([1, 2, 90, 3, 80, 4], "mix", warm=1, min_gap=50) == [0, 1, 2, 3, 4, 5]
    assert folds.prefix_order([1, 2, 3, 90, 80, 4, 5, 6], "bridgefirst", warm=0, min_gap=50) == [3, 4, 0, 1, 2, 5, 6, 7]
    assert folds.prefix_order([1, 2, 60, 55, 500, 3], "switchband", warm=0, min_gap=50) == [3, 2, 0, 1, 4, 5]
    assert folds.prefix_order([90, 1, 2, 3, 4, 5, 6, 7, 8, 9], "thinbridge", warm=0, min_gap=50) == [1, 2, 3, 4, 5, 6, 7, 8, 0, 9]


def test_window_cap_is_shared(table):
    got = {}
    for r in graph.band_capped(table, 6, 5).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    assert got[0] == {1, 2, 3, 4, 6} and got[1] == {0, 2, 3, 5, 7} and got[60] == {54, 56, 59, 61, 66}


def test_side_prune_gives_the_right_side_what_the_left_leaves(table):
    wide = graph.band(table, 8).where("src = 0 or src = 60")
    kept = folds.prune(wide, table, 4).collect()
    x = ordered(table)
    for src in (0, 60):
        mine = sorted(r["dst"] for r in kept if r["src"] == src)
        sides = []
        for side in ([v for v in range(src - 1, src - 9, -1) if v >= 0], range(src + 1, src + 9)):
            got = []
            for v in side:
                if not any(dist(x[v], x[src]) > dist(x[k], x[src]) and dist(x[v], x[src]) > dist(x[v], x[k]) for k in got):
                    got.append(v)
            sides.append(got)
        left = sides[0][:2]
        assert mine == sorted(left + sides[1][: 4 - len(left)])


def test_lanes_change_sides_within_the_tolerance():
    # ranks 0 to 2 on the left: the right side's 10 is more than 4 behind each
    assert folds._alternate(folds.Lanes([0, 1, 2], [10, 11], 4)) == [0, 1, 2, 10, 11]
    assert folds._alternate(folds.Lanes([0, 1, 2], [3, 4], 4)) == [0, 3, 1, 4, 2]
    assert folds._alternate(folds.Lanes([0, 3], [1, 2], -1)) == [0, 1, 2, 3]


def test_conflict_gate_replay(table, knn):
    e = folds.conflicts(knn, table)
    rows, got = {}, {}
    for r in e.collect():
        rows.setdefault(r["src"], []).append((r["rank"], r["dst"], set(r["conflicts"])))
    for lo, hi in ((0, 200), (20, 60), (50, 51)):
        got = {}
        for r in folds.conflict_gate(e, lo, hi).collect():
            got.setdefault(r["src"], []).append(r["rank"])
        for u, es in rows.items():
            kept = []
            for rank, dst, con in sorted(es, key=lambda t: t[0]):
                if lo <= dst <= hi and not con & set(kept):
                    kept.append(rank)
            assert sorted(got.get(u, [])) == kept


def test_band_is_an_equi_join(table):
    plan = graph.band(table, 3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    f = tmp_path / "a.fvecs"
    f.write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in x))
    assert [r["embedding"] for r in src.read_vectors(spark, str(f)).orderBy("vec_id").collect()] == x.tolist()
    src.write_fvecs(src.read_vectors(spark, str(f)), str(tmp_path / "b.fvecs"))
    assert (tmp_path / "b.fvecs").read_bytes() == f.read_bytes()
    (tmp_path / "a.i8bin").write_bytes(np.array([2, 3], "<i4").tobytes() + np.array([-1, 2, 3, 4, 5, -128], "i1").tobytes())
    assert src.read_vectors(spark, str(tmp_path / "a.i8bin"), True).orderBy("vec_id").first()["embedding"] == [-1, 2, 3]
    (tmp_path / "a.u8bin").write_bytes(np.array([1, 2], "<u4").tobytes() + bytes([255, 0]))
    assert src.read_vectors(spark, str(tmp_path / "a.u8bin")).first()["embedding"] == [255.0, 0.0]
    (tmp_path / "bad.fvecs").write_bytes(f.read_bytes()[:-1])
    with pytest.raises(Exception, match="whole records"):
        src.read_vectors(spark, str(tmp_path / "bad.fvecs")).collect()
    with pytest.raises(ValueError):
        src.read_vectors(spark, "x.txt")
    many = tmp_path / "many.fvecs"  # a folder: ids run on
    many.mkdir()
    wide = np.arange(1000, dtype="<f4").reshape(250, 4)
    for name, rows in (("b.fvecs", wide[100:]), ("a.fvecs", wide[:100]), ("note.txt", wide[:0])):
        (many / name).write_bytes(b"".join(np.int32(4).tobytes() + r.tobytes() for r in rows))
    split = src.read_vectors(spark, str(many), block_bytes=20 * 30)
    assert split.rdd.getNumPartitions() == 9
    assert [(r["vec_id"], r["embedding"]) for r in split.orderBy("vec_id").collect()] == list(enumerate(wide.tolist()))
    (tmp_path / "none.fvecs").write_bytes(b"")
    assert src.read_vectors(spark, str(tmp_path / "none.fvecs")).count() == 0
    mixed = x.tobytes()[:16], x.tobytes()[16:32]
    (tmp_path / "mixed.fvecs").write_bytes(np.int32(4).tobytes() + mixed[0] + np.int32(3).tobytes() + mixed[1])
    with pytest.raises(Exception, match="dimensions differ"):
        src.read_vectors(spark, str(tmp_path / "mixed.fvecs")).collect()
    assert src.check_fvecs(split).first() == (4, 250)
    assert src.beam_grid("24:8, 32:12") == [(24, 8), (32, 12)]


def test_json_lists(spark, tmp_path):
    put = lambda name, v: (tmp_path / name).write_text(json.dumps(v)) and str(tmp_path / name)
    assert [tuple(r) for r in src.read_ranges(spark, put("r.json", [1, 4, 2, 2])).orderBy("query_id").collect()] == [(0, 1, 4), (1, 2, 2)]
    for v in ([[1, 2], [3, 4]], [1, 2, 3, 4]):
        assert [tuple(r) for r in src.read_points(spark, put("p.json", v)).orderBy("pos").collect()] == [(0, 1, 2), (1, 3, 4)]
    assert tuple(src.read_boxes(spark, put("b.json", [[9, 2, 3, 4]])).first()) == (0, 2, 9, 3, 4)
    assert src.read_points(spark, put("e.json", [])).count() == 0
    with pytest.raises(Exception, match="no multiple of 2"):
        src.read_points(spark, put("o.json", [1, 2, 3])).collect()
    with pytest.raises(Exception, match="no multiple of 2"):
        src.read_ranges(spark, put("o.json", [1, 2, 3])).collect()
    with pytest.raises(Exception, match="no multiple of 4"):
        src.read_boxes(spark, put("o.json", [1, 2, 3, 4, 5])).collect()
    with pytest.raises(ValueError):
        src.read_uints(spark, put("n.json", [1, -2]))


def test_even_rows_and_sets(spark):
    front = spark.createDataFrame([("s", i, float(i), float(9 - i)) for i in range(8)], "selectivity_label string, run_id long, recall double, qps double")
    for most in (0, 1, 2, 3, 4, 7, 8, 20):
        last = 7
        want = list(range(8)) if most in (0, 8, 20) else [last] if most == 1 else sorted({round(i * last / (most - 1)) for i in range(most)})
        assert sorted(r.run_id for r in graph.even_rows(front, most).collect()) == want
    a = spark.createDataFrame([(1, 5), (1, 5), (1, 6), (2, 7)], "query_id long, id long")
    b = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 1)], "query_id long, id long")
    assert sorted(tuple(r) for r in graph.set_equality(a, b).collect()) == [(1, 1, 0, False), (2, 0, 0, True), (3, 0, 1, False)]
    runs = spark.createDataFrame([(1, "OK"), (2, None), (3, "error"), (4, "Completed"), (5, "")], "run_id long, status string")
    assert sorted(r.run_id for r in graph.completed(runs).collect()) == [1, 2, 4, 5]


def test_build_profile(spark, table, knn):
    edges, profile = folds.build_profile(table, knn, step=6, cap=20)
    row = profile.first()
    window, candidates = graph.band(table, 6), graph.band(table, 6).unionByName(knn.select("src", "dst")).distinct()
    first = folds.build(table, knn, step=6, cap=20, refine=False)
    pairs = first.select("src", "dst")
    assert (row["nodes"], row["knn"], row["window"], row["bridge"]) == (120, knn.count(), window.count(), 0)
    assert (row["candidates"], row["first_edges"], row["merged"]) == (candidates.count(), first.count(), pairs.unionByName(graph.transpose(pairs)).distinct().count())
    whole = folds.build(table, knn, step=6, cap=20)
    assert row["edges"] == whole.count() == edges.count() and row["edges_per_node"] == row["edges"] / 120
    assert {tuple(r) for r in edges.collect()} == {tuple(r) for r in whole.collect()}


def test_labels_and_shares(spark):
    tags = {"sel10pct": 0.1, "q2_sel10pct": 0.1, "SEL0p5 pct": 0.005, "x1_2_3pct": 0.023, "sel_25": 0.25, "selectivity-0.5": 0.5, "sel_0_5": 0.5, "run7": None, "": None, "12": None}
    got = spark.createDataFrame([(t,) for t in tags], "t string").select("t", K.selectivity_of(F.col("t")).alias("s")).collect()
    assert {r["t"]: None if r["s"] is None else round(r["s"], 12) for r in got} == tags
    labels = {" a b/c ": "a_b_c", "__x__": "x", "?!": "range", " ": None, "s-1.5_z": "s-1.5_z"}
    got = spark.createDataFrame([(t,) for t in labels], "t string").select("t", K.clean_label(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == labels
    shares = {0.1: "sel10pct", 0.005: "sel0p5pct", 0.12345: "sel12p3pct", 0.00012346: "sel0p0123pct", 1.0: "sel100pct"}
    got = spark.createDataFrame([(t,) for t in shares], "t double").select("t", K.selectivity_tag(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in got} == shares


def test_query_stream(spark, table, tmp_path):
    q = table.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    answer_stream(stream, lambda b: exact.topk(table, b, 2), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
