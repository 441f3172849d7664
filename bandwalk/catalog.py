"""Every query by name, and the SQL that gives the same rows.

Names start with the identifier of the operator in the inventory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandwalk.functions import kernels as K
from bandwalk.operators import approximate, boxes, exact, folds, graph, quotas, ranges, search, trace
from bandwalk.plans import fixtures as fx
from bandwalk.plans.duck import d2, sql
from bandwalk.sources.vectors import check_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, parts: str | None = None, body: str | None = None):
    """Register ``f(v)``, a function of the vectors table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(fx.vectors(spark, sf_dir))
        if body is not None:
            ORACLE[name] = sql(parts or "", body)
        return f

    return add


def _pairs(v: DataFrame) -> DataFrame:
    """Each vector with the next one in label order."""
    return v.select("pos", F.col("embedding").alias("a")).join(v.select((F.col("pos") - 1).alias("pos"), F.col("embedding").alias("b")), "pos")


PAIR = "FROM v a JOIN v b ON b.pos = a.pos + 1"
MUL = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
DOT = lambda a, b: MUL.format(a=a, b=b)

# exact search
query("range_topk", "v q", f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rk, vec_id AS id, d2 FROM (SELECT query_id, vec_id, {d2('embedding', 'qv')} AS d2 FROM q JOIN v ON label BETWEEN ql AND qr) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) <= 10")(
    lambda v: exact.topk(v, fx.queries(v), 10, [("label", "ql", "qr")])
)
query("t2_topk", "v q", f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rk, vec_id AS id, d2 FROM (SELECT query_id, vec_id, {d2('embedding', 'qv')} AS d2 FROM q, v) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) <= 10")(
    lambda v: exact.topk(v, fx.queries(v), 10)
)
query("t3_box_topk", "v q", f"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rk, vec_id AS id, d2 FROM (SELECT query_id, vec_id, {d2('embedding', 'qv')} AS d2 FROM q JOIN v ON x BETWEEN ql AND qr AND y BETWEEN ly AND ry) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) <= 10")(
    lambda v: exact.topk(v, fx.queries(v), 10, [("x", "ql", "qr"), ("y", "ly", "ry")])
)
query("j1_range_join", "v q", "SELECT query_id, vec_id FROM q JOIN v ON label BETWEEN ql AND qr")(lambda v: ranges.inside(v.select("pos", "vec_id"), ranges.label_interval(v, fx.queries(v))).select("query_id", "vec_id"))
query("j3_knn", "knn", "SELECT src, rank, dst, d2 FROM knn")(fx.knn)
query("w1_label_order", "v", "SELECT vec_id, label, pos FROM v")(lambda v: v.select("vec_id", "label", "pos"))
query("f1_label_range", "v", "SELECT vec_id, label FROM v WHERE label BETWEEN 2 AND 5")(lambda v: v.where(F.col("label").between(2, 5)).select("vec_id", "label"))
query("f2_label_interval", "iv", "SELECT query_id, first_pos, end_pos FROM iv")(lambda v: ranges.label_interval(v, fx.queries(v)))
query("f8_box", "v q", "SELECT query_id, vec_id FROM q JOIN v ON x BETWEEN ql AND qr AND y BETWEEN ly AND ry")(
    lambda v: ranges.inside(v.select("pos", "vec_id", "y"), ranges.label_interval(v, q := fx.queries(v))).join(q.select("query_id", "ly", "ry"), "query_id").where("y between ly and ry").select("query_id", "vec_id")
)
query("a1_centroid", "v", "SELECT dim - 1 AS dim, round(avg(CAST(embedding[dim] AS DOUBLE)), 9) AS mean FROM v, range(1, 65) t(dim) GROUP BY dim")(lambda v: exact.centroid(v).select(F.col("dim").cast("long").alias("dim"), F.round("mean", 9).alias("mean")))

# kernels
query("p1_squared_l2", "v", f"SELECT a.pos, {d2('a.embedding', 'b.embedding')} AS d2 {PAIR}")(lambda v: _pairs(v).select("pos", K.squared_l2("a", "b").alias("d2")))
query("p3_partial_distance", "v", f"SELECT a.pos, {DOT('a.embedding', 'a.embedding')} - 2 * {DOT('a.embedding', 'b.embedding')} AS d {PAIR}")(lambda v: _pairs(v).select("pos", K.partial_distance("a", "b").alias("d")))
query("p6_dot", "v", f"SELECT a.pos, {DOT('a.embedding', 'b.embedding')} AS dot {PAIR}")(lambda v: _pairs(v).select("pos", K.dot("a", "b").alias("dot")))
INT8 = "list_transform({x}, lambda t: CAST(round(CAST(t AS DOUBLE) * 127) AS TINYINT))"
query("p7_int8_l2", "v", f"SELECT a.pos, {d2(INT8.format(x='a.embedding'), INT8.format(x='b.embedding'))} AS d2 {PAIR}")(lambda v: _pairs(v).select("pos", K.squared_l2(K.quantise("a"), K.quantise("b")).alias("d2")))
query("p8_squared_norm", "v", f"SELECT pos, {DOT('embedding', 'embedding')} AS sq FROM v")(lambda v: v.select("pos", K.squared_norm("embedding").alias("sq")))
query("p9_int8_to_float", "v", f"SELECT pos, list_sum(list_transform({INT8.format(x='embedding')}, lambda t: CAST(t AS DOUBLE))) AS total FROM v")(
    lambda v: v.select("pos", F.aggregate(K.quantise("embedding").cast("array<float>"), F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"))
)
query("p11_label_gap", "e", "SELECT src, dst, abs(src - dst) AS gap FROM e")(lambda v: fx.edges(v).select("src", "dst", F.abs(F.col("src") - F.col("dst")).alias("gap")))
query("p12_label_value_gap", "e v", "SELECT src, dst, abs(a.label - b.label) AS gap FROM e JOIN v a ON a.pos = src JOIN v b ON b.pos = dst")(
    lambda v: fx.edges(v).join(v.select(F.col("pos").alias("src"), F.col("label").alias("la")), "src").join(v.select(F.col("pos").alias("dst"), F.col("label").alias("lb")), "dst").select("src", "dst", F.abs(F.col("la") - F.col("lb")).alias("gap"))
)
query("p14_jump_level", "e", "SELECT src, dst, least(30, CAST(floor(log2(greatest(abs(src - dst), 1))) AS BIGINT)) AS lvl FROM e")(lambda v: fx.edges(v).select("src", "dst", K.jump_level(F.abs(F.col("src") - F.col("dst"))).cast("long").alias("lvl")))
query("p16_grid_coordinate", "v", "SELECT vec_id, least(15, CAST(floor((least(1008, greatest(0, y)) - 0) * 16 / CAST(1009 AS DOUBLE)) AS BIGINT)) AS gy FROM v")(lambda v: v.select("vec_id", K.grid_coordinate(F.col("y"), F.lit(0), F.lit(1008), 16).alias("gy")))
query("p17_box_between", "v", "SELECT a.pos, b.x BETWEEN least(a.x, c.x) AND greatest(a.x, c.x) AND b.y BETWEEN least(a.y, c.y) AND greatest(a.y, c.y) AS inside FROM v a JOIN v b ON b.pos = a.pos + 1 JOIN v c ON c.pos = a.pos + 2")(
    lambda v: v.select("pos", F.col("x").alias("ax"), F.col("y").alias("ay"))
    .join(v.select((F.col("pos") - 1).alias("pos"), F.col("x").alias("bx"), F.col("y").alias("by")), "pos")
    .join(v.select((F.col("pos") - 2).alias("pos"), F.col("x").alias("cx"), F.col("y").alias("cy")), "pos")
    .select("pos", (K.box_between("ax", "bx", "cx") & K.box_between("ay", "by", "cy")).alias("inside"))
)
query("p18_selectivity", "iv v", "SELECT query_id, (end_pos - first_pos) / CAST((SELECT count(*) FROM v) AS DOUBLE) AS share FROM iv")(lambda v: ranges.label_interval(v, fx.queries(v)).select("query_id", ((F.col("end_pos") - F.col("first_pos")) / F.lit(float(v.count()))).alias("share")))
query("p22_selectivity_tag", "v", "SELECT pos, 'sel' || replace(regexp_replace(printf('%.3f', (pos + 1) / 1000.0 * 100), '\\.?0+$', ''), '.', 'p') || 'pct' AS tag FROM v")(lambda v: v.select("pos", K.selectivity_tag((F.col("pos") + 1) / 1000, 3).alias("tag")))

query("p23_small_selectivity_tag", "v", "SELECT pos, 'sel' || replace(CASE WHEN abs(p - round(p)) < 1e-9 THEN CAST(CAST(round(p) AS BIGINT) AS VARCHAR) ELSE printf('%.3g', p) END, '.', 'p') || 'pct' AS tag FROM (SELECT pos, (pos + 1) / 7000.0::DOUBLE * 100 AS p FROM v)")(lambda v: v.select("pos", K.selectivity_tag((F.col("pos") + 1) / F.lit(7000.0)).alias("tag")))
query("p22_inferred_selectivity", "v", "SELECT pos, CASE pos % 3 WHEN 0 THEN round((pos % 40 + (pos % 10) / 10.0::DOUBLE) / 100, 9) WHEN 1 THEN round((pos % 10) / 10.0::DOUBLE, 9) END AS share FROM v")(
    lambda v: v.select("pos", F.round(K.selectivity_of(F.expr("case pos % 3 when 0 then concat('q', pos % 7, '_Sel', pos % 40, 'p', pos % 10, ' pct') when 1 then concat('x', pos, '-selectivity_0.', pos % 10) else concat('run', pos) end")), 9).alias("share"))
)
query("p22_clean_label", "v", "SELECT pos, CASE pos % 3 WHEN 0 THEN 'a_' || pos || '.b-c' WHEN 1 THEN 'range' END AS label FROM v")(
    lambda v: v.select("pos", K.clean_label(F.expr("case pos % 3 when 0 then concat(' a !', pos, '.b-c? ') when 1 then '!?_' else '  ' end")).alias("label"))
)

# joins and candidates
query("j4_band", "v", "SELECT a.pos AS src, b.pos AS dst FROM v a JOIN v b ON a.pos <> b.pos AND abs(a.pos - b.pos) <= 12")(lambda v: graph.band(v, 12))
SPREAD = "SELECT pos AS src, {b} + CASE WHEN {q} = 1 AND {n} > 1 THEN {n} // 2 WHEN {q} >= {n} THEN k ELSE k * ({n} - 1) // ({q} - 1) END AS dst FROM z, range(0, 5) t(k) WHERE k < {q}"
query("g4_band_capped", "v", ", y AS (SELECT pos, least(pos, 12) AS ln, least(12, (SELECT count(*) FROM v) - 1 - pos) AS rn FROM v), x AS (SELECT *, least(rn, 5 - least(ln, 3)) AS r0 FROM y), z AS (SELECT *, least(ln, 5 - r0) AS l, least(rn, 5 - least(ln, 5 - r0)) AS r FROM x) " + SPREAD.format(q="l", n="ln", b="(pos - ln)") + " UNION ALL " + SPREAD.format(q="r", n="rn", b="(pos + 1)"))(lambda v: graph.band_capped(v, 12, 5))
query("j5_box_bands", "v", "SELECT DISTINCT src, dst FROM (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.pos <> b.pos AND abs(a.pos - b.pos) <= 4 UNION ALL SELECT a.vec_id, b.vec_id FROM (SELECT vec_id, row_number() OVER (ORDER BY y, vec_id) AS p FROM v) a JOIN (SELECT vec_id, row_number() OVER (ORDER BY y, vec_id) AS p FROM v) b ON a.p <> b.p AND abs(a.p - b.p) <= 4)")(
    lambda v: _by_id(graph.band(v, 4), v).unionByName(_by_id(graph.band(w := exact.label_order(v.drop("pos"), "y"), 4), w)).distinct()
)


def _by_id(pairs: DataFrame, v: DataFrame) -> DataFrame:
    ids = v.select("pos", "vec_id")
    return pairs.toDF("s", "d").join(ids.toDF("s", "src"), "s").join(ids.toDF("d", "dst"), "d").select("src", "dst")


query("j6_remap", "knn v", "SELECT src, rank, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY rank, dst) - 1 AS rank FROM knn) WHERE rank < 10")(
    lambda v: graph.remap(_named(fx.knn(v), v), v, 10)
)


def _named(knn: DataFrame, v: DataFrame) -> DataFrame:
    ids = v.select("pos", "vec_id")
    return knn.join(ids.toDF("src", "src_id"), "src").join(ids.toDF("dst", "dst_id"), "dst").select("src_id", "rank", "dst_id")


query("j7_transpose", "knn", "SELECT dst AS src, src AS dst FROM knn")(lambda v: graph.transpose(fx.knn(v)))
query("f13_reciprocal", "knn", "SELECT src, rank, dst FROM knn a WHERE EXISTS (SELECT 1 FROM knn b WHERE b.src = a.dst AND b.dst = a.src AND b.rank < 8)")(lambda v: graph.reciprocal(fx.knn(v), 8).select("src", "rank", "dst"))
query("j9_strict_rng", "e", "SELECT src, rank, dst, d2 FROM e")(fx.edges)
query("j10_as_of_header", "q v", "SELECT query_id, max(label) AS label FROM q JOIN v ON label <= qr GROUP BY query_id")(lambda v: graph.as_of_header(v.select("label"), fx.queries(v)))
query("f3_in_range_edges", "e iv", "SELECT query_id, src, rank, dst FROM e JOIN iv ON dst >= first_pos AND dst < end_pos")(lambda v: ranges.inside(fx.edges(v), ranges.label_interval(v, fx.queries(v)), "dst").select("query_id", "src", "rank", "dst"))
TWO = "a AS (SELECT src AS query_id, dst AS id, d2 FROM knn WHERE rank < 10), b AS (SELECT src AS query_id, dst AS id, d2 FROM knn WHERE rank BETWEEN 3 AND 12)"


def _two(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = fx.knn(v).select(F.col("src").alias("query_id"), F.col("dst").alias("id"), "d2", "rank")
    return k.where("rank < 10").drop("rank"), k.where("rank between 3 and 12").drop("rank")


query("a2_recall_by_distance", "knn", f", {TWO} SELECT sum(least(ca, cb)) / CAST(10 * (SELECT count(*) FROM embeddings) AS DOUBLE) AS recall FROM (SELECT query_id, d2, count(*) AS ca FROM a GROUP BY ALL) JOIN (SELECT query_id, d2, count(*) AS cb FROM b GROUP BY ALL) USING (query_id, d2)")(lambda v: exact.recall_by_distance(*_two(v), 10, v.count()))
query("a3_recall_by_id", "knn", f", {TWO} SELECT b.query_id, count(a.id) / CAST(count(*) AS DOUBLE) AS recall FROM b LEFT JOIN a ON a.query_id = b.query_id AND a.id = b.id GROUP BY b.query_id")(lambda v: exact.recall_by_id(*_two(v)))
query("j13_overlap", "knn", f", {TWO} SELECT query_id, count(*) AS both FROM a JOIN b USING (query_id, id) GROUP BY query_id")(lambda v: _two(v)[0].join(_two(v)[1].select("query_id", "id"), ["query_id", "id"]).groupBy("query_id").agg(F.count("*").alias("both")))
query("u1_union", "knn v", "SELECT DISTINCT src, dst FROM (SELECT src, dst FROM knn UNION ALL SELECT a.pos, b.pos FROM v a JOIN v b ON a.pos <> b.pos AND abs(a.pos - b.pos) <= 3)")(lambda v: fx.knn(v).select("src", "dst").unionByName(graph.band(v, 3)).dropDuplicates(["src", "dst"]))
query("u3_difference", "knn", f", {TWO} SELECT query_id, id FROM a EXCEPT ALL SELECT query_id, id FROM b")(lambda v: _two(v)[0].select("query_id", "id").exceptAll(_two(v)[1].select("query_id", "id")))
query("u5_intersection", "knn", f", {TWO} SELECT query_id, id FROM a INTERSECT SELECT query_id, id FROM b")(lambda v: _two(v)[0].select("query_id", "id").intersect(_two(v)[1].select("query_id", "id")))

# headers, chains, sampling
query("w2_smaller_neighbours", "c", "SELECT a.pos, coalesce(max(b.pos) FILTER (b.pos < a.pos), -1) AS prev, coalesce(min(b.pos) FILTER (b.pos > a.pos), -1) AS next FROM s a LEFT JOIN s b ON b.d < a.d GROUP BY a.pos")(lambda v: graph.smaller_neighbours(fx.scored(v)))
query("w4_headers", "c", "SELECT label, row_number() OVER (PARTITION BY label ORDER BY node DESC) - 1 AS ord, node FROM (SELECT h.label, s.pos AS node FROM (SELECT label, max(pos) AS hi FROM v GROUP BY label) h JOIN s ON s.pos <= h.hi WHERE NOT EXISTS (SELECT 1 FROM s j WHERE j.pos > s.pos AND j.pos <= h.hi AND j.d <= s.d)) QUALIFY row_number() OVER (PARTITION BY label ORDER BY node DESC) <= 20")(lambda v: graph.headers(fx.scored(v)))
query("w5_rank_fusion", "e", "SELECT src, dst, 0.7 * dr + (1 - 0.7) * gr AS score FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) - 1 AS dr, row_number() OVER (PARTITION BY src ORDER BY abs(src - dst), dst) - 1 AS gr FROM e)")(lambda v: graph.rank_fusion(fx.edges(v), 0.7).select("src", "dst", F.round("score", 9).alias("score")))
ORACLE["w5_rank_fusion"] = ORACLE["w5_rank_fusion"].replace("0.7 * dr + (1 - 0.7) * gr AS score", "round(CAST(0.7 AS DOUBLE) * dr + CAST(0.3 AS DOUBLE) * gr, 9) AS score")
query("w6_even_sample", "knn", "SELECT src, rank, dst FROM (SELECT *, count(*) OVER (PARTITION BY src) AS n FROM knn) WHERE rank IN (0, (n - 1) // 4, 2 * (n - 1) // 4, 3 * (n - 1) // 4, n - 1)")(lambda v: graph.even_sample(fx.knn(v).withColumn("i", F.col("rank")).withColumn("n", F.count("*").over(Window.partitionBy("src"))), 5, "src").select("src", "rank", "dst"))
SIDES = "SELECT src, dst, d2, CAST(dst > src AS INT) AS side, row_number() OVER (PARTITION BY src, dst > src ORDER BY d2, dst) - 1 AS k FROM knn"
query("w7_alternate_sides", "knn", f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY k * 2 + side) - 1 AS rank, dst FROM ({SIDES})")(lambda v: graph.alternate_sides(fx.knn(v)))
LVL = "least(30, CAST(floor(log2(greatest(abs(src - dst), 1))) AS INT))"
query("w9_round_robin", "knn", f"SELECT src, rank, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k, lvl DESC, side) - 1 AS rank FROM (SELECT src, dst, CAST(dst > src AS INT) AS side, {LVL} AS lvl, row_number() OVER (PARTITION BY src, dst > src, {LVL} ORDER BY d2, dst) AS k FROM knn)) WHERE rank < 8")(lambda v: graph.round_robin(fx.knn(v), 8))
query("w8_rolling_sum", "knn", "SELECT src, rank, sum(dst) OVER (PARTITION BY src ORDER BY rank ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS total FROM knn")(lambda v: fx.knn(v).select("src", "rank", F.sum("dst").over(Window.partitionBy("src").orderBy("rank").rowsBetween(-3, 0)).alias("total")))
query("t6_degree_cap", "knn", "SELECT src, rank, dst FROM knn WHERE rank < 6")(lambda v: fx.knn(v).where("rank < 6").select("src", "rank", "dst"))

# orders, annotations, gates
query("e2_reorder_distance", "knn", "SELECT src, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN rank < 8 THEN rank ELSE 8 END, CASE WHEN rank < 8 THEN 0 ELSE d2 END, rank) - 1 AS rank, dst FROM knn")(lambda v: graph.reorder(fx.knn(v), F.col("d2")))
query("e3_reorder_label_gap", "knn v", "SELECT src, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN rank < 8 THEN rank ELSE 8 END, CASE WHEN rank < 8 THEN 0 ELSE abs(a.label - b.label) END, rank) - 1 AS rank, dst FROM knn JOIN v a ON a.pos = src JOIN v b ON b.pos = dst")(
    lambda v: graph.reorder(fx.knn(v).join(v.select(F.col("pos").alias("src"), F.col("label").alias("la")), "src").join(v.select(F.col("pos").alias("dst"), F.col("label").alias("lb")), "dst"), F.abs(F.col("la") - F.col("lb")).cast("double"))
)
query("e4_reorder_hybrid", "knn", "SELECT src, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN rank < 8 THEN rank ELSE 8 END, CASE WHEN rank < 8 THEN 0 ELSE score END, rank) - 1 AS rank, dst FROM (SELECT *, rank + row_number() OVER (PARTITION BY src ORDER BY abs(src - dst), dst) - 1 AS score FROM knn)")(
    lambda v: graph.reorder(fx.knn(v).withColumn("score", F.col("rank") + F.row_number().over(Window.partitionBy("src").orderBy(F.abs(F.col("src") - F.col("dst")), "dst")) - 1), F.col("score").cast("double"))
)
SURV = "sv AS MATERIALIZED (SELECT k.src, k.rank, k.dst, CASE WHEN deg > 2 THEN l END AS l_drop, CASE WHEN deg > 2 THEN r END AS r_drop FROM knn k JOIN (SELECT src, count(*) AS deg FROM knn GROUP BY src) USING (src) LEFT JOIN (SELECT dom.src, dom.dst, max(y.label) FILTER (y.label < u.label) AS l, min(y.label) FILTER (y.label > u.label) AS r FROM dom JOIN v y ON y.pos = dom.by JOIN v u ON u.pos = dom.src GROUP BY ALL) m ON m.src = k.src AND m.dst = k.dst)"


def _survival(v: DataFrame) -> DataFrame:
    k = fx.knn(v)
    return graph.survival(k, graph.dominators(k, v), v)


query("e8_survival", "dom v", f", {SURV} SELECT src, rank, dst, l_drop, r_drop FROM sv")(_survival)
query("f10_survival_gate", "dom v q", f", {SURV} SELECT query_id, src, dst FROM q JOIN v x ON x.label BETWEEN ql AND qr JOIN sv ON sv.dst = x.pos WHERE rank < 4 OR NOT (coalesce(ql <= l_drop, false) OR coalesce(qr >= r_drop, false))")(lambda v: graph.survival_gate(_survival(v), v, fx.queries(v), 4))
query("e9_conflicts_full", "dom", "SELECT src, dst, count(*) AS n, min(\"by\") AS lowest, max(\"by\") AS highest FROM dom GROUP BY src, dst")(lambda v: graph.dominators(fx.knn(v), v).groupBy("src", "dst").agg(F.count("*").alias("n"), F.min("by").alias("lowest"), F.max("by").alias("highest")))
ROLE = "ro AS MATERIALIZED (SELECT src, rank, dst, CASE WHEN rank < 4 OR EXISTS (SELECT 1 FROM knn b WHERE b.src = a.dst AND b.dst = a.src AND b.rank < 4) THEN 'skeleton' WHEN gap > 0.3 THEN 'bridge' WHEN gap <= 0.1 THEN 'useful' ELSE 'reserve' END AS role, gap AS label_gap FROM (SELECT *, abs(src - dst) / CAST((SELECT count(*) FROM v) AS DOUBLE) AS gap FROM knn) a)"
query("e12_roles", "knn", f", {ROLE} SELECT src, rank, dst, role, label_gap FROM ro")(lambda v: graph.roles(fx.knn(v), v.count(), 4))
query("f12_role_gate", "knn", f", {ROLE} SELECT src, row_number() OVER (PARTITION BY src ORDER BY rank) - 1 AS rank, dst, role FROM (SELECT *, row_number() OVER (PARTITION BY src, role ORDER BY label_gap, rank) - 1 AS k FROM ro) WHERE k < CASE role WHEN 'skeleton' THEN 6 WHEN 'useful' THEN 4 ELSE 2 END")(lambda v: graph.role_gate(graph.roles(fx.knn(v), v.count(), 4), {"skeleton": 6, "useful": 4, "bridge": 2, "reserve": 2}))
query("d9_no_in_range_dominator", "dom iv", "SELECT query_id, src, dst FROM knn k JOIN iv ON dst >= first_pos AND dst < end_pos WHERE NOT EXISTS (SELECT 1 FROM dom WHERE dom.src = k.src AND dom.dst = k.dst AND dom.by >= first_pos AND dom.by < end_pos)")(lambda v: _asked(_unruled(v, fx.knn(v), s := ranges.label_interval(v, fx.queries(v))), s))


def _unruled(v: DataFrame, knn: DataFrame, spans: DataFrame) -> DataFrame:
    """``first_pos, end_pos, src, dst``: for each distinct range the edges into it that no sibling in it dominates."""
    edge = ["first_pos", "end_pos", "src", "dst"]
    inside = ranges.inside_each(knn.select("src", "dst"), spans, "dst")
    ruled = ranges.inside_each(graph.dominators(knn, v), spans, "by").select(*edge)
    return inside.join(ruled.distinct(), edge, "left_anti").select(*edge)


def _asked(edges: DataFrame, spans: DataFrame) -> DataFrame:
    return ranges.to_queries(edges, spans, "src").select("query_id", "src", "dst")


query("d8_rng_in_range", "dom iv", "SELECT query_id, count(*) AS full, count(*) FILTER (NOT EXISTS (SELECT 1 FROM dom WHERE dom.src = k.src AND dom.dst = k.dst AND dom.by >= first_pos AND dom.by < end_pos)) AS kept FROM knn k JOIN iv ON dst >= first_pos AND dst < end_pos AND src >= first_pos AND src < end_pos GROUP BY query_id")(lambda v: _pruned_in_range(fx.knn(v), v, ranges.label_interval(v, fx.queries(v))))
ORACLE["d8_rng_in_range"] = ORACLE["d8_rng_in_range"].replace("count(*) FILTER (NOT EXISTS (SELECT 1 FROM dom WHERE dom.src = k.src AND dom.dst = k.dst AND dom.by >= first_pos AND dom.by < end_pos)) AS kept FROM knn k", "count(*) FILTER (free) AS kept FROM (SELECT query_id, NOT EXISTS (SELECT 1 FROM dom WHERE dom.src = k.src AND dom.dst = k.dst AND dom.by >= first_pos AND dom.by < end_pos) AS free FROM knn k").replace("src < end_pos GROUP BY", "src < end_pos) GROUP BY")


def _pruned_in_range(knn: DataFrame, v: DataFrame, spans: DataFrame) -> DataFrame:
    """Per query the edges inside its range, and those left by the strict rule among in-range neighbours: counted once for each distinct range."""
    edge = ["first_pos", "end_pos", "src", "dst"]
    inside = ranges.inside_each(knn, spans, "dst").where("src >= first_pos and src < end_pos").select(*edge)
    free = _unruled(v, knn, spans).withColumn("free", F.lit(1))
    counted = inside.join(free, edge, "left").groupBy("first_pos", "end_pos").agg(F.count("*").alias("full"), F.count("free").alias("kept"))
    return spans.join(counted, ["first_pos", "end_pos"]).select("query_id", "full", "kept")


query("d10_local_and_unruled", "dom iv", "SELECT DISTINCT query_id, src, dst FROM knn k JOIN iv ON dst >= first_pos AND dst < end_pos WHERE rank < 3 OR NOT EXISTS (SELECT 1 FROM dom WHERE dom.src = k.src AND dom.dst = k.dst AND dom.by >= first_pos AND dom.by < end_pos)")(
    lambda v: _local_and_unruled(fx.knn(v), v, ranges.label_interval(v, fx.queries(v)))
)


def _local_and_unruled(knn: DataFrame, v: DataFrame, spans: DataFrame, local: int = 3) -> DataFrame:
    """An edge carries the siblings that dominate it, at most its node's others, so no edge is copied for each range and compared there. ``knn`` has an edge once."""
    siblings = graph.dominators(knn, v).groupBy("src", "dst").agg(F.collect_list("by").alias("bys"))
    edges = knn.select("src", "rank", "dst").join(siblings, ["src", "dst"], "left")
    ruled = F.exists("bys", lambda by: (by >= F.col("first_pos")) & (by < F.col("end_pos")))
    return ranges.inside(edges, spans, "dst", where=(F.col("rank") < local) | ~F.coalesce(ruled, F.lit(False))).select("query_id", "src", "dst")


query("d11_switch_band", "knn iv", "SELECT query_id, src, dst FROM knn JOIN iv ON dst >= first_pos AND dst < end_pos WHERE abs(src - dst) * 100 BETWEEN 4 * (end_pos - first_pos) AND 25 * (end_pos - first_pos)")(lambda v: _asked(ranges.inside_each(fx.knn(v), s := ranges.label_interval(v, fx.queries(v)), "dst").where("abs(src - dst) * 100 between 4 * (end_pos - first_pos) and 25 * (end_pos - first_pos)"), s))

# statistics
query("a5_degree_stats", "e", "SELECT CAST(sum(n) AS BIGINT) AS total, avg(n) AS mean, max(n) AS largest FROM (SELECT src, count(*) AS n FROM e GROUP BY src)")(lambda v: graph.degree_stats(fx.edges(v)))
query("a6_summary", "knn", "SELECT min(d2) AS low, max(d2) AS high, round(avg(d2), 9) AS mean, round(quantile_cont(d2, 0.5), 9) AS p50, round(quantile_cont(d2, 0.9), 9) AS p90, round(quantile_cont(d2, 0.99), 9) AS p99 FROM knn")(lambda v: graph.summary(fx.knn(v), "d2").select("low", "high", *(F.round(c, 9).alias(c) for c in ("mean", "p50", "p90", "p99"))))
query("a7_correlation", "knn", "SELECT round(coalesce(corr(d2, abs(src - dst)), 0), 9) AS r FROM knn")(lambda v: fx.knn(v).agg(F.round(F.coalesce(F.corr("d2", F.abs(F.col("src") - F.col("dst")).cast("double")), F.lit(0.0)), 9).alias("r")))
query("a8_benefit_by_bucket", "knn", f"SELECT CAST({LVL} AS BIGINT) AS bucket, count(*) AS evals, CAST(sum(CAST(rank < 4 AS INT)) AS BIGINT) AS inserts, CAST(sum(CAST(rank = 0 AS INT)) AS BIGINT) AS bests FROM knn GROUP BY 1")(
    lambda v: fx.knn(v).groupBy(K.jump_level(F.abs(F.col("src") - F.col("dst"))).cast("long").alias("bucket")).agg(F.count("*").alias("evals"), F.sum((F.col("rank") < 4).cast("long")).alias("inserts"), F.sum((F.col("rank") == 0).cast("long")).alias("bests"))
)
query("a9_support", "knn", "SELECT a.src, b.dst, count(*) AS support FROM knn a JOIN knn b ON b.src = a.dst WHERE a.rank < 4 AND b.rank < 4 AND b.dst <> a.src GROUP BY ALL")(
    lambda v: fx.knn(v).where("rank < 4").select("src", F.col("dst").alias("via")).join(fx.knn(v).where("rank < 4").select(F.col("src").alias("via"), "dst"), "via").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("support"))
)
query("a10_prefix_stats", "knn", f"SELECT round(avg(g), 9) AS mean_gap, round(avg(l), 9) AS left_share, round(avg(t), 9) AS switch_share, round(avg(d), 9) AS level_share FROM (SELECT src, avg(gap) AS g, avg(lft) AS l, sum(turn) / CAST(greatest(count(*) - 1, 1) AS DOUBLE) AS t, count(DISTINCT lvl) / CAST(10 AS DOUBLE) AS d FROM (SELECT *, coalesce(CAST(lft <> lag(lft) OVER (PARTITION BY src ORDER BY rank) AS INT), 0) AS turn FROM (SELECT src, rank, abs(src - dst) AS gap, CAST(dst < src AS INT) AS lft, {LVL} AS lvl FROM knn WHERE rank < 10)) GROUP BY src)")(lambda v: graph.prefix_stats(fx.knn(v), 10))
query("a11_conflict_histogram", "dom", "SELECT CASE WHEN n = 0 THEN '0' WHEN n = 1 THEN '1' WHEN n < 4 THEN '2-3' WHEN n < 8 THEN '4-7' WHEN n < 16 THEN '8-15' ELSE '16-31' END AS bucket, count(*) AS edges FROM (SELECT k.src, k.dst, count(dom.by) AS n FROM knn k LEFT JOIN dom ON dom.src = k.src AND dom.dst = k.dst GROUP BY ALL) GROUP BY 1")(lambda v: _histogram(fx.knn(v), v))


def _histogram(knn: DataFrame, v: DataFrame) -> DataFrame:
    n = knn.select("src", "dst").join(graph.dominators(knn, v).groupBy("src", "dst").agg(F.count("*").alias("n")), ["src", "dst"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    c = F.col("n")
    bucket = F.when(c == 0, "0").when(c == 1, "1").when(c < 4, "2-3").when(c < 8, "4-7").when(c < 16, "8-15").when(c < 32, "16-31").otherwise("32+")
    return n.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("edges"))


query("a12_pareto", "v", f", r AS (SELECT selectivity_label, run_id, CAST((run_id * 37) % 101 AS DOUBLE) AS recall, qps FROM (SELECT label % 3 AS selectivity_label, vec_id AS run_id, CAST(y AS DOUBLE) AS qps FROM v)) SELECT selectivity_label, run_id, recall, qps FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.selectivity_label = a.selectivity_label AND b.recall >= a.recall AND b.qps >= a.qps AND (b.recall > a.recall OR b.qps > a.qps))")(
    lambda v: graph.pareto(v.select((F.col("label") % 3).alias("selectivity_label"), F.col("vec_id").alias("run_id"), (F.col("vec_id") * 37 % 101).cast("double").alias("recall"), F.col("y").cast("double").alias("qps"))).select("selectivity_label", "run_id", "recall", "qps")
)
RUNS = "r AS (SELECT label % 3 AS selectivity_label, vec_id AS run_id, CAST((vec_id * 37) % 101 AS DOUBLE) AS recall, CAST(y AS DOUBLE) AS qps, CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN 'OK' WHEN 2 THEN 'failed' END AS status FROM v)"


def _runs(v: DataFrame) -> DataFrame:
    status = F.expr("case pos % 4 when 0 then '' when 1 then 'OK' when 2 then 'failed' end").alias("status")
    return v.select((F.col("label") % 3).alias("selectivity_label"), F.col("vec_id").alias("run_id"), (F.col("vec_id") * 37 % 101).cast("double").alias("recall"), F.col("y").cast("double").alias("qps"), status)


query("f15_completed", "v", f", {RUNS} SELECT run_id, recall, qps FROM r WHERE status IS NULL OR lower(status) IN ('', 'completed', 'ok')")(lambda v: graph.completed(_runs(v)).select("run_id", "recall", "qps"))
query("a13_even_rows", "v", f", {RUNS}, p AS (SELECT *, row_number() OVER (PARTITION BY selectivity_label ORDER BY recall, qps DESC, run_id) - 1 AS i, count(*) OVER (PARTITION BY selectivity_label) AS n FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.selectivity_label = a.selectivity_label AND b.recall >= a.recall AND b.qps >= a.qps AND (b.recall > a.recall OR b.qps > a.qps))) SELECT selectivity_label, run_id, recall, qps FROM p WHERE n <= 3 OR i IN (0, CAST(round_even((n - 1) / 2, 0) AS BIGINT), n - 1)")(
    lambda v: graph.even_rows(graph.pareto(_runs(v).drop("status")), 3).select("selectivity_label", "run_id", "recall", "qps")
)
SETS = "a AS (SELECT src AS query_id, dst AS id FROM knn WHERE rank < 10), b AS (SELECT src AS query_id, dst AS id FROM knn WHERE rank BETWEEN src % 2 AND 9 + src % 3)"
LACKS = "(SELECT query_id, count(*) AS n FROM (SELECT * FROM {} EXCEPT ALL SELECT * FROM {}) GROUP BY query_id)"
query("u4_set_equality", "knn", f", {SETS} SELECT g.query_id, coalesce(x.n, 0) AS only_a, coalesce(y.n, 0) AS only_b, x.n IS NULL AND y.n IS NULL AS equal FROM (SELECT DISTINCT src AS query_id FROM knn) g LEFT JOIN {LACKS.format('a', 'b')} x USING (query_id) LEFT JOIN {LACKS.format('b', 'a')} y USING (query_id)")(
    lambda v: (lambda k: graph.set_equality(k.where("rank < 10"), k.where("rank between query_id % 2 and 9 + query_id % 3")))(fx.knn(v).withColumnsRenamed({"src": "query_id", "dst": "id"}))
)
query("p10_permutation", "v", "SELECT o.pos, s.vec_id, CAST(s.embedding[1] AS DOUBLE) AS first FROM v o JOIN v s ON s.pos = o.vec_id")(
    lambda v: graph.permute(v, v.select("pos", F.col("vec_id").alias("source"))).select("pos", "vec_id", F.col("embedding")[0].cast("double").alias("first"))
)
query("a20_graph_stats", "e iv", "SELECT query_id, max(end_pos - first_pos) AS width, count(*) AS kept, count(*) / CAST((SELECT count(*) FROM e) AS DOUBLE) AS share FROM e JOIN iv ON src >= first_pos AND src < end_pos AND dst >= first_pos AND dst < end_pos GROUP BY query_id")(
    lambda v: ranges.inside_sums(e := fx.edges(v), s := ranges.label_interval(v, fx.queries(v)), {"kept": "1L"}, v.count()).join(s, "query_id").where("kept > 0").select("query_id", (F.col("end_pos") - F.col("first_pos")).alias("width"), "kept", (F.col("kept") / F.lit(float(e.count()))).alias("share"))
)

query("d4_range_stats", "e c iv", ", h AS (SELECT h.label, s.pos AS node FROM (SELECT label, max(pos) AS hi FROM v GROUP BY label) h JOIN s ON s.pos <= h.hi WHERE NOT EXISTS (SELECT 1 FROM s j WHERE j.pos > s.pos AND j.pos <= h.hi AND j.d <= s.d)), g AS (SELECT pos, count(e.src) AS deg FROM v LEFT JOIN e ON e.src = v.pos GROUP BY pos), i AS (SELECT query_id, pos, deg, count(e.dst) AS n FROM iv JOIN g ON pos >= first_pos AND pos < end_pos LEFT JOIN e ON e.src = pos AND e.dst >= first_pos AND e.dst < end_pos GROUP BY ALL) SELECT query_id, any_value(end_pos - first_pos) AS width, (SELECT count(*) FROM h JOIN v ON v.label = h.label WHERE v.pos = iv.end_pos - 1 AND node >= first_pos AND node < end_pos) AS header_size, avg(deg) AS degree, avg(n) AS in_range_degree, round(coalesce(avg(n / CAST(deg AS DOUBLE)) FILTER (deg > 0), 0), 9) AS keep_ratio, CAST(sum(n) AS BIGINT) AS kept, sum(n) / CAST((SELECT count(*) FROM e) AS DOUBLE) AS share FROM i JOIN iv USING (query_id) GROUP BY query_id, first_pos, end_pos")(
    lambda v: ranges.range_stats(fx.edges(v), v, ranges.label_interval(v, fx.queries(v)), graph.headers(fx.scored(v))).withColumn("keep_ratio", F.round("keep_ratio", 9))
)

# prefix policies and reserves that are windows
query("r1_distance", "knn", "SELECT src, rank, dst FROM knn")(lambda v: folds.reorder_prefix(fx.knn(v), "dist").select("src", "rank", "dst"))
query("r12_score", "knn", f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY rank - 0.5 * jr, rank) - 1 AS rank, dst FROM (SELECT src, rank, dst, row_number() OVER (PARTITION BY src ORDER BY {LVL} DESC, rank) - 1 AS jr FROM knn)")(lambda v: graph.jump_score(fx.knn(v), 0.5))
query("g14_support_reserve", "knn", "SELECT src, rank, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k * 2 + side) - 1 AS rank FROM (SELECT src, dst, CAST(dst > src AS INT) AS side, row_number() OVER (PARTITION BY src, dst > src ORDER BY support DESC, d2, dst) - 1 AS k FROM (SELECT f.src, f.dst, count(*) AS support FROM (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn) f GROUP BY ALL) JOIN knn USING (src, dst))) WHERE rank < 6")(
    lambda v: folds.support_reserve((k := fx.knn(v)).select("src", "dst").unionByName(graph.transpose(k)), k, 6)
)
query("g15_bridge_gap_reserve", "knn", "SELECT src, rank, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY k * 2 + side) - 1 AS rank FROM (SELECT src, dst, CAST(dst > src AS INT) AS side, row_number() OVER (PARTITION BY src, dst > src ORDER BY " + LVL + " DESC, support DESC, d2, dst) - 1 AS k FROM (SELECT f.src, f.dst, count(*) AS support FROM (SELECT src, dst FROM knn UNION ALL SELECT dst, src FROM knn) f WHERE abs(src - dst) >= 50 GROUP BY ALL) JOIN knn USING (src, dst))) WHERE rank < 6")(
    lambda v: folds.support_reserve((k := fx.knn(v)).select("src", "dst").unionByName(graph.transpose(k)), k, 6, 50)
)

# quotas by role and side
VOTES = f"vo AS (SELECT k.src, k.dst, k.d2, k.rank, CASE WHEN EXISTS (SELECT 1 FROM knn b WHERE b.src = k.dst AND b.dst = k.src) THEN 2 ELSE 1 END AS support, abs(k.src - k.dst) AS gap, CAST(k.dst > k.src AS INT) AS side, {LVL.replace('src', 'k.src').replace('dst', 'k.dst')} AS lvl FROM knn k)"
TURNS = "row_number() OVER (PARTITION BY src{by} ORDER BY 2 * {k} + side)"


def _votes(v: DataFrame) -> DataFrame:
    """The k-NN edges with a support of 2 if mutual, else 1."""
    k = fx.knn(v)
    back = graph.transpose(k).withColumn("support", F.lit(2).cast("long"))
    return k.join(back, ["src", "dst"], "left").fillna(1, ["support"])


_ROLE_ORDER = "CASE role WHEN 'local' THEN 0 ELSE -support END, CASE role WHEN 'far' THEN -gap ELSE 0 END, d2, CASE role WHEN 'mid' THEN -gap ELSE 0 END, dst"
query("g18_role_quota", "knn", f""", {VOTES},
a AS (SELECT *, CASE WHEN rank < 3 THEN 'head' WHEN gap >= 150 THEN 'far' WHEN gap >= 40 THEN 'mid' ELSE 'local' END AS role FROM vo),
b AS (SELECT *, count(*) FILTER (role = 'local') OVER w AS nl, count(*) FILTER (role = 'mid') OVER w AS nm, count(*) FILTER (role = 'far') OVER w AS nf FROM a WINDOW w AS (PARTITION BY src)),
c AS (SELECT *, least(nm, 2) AS tm, least(nf, 1) AS tf, row_number() OVER (PARTITION BY src, role, side ORDER BY {_ROLE_ORDER}) AS k FROM b),
d AS (SELECT *, 7 - tm - tf AS tl, greatest(7 - tm - tf - nl, 0) AS short, {TURNS.format(by=', role', k='k')} AS turn FROM c),
e AS (SELECT *, least(short, nm - tm) AS xm, turn <= CASE role WHEN 'mid' THEN tm WHEN 'far' THEN tf ELSE tl END AS first FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY src, role, first, side ORDER BY k) AS k2 FROM e),
g AS (SELECT *, {TURNS.format(by=', role, first', k='k2')} AS again FROM f),
h AS (SELECT *, CASE WHEN role = 'head' THEN 0 WHEN first THEN CASE role WHEN 'local' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END WHEN role = 'mid' AND again <= xm THEN 4 WHEN role = 'far' AND again <= least(short - xm, nf - tf) THEN 5 END AS stage FROM g)
SELECT src, row_number() OVER (PARTITION BY src ORDER BY stage, CASE WHEN stage = 0 THEN rank WHEN stage <= 3 THEN turn ELSE again END) - 1 AS rank, dst, CASE role WHEN 'head' THEN 'local' ELSE role END AS role FROM h WHERE stage IS NOT NULL""")(
    lambda v: quotas.select_roles(_votes(v), 10, warm=3, mid_gap=40, far_gap=150, mid_share=0.22, far_share=0.08)
)
query("g18_pool_support", "knn", f", {VOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY src, side ORDER BY support DESC, gap DESC, d2, dst) AS k FROM vo WHERE rank >= 6 AND gap >= 20), t AS (SELECT *, {TURNS.format(by='', k='k')} AS turn FROM m) SELECT src, rank, dst FROM knn WHERE rank < 6 UNION ALL SELECT src, 5 + turn, dst FROM t WHERE turn <= 4")(
    lambda v: quotas.append_support((k := _votes(v)).where("rank < 6"), k, 4, 20)
)
query("g17_tail_reserve", "knn", f", {VOTES}, m AS (SELECT *, row_number() OVER (PARTITION BY src, side, lvl ORDER BY support DESC, d2, dst) AS k FROM vo WHERE rank >= 6), t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, lvl DESC, side) AS turn FROM m) SELECT src, rank, dst FROM knn WHERE rank < 6 UNION ALL SELECT src, 5 + turn, dst FROM t WHERE turn <= 4")(
    lambda v: quotas.tail_reserve((k := _votes(v)).where("rank < 6").select("src", "rank", "dst"), k.withColumn("core", F.col("support") == 2), 4)
)
BATCH = "CASE pos % 5 WHEN 1 THEN '' ELSE 'q' || pos % 3 END AS qrange_file, CASE pos % 7 WHEN 2 THEN NULL WHEN 3 THEN '-4' WHEN 4 THEN '1x' ELSE '' || (pos % 9 + 1) END AS topk, CASE pos % 11 WHEN 5 THEN ' ' ELSE ' ' || pos % 6 END AS beam_size, '8' AS trunc_size, CASE pos % 4 WHEN 0 THEN 'g1' END AS groundtruth_file"
query("f16_checked_runs", "v", f""", b AS (SELECT vec_id AS run_id, {BATCH} FROM v), c AS (SELECT *, TRY_CAST(trim(topk) AS BIGINT) AS k, TRY_CAST(trim(beam_size) AS BIGINT) AS m, CASE qrange_file WHEN 'q0' THEN 20 WHEN 'q1' THEN 19 ELSE 0 END AS n FROM b),
d AS (SELECT *, CASE WHEN qrange_file = '' THEN 'no qrange_file' WHEN coalesce(trim(topk), '') = '' THEN 'no topk' WHEN k IS NULL OR k <= 0 THEN 'bad topk' WHEN trim(beam_size) = '' THEN 'no beam_size' WHEN m IS NULL OR m <= 0 THEN 'bad beam_size' WHEN n < 20 THEN 'too few ranges' WHEN groundtruth_file IS NOT NULL AND 50 < k * 10 THEN 'too few ids' END AS reason FROM c)
SELECT run_id, k AS topk, CASE WHEN k IS NULL THEN m WHEN m IS NULL THEN k ELSE greatest(m, k) END AS beam_size, CASE WHEN reason IS NULL THEN 'ok' ELSE 'failed' END AS status, reason FROM d""")(
    lambda v: check_runs(v.selectExpr("vec_id AS run_id", *BATCH_COLUMNS), v.sparkSession.createDataFrame([("q0", 20), ("q1", 19), ("g1", 50)], "file string, length long"), 10).select("run_id", "topk", "beam_size", "status", "reason")
)
BATCH_COLUMNS = [BATCH.split(", ")[0], *BATCH.split(", ")[1:]]

# two labels
query("g25_entry_grid", "v", "SELECT gx, gy, list(vec_id ORDER BY vec_id) AS ids FROM (SELECT vec_id, least(7, CAST(floor((x - x0) * 8 / CAST(x1 - x0 + 1 AS DOUBLE)) AS BIGINT)) AS gx, least(7, CAST(floor((y - y0) * 8 / CAST(y1 - y0 + 1 AS DOUBLE)) AS BIGINT)) AS gy FROM v, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)) GROUP BY gx, gy")(lambda v: boxes.entry_grid(v, 8).withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")))
ORACLE["g25_entry_grid"] = ORACLE["g25_entry_grid"].replace("list(vec_id ORDER BY vec_id) AS ids", "string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS ids")
query("j15_grid_candidates", "v q", "SELECT query_id, vec_id FROM q JOIN v ON x BETWEEN ql AND qr AND y BETWEEN ly AND ry")(lambda v: boxes.grid_candidates(v, fx.queries(v).select("query_id", F.col("ql").alias("lx"), F.col("qr").alias("rx"), "ly", "ry"), 8))

# seeds
SPACED = "SELECT DISTINCT query_id, first_pos + i * (end_pos - first_pos - 1) // {m} AS seed FROM iv, range(0, {n}) t(i)"


def _spans(v: DataFrame) -> DataFrame:
    q = fx.queries(v)
    return q.join(ranges.label_interval(v, q), "query_id")


query("b23_anchor_seeds", "iv", SPACED.format(m=2, n=3))(lambda v: search.seeds("anchors", _spans(v), v, None, 3))
query("b24_oracle_seeds", "v q iv", f"SELECT query_id, pos AS seed FROM (SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY {d2('embedding', 'qv')}, pos) AS r FROM q JOIN iv USING (query_id) JOIN v ON pos >= first_pos AND pos < end_pos) WHERE r <= 4")(lambda v: search.seeds("oracle_query_seed", _spans(v), v, None))
query("b25_cheap_seeds", "v q iv", f"SELECT query_id, seed FROM (SELECT query_id, seed, row_number() OVER (PARTITION BY query_id ORDER BY {d2('embedding', 'qv')}, seed) AS r FROM ({SPACED.format(m=63, n=64)}) JOIN q USING (query_id) JOIN v ON pos = seed) WHERE r <= 4")(lambda v: search.seeds("cheap_query_seed", _spans(v), v, None))
HEAD = "h AS (SELECT h.label, s.pos AS node FROM (SELECT label, max(pos) AS hi FROM v GROUP BY label) h JOIN s ON s.pos <= h.hi WHERE NOT EXISTS (SELECT 1 FROM s j WHERE j.pos > s.pos AND j.pos <= h.hi AND j.d <= s.d))"
query("b22_header_seeds", "c iv", f", {HEAD} SELECT query_id, node AS seed FROM iv JOIN q USING (query_id) JOIN h ON h.label = (SELECT max(label) FROM v WHERE label <= qr) WHERE node >= first_pos AND node < end_pos")(lambda v: search.seeds("header", _spans(v), v, graph.headers(fx.scored(v))))

# folds and searches, checked by tests against plain versions
query("g2_build")(lambda v: folds.build(v, fx.knn(v), refine=False))
SEEDING = {"limit": 4, "expand": 2, "beam": 24, "degree": 12}
query("g3_build_refined")(lambda v: folds.build(v, k := fx.knn(v), window_cap=16, bridges=approximate.seed_bridges(v, k, fx.scored(v), **SEEDING)))
query("a14_build_profile")(lambda v: folds.build_profile(v, fx.knn(v), window_cap=16)[1])
query("g5_prune")(lambda v: folds.prune(fx.knn(v), v, 8, by_side=False))
query("g7_side_prune")(lambda v: folds.prune(graph.band(v, 12), v, 16))
query("g9_quota_merge")(lambda v: folds.quota_merge(fx.knn(v).select("src", "dst"), graph.band(v, 6), v, 16))
query("g10_chain_bridges")(lambda v: folds.chain_bridges(v, fx.scored(v)))
query("g10_seed_bridges")(lambda v: approximate.seed_bridges(v, fx.knn(v), fx.scored(v), **SEEDING))
query("g10_far_chains")(lambda v: approximate.seed_chains(v, fx.scored(v), 3, "far"))
query("g11_seed_queue")(lambda v: approximate.seed_search(v, fx.knn(v), approximate.seed_chains(v, fx.scored(v), 2).where("src % 20 = 0"), "queue", "expanded", batch=2, expand=4, degree=12))
query("g1_nn_descent")(lambda v: approximate.nn_descent(v, 16))
query("g23_box_prune")(lambda v: folds.box_prune(fx.knn(v).select("src", "dst"), v, 12))
_SCORED = f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY {{order}}) - 1 AS rank, dst, d2 FROM (SELECT *, row_number() OVER (PARTITION BY src, {{scope}} ORDER BY {LVL} DESC, rank) - 1 AS jr FROM knn)"
_POLICY_SQL = {
    "score": _SCORED.format(scope="true", order="rank - CAST(0.35 AS DOUBLE) * jr, rank"),
    "scoreg": _SCORED.format(scope="rank < 2", order="CASE WHEN rank < 2 THEN 0 ELSE 1 END, CASE WHEN rank < 2 THEN rank ELSE rank - 2 - CAST(0.35 AS DOUBLE) * jr END, rank"),
    "cover": f"SELECT src, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN rank < 2 THEN 0 WHEN o <= 7 THEN 1 ELSE 2 END, CASE WHEN rank >= 2 AND o <= 7 THEN o ELSE rank END) - 1 AS rank, dst, d2 FROM (SELECT *, row_number() OVER (PARTITION BY src, rank < 2 ORDER BY k, lvl DESC, side) AS o FROM (SELECT *, row_number() OVER (PARTITION BY src, rank < 2, lvl, side ORDER BY rank) AS k FROM (SELECT *, {LVL} AS lvl, CAST(dst >= src AS INT) AS side FROM knn)))",
}
for _p in folds.POLICIES[1:]:
    query(f"r_{_p}", "knn", _POLICY_SQL.get(_p))(lambda v, p=_p: folds.reorder_prefix(fx.knn(v), p, warm=2, min_gap=16, ratio=0.5 if p in ("mix", "cover") else None))
query("e5_reorder_survival")(lambda v: folds.reorder_survival(fx.knn(v), v))
query("e6_reorder_core_first")(lambda v: folds.reorder_survival(fx.knn(v), v, core_first=True))
query("e10_conflicts_exact")(lambda v: folds.conflicts(fx.knn(v), v))
query("f11_conflict_gate")(lambda v: folds.conflict_gate(folds.conflicts(fx.knn(v), v), 100, 300))


def _searchable(v: DataFrame) -> tuple[search.Index, DataFrame]:
    v = v.cache()
    g = search.Index(v, folds.build(v, fx.knn(v).cache()).cache())
    q = _spans(v)
    return g, search.with_seeds(q, search.seeds("anchors", q, v, None, 3))


query("b5_beam_search")(lambda v: search.search(*_searchable(v), search.Options()))
query("b4_round_trace")(lambda v: search.search(*_searchable(v), search.Options(), "trace"))
query("d1_query_trace")(lambda v: search.search(*_searchable(v), search.Options(), "stats"))
for _p in ("even", "sides", "reciprocal", "corebridge"):
    query(f"b_pick_{_p}")(lambda v, p=_p: search.search(*_searchable(v), search.Options(trunc=8, prefix=4, pick=p)))
query("b9_nav_width")(lambda v: search.search(*_searchable(v), search.Options(nav_degree=4, early_stop=8)))
query("b19_rescue")(lambda v: search.search(*_searchable(v), search.Options(trunc=8, rescue=2, fallback_stall=4)))
query("s23_search_events")(lambda v: search.search(*_searchable(v), search.Options(), "events"))
query("a8_event_benefit")(lambda v: search.benefit(search.search(*_searchable(v), search.Options(), "events"), search.gap_bucket(), "bucket"))
query("w10_rank_benefit")(lambda v: search.benefit(search.search(*_searchable(v), search.Options(), "events"), F.col("selected_rank"), "selected_rank"))
TEACHER = search.Options(k=10, beam=24, trunc=16, pick="even", prefix=8)


def _taught(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges, and what every one earned when all rows were searched from the last label's header."""
    v = v.cache()
    edges, last = fx.knn(v).cache(), graph.headers(fx.scored(v))
    starts = last.join(last.agg(F.max("label").alias("label")), "label").agg(F.sort_array(F.collect_set("node"))).first()[0]  # one header: 20 nodes at most
    index = search.Index(v, edges)
    scores = trace.learned(index, v, starts, TEACHER)
    index.release()
    return edges, scores


query("a16_edge_scores")(lambda v: _taught(v)[1])
query("e7_trace_reorder")(lambda v: trace.reorder_by_score(*_taught(v), 4, 12))
query("a17_coverage")(lambda v: trace.coverage((t := _taught(v))[0], t[1].withColumnRenamed("src", "current_node"), t[1], v.count()))
query("b33_sweep")(lambda v: search.sweep(*(gq := _searchable(v)), exact.topk(v, gq[1], 10, [("label", "ql", "qr")]).select("query_id", "id"), [(24, 8), (48, 16), (96, 32)]))
