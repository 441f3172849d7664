"""Counts of edges inside position ranges, without joining edges to ranges.

An edge lies in ``[first, end)`` if its smaller end is not below ``first`` and its larger end
is below ``end``: edges below ``end`` less those that also begin below ``first``.  The second
count splits ``first`` into digits: an edge is entered at each level under the digits above,
a range asks at each level for the digits below its own, and a running sum in the order of
the larger ends answers.  Running sums go over range partitions with carried totals, so no
key, however hot, is one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandwalk import tables

BITS = 4
#: Positions of a block, queries of a list at most or nearly, rows of a lot, most tasks.
SPAN, ASKED, LOT, TASKS = 256, 512, 1024, 1024


def running(rows: DataFrame, by: list[str], order: list[str], values: list[str], how: str = "sum") -> DataFrame:
    """``rows`` with the sums (or maxima) of ``values`` over the rows of the same ``by`` up to each, in ``order``; nulls add nothing."""
    spark, fold = rows.sparkSession, {"sum": F.sum, "max": F.max}[how]
    join = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest
    dealt = rows.repartitionByRange(*by, *order).withColumn("part_", F.spark_partition_id())
    dealt, path = tables.cut(dealt, "dealt")
    total = dealt.groupBy(*by, "part_").agg(*[fold(c).alias(f"{c}_") for c in values])  # a row for each key and task
    earlier = Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    carried = total.select(*by, "part_", *[fold(f"{c}_").over(earlier).alias(f"{c}_") for c in values])
    own = Window.partitionBy(*by, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.withColumns({c: fold(c).over(own) for c in values}).join(carried, [*by, "part_"])
    out = out.withColumns({c: join(F.col(c), F.col(f"{c}_")) for c in values}).drop("part_", *[f"{c}_" for c in values])
    out, _ = tables.cut(out, "running")
    tables.drop(spark, path)
    return out


def label_interval(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, first_pos, end_pos`` (exclusive) of the labels in ``[ql, qr]``; empty ranges give no row.

    Labels with their counts and the bounds of all queries are put in one order, whose running
    sums are the positions: nothing is joined by comparison.
    """
    none = F.lit(None).cast("long")
    labels = vectors.groupBy(F.col("label").cast("long").alias("at")).agg(F.count("*").alias("n")).select("at", F.lit(1).alias("kind"), none.alias("query_id"), "n")
    bound = lambda c, kind: F.struct(F.col(c).cast("long").alias("at"), F.lit(kind).alias("kind"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.array(bound("ql", 0), bound("qr", 2))).alias("b")).select("b.at", "b.kind", "query_id", none.alias("n"))
    sums = running(labels.unionByName(asked).withColumn("one", F.lit(0)), ["one"], ["at", "kind"], ["n"]).where("kind <> 1")
    out = sums.groupBy("query_id").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("first_pos"), F.max(F.when(F.col("kind") == 2, F.col("n"))).alias("end_pos"))
    return out.where("first_pos < end_pos")


def as_of(values: DataFrame, queries: DataFrame, value: str, bound: str) -> DataFrame:
    """``query_id`` and the largest ``value`` not above its ``bound``; no row if there is none. A running maximum over both."""
    known = values.select(F.col(value).cast("long").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.col(value).cast("long").alias(value)).distinct()
    asked = queries.select(F.col(bound).cast("long").alias("at"), F.lit(1).alias("kind"), F.col("query_id").cast("long").alias("query_id"), F.lit(None).cast("long").alias(value))
    last = running(known.unionByName(asked).withColumn("one", F.lit(0)), ["one"], ["at", "kind"], [value], "max")
    return last.where(f"kind = 1 and {value} is not null").select("query_id", value)


def distinct(spans: DataFrame) -> DataFrame:
    """``first_pos, end_pos``: each range once, however many queries ask for it."""
    return spans.select("first_pos", "end_pos").distinct()


def inside_each(rows: DataFrame, spans: DataFrame, at: str = "pos") -> DataFrame:
    """``rows`` with ``first_pos, end_pos`` for each distinct range that holds their position ``at``.

    An enumeration looks small to the planner, so the join is named: broadcast, its positions would all meet in the driver.
    """
    each = distinct(spans)
    each = each.select("first_pos", "end_pos", F.explode(F.sequence("first_pos", F.col("end_pos") - 1)).alias(at))
    return rows.join(each.hint("merge"), at)


def to_queries(rows: DataFrame, spans: DataFrame, key: str, lots: int = 64) -> DataFrame:
    """``rows(first_pos, end_pos, ...)`` for each query of their range, which many may share: both sides are dealt into ``lots`` by ``key``."""
    lot = F.pmod(F.xxhash64(key), F.lit(lots)).cast("int")
    asked = spans.select("query_id", "first_pos", "end_pos", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot_"))
    return rows.withColumn("lot_", lot).join(asked.hint("merge"), ["first_pos", "end_pos", "lot_"]).drop("lot_")


def inside(rows: DataFrame, spans: DataFrame, at: str = "pos", also: tuple[str, ...] = (), where: Column | None = None) -> DataFrame:
    """``rows`` with ``query_id, first_pos, end_pos`` for each query whose range holds their position ``at``.

    Lists of queries with one range (and equal ``also``, columns of ``spans``) meet the blocks of positions that it touches,
    by equality on the block and, where a block has many rows, a lot of them.  ``where`` is asked once for a row and a list;
    only then are lists opened, so nothing that grows with rows times queries is sent, and what is written has the rows of
    one list after each other, which Parquet stores in few bytes.
    """
    rows, _ = tables.cut(rows.withColumn("b_", F.floor(F.col(at) / SPAN)), "rows")
    many = rows.groupBy("b_").agg(F.ceil(F.count("*") / LOT).alias("lots_")).hint("merge")
    asked, end = spans.agg(F.count("*"), F.coalesce(F.max("end_pos"), F.lit(0))).first()
    lists, parts = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked // ASKED)))), max(1, min(TASKS, -(-end // SPAN)))
    asked = spans.groupBy("first_pos", "end_pos", *also, lists.alias("list_")).agg(F.collect_list("query_id").alias("ids_")).drop("list_")
    asked = asked.withColumn("b_", F.explode(F.sequence(F.floor(F.col("first_pos") / SPAN), F.floor((F.col("end_pos") - 1) / SPAN))))
    asked = asked.join(many, "b_").withColumn("lot_", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots_") - 1))).drop("lots_")
    dealt = rows.join(many, "b_").withColumn("lot_", F.pmod(F.xxhash64(*rows.columns), "lots_")).drop("lots_")
    # blocks are few bytes and much work: as many tasks as blocks, which are not put together by size
    asked, dealt = (side.toDF(*side.columns).repartition(parts, "b_", "lot_") for side in (asked, dealt))
    met = asked.join(dealt.hint("merge"), ["b_", "lot_"]).where((F.col(at) >= F.col("first_pos")) & (F.col(at) < F.col("end_pos")))
    met = met if where is None else met.where(where)
    return met.select(*[c for c in rows.columns if c != "b_"], F.explode("ids_").alias("query_id"), "first_pos", "end_pos", *also)


def _lower_blocks(level: int, digit: int):
    """At a level, the blocks before the one of ``first_pos`` under the same block above."""
    at, above = F.shiftright("first_pos", level * BITS), F.shiftright("first_pos", (level + 1) * BITS)
    before = F.filter(F.sequence(F.lit(0), F.lit(digit)), lambda d: d < at.bitwiseAND(F.lit(digit)))
    return F.transform(before, lambda d: F.struct(F.lit(level + 1).alias("level"), (F.shiftleft(above, BITS) + d).alias("block"), F.lit(-1).alias("sign")))


def inside_sums(edges: DataFrame, spans: DataFrame, values: dict[str, str], n: int) -> DataFrame:
    """``query_id`` and, for each name, the sum of an expression over the edges inside ``[first_pos, end_pos)``.

    ``edges(src, dst, ...)`` has positions below ``n``; ranges without edges get 0.
    """
    levels = max(1, -(-max(n, 1).bit_length() // BITS))
    names, digit = list(values), (1 << BITS) - 1
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("at"), *[F.expr(x).alias(c) for c, x in values.items()])
    # level 0 holds all edges; level l > 0 the block of the smaller end without its last (l - 1) * BITS bits
    blocks = [F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("block")), *[F.struct(F.lit(i + 1).alias("level"), F.shiftright("a", i * BITS).alias("block")) for i in range(levels)]]
    entered = ends.select(F.explode(F.array(*blocks)).alias("b"), "at", *names).select("b.level", "b.block", "at", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("sign"), *names)
    lower = [_lower_blocks(i, digit) for i in range(levels)]
    asked = F.concat(F.array(F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("block"), F.lit(1).alias("sign"))), *lower)
    asks = spans.select("query_id", F.col("end_pos").alias("at"), F.explode(asked).alias("b"))
    kinds = dict(entered.dtypes)
    asks = asks.select("b.level", "b.block", "at", F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("query_id"), F.col("b.sign").cast("long").alias("sign"), *[F.lit(None).cast(kinds[c]).alias(c) for c in names])
    sums = running(entered.unionByName(asks), ["level", "block"], ["at", "kind"], names)
    return sums.where("kind = 0").groupBy("query_id").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in names])


def range_stats(edges: DataFrame, vectors: DataFrame, spans: DataFrame, headers: DataFrame) -> DataFrame:
    """Per range: nodes, header nodes in it, degree and in-range degree means, share of edges kept.

    ``query_id, width, header_size, degree, in_range_degree, keep_ratio, kept, share``: means over the nodes of the range
    (``keep_ratio`` over those with edges, 0 if there are none), ``share`` of all edges of the graph.  ``headers(label, node)``;
    a range takes the header of its last node's label.
    """
    n, total = vectors.count(), edges.count()
    deg = vectors.select("pos", "label").join(edges.groupBy(F.col("src").alias("pos")).agg(F.count("*").alias("deg")), "pos", "left").fillna(0, ["deg"])
    weighed = edges.select("src", "dst").join(deg.select(F.col("pos").alias("src"), "deg"), "src")
    kept = inside_sums(weighed, spans, {"kept": "1L", "ratio": "1D / deg"}, n)
    # degrees of the nodes before both bounds, by running sums over positions
    marks = deg.select(F.col("pos").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("sign"), "deg", (F.col("deg") > 0).cast("long").alias("linked"))
    bounds = spans.select("query_id", F.explode(F.array(F.struct(F.col("first_pos").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end_pos").alias("at"), F.lit(1).alias("sign")))).alias("b"))
    bounds = bounds.select(F.col("b.at").alias("at"), F.lit(0).alias("kind"), F.col("query_id").cast("long").alias("query_id"), F.col("b.sign").cast("long").alias("sign"), F.lit(None).cast("long").alias("deg"), F.lit(None).cast("long").alias("linked"))
    sums = running(marks.unionByName(bounds).withColumn("one", F.lit(0)), ["one"], ["at", "kind"], ["deg", "linked"])
    sums = sums.where("kind = 0").groupBy("query_id").agg(F.sum(F.col("deg") * F.col("sign")).alias("out"), F.sum(F.col("linked") * F.col("sign")).alias("linked"))
    last = spans.select("query_id", "first_pos", "end_pos", (F.col("end_pos") - 1).alias("pos")).join(vectors.select("pos", "label"), "pos")
    head = last.join(headers.select("label", "node"), "label").where("node >= first_pos and node < end_pos").groupBy("query_id").agg(F.count("*").alias("header_size"))
    width = F.col("end_pos") - F.col("first_pos")
    out = spans.join(kept, "query_id").join(sums, "query_id").join(head, "query_id", "left")
    return out.select(
        "query_id",
        width.alias("width"),
        F.coalesce("header_size", F.lit(0)).alias("header_size"),
        (F.col("out") / width).alias("degree"),
        (F.col("kept") / width).alias("in_range_degree"),
        F.when(F.col("linked") > 0, F.col("ratio") / F.col("linked")).otherwise(0.0).alias("keep_ratio"),
        "kept",
        (F.col("kept") / F.lit(float(max(total, 1)))).alias("share"),
    )
