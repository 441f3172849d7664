"""Choices among a node's candidates by role and side, as windows: no group is opened.

Alternation of two sorted sides, left first and going on with one when the other ends, is
the order of twice the place within a side plus the side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwalk.functions.kernels import jump_level

_ROLES = ("local", "mid", "far")


def _alternating(rows: DataFrame, name: str, order: list, *by: str) -> DataFrame:
    """Adds ``name``: places from 1 in turns of both sides, each side in ``order``."""
    k = F.row_number().over(Window.partitionBy("src", *by, "side").orderBy(*order))
    rows = rows.withColumn("k_", k * 2 + F.col("side"))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("src", *by).orderBy("k_"))).drop("k_")


def _order() -> list:
    """Within a role: local by distance, mid by support and distance, far by support and gap."""
    local, far = F.col("role") == "local", F.col("role") == "far"
    return [F.when(local, 0).otherwise(-F.col("support")), F.when(far, -F.col("gap")).otherwise(0), "d2", F.when(far, 0).otherwise(F.when(local, 0).otherwise(-F.col("gap"))), "dst"]


def select_roles(candidates: DataFrame, target: int, warm: int = 8, mid_gap: int = 128, far_gap: int = 2048, mid_share: float = 0.22, far_share: float = 0.08) -> DataFrame:
    """``src, rank, dst, role``: of each node's ``candidates(src, dst, d2, support)`` at most ``target``.

    The nearest ``warm`` come first.  Of the room left, ``mid_share`` goes to gaps from ``mid_gap`` and
    ``far_share`` to gaps from ``far_gap`` (rounded, no more than there are), the rest to the others, in turns of
    both sides.  Room that local ones cannot fill goes to mid, then to far.  Nodes with no more than
    ``target`` candidates keep all, by distance.  Pairs are distinct; ties go to the smaller ``dst``.
    """
    far_gap = max(mid_gap + 1, far_gap)
    node = Window.partitionBy("src")
    rows = candidates.where("src <> dst").withColumns({"gap": F.abs(F.col("src") - F.col("dst")), "side": (F.col("dst") > F.col("src")).cast("int"), "i": F.row_number().over(node.orderBy("d2", "dst")) - 1, "n": F.count("*").over(node)})
    whole = F.col("n") <= target
    head = whole | (F.col("i") < min(warm, target))
    role = F.when(head, "head").when(F.col("gap") >= far_gap, "far").when(F.col("gap") >= mid_gap, "mid").otherwise("local")
    rows = rows.withColumn("role", role)
    rows = rows.withColumns({f"n_{r}": F.count(F.when(F.col("role") == r, 1)).over(node) for r in _ROLES})
    remain = F.lit(target - min(warm, target))
    rows = rows.withColumns({f"t_{r}": F.least(F.col(f"n_{r}"), F.round(remain * share).cast("long")) for r, share in (("mid", mid_share), ("far", far_share))})
    rows = rows.withColumn("t_local", remain - F.col("t_mid") - F.col("t_far"))
    rows = rows.withColumn("short", F.greatest(F.col("t_local") - F.col("n_local"), F.lit(0)))
    rows = rows.withColumn("x_mid", F.least("short", F.col("n_mid") - F.col("t_mid")))
    rows = rows.withColumn("x_far", F.least(F.col("short") - F.col("x_mid"), F.col("n_far") - F.col("t_far")))
    of = lambda kind: F.when(F.col("role") == "mid", F.col(f"{kind}_mid")).when(F.col("role") == "far", F.col(f"{kind}_far"))
    rows = _alternating(rows, "turn", _order(), "role").withColumn("first", F.col("turn") <= F.coalesce(of("t"), F.col("t_local")))
    rows = _alternating(rows, "again", _order(), "role", "first")
    stage = F.when(F.col("role") == "head", 0).when(F.col("first"), F.when(F.col("role") == "local", 1).when(F.col("role") == "mid", 2).otherwise(3)).when(F.col("again") <= F.coalesce(of("x"), F.lit(0)), F.when(F.col("role") == "mid", 4).otherwise(5))
    rows = rows.withColumn("stage", stage).where("stage is not null")
    place = F.when(F.col("stage") == 0, F.col("i")).when(F.col("stage") <= 3, F.col("turn")).otherwise(F.col("again"))
    rank = F.row_number().over(node.orderBy("stage", place)) - 1
    return rows.select("src", rank.cast("long").alias("rank"), "dst", F.when(F.col("role") == "head", "local").otherwise(F.col("role")).alias("role"))


def append_support(chosen: DataFrame, support: DataFrame, room: int, min_gap: int) -> DataFrame:
    """``src, rank, dst``: ``chosen``, then up to ``room`` supported nodes at a gap of ``min_gap`` or more that are not chosen.

    ``support(src, dst, d2, support)``; by support, gap, distance, in turns of both sides.
    """
    gap = F.abs(F.col("src") - F.col("dst"))
    more = support.where("src <> dst").where(gap >= min_gap).join(chosen.select("src", "dst"), ["src", "dst"], "left_anti")
    more = more.withColumn("side", (F.col("dst") > F.col("src")).cast("int"))
    more = _alternating(more, "turn", [F.col("support").desc(), gap.desc(), "d2", "dst"]).where(F.col("turn") <= room)
    return _after(chosen, more)


def tail_reserve(reordered: DataFrame, pool: DataFrame, room: int) -> DataFrame:
    """``src, rank, dst``: edges in their order, then up to ``room`` of ``pool(src, dst, d2, core)`` that are not among them.

    Bins of jump level and side take turns, long ones first, left before right; a bin gives its
    core candidates before its bridges, each by distance.  A pair listed twice counts as core.
    """
    rest = pool.where("src <> dst").groupBy("src", "dst").agg(F.min("d2").alias("d2"), F.max("core").alias("core"))
    rest = rest.join(reordered.select("src", "dst"), ["src", "dst"], "left_anti")
    rest = rest.withColumns({"side": (F.col("dst") > F.col("src")).cast("int"), "lvl": jump_level(F.abs(F.col("src") - F.col("dst"))).cast("int")})
    rest = rest.withColumn("k", F.row_number().over(Window.partitionBy("src", "side", "lvl").orderBy(F.col("core").desc(), "d2", "dst")))
    rest = rest.withColumn("turn", F.row_number().over(Window.partitionBy("src").orderBy("k", F.col("lvl").desc(), "side"))).where(F.col("turn") <= room)
    return _after(reordered, rest)


def _after(chosen: DataFrame, more: DataFrame) -> DataFrame:
    both = chosen.select("src", "dst", F.lit(0).alias("late"), F.col("rank").cast("long").alias("at")).unionByName(more.select("src", "dst", F.lit(1).alias("late"), F.col("turn").cast("long").alias("at")))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("late", "at")) - 1
    return both.select("src", rank.cast("long").alias("rank"), "dst")
