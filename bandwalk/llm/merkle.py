"""A Merkle manifest of a table: a tree for each part, a tree over the parts, a proof for each row.

Leaves are numbered by ranges: rows are ranged by part and key, each task numbers its own, and
the counts of the tasks before are added.  ``fanout ** levels`` consecutive nodes form a
superblock that one group collapses by ``levels`` levels; the roots of the blocks are reduced
in the same way until a part has one node.  Proofs come back down the same tables: a block
adds its lower siblings before those of its root.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard

LEVELS = 10


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode("ascii")).hexdigest()


def leaf_hash(*values) -> F.Column:
    """SHA-256 (hex) of values: ``-`` for null, else number of UTF-8 bytes, colon, value."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def numbered(rows: DataFrame, part: str, key: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_ix, _pos``, and the parts: ``_ix, _value, _n, _parts``.

    ``_ix`` numbers the values of ``part`` (null first), ``_pos`` the rows of a part by
    ``key`` and ``tie`` (nulls first), both from 0.
    """
    order = [F.col(c).asc_nulls_first() for c in (part, key, tie)]
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    at = cut(at.withColumn("_task", F.shiftright("_at", 33)), "numbered")
    spans = at.groupBy(F.col(part).alias("_value"), "_task").agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))  # a row for each part and task
    parts = spans.groupBy("_value").agg(F.sum("_rows").alias("_n"))
    whole = Window.orderBy(F.col("_value").asc_nulls_first())  # a row for each part
    parts = cut(parts.withColumn("_ix", (F.row_number().over(whole) - 1).cast("long")).withColumn("_parts", F.count("*").over(Window.partitionBy())), "parts")
    before = F.sum("_rows").over(Window.partitionBy("_value").orderBy("_task")) - F.col("_rows")
    spans = spans.withColumn("_shift", before - F.col("_low")).join(parts.select(F.col("_value").alias("_v"), "_ix"), F.col("_value").eqNullSafe(F.col("_v")))
    spans = spans.select("_value", F.col("_task").alias("_t"), "_shift", "_ix")
    out = at.join(spans, F.col(part).eqNullSafe(F.col("_value")) & (F.col("_task") == F.col("_t")))
    return out.withColumn("_pos", F.col("_at") + F.col("_shift")).drop("_at", "_task", "_t", "_value", "_shift"), parts


def tree_levels(n, fanout: int) -> F.Column:
    """How often ``n`` nodes are reduced until one remains."""
    sizes = [fanout**k for k in range(63) if fanout**k < 1 << 62]
    return F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in sizes]), lambda x: x < n))


def _layers(nodes: list[str], levels: int, fanout: int) -> list[list[str]]:
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([_hash(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def _reduce(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """``nodes(part, pos, h, up)`` and the tables of block roots above, up to one node a part; ``up``: levels still above."""

    def collapse(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        up = int(pdf["up"].iloc[0])
        top = _layers(pdf["h"].tolist(), min(up, levels), fanout)[-1]
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "pos": pdf["block"].iloc[:1], "h": top, "up": max(up - levels, 0)})

    out = [nodes]
    while most > 0:
        blocks = out[-1].withColumn("block", F.expr(f"pos div {fanout**levels}"))
        out.append(cut(blocks.groupBy("part", "block").applyInPandas(collapse, "part long, pos long, h string, up long"), "blocks"))
        most -= levels
    return out


def _descend(tables: list[DataFrame], top: DataFrame, fanout: int, levels: int, carry: list[str]) -> DataFrame:
    """The lowest table with ``path``, its siblings up to the top and then ``path`` of ``top(part, pos, path, *carry)``."""
    paths = top
    for t in reversed(tables[:-1]):
        keep = [c for c in t.columns if c not in ("up", *carry)]
        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in t.schema if f.name in keep), "path string", *(f"`{c}` string" for c in carry)])

        def spread(own, above):
            own = own.sort_values("pos").reset_index(drop=True)
            layers = _layers(own["h"].tolist(), min(int(own["up"].iloc[0]), levels), fanout)
            path = [above["path"].iloc[0]]
            for layer in reversed(layers[:-1]):
                path = ["".join(layer[i - i % fanout : i] + layer[i + 1 : i - i % fanout + fanout]) + path[i // fanout] for i in range(len(layer))]
            return own.drop(columns=["up", "block"]).assign(path=path, **{c: above[c].iloc[0] for c in carry})

        lower = t.withColumn("block", F.expr(f"pos div {fanout**levels}"))
        above = paths.select("part", F.col("pos").alias("block"), "path", *carry)
        paths = lower.groupBy("part", "block").cogroup(above.groupBy("part", "block")).applyInPandas(spread, schema)
    return paths


def manifest(rows: DataFrame, columns: list[str], part: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = (), fanout: int = 2, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``rows``: ``key, *keep, leaf, pos, n, part, parts, proof, subroot, root``.

    A leaf is the hash of ``columns`` in their order.  Leaves of a part ascend by ``key``, rows
    of one key by leaf; a null key or part comes first.  While a part has several nodes, every
    ``fanout`` consecutive ones (the last run may be shorter) become the hash of their hex
    digests; what remains is its ``subroot``, and the subroots by ``part`` give ``root`` likewise.
    ``proof`` is the siblings' hex digests from the leaf's level up to the root, left to right
    within a level, without separators; ``pos`` of ``n`` leaves and ``part`` of ``parts`` say where
    each belongs.  Repeated rows have leaves of their own; an empty table has no rows.  Columns
    that are not named are ignored, whatever their names.
    """
    key_, part_, kept = "key", "value", [f"x{i}" for i in range(len(keep))]
    leaf = leaf_hash(*[F.col(f"`{c}`") for c in columns])
    kinds = dict(rows.dtypes)
    thin = rows.select(F.col(f"`{key}`").alias(key_), F.col(f"`{part}`").cast("string").alias(part_), *[F.col(f"`{c}`").alias(x) for c, x in zip(keep, kept, strict=True)], leaf.alias("h"))
    thin = cut(thin, "leaves")  # ranges read it twice
    at, parts = numbered(thin, part_, key_, "h")
    sizes = parts.withColumn("up", tree_levels(F.col("_n"), fanout).cast("long"))
    most, n_parts = sizes.agg(F.coalesce(F.max("up"), F.lit(0)), F.count("*")).first()
    nodes = at.join(sizes.select("_ix", F.col("_n").alias("n"), F.col("_parts").alias("parts"), "up"), "_ix")
    texts = [F.col(c).cast("string").alias(c) for c in (key_, *kept)]  # pandas would make long columns with nulls floats
    nodes = cut(nodes.select(F.col("_ix").alias("part"), F.col("_pos").alias("pos"), "h", "up", *texts, "n", "parts"), "nodes")
    discard(thin)
    own = _reduce(nodes, most, fanout, levels)
    width = next(k for k in range(64) if fanout**k >= n_parts)
    subroots = own[-1].select(F.lit(0).cast("long").alias("part"), F.col("part").alias("pos"), "h", F.lit(width).cast("long").alias("up"))
    over = _reduce(subroots, width, fanout, levels)
    top = over[-1].select("part", "pos", F.lit("").alias("path"), F.col("h").alias("root"))
    if width:
        up = _descend(over, top, fanout, levels, ["root"]).select(F.col("pos").alias("part"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    else:
        up = top.select("part", "pos", "path", F.col("root").alias("subroot"), "root")
    if most:
        out = _descend(own, up, fanout, levels, ["subroot", "root"])
    else:
        out = nodes.join(up.drop("pos"), "part")
    own = [F.col(x).cast(kinds[c]).alias(c) for c, x in zip((key, *keep), (key_, *kept), strict=True)]
    return out.select(*own, F.col("h").alias("leaf"), "pos", "n", "part", "parts", F.col("path").alias("proof"), "subroot", "root")


def fold(leaf: str, proof: str, pos: int, n: int, part: int, parts: int, fanout: int = 2) -> str:
    """The root that a leaf and its proof give."""
    at = 0
    for i, count in ((pos, n), (part, parts)):
        while count > 1:
            run = i - i % fanout
            left, right = i - run, min(run + fanout, count) - i - 1
            middle, end = at + 64 * left, at + 64 * (left + right)
            leaf = _hash([proof[at:middle], leaf, proof[middle:end]])
            at, i, count = end, i // fanout, -(-count // fanout)
    return leaf


def verify(proofs: DataFrame, leaf: str = "leaf", fanout: int = 2) -> DataFrame:
    """Rows of ``manifest`` with ``folded_root`` from the column ``leaf`` and their proofs, and ``verified``."""
    columns = (leaf, "proof", "pos", "n", "part", "parts")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            folded = [fold(*r, fanout) for r in zip(*[b.column(c).to_pylist() for c in columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(folded, pa.string())], names=[*b.schema.names, "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema) + ", folded_root string"
    return proofs.mapInArrow(run, schema).withColumn("verified", F.col("folded_root") == F.col("root"))
