"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells.

Equal vectors are one class with a multiplicity, so copies never meet as pairs.  Every
class lives in the cell of its nearest centroid and also visits each cell whose centroid is
nearly as close, so pairs that straddle a border meet.  Cells are split into bounded blocks
and each block is compared with the visitors of its cell, also in blocks.  A comparison
emits counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hash_sample

BLOCK = 1024
SAMPLE = 20_000
MARGIN = 0.2


def _unit(batches):
    """Unit vectors as doubles; rows that are null, zero or not finite come out as null."""
    import pyarrow as pa

    for b in batches:
        out = []
        for v in b.column("embedding").to_pylist():
            if not v or any(x is None for x in v):
                out.append(None)
                continue
            x = np.array(v, np.float64)
            top = np.abs(x).max()
            if not np.isfinite(x).all() or top == 0:
                out.append(None)
                continue
            x = x / top
            out.append((x / np.sqrt((x * x).sum())).tobytes())
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Unit centroids of the rows of ``x``; empty cells keep their start."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(1))
        c[norm > 1e-12] = total[norm > 1e-12] / norm[norm > 1e-12, None]
    return c


def _assign(centroids: dict[int, np.ndarray], margin: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, units = b.column("rep").to_numpy(), b.column("unit")
            rows, cells, home, own_cell, seen = [], [], [], np.zeros(len(ids), np.int64), [[]] * len(ids)
            size = np.array([len(u.as_buffer()) // 8 for u in units], np.int64)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = np.frombuffer(b"".join(units[int(i)].as_buffer() for i in at)).reshape(len(at), d)
                if d not in centroids:  # a rare length: one cell for all of it
                    r, c, own = np.arange(len(at)), np.zeros(len(at), np.int64), np.ones(len(at), bool)
                else:
                    dots = x @ centroids[d].T
                    best = dots.argmax(1)
                    r, c = np.nonzero(dots >= dots[np.arange(len(at)), best][:, None] - margin)
                    own = best[r] == c
                c = c + (int(d) << 32)
                rows.append(at[r])
                cells.append(c)
                home.append(own)
                own_cell[at[r[own]]] = c[own]
                for i, part in zip(at, np.split(c, np.searchsorted(r, np.arange(1, len(at)))), strict=True):
                    seen[i] = part
            if not rows:
                continue
            rows = np.concatenate(rows)
            take = pa.array(rows)
            cols = [pa.array(ids[rows]), b.column("times").take(take), pa.array(np.concatenate(cells)), pa.array(np.concatenate(home)), pa.array(own_cell[rows]), pa.array(seen, pa.list_(pa.int64())).take(take), units.take(take)]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "times", "cell", "home", "at", "seen", "unit"])

    return run


def _forest(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, column) that span the components of a boolean link matrix, by breadth."""
    new_row, new_col = hit.any(1), hit.any(0)
    a, b = [], []
    for i in range(len(hit)):
        if not new_row[i]:
            continue
        new_row[i] = False
        rows = np.array([i])
        while len(rows):
            sub = hit[rows] & new_col
            cols = np.flatnonzero(sub.any(0))
            if not len(cols):
                break
            new_col[cols] = False
            a.append(rows[sub[:, cols].argmax(0)])
            b.append(cols)
            sub = hit[:, cols] & new_row[:, None]
            rows = np.flatnonzero(sub.any(1))
            new_row[rows] = False
            a.append(rows)
            b.append(cols[sub[rows].argmax(1)])
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _compare(cosine: float):
    def run(key, left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"kind": [], "a": [], "b": []}).astype("int64")
        x, y = (np.frombuffer(b"".join(d["unit"])).reshape(len(d), -1) for d in (left, right))
        a, b = left["rep"].to_numpy(), right["rep"].to_numpy()
        hit = (x @ y.T >= cosine) & (a[:, None] != b[None, :])
        n = hit @ right["times"].to_numpy()
        i, j = _forest(hit)
        count = pd.DataFrame({"kind": 0, "a": a[n > 0], "b": n[n > 0]})
        # A visitor whose own cell the other end does not visit counts the link here.
        home = right["at"].to_numpy()
        p, q = np.nonzero(hit & (home != key[0])[None, :])
        seen = np.full((len(x), max(map(len, left["seen"]), default=0)), -1, np.int64)
        for k, cells in enumerate(left["seen"]):
            seen[k, : len(cells)] = cells
        back = np.zeros(len(y), np.int64)
        for k in range(0, len(p), 1 << 16):
            i2, j2 = p[k : k + (1 << 16)], q[k : k + (1 << 16)]
            once = ~(seen[i2] == home[j2][:, None]).any(1)
            np.add.at(back, j2[once], left["times"].to_numpy()[i2[once]])
        count = pd.concat([count, pd.DataFrame({"kind": 0, "a": b[back > 0], "b": back[back > 0]})])
        return pd.concat([count, pd.DataFrame({"kind": 1, "a": a[i], "b": b[j]})]).astype("int64")

    return run


def near_vectors(vectors: DataFrame, cosine: float = 0.9, cells: int | None = None, margin: float = MARGIN, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding)``.

    Links join vectors of equal length whose cosine is at least ``cosine``.  Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing.  Rows
    with a null id link with nothing and are kept.  Repeated rows of one id are one vector
    to the count of others.  Centroids come from about ``sample`` rows, so cells number an
    eighth of it at most; every row is assigned and compared.  A link found from one side counts
    for both ends.  Labels and other columns are ignored.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = cut(src.mapInArrow(_unit, "vec_id long, unit binary"), "unit")
    good = unit.where("unit is not null and vec_id is not null")
    same = good.distinct().groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    classes = cut(same, "classes")
    n = classes.count()
    # a sample for the centroids only, by a threshold on the hash
    picked = hash_sample(classes, sample, "unit").select("unit").collect()
    picked.sort(key=lambda r: r["unit"])
    by_size: dict[int, list] = {}
    for r in picked:
        by_size.setdefault(len(r["unit"]) // 8, []).append(np.frombuffer(r["unit"]))
    centroids = {}
    for d, rows in by_size.items():
        k = min(cells or max(1, round(n / 2000)), max(1, len(rows) // 8))
        centroids[d] = spherical_kmeans(np.stack(rows), k)
    placed = cut(classes.mapInArrow(_assign(centroids, margin), "rep long, times long, cell long, home boolean, at long, seen array<long>, unit binary"), "placed")
    held = placed.where("home").groupBy("cell").agg(F.count("*").alias("held"))
    visits = placed.groupBy("cell").agg(F.count("*").alias("visits"))
    shape = held.join(visits, "cell").select("cell", F.ceil(F.col("held") / block).cast("int").alias("rows"), F.ceil(F.col("visits") / (4 * block)).cast("int").alias("cols"))
    dealt = placed.join(shape, "cell").withColumn("h", F.xxhash64("rep"))
    left = dealt.where("home").select("cell", F.pmod("h", "rows").cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"), "rep", "times", "seen", "unit")
    right = dealt.select("cell", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"), F.pmod("h", "cols").cast("int").alias("c"), "rep", "times", "at", "unit")
    right = right.toDF(*right.columns)
    keys = ("cell", "r", "c")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(cosine), "kind long, a long, b long")
    found = cut(found, "found")
    count = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("others"))
    comp = cut(components(found.where("kind = 1")), "comp").withColumnRenamed("node", "rep")
    known = classes.join(count, "rep", "left").join(comp, "rep", "left")
    per = good.distinct().join(known.select("unit", "rep", "times", "others", "component"), "unit")
    per = per.groupBy("vec_id").agg(F.max(F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = unit.select("vec_id").join(per, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
