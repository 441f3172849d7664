"""Exact nearest neighbours under label predicates, and the label order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandwalk import tables
from bandwalk.operators.ranges import label_interval

#: Rows of a block at least and at most; rows and columns of queries and base compared at once, and bins of columns whose
#: least values bound the nearest; distances summed at once; queries of a group that merges its meetings; most tasks of meetings.
BLOCK, FULL, ROWS, TILE, BINS, HEAD, MERGED, MEETINGS = 2048, 32768, 256, 4096, 256, 4096, 512, 1024


def label_order(vectors: DataFrame, label: str = "label", key: str = "vec_id") -> DataFrame:
    """Adds ``pos``, the place in ``(label, key)`` order from 0.

    Places inside a label come from a window per label; the offsets before it from a
    window over the distinct labels only.
    """
    count = vectors.groupBy(label).agg(F.count("*").alias("n"))
    before = count.select(F.col(label).alias("l_"), (F.sum("n").over(Window.orderBy(label)) - F.col("n")).alias("off"))
    inside = F.row_number().over(Window.partitionBy(label).orderBy(key)) - 1
    out = vectors.withColumn("in_", inside).join(before, F.col(label) == F.col("l_"))
    return out.withColumn("pos", (F.col("off") + F.col("in_")).cast("long")).drop("in_", "off", "l_")


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, summed over the dimensions in order."""
    out = np.zeros((len(x), len(y)))
    for d in range(x.shape[1]):
        diff = x[:, d, None] - y[None, :, d]
        out += diff * diff
    return out


def _column(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _matrix(col) -> np.ndarray:
    """An Arrow column of number lists of one length, as rows in double precision; what is null becomes NaN."""
    lists = col.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _first(rows: np.ndarray, most: int) -> np.ndarray:
    """Which of the ascending ``rows`` are among the first ``most`` of their value."""
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, int)
    return np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)])) < most


def _hits(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few true values of ``mask``, looked for eight at a time."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, byte = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + byte


def nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, allowed=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``rows, columns, d2``: the ``k`` nearest rows of ``y`` for each row of ``x``, nearest first, ties by ``ids``.

    Products in single precision, with a bound of their error, leave the few columns that can be among the
    nearest; only those get their distance, summed like ``distances``.  Columns come in tiles and are dealt to bins: ``k`` bins
    whose least product is small hold ``k`` columns as near, so no farther one counts, and the bound falls from tile to tile.
    ``allowed(rows)`` is a mask for a slice of rows.
    """
    at_x, at_y = (np.flatnonzero(np.isfinite(m).all(1)) for m in (x, y))
    out = []
    if len(at_x) and len(at_y) and x.shape[1]:
        xs, ys = x[at_x], y[at_y]
        scale = max(np.abs(xs).max(), np.abs(ys).max()) or 1.0
        left, right = (xs / scale).astype(np.float32), (ys / scale).astype(np.float32)
        sq = np.square(right, dtype=np.float64).sum(1)
        size, top = np.sqrt(np.square(left, dtype=np.float64).sum(1)), np.sqrt(sq.max())
        terms = 16 * (x.shape[1] + 8)  # twice the error of two values: of products in single, of distances in double precision
        slack = (terms * 2.0**-24 * (2 * size * top + top * top) + terms * 2.0**-53 * np.square(size + top) + 1e-30).astype(np.float32)
        left, right = np.c_[-2 * left, np.ones(len(left), np.float32)], np.c_[right, sq].astype(np.float32)
        bins = BINS * max(1, -(-2 * k // BINS))
        wide = bins * max(1, TILE // bins)
        tiles = [np.ascontiguousarray(right[c : c + wide].T) for c in range(0, len(ys), wide)]
        for lo in range(0, len(xs), ROWS):
            strip, room = left[lo : lo + ROWS], slack[lo : lo + ROWS]
            least, found = np.full((len(strip), bins), np.inf, np.float32), []
            fits = None if allowed is None else allowed(at_x[lo : lo + ROWS])
            if fits is not None and len(at_y) < len(y):
                fits = fits[:, at_y]
            for t, tile in enumerate(tiles):
                g = strip @ tile
                if fits is not None:
                    g[~fits[:, t * wide : t * wide + g.shape[1]]] = np.inf
                whole = g.shape[1] // bins * bins
                if whole:
                    np.minimum(least, g[:, :whole].reshape(len(g), -1, bins).min(1), out=least)
                rest = g.shape[1] - whole
                np.minimum(least[:, :rest], g[:, whole:], out=least[:, :rest])
                bound = np.minimum(np.partition(least, k - 1, axis=1)[:, k - 1] + room, np.finfo(np.float32).max)
                hit = _hits(g <= bound[:, None])
                found.append((hit // g.shape[1], hit % g.shape[1] + t * wide, g.ravel()[hit]))
            rows, cols, value = (np.concatenate(c) for c in zip(*found, strict=True))
            kept = value <= bound[rows]
            rows, cols = rows[kept], cols[kept]
            d = np.concatenate([in_order(xs[lo + rows[i : i + HEAD]], ys[cols[i : i + HEAD]]) for i in range(0, len(rows), HEAD)] or [np.zeros(0)])
            order = np.lexsort((ids[at_y[cols]], d, rows))
            order = order[np.isfinite(d[order])]
            order = order[_first(rows[order], k)]
            out.append((at_x[lo + rows[order]], at_y[cols[order]], d[order]))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return tuple(np.concatenate(c) for c in zip(empty, *out, strict=True))


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of equal place, summed over the dimensions in order."""
    sq, out = np.square(x - y), np.zeros(len(x))
    for d in range(x.shape[1]):
        out += sq[:, d]
    return out


def _listed(lengths: np.ndarray, values: np.ndarray):
    """A list column of ``values`` in order, ``lengths`` each."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values))


def _block(k: int, ranges: list[tuple[str, str, str]], strict: bool):
    """A meeting of base and queries: a row for each query that finds something, with its nearest in two lists."""

    def run(base, queries):
        import pyarrow as pa

        ids, asked = _column(base, "id"), _column(queries, "query_id")
        tests = [(_column(base, value), _column(queries, lo), _column(queries, hi)) for value, lo, hi in ranges]

        def allowed(rows):
            ok = np.ones((len(rows), len(ids)), bool)
            for v, lo, hi in tests:
                ok &= (v[None, :] >= lo[rows][:, None]) & (v[None, :] <= hi[rows][:, None])
            return ok

        if not len(ids) or not len(asked):
            which, best, d = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        else:  # one more, as a query may meet itself
            which, best, d = nearest(_matrix(queries.column("qv")), _matrix(base.column("embedding")), ids, k + strict, allowed if tests else None)
        if strict:
            other = np.flatnonzero(ids[best] != asked[which])
            other = other[_first(which[other], k)]
            which, best, d = which[other], best[other], d[other]
        row, many = np.unique(which, return_counts=True)
        return pa.table({"query_id": pa.array(asked[row], pa.int64()), "id": _listed(many, ids[best].astype(np.int64)), "d2": _listed(many, d)})

    return run


def _merge(k: int):
    """The nearest of all meetings of a group of queries, with their ranks."""

    def run(met):
        import pyarrow as pa

        lists = met.column("id").combine_chunks()
        query, ids = np.repeat(_column(met, "query_id"), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        d = met.column("d2").combine_chunks().flatten().to_numpy()
        order = np.lexsort((ids, d, query))
        order = order[_first(query[order], k)]
        query = query[order]
        start = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
        rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)])) + 1
        return pa.table({"query_id": pa.array(query, pa.int64()), "rk": pa.array(rank, pa.int64()), "id": pa.array(ids[order], pa.int64()), "d2": pa.array(d[order], pa.float64())})

    return run


def _side(n: int) -> int:
    """Rows a block for ``n`` rows: an eighth of them within bounds, so that copies for the meetings grow with the rows until blocks are full."""
    return max(BLOCK, min(FULL, -(-n // 8)))


def topk(base: DataFrame, queries: DataFrame, k: int, ranges=(), exclude_self: bool = False, key: str = "vec_id") -> DataFrame:
    """``query_id, rk, id, d2``: the k nearest rows per query, best first, ties by id.

    ``ranges`` lists ``(base column, low, high)`` with closed bounds from the query's columns.
    Base and queries meet block by block, so neither is broadcast or gathered; each meeting
    keeps k neighbours per query as one row, and groups of queries merge their meetings.  If the first range is on
    ``pos``, or on ``label`` and the base has positions, blocks are runs of positions, and a query meets
    only those that its interval touches.
    """
    extra = [v for v, _, _ in ranges]
    bounds = [c for _, lo, hi in ranges for c in (lo, hi)]
    by_pos = bool(extra) and extra[0] in ("label", "pos") and "pos" in base.columns
    asked, rows = queries.count(), base.count()
    n_query, size = max(1, -(-asked // _side(asked))), _side(rows)
    n_base = max(1, -(-rows // size))
    right = queries.select("query_id", "qv", *bounds).withColumn("c", F.pmod(F.xxhash64("query_id"), F.lit(n_query)).cast("int"))
    if by_pos:
        block = F.floor(F.col("pos") / size).cast("int")
        reach = F.sequence(F.floor(F.col("first_pos") / size), F.floor((F.col("end_pos") - 1) / size))
        if extra[0] == "pos":
            lo, hi = F.greatest(F.col(ranges[0][1]), F.lit(0)), F.least(F.col(ranges[0][2]), F.lit(max(rows - 1, 0)))
            spans = queries.select("query_id", lo.alias("first_pos"), (hi + 1).alias("end_pos")).where("first_pos < end_pos")
        else:
            spans = label_interval(base, queries)
        right = right.join(spans.select("query_id", F.explode(reach.cast("array<int>")).alias("b")), "query_id")
    else:
        block = F.pmod(F.xxhash64("id"), F.lit(n_base)).cast("int")
        right = right.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_base - 1))))
    place = ["pos"] if by_pos else []
    left = base.select(F.col(key).alias("id"), "embedding", *extra, *[p for p in place if p not in extra]).withColumn("b", block).drop(*[p for p in place if p not in extra])
    left = left.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
    # meetings are few bytes and much work: as many tasks as meetings, which are not put together by size
    left, right = (side.toDF(*side.columns).repartition(min(n_base * n_query, MEETINGS), "b", "c") for side in (left, right))
    near = left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(_block(k, list(ranges), exclude_self), "query_id long, id array<long>, d2 array<double>")
    group = F.pmod(F.xxhash64("query_id"), F.lit(max(1, asked // MERGED)))
    return near.groupBy(group.alias("g")).applyInArrow(_merge(k), "query_id long, rk long, id long, d2 double")


def knn_graph(vectors: DataFrame, k: int) -> DataFrame:
    """``src, rank, dst, d2`` over positions, without self, rank from 0: a table, so that who reads it twice makes it once."""
    v, path = tables.cut(vectors.select("pos", "embedding"), "vectors")
    queries = v.select(F.col("pos").alias("query_id"), F.col("embedding").alias("qv"))
    out = topk(v, queries, k, exclude_self=True, key="pos")
    out, _ = tables.cut(out.select(F.col("query_id").alias("src"), (F.col("rk") - 1).alias("rank"), F.col("id").alias("dst"), "d2"), "knn")
    tables.drop(vectors.sparkSession, path)
    return out


def centroid(vectors: DataFrame) -> DataFrame:
    """``dim, mean`` per component."""
    each = vectors.select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def recall_by_distance(found: DataFrame, truth: DataFrame, k: int, n_queries: int) -> DataFrame:
    """Share of the k * n true distances met, with multiplicity."""
    a = found.groupBy("query_id", "d2").agg(F.count("*").alias("ca"))
    b = truth.groupBy("query_id", "d2").agg(F.count("*").alias("cb"))
    return a.join(b, ["query_id", "d2"]).agg((F.coalesce(F.sum(F.least("ca", "cb")), F.lit(0)) / F.lit(float(k * n_queries))).alias("recall"))


def recall_by_id(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Per query the share of true ids that were found."""
    hit = truth.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
