"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model over byte and word statistics gives each document its evidence.  Grouped
sums of that evidence (the label itself where there is one) give each host and each path
below it a posterior mean; how far a sparse site is drawn to the level above is estimated
from the spread between the sites themselves.  A document's log-odds are its own evidence
plus its path's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, column_bytes, cut, discard, hash_sample, pieces_of, prefix_hash, range_hash, unused

FEATURES = ("upper", "bang", "bar", "symbol", "digit", "repeat", "distinct", "length", "long_word", "newline")
TRAINING_ROWS = 20_000


def distinct_share(w: np.ndarray, window: int = 400) -> float:
    """Distinct words over words, each counted within its window of the text, so that length does not lower it."""
    return sum(len(np.unique(w[i : i + window])) for i in range(0, len(w), window)) / max(1, len(w))


def document_features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    out = np.zeros((len(at) - 1, len(FEATURES)))
    for i, j in pieces_of(at):
        buf = data[at[i] : at[j]]
        if not len(buf):
            continue
        h = prefix_hash(buf)
        c2, acc = np.zeros(len(buf), bool), buf == 0xC3
        c2[1:] = acc[:-1] & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
        upper = (buf >= 65) & (buf <= 90) | c2
        lower = (buf >= 97) & (buf <= 122) | (np.concatenate(([False], acc[:-1])) & ~c2)
        symbol = np.isin(buf, np.frombuffer(b"#$%&*^~<>{}[]@=+_", np.uint8))
        flags = {"upper": upper, "lower": lower, "bang": buf == 33, "bar": buf == 124, "symbol": symbol, "digit": (buf >= 48) & (buf <= 57), "newline": buf == 10}
        total = {k: np.concatenate(([0], np.cumsum(v))) for k, v in flags.items()}
        gap = np.ones(len(buf) + 2, bool)
        gap[1:-1] = _SPACE[buf]
        for k in range(i, j):
            lo, hi = int(at[k] - at[i]), int(at[k + 1] - at[i])
            if hi == lo:
                continue
            g = gap[lo : hi + 2].copy()
            g[0] = g[-1] = True
            turn = np.flatnonzero(g[1:] != g[:-1]) + lo
            s, e = turn[::2], turn[1::2]
            n = len(s)
            count = {f: float(v[hi] - v[lo]) for f, v in total.items()}
            w = range_hash(h, s, e)
            repeat = float((w[1:] == w[:-1]).mean()) if n > 1 else 0.0
            out[k] = (
                count["upper"] / max(1.0, count["upper"] + count["lower"]),
                count["bang"] / max(1, n),
                count["bar"] / max(1, n),
                count["symbol"] / max(1, n),
                count["digit"] / (hi - lo),
                repeat,
                distinct_share(w),
                np.log1p(n),
                float((e - s > 25).mean()) if n else 0.0,
                count["newline"] / max(1, n),
            )
    return out


def _extract(batches):
    import pyarrow as pa

    for b in batches:
        x = document_features(*column_bytes(b.column("text")))
        flat = pa.array(x.ravel())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), b.column("host"), b.column("path"), rows], names=["doc_id", "th", "host", "path", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights (bias last) by Newton steps."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.clip((x - centre) / scale, -8, 8), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (y - p) - penalty * w
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), grad)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", training_rows: int = TRAINING_ROWS, threshold: float = 0.5) -> DataFrame:
    """``doc_id, th, evidence, host_quality, path_quality, quality, keep`` per row of ``docs``.

    ``th`` is the hash of the text.  The logistic model is fitted on about
    ``training_rows`` labelled documents, those whose hash is below a threshold; site
    statistics cover every document.  Without labels of both kinds the evidence is 0 for all.  Null
    hosts and paths are sites of their own; null and empty texts have all features 0; a
    null id has no label.  Several labels of a document are averaged, repeated rows count
    as often as they stand.  Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col("text").cast("binary").alias("text"))
    feats = cut(src.mapInArrow(_extract, "doc_id long, th long, host string, path string, x array<double>"), "features")
    truth = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("doc_id is not null and y is not null")
    truth = truth.groupBy("doc_id").agg(F.avg("y").alias("y"))
    known = cut(feats.join(truth, "doc_id").select("doc_id", "th", "x", "y"), "labelled")
    rows = hash_sample(known, training_rows, "doc_id", "th").collect()
    discard(known)
    rows.sort(key=lambda r: (r["doc_id"], r["th"]))
    y = np.array([float(r["y"] >= 0.5) for r in rows])
    k = len(FEATURES)
    if len(rows) and 0 < y.sum() < len(y):
        centre, scale, w = fit_logistic(np.array([r["x"] for r in rows]), y)
        prior = float(np.log(y.mean() / (1 - y.mean())))
    else:
        centre, scale, w, prior = np.zeros(k), np.ones(k), np.zeros(k + 1), 0.0
    z = [F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col("x")[i] - float(centre[i])) / float(scale[i]))) * float(w[i]) for i in range(k)]
    total = F.lit(float(w[-1]) - prior)
    for term in z:
        total = total + term
    scored = feats.select("doc_id", "th", "host", "path", F.round(total, 6).alias("evidence")).join(truth, "doc_id", "left")
    chance = F.coalesce("y", 1 / (1 + F.exp(-(F.col("evidence") + prior))))
    site = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.round(chance, 9).cast("decimal(20,9)")).cast("double").alias("s"))
    whole = site.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    mean, kappa = _strength(whole, "hn", "hs")
    hosts = whole.select(F.col("host").alias("above"), ((F.col("hs") + kappa * mean) / (F.col("hn") + kappa)).alias("host_quality"))
    kappa = _strength(site, "n", "s")[1]
    paths = site.join(hosts, F.col("host").eqNullSafe(F.col("above"))).select("host", "path", "host_quality", ((F.col("s") + kappa * F.col("host_quality")) / (F.col("n") + kappa)).alias("path_quality"))
    paths = paths.select(F.coalesce("host", F.lit("\0")).alias("h_"), F.coalesce("path", F.lit("\0")).alias("p_"), F.round("host_quality", 6).alias("host_quality"), F.round("path_quality", 6).alias("path_quality"))
    out = scored.withColumn("h_", F.coalesce("host", F.lit("\0"))).withColumn("p_", F.coalesce("path", F.lit("\0"))).join(paths, ["h_", "p_"])
    safe = F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.col("path_quality")))
    quality = 1 / (1 + F.exp(-(F.col("evidence") + F.log(safe / (1 - safe)))))
    return out.select("doc_id", "th", "evidence", "host_quality", "path_quality", F.round(quality, 6).alias("quality")).withColumn("keep", F.col("quality") >= threshold)


def _strength(sites: DataFrame, n: str, s: str) -> tuple[float, float]:
    """The overall mean, and how many pseudo-documents a site is drawn to the level above with.

    The spread between sites beyond what their sizes explain is matched to a Beta's.
    """
    m = F.col(s) / F.col(n)
    r = sites.agg(F.sum(s).alias("s"), F.sum(n).alias("n"), F.count("*").alias("g"), F.sum(F.col(n) * m * m).alias("q")).first()
    if not r["n"]:
        return 0.5, 1000.0
    mean = min(0.99, max(0.01, r["s"] / r["n"]))
    noise = mean * (1 - mean)
    between = r["q"] / r["n"] - (r["s"] / r["n"]) ** 2 - noise * r["g"] / r["n"]
    return round(mean, 9), round(min(1000.0, max(1.0, noise / between - 1)), 6) if between > 1e-6 else 1000.0


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, whatever their names.

    Rows that repeat id and text stay or go together; a null text counts as empty, a null id
    as an id of its own.  A table without rows gives none.
    """
    d, th, h = unused(docs, "d", "th", "h")
    bad = classify(docs, labels, **options).where(~F.col("keep")).select(F.col("doc_id").alias(d), F.col("th").alias(th)).distinct()
    src = docs.withColumn(h, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    match = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(h) == F.col(th))
    return src.join(bad, match, "left_anti").select(*docs.columns)
