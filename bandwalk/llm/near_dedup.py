"""MinHash near-deduplication with min-max signatures.

Every permutation yields both the smallest and the largest image of a document's
shingle set, so 128 signature values take 64 hash evaluations.  Bands of four values
give candidates; links are confirmed on the full shingle sets.

Groups of copies never meet as all pairs.  Equal sets are one class.  Each bucket first
compares its members with its smallest class only; what that joins is contracted to
components.  Another round compares each member with a few pivots drawn by hash from other
components of its bucket.  At last a bucket of few members compares those of components that
still differ as pairs.  Members of larger buckets are joined by an exact prefix filter: sets
in order of rarity that reach the similarity share a shingle early enough, at positions that
leave room for the overlap needed.  So no candidate pair is left out unless both are in one
component already, and documents that only share a bucket do not meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_bytes, components, cut, mix64, shingle_sets

PERMUTATIONS = 64
BAND = 4
STAR_ROUNDS = 2
PIVOTS = 4
#: Members of a bucket up to which the last comparison takes its pairs as they are.
SMALL = 16
#: A class of equal sets is spread over tasks if it holds more than one in so many documents.
HOT_SHARE = 1000


def _slices(batches, rows: int = 1000):
    """Parts of the batches: what a worker holds at once is bounded by them."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _signer(width: int, permutations: int, band: int):
    odd = mix64(np.arange(1, permutations + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

    def run(batches):
        import pyarrow as pa

        for b in _slices(batches):
            values, at = shingle_sets(*column_bytes(b.column("text")), width)
            n = len(at) - 1
            size = np.diff(at)
            full = np.flatnonzero(size)
            starts = at[:-1][full]
            sig = np.zeros((len(full), 2 * permutations), np.uint64)
            fp = np.zeros((n, 2), np.uint64)
            if len(full):
                for k, a in enumerate(odd):
                    image = values * a
                    sig[:, 2 * k] = np.minimum.reduceat(image, starts)
                    sig[:, 2 * k + 1] = np.maximum.reduceat(image, starts)
                fp[full, 0] = np.add.reduceat(mix64(values), starts)
                fp[full, 1] = np.add.reduceat(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), starts)
            bands = 2 * permutations // band
            keys = np.zeros((len(full), bands), np.uint64)
            for t in range(bands):
                h = np.full(len(full), t + 1, np.uint64)
                for c in range(band):
                    h = mix64(h * np.uint64(0x9FB21C651E98DF25) + sig[:, t * band + c])
                keys[:, t] = h
            lengths = np.zeros(n + 1, np.int32)
            lengths[1:][full] = bands
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array(size.astype(np.int64)),
                    pa.array(fp[:, 0].view(np.int64)),
                    pa.array(fp[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                ],
                names=["doc_id", "n_shingles", "fp", "fp2", "bands"],
            )

    return run


def _sets(width: int):
    def run(batches):
        import pyarrow as pa

        for b in _slices(batches):
            values, at = shingle_sets(*column_bytes(b.column("text")), width)
            raw = pa.py_buffer(np.ascontiguousarray(values).tobytes())
            offsets = pa.py_buffer((at * 8).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, raw])], names=["rep", "set"])

    return run


def _members(batches):
    """One row for each shingle of a set."""
    import pyarrow as pa

    for b in batches:
        for c in (b.slice(i, 500) for i in range(0, b.num_rows, 500)):
            data, at = column_bytes(c.column("set"))
            row = pa.array(np.repeat(np.arange(c.num_rows), np.diff(at) // 8))
            yield pa.RecordBatch.from_arrays([c.column("rep").take(row), pa.array(np.frombuffer(data.tobytes(), np.int64))], names=["rep", "tok"])


def prefix_pairs(sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different components that may reach ``percent``, by rarest shingles.

    ``sets(rep, n, set)``, ``comp(rep, component)``.  Every pair that reaches it is among them.
    """
    toks = cut(sets.mapInArrow(_members, "rep long, tok long"), "toks")
    shared = toks.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    common = toks.join(shared, "tok").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("t"))
    # Shingles of one set only come first in the order and join with nothing.
    known = common.join(sets.select("rep", "n"), "rep").withColumn("lone", F.col("n") - F.size("t"))
    reach = f"cast(n - ({percent} * n + 99) div 100 + 1 - lone AS int)"
    known = known.join(comp, "rep").where(f"{reach} > 0")
    post = cut(known.select("rep", "n", "component", "lone", F.expr(f"posexplode(transform(slice(t, 1, {reach}), x -> x.tok)) AS (p, tok)")).selectExpr("rep", "n", "component", "lone + p AS i", "tok"), "prefixes")
    sizes = post.groupBy("tok", "component").agg(F.count("*").alias("c"))
    most = sizes.groupBy("tok").agg(F.max_by("component", F.struct("c", "component")).alias("most"), F.count("*").alias("k")).where("k > 1").select("tok", "most")
    right = post.join(most, "tok")
    left = right.where("component <> most")  # a pair of two components has an end outside the largest
    right = right.selectExpr("tok", "rep AS b", "n AS m", "component AS other", "i AS j", "most AS same")
    need = f"({percent} * (n + m) + {99 + percent}) div {100 + percent}"
    room = f"least(n, m) * 100 >= {percent} * greatest(n, m) and 1 + least(n - i - 1, m - j - 1) >= {need}"
    pairs = left.join(right, "tok").where("component <> other and (other = same or rep < b)").where(room)
    return pairs.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _confirm(percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            left, right = b.column("left"), b.column("right")
            keep = np.zeros(b.num_rows, bool)
            last, x = None, None
            for i in range(b.num_rows):
                y = np.frombuffer(right[i].as_buffer(), np.uint64)
                if x is None or b.column("a")[i].as_py() != last:
                    last, x = b.column("a")[i].as_py(), np.frombuffer(left[i].as_buffer(), np.uint64)
                if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
                    continue
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                spot = np.searchsorted(large, small)
                spot[spot == len(large)] = 0
                both = int((large[spot] == small).sum())
                keep[i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, permutations: int = PERMUTATIONS, band: int = BAND) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets.
    Null, empty or wordless texts have no shingles and link with nothing.  Rows that repeat
    a doc_id are one document to the links and stay as rows.  A null doc_id links with
    nothing: its component is null and it is kept.  Other columns are ignored.
    A linked pair at the threshold is missed by all bands with probability 5e-6.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    sig = cut(src.mapInArrow(_signer(width, permutations, band), "doc_id long, n_shingles long, fp long, fp2 long, bands array<long>"), "sig")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    same = ["fp", "fp2", "n_shingles"]
    classes = cut(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "classes")
    hot = classes.where(F.col("c") > max(1, sig.count() // HOT_SHARE))  # at most HOT_SHARE rows
    keyed, hot = full.select("doc_id", *same), F.broadcast(hot.drop("c"))
    member = keyed.join(hot, same).unionByName(keyed.join(hot, same, "left_anti").join(classes.drop("c"), same))
    member = cut(member.select("doc_id", "rep", "n_shingles"), "member")
    reps = member.where("doc_id = rep").select("doc_id").distinct()
    rows = full.join(reps, "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("band")).distinct()
    crowd = rows.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    rows = cut(rows.join(crowd, "band", "left_semi"), "bands")
    needed = rows.select("rep").distinct()
    sets = src.withColumnRenamed("doc_id", "rep").join(needed, "rep", "left_semi").mapInArrow(_sets(width), "rep long, set binary")
    sets = cut(sets, "sets")

    def confirmed(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("rep").alias("a"), F.col("set").alias("left"))
        right = sets.select(F.col("rep").alias("b"), F.col("set").alias("right"))
        return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a long, b long"), "links")

    links, tested, comp = None, None, None
    fits = f"least(n, m) * 100 >= {int(percent)} * greatest(n, m)"
    for turn in range(STAR_ROUNDS + 1):
        at = rows if comp is None else rows.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        if turn < STAR_ROUNDS:
            if comp is None:
                lead = rows.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"))
                pairs = rows.join(lead, "band").where("rep <> lead.rep").select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), "n", F.col("lead.n").alias("m"))
            else:
                pivot = [F.min(F.struct(F.xxhash64("rep", F.lit(PIVOTS * turn + k)).alias("h"), "rep", "n", "component")) for k in range(PIVOTS)]
                leads = at.groupBy("band").agg(F.array(*pivot).alias("leads"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
                pairs = at.join(leads, "band").select("rep", "n", F.explode(F.expr("filter(leads, l -> l.component <> component)")).alias("lead"))
                pairs = pairs.select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), "n", F.col("lead.n").alias("m"))
        else:
            mixed = at.groupBy("band").agg(F.count("*").alias("c"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band", "c")
            left = at.join(mixed, "band")
            large = cut(left.where(F.col("c") > SMALL).select("rep", "n", "component").distinct(), "large")
            left = left.where(F.col("c") <= SMALL)
            right = left.select("band", F.col("rep").alias("a"), F.col("n").alias("m"), F.col("component").alias("other"))
            pairs = left.join(right, "band").where("a < rep and component <> other").where(fits).select("a", F.col("rep").alias("b"), "n", "m")
            far = prefix_pairs(sets.join(large.select("rep", "n"), "rep"), large.select("rep", "component"), percent)
            pairs = pairs.unionByName(far.withColumn("n", F.lit(1)).withColumn("m", F.lit(1)))
        pairs = pairs.where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        fresh = confirmed(pairs)
        links = fresh if links is None else links.unionByName(fresh)
        if comp is None or not fresh.isEmpty():
            comp = cut(components(links), "comp")
    by_doc = member.select("doc_id", "rep").distinct().join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    by_doc = by_doc.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    out = sig.select("doc_id", "n_shingles").join(by_doc, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
