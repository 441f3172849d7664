"""What each of five quality filters removes, alone and in every order.

Texts are scanned as Arrow buffers: byte classes by table, prefix sums for words, capitals,
code points and symbols, and for distinct words the sorted 64-bit hashes of each document's
words, where equal neighbours count as equal only if their bytes are.  A document is then
five bits, and every figure of the audit is a sum of document counts over sets of bits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, column_bytes, pieces_of, prefix_hash, range_hash

FILTERS = "ABCDE"
SLICE = 1 << 20


@dataclass(frozen=True)
class Limits:
    """A: fewer words; B: fewer distinct words per hundred; C: more capitals per hundred code points; D: any of these symbols."""

    least_words: int = 200
    distinct_percent: int = 50
    capital_percent: int = 2
    symbols: str = "#$%&*|"


_CAPITAL, _POINT = np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = True
_POINT[0x80:0xC0] = False  # continuation bytes


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; a word ends with its row."""
    space = _SPACE[data]
    gap_before, gap_after = np.ones(len(data), bool), np.ones(len(data), bool)
    gap_before[1:], gap_after[:-1] = space[:-1], space[1:]
    gap_before[offsets[offsets < len(data)]] = True
    gap_after[offsets[offsets > 0] - 1] = True
    return np.flatnonzero(~space & gap_before), np.flatnonzero(~space & gap_after) + 1


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """By slices that no word crosses; a word longer than a slice is hashed by itself."""
    out, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        lo, hi = start[i], end[j - 1]
        if hi - lo > SLICE:
            out[i] = int.from_bytes(hashlib.blake2b(data[lo:hi].tobytes(), digest_size=8).digest(), "little")
        else:
            out[i:j] = range_hash(prefix_hash(data[lo:hi]), start[i:j] - lo, end[i:j] - lo)
        i = j
    return out


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` and from ``b`` are equal: eight at a time."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    same, left = np.ones(len(a), bool), np.arange(len(a))
    for k in range(0, int(size.max(initial=0)), 8):
        left = left[(size[left] > k) & same[left]]
        if not len(left):
            break
        n = np.minimum(size[left] - k, 8).astype(np.uint64)
        mask = ~np.uint64(0) >> (np.uint64(64) - n * np.uint64(8))
        same[left] = (eight[a[left] + k] ^ eight[b[left] + k]) & mask == 0
    return same


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of every row."""
    start, end = word_spans(data, offsets)
    first = np.searchsorted(start, offsets)
    n = np.diff(first)
    row, hashes = np.repeat(np.arange(len(n)), n), _word_hashes(data, start, end)
    order = np.lexsort((hashes, row))
    a, b = order[:-1], order[1:]
    equal = np.flatnonzero((hashes[a] == hashes[b]) & (row[a] == row[b]))
    a, b = a[equal], b[equal]
    size = end - start
    true = size[a] == size[b]
    true[true] = _same_bytes(data, start[a][true], start[b][true], size[a][true])
    distinct = n - np.bincount(row[b], minlength=len(n))
    for r in np.unique(row[b[~true]]).tolist():  # two words with one hash: count this row by its words
        distinct[r] = len({data[s:e].tobytes() for s, e in zip(start[first[r] : first[r + 1]], end[first[r] : first[r + 1]], strict=True)})
    return n, distinct


def _scanner(limits: Limits):
    symbol = np.zeros(256, bool)
    symbol[list(limits.symbols.encode("ascii"))] = True

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            fails, digests = np.zeros(batch.num_rows, np.int32), []
            for i, j in pieces_of(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                n, distinct = words_of(part, at)
                tests = (
                    n < limits.least_words,
                    100 * distinct < limits.distinct_percent * n,
                    100 * _per_row(_CAPITAL[part], at) > limits.capital_percent * _per_row(_POINT[part], at),
                    _per_row(symbol[part], at) > 0,
                )
                for bit, t in enumerate(tests):
                    fails[i:j] |= t.astype(np.int32) << bit
                digests += [hashlib.sha256(part[at[k] : at[k + 1]]).digest() for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(fails, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "fails", "digest"])

    return run


def document_fails(docs: DataFrame, part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """``doc_id, part, fails, digest``: bits 0 to 3 of ``fails`` for filters A to D, and SHA-256 of the text."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    return src.mapInArrow(_scanner(limits), "doc_id long, part string, fails int, digest binary")


def fail_counts(docs: DataFrame, labels: DataFrame, part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """``part, fails, n, good, toxic``: documents by the set of filters they fail, with E as bit 4.

    A document fails E if its text is that of a smaller ``doc_id`` anywhere.  Copies are first
    summed by text, part, set and labels, so a group of copies of any size is a few rows when
    its smallest id is found.
    """
    each = document_fails(docs, part, limits)
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = each.join(known, "doc_id", "left").fillna(0, ["quality", "toxic"])
    kinds = ("digest", "part", "fails", "quality", "toxic")
    rows = rows.groupBy("doc_id", *kinds).agg(F.count("*").alias("n"))  # rows of one id together
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")
    copies = rows.groupBy(*kinds).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), first)
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    copies = copies.withColumn("fresh", F.col("nameless") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0))
    split = F.array(F.struct(F.col("fails").alias("fails"), F.col("fresh").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("fresh")).alias("n")))
    sets = copies.select("part", "quality", "toxic", F.inline(split)).where("n > 0")
    return sets.groupBy("part", "fails").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("quality")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source", limits: Limits = Limits()) -> DataFrame:
    """One row per part, order of the five filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    ``docs(doc_id, text, <part>)`` and ``labels(doc_id, quality, toxic)``.  A null text is
    empty, a null part the empty string.  Rows are counted one by one: repeated rows of one id
    are no copies of each other, but fail E beside a smaller id; a row without id neither fails
    E nor makes another fail.  Several labels of an id count as one, 1 if any is 1; an id without
    labels is neither good nor toxic.  An empty table gives no rows.  Other columns, of any name,
    are ignored.
    """
    sets = fail_counts(docs, labels, part, limits)
    table = sets.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("fails", F.struct("n", "good", "toxic")))).alias("by"))  # at most 32 sets
    masks = [F.lit(m) for m in range(1 << len(FILTERS))]
    counts = lambda c: F.array(*[F.coalesce(F.col("by")[m][c], F.lit(0).cast("long")) for m in masks]).alias(c)
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order):
            bit = 1 << FILTERS.index(f)
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    each = table.select("part", counts("n"), counts("good"), counts("toxic")).select("*", F.inline(F.array(*steps)))

    def total(column: str, test: str, weight: str = "1") -> F.Column:
        return F.expr(f"aggregate(sequence(0, 31), 0L, (acc, m) -> acc + if({test}, {column}[m] * {weight}, 0L))")

    here = "m & before = 0 and m & bit <> 0"
    return each.select(
        "part",
        "filter_order",
        "step",
        total("n", "m & (before | bit) = 0").alias("kept"),
        total("n", here).alias("removed"),
        total("n", "m & before <> 0 and m & bit <> 0").alias("redundant"),
        total("n", "m = bit").alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        total("n", "m & bit <> 0", "(120 div bit_count(m))").alias("shapley"),  # of 120 orders, those where the filter is the first to fail
    )
