"""Line deduplication by an exact set-similarity join, in SQL functions only.

A line is the set of its lower-cased words.  Words are ordered by rarity: their number of
occurrences over all documents, counted in a fixed number of buckets (so the table has a
proven size), then by hash.  Lines with equal sets (by 128 bits of hash) are one class, which
its earliest line stands for; groups of copies shrink to it before anything is shuffled.

The prefix filter takes neighbours in that order (above a similarity of two thirds): of two similar sets with ``a`` and ``b`` words
of their own, each own word parts one pair of common neighbours at most, so one of the first
``a + b + 1`` such pairs is whole in both, among the first ``2 + 2a + b`` words.  A class is posted
under each pair of neighbours of its prefix; two classes that meet go on if their sizes and the
positions leave room for the overlap needed.  Classes too small for any other set to be
similar are not posted.  Each posting first compares its classes with its lead, the one of most
copies.  What stays open in a small posting meets the earlier rest.  In a large one the lead's
words say nothing, so the same filter runs once more over the words by which a set and the lead
differ: sets as near to the lead as together to be similar need no comparison, all others share a
word of a prefix of these differences.  All is verified on the full sets.  A class goes if any
earlier one, kept or not, is similar.  Keys that seem to hold more than a thousandth of all
postings take a broadcast of their leads and never gather in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, unused

BUCKETS = 1 << 17
#: A key is hot if it holds more than one in so many postings; there are at most as many hot keys.
HOT_SHARE = 1000
#: Hot keys are looked for in one of so many classes; which keys are hot changes no result.
HOT_SAMPLE = 64
#: Postings that no key is hot below.
HOT_LEAST = 256
#: Members of a posting up to which its open classes meet the earlier rest as pairs; larger ones go by differences, with the same result.
SMALL = 32
LINE = ("d", "th", "ln")


def _folded(text) -> Column:
    """Lower-cased text with spaces for other white space but newlines: then a split needs no pattern."""
    text = F.col(text) if isinstance(text, str) else text
    # searched for as bytes, and before lower-casing: a pattern takes a string of it all, and a shared value is computed once for each use
    other = text.contains("\t") | text.contains("\x0b") | text.contains("\f") | text.contains("\r")
    return F.when(other, F.regexp_replace(F.lower(text), r"[\t\x0B\f\r]", " ")).otherwise(F.lower(text))


def _blank(line) -> Column:
    """Whether a line is white space only."""
    return F.ltrim(line, F.lit(" \t\x0b\f\r\n")) == ""


def _words(line) -> Column:
    return F.array_remove(F.split(line, " "), "")


def rarity(src: DataFrame, buckets: int = BUCKETS) -> Column:
    """A literal with one entry for each bucket: its words' occurrences on a logarithmic scale, 0 to 127.

    What reaches the driver is one count a bucket, whatever the size of the input.
    """
    words = src.select(F.explode(F.split(F.replace(_folded("text"), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = dict(words.groupBy(F.pmod(F.xxhash64("w"), F.lit(buckets)).alias("b")).count().collect())
    scale = (min(127, round(3 * math.log2(counts[b]))) if b in counts else 0 for b in range(buckets))
    return F.expr("cast(split('" + ",".join(map(str, scale)) + "', ',') AS array<tinyint>)")


def token_codes(line: str, scale: Column, buckets: int = BUCKETS) -> Column:
    """Sorted distinct codes of a folded line's words, rarest first: rarity in the top byte, 56 bits of hash below."""
    hashes = F.transform(_words(F.col(line)), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: _code(h, scale, buckets))))


def _code(h: Column, scale: Column, buckets: int) -> Column:
    rare = F.get(scale, F.pmod(h, F.lit(buckets)).cast("int")).cast("long")
    return F.shiftleft(rare, 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))


def _source(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))


def classes(src: DataFrame, scale: Column, percent: int, min_words: int) -> DataFrame:
    """``s, d, th, ln, n, p, copies``: per class its earliest line, size, prefix (empty if nothing else can be similar), lines."""
    lines = src.where("text <> ''").select("d", "th", F.posexplode(F.split(_folded("text"), "\n")).alias("ln", "line"))
    # A filter on the size of the codes would move below their projection and compute them twice.
    coded = lines.where(~_blank(F.col("line"))).withColumn("t", token_codes("line", scale))
    # a + b * percent / 100 is at most n * (100 - percent) / 100, so twice a and once b is at most ``own``.
    own = f"greatest(2 * {100 - percent} * size(t) div 100, {100 - percent} * size(t) div {percent})"
    prefix = F.expr(f"if({100 - percent} * size(t) >= {percent}, slice(t, 1, cast(2 + {own} AS int)), slice(t, 1, 0))")
    coded = coded.select(*LINE, F.size("t").alias("n"), F.xxhash64("t").alias("s"), F.xxhash64(F.lit(1), "t").alias("s2"), prefix.alias("p"))
    if min_words > 1:
        coded = coded.where(F.col("n") >= min_words)
    first = coded.groupBy("s", "s2").agg(F.min(F.struct(*LINE, "n", "p")).alias("e"), F.count("*").alias("copies"))
    return first.select("s", "e.*", "copies")


def _postings(reps: DataFrame) -> DataFrame:
    """``key, s, d, ln, n, i, copies``: one row per pair of neighbours in a prefix."""
    pairs = F.posexplode(F.expr("transform(slice(p, 2, size(p)), (y, i) -> xxhash64(p[i], y))")).alias("i", "key")
    return reps.where("size(p) > 1").select("s", "d", "ln", "n", "copies", pairs)


def line_matches(src: DataFrame, reps: DataFrame, scale: Column, percent: int) -> DataFrame:
    """``s`` of the classes that an earlier class is similar to.

    ``src`` is ``(d, th, text)`` and ``reps`` what ``classes`` makes of it.
    """
    post = _postings(reps)
    overlap = "least(i, i2) + 2 + least(n - i - 2, n2 - i2 - 2)"
    need = f"({percent} * (n + n2) + {99 + percent}) div {100 + percent}"
    fits = f"least(n, n2) * 100 >= {percent} * greatest(n, n2) and {overlap} >= {need}"
    # Near copies resemble the line they were made from, which most copies are of, more than each other.
    me, by = F.struct((-F.col("copies")).alias("few"), "d", "ln", "s", "n", "i"), Window.partitionBy("key")
    hot = _hot_keys(reps)
    if hot is not None:
        hot_rows = post.join(F.broadcast(hot), "key", "left_semi")
        led = cut(hot_rows.groupBy("key").agg(F.min(me).alias("lead"), F.count("*").alias("c")), "hot")
        hot_rows = hot_rows.join(F.broadcast(led), "key")
        post = post.join(F.broadcast(hot), "key", "left_anti")
    post = post.withColumn("c", F.count("*").over(by)).withColumn("lead", F.min(me).over(by)).where("c > 1")
    if hot is not None:
        post = post.unionByName(hot_rows)
    post = cut(post, "post")
    star = post.where("s <> lead.s").selectExpr("s", "n", "i", "lead.s AS led", "lead.n AS n2", "lead.i AS i2", "c")
    star = star.where(f"c > {SMALL} or ({fits})").groupBy("s", "led").agg(F.max(F.col("c") > SMALL).alias("wide"))
    star = cut(star, "pairs")
    apart = cut(_apart(star, reps, src, scale), "apart")
    done = cut(_near_lead(apart, percent), "done")
    few = post.where(f"c between 3 and {SMALL}")
    open_ = few.where("s <> lead.s").join(done, "s", "left_anti").select("key", "s", "d", "ln", "n", "i", F.col("lead.s").alias("first"))
    other = few.selectExpr("key", "s AS led", "d AS d2", "ln AS ln2", "n AS n2", "i AS i2")
    rest = open_.join(other, "key").where("led <> s and led <> first and struct(d2, ln2) <= struct(d, ln)").where(fits).select("s", "led")
    rest = cut(rest.unionByName(_by_differences(apart, done, percent)).distinct(), "rest")
    if not rest.isEmpty():
        near = _apart(rest.withColumn("wide", F.lit(False)), reps, src, scale).where(f"{100 + percent} * m <= {100 - percent} * (n + n2)")
        later = F.when(F.col("place") < F.col("place2"), F.col("led")).otherwise(F.col("s"))
        done = done.unionByName(cut(near.select(later.alias("s")).distinct(), "done"))
    for t in (post, star, apart, rest):
        discard(t)
    return done


def _apart(pairs: DataFrame, reps: DataFrame, src: DataFrame, scale: Column) -> DataFrame:
    """Per pair ``(s, led, wide)``: ``place`` and ``n`` of ``s``, the same of ``led``, and ``m``, the words that only one of both has.

    Where ``wide``, ``x`` holds these words: those that ``led`` lacks first, both parts rarest first.
    """
    ends = pairs.select(F.explode(F.array("s", "led")).alias("s")).distinct()
    at = reps.select("s", *LINE).join(ends, "s").groupBy("d", "th").agg(F.collect_list(F.struct("ln", "s")).alias("at"))
    full = src.join(at, ["d", "th"]).select("d", "th", "at", F.split(_folded("text"), "\n").alias("parts"))
    full = full.select("d", "th", F.explode(F.transform("at", lambda e: F.struct(e["ln"].alias("ln"), e["s"].alias("s"), F.get("parts", e["ln"]).alias("line")))).alias("e"))
    full = full.select("d", "th", "e.*").dropDuplicates(["s", *LINE]).withColumn("t", token_codes("line", scale))
    full = cut(full.select("s", F.struct(*LINE).alias("place"), "t"), "sets")
    both = pairs.join(full, "s").join(full.toDF("led", "place2", "t2"), "led")
    both = both.withColumn("x", F.concat(F.array_except("t", "t2"), F.array_except("t2", "t")))
    return both.select("s", "led", "wide", "place", "place2", F.size("t").cast("long").alias("n"), F.size("t2").cast("long").alias("n2"), F.size("x").cast("long").alias("m"), F.when(F.col("wide"), F.col("x")).alias("x"))


def _near_lead(apart: DataFrame, percent: int) -> DataFrame:
    """``s`` of the classes, leads among them, that have an earlier one of the same lead so near that both must be similar.

    Two sets are similar if the words that only one of them has are at most ``100 - percent`` for each
    ``100 + percent`` of both sizes; of two sets, these are no more than what both differ from the lead by.
    So each set has a debt, and two whose debts add up to nothing or less are similar.
    """
    debt = f"{100 + percent} * m - {100 - percent} * n AS debt"
    members = apart.selectExpr("s", "led", "place", "n", debt)
    leads = apart.groupBy("led").agg(F.min("place2").alias("place"), F.min("n2").alias("n")).selectExpr("led AS s", "led", "place", "n", f"{percent - 100} * n AS debt")
    members = members.unionByName(leads).where(f"{percent} * debt <= {100 * (100 - percent)} * n")
    first = members.groupBy("led", "debt").agg(F.min("place").alias("place2")).withColumnRenamed("debt", "debt2").withColumnRenamed("led", "of")
    earlier = (F.col("led") == F.col("of")) & (F.col("debt") + F.col("debt2") <= 0) & (F.col("place2") < F.col("place"))
    return members.join(first, earlier, "left_semi").select("s").distinct()


def _steps(apart: DataFrame, percent: int) -> DataFrame:
    """``led, w, s, place, n, m, i``: a row per word of the prefix of each difference from the lead.

    Similar sets of ``n`` and any size differ by ``own = n * (100 - percent) / percent`` words at most, so
    their differences from the lead share all but ``own`` of either, and one word unless ``_near_lead`` decides.
    """
    own = f"{100 - percent} * n div {percent}"
    prefix = f"slice(x, 1, cast(m - greatest(1, m - {own}) + 1 AS int))"
    return apart.where("m > 0").select("led", "s", "place", "n", "m", F.posexplode(F.expr(prefix)).alias("i", "w"))


def _by_differences(apart: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """``s, led``: open classes of large postings with earlier ones of the same lead whose differences from it may share enough."""
    wide = apart.where("wide")
    open_ = wide.join(done, "s", "left_anti")
    other = wide.join(open_.groupBy("led").agg(F.max("place").alias("last")), "led").where("place < last")
    other = _steps(other, percent).selectExpr("led AS of", "w AS w2", "s AS s2", "place AS place2", "n AS n2", "m AS m2", "i AS i2")
    most = f"{100 - percent} * (n + n2) div {100 + percent}"
    room = f"2 * (1 + least(m - i - 1, m2 - i2 - 1)) >= m + m2 - {most}"
    both = _steps(open_, percent).join(other, (F.col("led") == F.col("of")) & (F.col("w") == F.col("w2")) & (F.col("place2") < F.col("place")))
    return both.where(f"least(n, n2) * 100 >= {percent} * greatest(n, n2) and {room}").select("s", F.col("s2").alias("led"))


def _hot_keys(reps: DataFrame) -> DataFrame | None:
    """The keys that hold more than a ``HOT_SHARE``-th of the postings looked at: at most ``HOT_SHARE`` rows."""
    sizes = _postings(reps.where(F.pmod("s", F.lit(HOT_SAMPLE)) == 0)).groupBy("key").count()
    total = sizes.agg(F.sum("count")).first()[0] or 0
    hot = sizes.where(F.col("count") > max(HOT_LEAST // HOT_SAMPLE, total // HOT_SHARE)).select("key")
    return None if hot.isEmpty() else cut(hot, "hot")


def dedup_lines(docs: DataFrame, percent: int = 90, min_words: int = 1) -> DataFrame:
    """All columns of ``docs(doc_id, text, ...)`` with ``text`` freed of later similar lines, and ``n_lines``, ``n_removed``.

    Lines are what newlines separate; order is by doc_id, text hash and line.  Lines without
    words, or with fewer than ``min_words`` different ones, stay.  Null and empty texts stay as
    they are and have no lines.  Rows that repeat both id and text are one document: all get
    the same text.  Rows without id come last in the order.  Extra columns, whatever their
    names, are kept; columns called n_lines or n_removed are replaced.  A table without rows
    gives none.  ``percent`` is 67 to 100: similar sets surely share a pair of neighbours only
    above a similarity of two thirds, so lower ones are refused.
    """
    if not 67 <= percent <= 100:
        raise ValueError(f"percent has to be 67 to 100, not {percent}")
    src = _source(docs)
    scale = rarity(src)
    reps = cut(classes(src, scale, percent, min_words), "classes")
    kept = reps.join(line_matches(src, reps, scale, percent), "s", "left_anti")
    extra = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d, th, stay, parts, rows = unused(docs, "d", "th", "stay", "parts", "rows")
    kept = kept.groupBy(F.col("d").alias(d), F.col("th").alias(th)).agg(F.collect_list("ln").alias(stay))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select(*extra, F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias(d), F.xxhash64(text).alias(th))
    out = out.join(kept, [d, th], "left").withColumn(parts, F.split(text, "\n"))
    few = _blank if min_words == 1 else (lambda x: F.size(F.array_distinct(_words(_folded(x)))) < min_words)
    free = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: few(F.get(parts, i)))
    out = out.withColumn(rows, F.sort_array(F.concat(F.coalesce(stay, F.array().cast("array<int>")), free)))
    whole = (text == "") | (F.size(rows) == F.size(parts))
    left = F.array_join(F.transform(rows, lambda i: F.get(parts, i)), "\n")
    n = F.when(text == "", 0).otherwise(F.size(parts)).cast("long")
    out = out.withColumns({"n_lines": n, "n_removed": F.when(whole, 0).otherwise(F.size(parts) - F.size(rows)).cast("long"), "text": F.when(whole, F.col("text")).otherwise(left)})
    return out.select(*extra, "n_lines", "n_removed")
