"""License scan by a positional rare-token index, in SQL functions only.

Templates are short word lists.  One pass counts in how many documents each template word
occurs; each template is then indexed under its words of highest inverse document frequency.
A document that holds none of the indexed words is done after one regular expression.  The
others list the places of their indexed words once; a place and the word's place in a
template give a relative position, and the positions from several words are united, so that a
copy which changed one rare word is not lost.  At each position the words are compared, and the mandatory key phrase has to stand whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words before A-Z are folded.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """``words`` to find; ``key`` (start, end) must stand whole; ``share`` of words that must agree."""

    label: str
    words: tuple[str, ...]
    key: tuple[int, int] = (0, 0)
    share: float = 1.0
    base: bool = False
    anchors: tuple[int, ...] = field(default=())


def _t(label: str, text: str, key: str = "", share: float = 1.0, base: bool = False) -> Template:
    words, wanted = tuple(text.split()), tuple(key.split())
    at = next(i for i in range(len(words)) if words[i : i + len(wanted)] == wanted)
    return Template(label, words, (at, at + len(wanted)), share, base)


#: Phrases that decide the base labels.
BASE = (
    _t("mit", "under the mit license", base=True),
    _t("apache-2", "apache license version 2", base=True),
    _t("cc-by-nc", "cc by nc", base=True),
)
#: Notices the index also finds when some words differ, as long as the key phrase stands.
NOTICES = (
    _t("mit", "released under the mit license", "mit license", 0.8),
    _t("apache-2", "licensed under the apache license version 2 0", "apache license", 0.75),
    _t("cc-by-nc", "licensed under cc by nc 4 0", "by nc", 0.7),
    _t("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa", 0.7),
    _t("cc-by", "licensed under cc by 4 0", "cc by 4", 0.7),
    _t("gpl-3", "this work is licensed under the gnu general public license version 3", "general public license version 3", 0.75),
    _t("gpl-2", "this work is licensed under the gnu general public license version 2", "general public license version 2", 0.75),
    _t("lgpl", "licensed under the gnu lesser general public license", "lesser general public license", 0.7),
    _t("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms", 0.7),
    _t("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", 0.7),
)


def _quoted(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def indexed(docs: DataFrame, templates=BASE + NOTICES, rare: int = 3) -> list[Template]:
    """Templates with the places of their ``rare`` words of highest IDF over all of ``docs``.

    What reaches the driver is one count for each template word.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    words = F.split(F.lower("text"), GAP)
    seen = docs.select(F.explode(F.array_intersect(F.expr(_quoted(vocabulary)), words)).alias("word"))
    df = dict(seen.groupBy("word").count().collect())
    idf = {w: -math.log1p(df.get(w, 0)) for w in vocabulary}
    out = []
    for t in templates:
        order = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], i))
        out.append(Template(t.label, t.words, t.key, t.share, t.base, tuple(order[: 1 if t.base else rare])))
    return out


def scan_licenses(docs: DataFrame, templates=BASE + NOTICES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places`` per row.

    Words are runs without ASCII gaps, A-Z folded.  Null and empty texts have none.
    ``n_base`` counts every place of every base phrase; ``places`` lists
    ``(label, start, share, base)`` of all finds.  A document without finds has empty
    labels, null places of words and score 0.  Rows are independent of each other, so
    repeated rows and null ids need no rule.  Other columns are ignored.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    index = indexed(src, templates)
    lookup = sorted({t.words[i] for t in index for i in t.anchors})
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    some = F.col("text").rlike("(?i)" + "|".join(lookup))
    src = src.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long"))
    src = src.withColumn("w", F.when(some, F.array_remove(F.split(folded, GAP), "")))
    hits = f"filter(transform(w, (x, i) -> struct(x AS word, i AS at)), h -> array_contains({_quoted(lookup)}, h.word))"
    src = src.withColumn("hits", F.expr(hits))
    finds = []
    for t in index:
        n, words = len(t.words), _quoted(t.words)
        places = "array_distinct(concat(" + ", ".join(f"transform(filter(hits, h -> h.word = '{t.words[i]}'), h -> h.at - {i})" for i in t.anchors) + "))"
        agree = f"aggregate(sequence(0, {n - 1}), 0, (a, i) -> a + if(coalesce(get(w, s + i) = get({words}, i), false), 1, 0))"
        lo, hi = t.key
        key = f"slice(w, s + {lo} + 1, {hi - lo}) = {_quoted(t.words[lo:hi])}" if hi > lo else "true"
        reach = f"s + {lo if hi > lo else 0} >= 0 AND s + {hi if hi > lo else n} <= size(w)"
        found = f"filter(transform(filter({places}, s -> {reach}), s -> struct('{t.label}' AS label, cast(greatest(s, 0) AS bigint) AS start, if({key}, {agree}, 0) / {float(n)}D AS share, {str(t.base).lower()} AS base)), f -> f.share >= {t.share})"
        finds.append(found)
    src = src.withColumn("places", F.expr("coalesce(if(size(hits) > 0, concat(" + ", ".join(finds) + "), NULL), array())"))
    return src.selectExpr(
        "doc_id",
        "n_words",
        "cast(size(filter(places, p -> p.base)) AS bigint) AS n_base",
        "array_min(transform(filter(places, p -> p.base), p -> p.start)) AS first_word",
        "array_max(transform(filter(places, p -> p.base), p -> p.start)) AS last_word",
        "array_join(array_sort(array_distinct(transform(filter(places, p -> p.base), p -> p.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',') AS labels",
        "coalesce(array_max(transform(places, p -> p.share)), 0D) AS score",
        "places",
    )
