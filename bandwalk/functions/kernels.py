"""Vector and label kernels as Spark SQL expressions.

Sums run left to right in double precision; storage stays float.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def squared_l2(a, b) -> Column:
    """Sum of squared differences of two numeric arrays."""
    return _fold(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a, b) -> Column:
    return _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_norm(a) -> Column:
    return _fold(F.transform(a, lambda x: x.cast("double") * x.cast("double")))


def partial_distance(x, q) -> Column:
    """``|x|^2 - 2 x.q``: orders like the distance to ``q`` within one query, may be negative."""
    return squared_norm(x) - 2 * dot(x, q)


def quantise(a, scale: float = 127.0) -> Column:
    """Components as signed bytes."""
    return F.transform(a, lambda x: F.round(x.cast("double") * scale).cast("tinyint"))


def jump_level(gap) -> Column:
    """``floor(log2(gap))``, 0 for gaps 0 and 1, at most 30."""
    return F.least(F.lit(30), F.length(F.bin(F.greatest(gap, F.lit(1)))) - 1)


def grid_coordinate(v, lo, hi, cells: int) -> Column:
    """Cell of ``v`` in a regular grid over ``[lo, hi]``."""
    clamped = F.greatest(lo, F.least(hi, v))
    return F.least(F.lit(cells - 1), F.floor((clamped - lo) * cells / (hi - lo + 1))).cast("long")


def box_between(a, b, c) -> Column:
    """Whether ``b`` lies between ``a`` and ``c`` (column names)."""
    return F.col(b).between(F.least(a, c), F.greatest(a, c))


def seed_string(ids) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ";")


def selectivity_of(tag) -> Column:
    """A share from a label: a number before ``pct`` is percent; else one after ``sel`` or ``selectivity``, percent if over 1; else null.

    ``p`` and ``_`` between digits are decimal points: ``q2_sel0p5pct`` is 0.005.
    """
    text = F.regexp_replace(F.lower(tag), r"(?<=\d)[p_](?=\d)", ".")
    percent = F.regexp_extract(text, r"(\d+\.?\d*) *pct", 1).try_cast("double")
    share = F.regexp_extract(text, r"sel(?:ectivity)?[-_]?(\d+\.?\d*)", 1).try_cast("double")
    return F.when(percent.isNotNull(), percent / 100).when(share > 1, share / 100).otherwise(share)


def clean_label(label) -> Column:
    """Letters, digits, ``_``, ``.`` and ``-``; what lies between becomes one ``_``, none at the ends; ``range`` if nothing is left, null for a blank."""
    text = F.trim(label)
    kept = F.btrim(F.regexp_replace(text, r"[^\w.\-]+", "_"), F.lit("_"))
    return F.when(text == "", F.lit(None)).when(kept == "", "range").otherwise(kept)


def selectivity_tag(share, places: int | None = None) -> Column:
    """``sel10pct`` for 0.1, ``sel0p5pct`` for 0.005: whole percent, else three significant digits, from 1000 on with an exponent; null for null.

    With ``places`` percent has at most that many decimals instead.  Digits are rounded as C's ``printf`` rounds the double itself.
    """

    def text(p: float) -> str:
        if places is not None:
            return re.sub(r"\.?0+$", "", f"{p:.{places}f}") if places else f"{p:.0f}"
        return str(round(p)) if math.isfinite(p) and abs(p - round(p)) < 1e-9 else f"{p:.3g}"

    @F.pandas_udf("string")
    def tag(percent: pd.Series) -> pd.Series:
        return percent.map(lambda p: f"sel{text(p)}pct".replace(".", "p"), na_action="ignore")

    return tag(share * 100)
