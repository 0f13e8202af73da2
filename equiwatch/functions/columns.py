"""Column-level building blocks (all JVM-side expressions, no Python UDFs).

Every function returns a ``Column`` and can be used in ``select``/``withColumn``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the monitored application's rules.
# ---------------------------------------------------------------------------
# Boolean-like spellings accepted by the cleaning step (after trim + lower).
TRUTHY = ("1", "true", "t", "yes", "y", "ready", "cleared", "pass", "passed")
FALSY = ("0", "false", "f", "no", "n", "not ready", "uncleared", "fail", "failed")
# Age bins: right-closed, lowest edge included.
AGE_EDGES = (0, 18, 22, 26, 30, 35, 120)
AGE_LABELS = ("<=18", "19-22", "23-26", "27-30", "31-35", "36+")
# Raw values accepted in a binary target column.
BINARY_TARGET_VALUES = ("0", "1", "true", "false")
# Spellings read as missing in text input (pandas' usual NA strings).
NA_STRINGS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>")

# Number syntax accepted by the numeric coercion: optional sign, digits with an
# optional fraction (or a bare fraction), optional exponent; or inf/infinity.
NUMERIC_PATTERN = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)$"


#: Every character that counts as white space (tabs, newlines, no-break spaces, ...).
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def strip(c: Column) -> Column:
    """Text without white space at either end."""
    return F.trim(c, F.lit(WHITE_SPACE))


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: str | Column) -> Column:
    """NaN becomes NULL (Spark sorts NaN above every number; pandas calls it missing)."""
    c = col_of(c)
    return F.when(~F.isnan(c), c)


def safe_rate(num: Column, den: Column) -> Column:
    """num/den as double, 0.0 when the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound to [lo, hi]; NULL stays NULL (``greatest``/``least`` would skip it)."""
    c = col_of(c)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def null_group_label(c: str | Column, label: str = "Unknown") -> Column:
    """Group value as text, missing → ``label``."""
    return F.coalesce(col_of(c).cast("string"), F.lit(label))


def bin_column(c: str | Column, edges: Sequence[float] = AGE_EDGES,
               labels: Sequence[str] = AGE_LABELS) -> Column:
    """Right-closed bins with the lowest edge included; outside or missing → NULL."""
    if len(labels) != len(edges) - 1:
        raise ValueError("need one label per bin")
    c = col_of(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = ((c >= lo) if i == 0 else (c > lo)) & (c <= hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def hash_draw(key: str | Column, seed: int) -> Column:
    """Deterministic uniform draw in [0, 1) from a row key and a seed.

    ``md5(key:seed)``'s first 32 bits / 2^32 — reproducible on any engine that
    has md5, independent of partitioning and task retries.
    """
    text = F.concat(col_of(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def boolish_value(c: str | Column) -> Column:
    """trim+lower text → 1 / 0 / NULL."""
    low = F.lower(strip(col_of(c).cast("string")))
    return (F.when(low.isin(*TRUTHY), F.lit(1))
             .when(low.isin(*FALSY), F.lit(0)))


def is_boolish(c: str | Column) -> Column:
    low = F.lower(strip(col_of(c).cast("string")))
    return F.coalesce(low.isin(*(TRUTHY + FALSY)), F.lit(False))


def numeric_text(c: str | Column) -> Column:
    """Text with ``$``, ``,``, ``%`` and outer blanks removed."""
    # ``translate`` with an empty replacement deletes the characters (no regex).
    return strip(F.translate(col_of(c).cast("string"), "$,%", ""))


def parse_number(c: str | Column) -> Column:
    """Strict text → double: NULL unless the cleaned text is a plain number.

    Spark's own cast accepts ``12d``, ``5f`` and ``nan``; the guard rejects them.
    """
    s = numeric_text(c)
    return F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))


def to_label(c: str | Column) -> Column:
    """Label text/number → int 0/1-ish: boolish first, then number, missing → 0."""
    c = col_of(c)
    b = boolish_value(c)
    num = parse_number(c)
    return F.coalesce(b.cast("double"), num, F.lit(0.0)).cast("int")


def epoch_seconds(c: str | Column) -> Column:
    """Timestamp (with or without zone) → seconds since epoch as double; NULL stays NULL."""
    return F.unix_micros(col_of(c).cast("timestamp")).cast("double") / F.lit(1e6)


def sanitize_nonfinite(c: str | Column) -> Column:
    """NaN / ±inf → 0.0 (the encoded-matrix rule); NULL stays NULL."""
    c = col_of(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def linear_score(terms: Sequence[tuple]) -> Column:
    """Weighted sum of terms.

    Each term is ``(kind, column, weight, *args)``:

    * ``("raw", c, w)``            → w·c
    * ``("inv", c, w, top)``       → w·(top − c)
    * ``("ratio", c, w, k)``       → w·clip(c/k, 0, 1)
    * ``("eq", c, w, value)``      → w·(c = value)   (category offset)
    * ``("in", c, w, values)``     → w·(c ∈ values)
    """
    total = F.lit(0.0)
    for term in terms:
        kind, c, w = term[0], col_of(term[1]), float(term[2])
        if kind == "raw":
            part = c.cast("double")
        elif kind == "inv":
            part = F.lit(float(term[3])) - c.cast("double")
        elif kind == "ratio":
            part = clip(c.cast("double") / F.lit(float(term[3])), 0.0, 1.0)
        elif kind == "eq":
            part = F.when(c == F.lit(term[3]), F.lit(1.0)).otherwise(F.lit(0.0))
        elif kind == "in":
            part = F.when(c.isin(*term[3]), F.lit(1.0)).otherwise(F.lit(0.0))
        else:
            raise ValueError(f"unknown term kind {kind!r}")
        total = total + part * F.lit(w)
    return total


def threshold_label(score: Column, threshold: float) -> Column:
    """``score >= threshold`` as 0/1 (missing → 0)."""
    return F.coalesce((score >= F.lit(threshold)).cast("int"), F.lit(0))
