"""CSV source: header + inferred types, UTF-8 or latin-1 by its bytes, NA spellings → NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NA_STRINGS, NUMERIC_PATTERN
from .tables import normalize_missing

INTEGER_PATTERN = r"^\s*[+-]?\d{1,18}\s*$"

SUPPORTED = (".csv",)


def check_extension(path: str) -> None:
    """Only CSV (any case) is accepted; a folder of CSV part files is too (a last
    path segment without an extension, on any file system)."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if "." not in last or last.startswith("."):
        return
    if not last.lower().endswith(SUPPORTED):
        raise ValueError("Unsupported file type. Provide a .csv file")


def _read(spark: SparkSession, path: str, encoding: str, schema: T.StructType | None,
          sampling_ratio: float, multiline: bool) -> DataFrame:
    r = (spark.read.option("header", True).option("encoding", encoding).option("mode", "PERMISSIVE")
         .option("escape", '"').option("multiLine", multiline))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True).option("samplingRatio", sampling_ratio)
    return r.csv(path)


def na_to_null(df: DataFrame) -> DataFrame:
    """Text cells spelled like a missing value become NULL; NaN → NULL on doubles."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            cols.append(F.when(~c.isin(*NA_STRINGS), c).alias(f.name))
        else:
            cols.append(c)
    return normalize_missing(df.select(*cols))


def refine_types(df: DataFrame) -> DataFrame:
    """After NA spellings became NULL, a text column whose non-null values are all
    integers becomes ``long``, all numbers ``double`` (one aggregate pass).
    Spark inferred ``string`` for such columns because of the NA text."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return df
    aggs = []
    for i, c in enumerate(text):
        v = F.trim(F.col(f"`{c}`"))
        aggs += [F.count(F.col(f"`{c}`")).alias(f"n{i}"),
                 F.count_if(v.rlike(INTEGER_PATTERN)).alias(f"i{i}"),
                 F.count_if(v.rlike(NUMERIC_PATTERN)).alias(f"d{i}")]
    row = df.agg(*aggs).first()
    casts = {}
    for i, c in enumerate(text):
        n = row[f"n{i}"]
        if n and row[f"i{i}"] == n:
            casts[c] = "long"
        elif n and row[f"d{i}"] == n:
            casts[c] = "double"
    if not casts:
        return df
    return df.select(*[F.trim(F.col(f"`{f.name}`")).cast(casts[f.name]).alias(f.name) if f.name in casts
                       else F.col(f"`{f.name}`") for f in df.schema.fields])


def raw_facts(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """(all bytes are valid UTF-8, a quoted cell holds a line end): one distributed pass over the raw lines.

    Quotes inside a cell are doubled, so a line has an odd number of them only where
    a cell goes on in the next line or comes from the one before.
    """
    quotes = F.length("value") - F.length(F.translate("value", '"', ""))
    row = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")), F.bool_or(quotes % 2 == 1)).first()
    return row[0] is not False, bool(row[1])


def read_csv_infer(spark: SparkSession, path: str, schema: T.StructType | None = None,
                   sampling_ratio: float = 1.0, multiline: bool | None = None) -> DataFrame:
    """Read CSV as UTF-8, or as ISO-8859-1 where its bytes aren't valid UTF-8.

    Quotes inside a quoted cell are doubled.  Where a quoted cell holds a line end, a
    file is read in one split (``multiline``); by default the bytes tell, and files
    without such cells are split.  ``sampling_ratio`` < 1 limits the type inference pass."""
    check_extension(path)
    utf8, spans = raw_facts(spark, path)
    encoding, multiline = "UTF-8" if utf8 else "ISO-8859-1", spans if multiline is None else multiline
    out = na_to_null(_read(spark, path, encoding, schema, sampling_ratio, multiline))
    return refine_types(out) if schema is None else out
