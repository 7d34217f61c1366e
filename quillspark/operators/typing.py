"""Stringly-typed storage and type restoration.

The source system stores silver / gold / stream bronze with every column as text and
re-types on read. ``stringify`` reproduces that text form (Python spellings: ``True``/``False``,
``nan`` for missing); ``restore_types`` parses it back with bad values -> null (never an error
under ANSI), so typed and text-typed layers can be mixed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.exprs import py_float_text

MISSING = "nan"


def stringify(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            txt = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            txt = py_float_text(f.name)
        elif isinstance(f.dataType, T.DateType):
            txt = F.date_format(c, "yyyy-MM-dd")
        else:
            txt = c.cast("string")
        cols.append(F.coalesce(txt, F.lit(MISSING)).alias(f.name))
    return df.select(*cols)


def restore_types(df: DataFrame, spec: Mapping[str, str]) -> DataFrame:
    """``spec``: column -> one of double, long, int, decimal(p,s), date, timestamp, boolean, string."""
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        kind = spec.get(name, "string")
        missing = c.isNull() | (c == MISSING) | (c == "None") | (c == "NaT")
        if kind == "boolean":
            val = F.when(c == "True", F.lit(True)).when(c == "False", F.lit(False))
        elif kind == "date":
            val = F.try_to_date(c, "yyyy-MM-dd")
        elif kind == "timestamp":
            val = F.try_to_timestamp(c)
        elif kind == "string":
            val = c
        else:
            val = F.expr(f"try_cast(`{name}` as {kind})")
            if kind in ("double", "float"):
                val = F.when(F.isnan(val), F.lit(None)).otherwise(val)
        out.append(F.when(missing, F.lit(None)).otherwise(val).cast(kind if kind != "string" else "string").alias(name))
    return df.select(*out)
