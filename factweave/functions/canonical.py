"""One text for equal values: JSON with sorted names at every depth, single spaces and eight digits, built from the schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Digits after the point. Fixed value.
DIGITS = 8


def _quoted(c: Column) -> Column:
    """A text as JSON."""
    array = F.to_json(F.array(c))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def text(c: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a column of this type. Missing values are null; a variant has its names sorted, its strings and numbers stay as they are."""
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"\"{f.name}\":"), text(c[f.name], f.dataType)) for f in sorted(kind, key=lambda f: f.name)]
        body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: text(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_quoted(e["key"].cast("string")).alias("k"), text(e["value"], kind.valueType).alias("v"))))
        body = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(":"), e["v"])), ","), F.lit("}"))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        body = (F.round(c.cast("double"), DIGITS) + F.lit(0.0)).cast("string")  # no minus zero
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        body = _quoted(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        body = c.cast("string")
    elif isinstance(kind, T.VariantType):
        body = F.to_json(c)
    else:
        body = _quoted((F.unix_micros(c) if isinstance(kind, T.TimestampType) else F.base64(c) if isinstance(kind, T.BinaryType) else c).cast("string"))
    return F.when(c.isNull(), F.lit("null")).otherwise(body)


def row_text(df: DataFrame, **fields: Column) -> Column:
    """Canonical JSON of an object of columns of ``df``."""
    kinds = df.select(*[c.alias(n) for n, c in fields.items()]).schema
    parts = [F.concat(F.lit(f'"{n}":'), text(fields[n], kinds[n].dataType)) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def op_key(df: DataFrame, kind: Column, **payload: Column) -> Column:
    """SHA-256 of an operation's kind and payload (columns of ``df``): equal payloads share it in any order of names, spacing and last digits."""
    named = _quoted(F.upper(F.trim(F.coalesce(kind.cast("string"), F.lit("")))))
    return F.sha2(F.concat(F.lit('{"operation_type":'), named, F.lit(',"payload":'), row_text(df, **payload), F.lit("}")), 256)
