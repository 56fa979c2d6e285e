"""Column roles read from the schema (numeric, categorical, datetime).

A column may carry ``{"curata_role": "categorical"}`` in its metadata (binned
columns, explicit category casts, map-rule targets): it is then categorical
whatever its physical type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

ROLE_KEY = "curata_role"
POSITION = {ROLE_KEY: "position"}     # where a row stands in the files it was loaded from
LEVELS_KEY = "curata_levels"

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _field(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise KeyError(name)


def role_of(field: T.StructField) -> str | None:
    return (field.metadata or {}).get(ROLE_KEY)


def is_numeric_field(field: T.StructField, bool_is_numeric: bool = False) -> bool:
    if role_of(field) == "categorical":
        return False
    if isinstance(field.dataType, T.BooleanType):
        return bool_is_numeric
    return isinstance(field.dataType, NUMERIC_TYPES)


def is_integral_field(field: T.StructField) -> bool:
    return isinstance(field.dataType, INTEGRAL_TYPES) and role_of(field) != "categorical"


def is_categorical_field(field: T.StructField, include_bool: bool = True) -> bool:
    if role_of(field) == "categorical":
        return True
    if isinstance(field.dataType, T.BooleanType):
        return include_bool
    return isinstance(field.dataType, T.StringType)


def numeric_columns(df: DataFrame, bool_is_numeric: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_field(f, bool_is_numeric)]


def categorical_columns(df: DataFrame, include_bool: bool = True) -> list[str]:
    """EDA pickers count booleans as categorical; cleaning steps pass
    ``include_bool=False`` (booleans are neither imputed nor encoded there)."""
    return [f.name for f in df.schema.fields if is_categorical_field(f, include_bool)]


def is_numeric(df: DataFrame, name: str) -> bool:
    return is_numeric_field(_field(df, name))


def is_integral(df: DataFrame, name: str) -> bool:
    return is_integral_field(_field(df, name))


def is_categorical(df: DataFrame, name: str, include_bool: bool = True) -> bool:
    return is_categorical_field(_field(df, name), include_bool)


def categorical(col: Column, name: str, levels: list[str] | None = None) -> Column:
    """Alias ``col`` as ``name`` and mark it categorical (optionally ordered levels)."""
    meta = {ROLE_KEY: "categorical"}
    if levels is not None:
        meta[LEVELS_KEY] = list(levels)
    return col.alias(name, metadata=meta)


def dtype_name(field: T.StructField) -> str:
    """Type label used in reports: Spark's simple type name, ``category`` for
    columns marked categorical."""
    if role_of(field) == "categorical":
        return "category"
    return field.dataType.simpleString()
