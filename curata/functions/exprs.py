"""Column expressions shared by the operators. All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's ``str.strip()`` removes (``str.isspace``),
# written as a Java regex character class.
WHITESPACE_CLASS = (
    "[\\t\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x1F \\x{85}\\x{A0}\\x{1680}"
    "\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)

# Label shown for a missing category.
MISSING_LABEL = "(Missing)"

# Text forms of a missing cell in the reference's string casts.
MISSING_TOKENS = ("nan", "<NA>", "None")

# date/time layouts tried, in order, when text is read as time,
# each with a regular expression every parseable text matches (checked first,
# so texts that cannot parse never reach the parser).
DATETIME_FORMATS = (
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"),
    ("yyyy-MM-dd HH:mm", r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$"),
    ("yyyy-MM-dd", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("yyyy/MM/dd", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$"),
    ("MM/dd/yyyy", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"),
    ("yyyy-MM", r"^[0-9]{4}-[0-9]{2}$"),
)


# The text shape of a number (decimal, exponent, inf, nan),
# white space around it allowed.
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"
NUMBER_PATTERN = r"(?i)^\s*[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\s*$"


def text_to_double(c: Column) -> Column:
    """Text to double, NULL when it is not a number. Text that does not have
    the shape of a number never reaches the parser (a failed parse costs an
    exception per cell)."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def text_to_long(c: Column) -> Column:
    """Text to bigint, NULL when it is not a whole number in range. Only text
    shaped like an integer is cast (TRY casts pay an exception per failure)."""
    return F.when(c.rlike(INTEGER_PATTERN), c.try_cast("bigint"))


def nan_to_null(c: Column) -> Column:
    """Float NaN becomes NULL (in Spark ``NaN > 0`` is true, ``NaN IS NULL`` false)."""
    return F.nanvl(c, F.lit(None).cast("double"))


def clean_numeric(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN as NULL."""
    c = F.col(f"`{name}`")
    dt = df.schema[name].dataType
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return nan_to_null(c.cast("double"))
    return c.cast("double")


def zero_sign(c: Column) -> Column:
    """Turn ``-0.0`` into ``0.0`` so equal values print and hash alike."""
    return c + F.lit(0.0)


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    ws = WHITESPACE_CLASS
    return F.regexp_replace(c, f"\\A{ws}+|{ws}+\\z", "")


def bool_text(c: Column) -> Column:
    return F.when(c, F.lit("True")).when(~c, F.lit("False"))


def display_text(c: Column, dtype: T.DataType) -> Column:
    """Text of a value as the reference shows it (``True``/``False`` for booleans)."""
    if isinstance(dtype, T.BooleanType):
        return bool_text(c)
    return c.cast("string")


def label_missing(c: Column, dtype: T.DataType = T.StringType()) -> Column:
    """Category label with missing cells shown as ``(Missing)``."""
    return F.coalesce(display_text(c, dtype), F.lit(MISSING_LABEL))


def python_float_text(v: float) -> str:
    return repr(float(v))


def _text_matches(c: Column, dtype: T.DataType, values) -> tuple[Column, bool]:
    """A predicate that is true where the text of a value is in ``values``
    (NULL for a missing cell), and whether missing cells match too."""
    values = list(dict.fromkeys(str(v) for v in values))
    missing = any(v in MISSING_TOKENS for v in values)
    if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        numbers = []
        for v in values:
            try:
                f = float(v)
            except ValueError:
                continue
            if not math.isnan(f) and python_float_text(f) == v:
                numbers.append(f)
        c = c if isinstance(dtype, T.DoubleType) else c.cast("double")
        return (c.isin(numbers) if numbers else F.lit(False)), missing
    if isinstance(dtype, T.BooleanType):
        return bool_text(c).isin(values), missing
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        # only the text that the number itself would have
        whole = [int(v) for v in values if re.fullmatch(r"-?[0-9]{1,19}", v) and str(int(v)) == v and abs(int(v)) < 2**63]
        return (c.isin(whole) if whole else F.lit(False)), missing
    return (c if isinstance(dtype, T.StringType) else c.cast("string")).isin(values), missing


def text_in(c: Column, dtype: T.DataType, values) -> Column:
    """True where the text of a value is in ``values``. Never NULL.

    Strings compare as they are, booleans as ``True``/``False``, integers as
    their digits (``05`` is not 5). For floating columns a value matches a
    token exactly when the token is Python's canonical text of that float, so
    ``5.0`` matches 5 and ``5`` does not. Missing cells match ``nan``,
    ``<NA>`` or ``None``.
    """
    hit, missing = _text_matches(c, dtype, values)
    if missing:
        gone = c.isNull()
        if isinstance(dtype, (T.FloatType, T.DoubleType)):
            gone = gone | F.isnan(c)
        hit = hit | gone
    return F.coalesce(hit, F.lit(False))


def text_not_in(c: Column, dtype: T.DataType, values) -> Column:
    """The opposite of :func:`text_in` in a form that the scan can evaluate."""
    hit, missing = _text_matches(c, dtype, values)
    if missing:
        keep = c.isNotNull() & ~hit
        return keep & ~F.isnan(c) if isinstance(dtype, (T.FloatType, T.DoubleType)) else keep
    return c.isNull() | ~hit


def parse_datetime(c: Column, formats=DATETIME_FORMATS) -> Column:
    """Text to timestamp with the fixed layout list; unparseable gives NULL.
    A layout is only tried on text its pattern admits: a failed parse is
    costly, a regular-expression test is not."""
    s = F.trim(c.cast("string"))
    return F.coalesce(*[F.when(s.rlike(rx), F.try_to_timestamp(s, F.lit(f))) for f, rx in formats])
