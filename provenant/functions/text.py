"""Scalar normalizers as native Column expressions (no Python UDFs).

Each function mirrors a Python-side rule of the source system and stays inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType

from ..config import DATE_SHAPES, PROJECT_ID_PATTERN, SPARK_DATE_PATTERNS

# --- Fixed values: the characters Python's str.isspace() accepts ---
# \t \n \x0b \x0c \r, \x1c-\x1f, space, \x85, \xa0, \u1680, \u2000-\u200a,
# \u2028, \u2029, \u202f, \u205f, \u3000. Spark's trim() removes spaces only.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
              "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")
_WS_CLASS = r"[\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

# Python float() syntax: digits with single underscores between them, optional
# fraction and exponent, or nan / inf / infinity; surrounding white space allowed.
_DIGITS = r"\d(?:_?\d)*"
_PY_FLOAT_RE = (rf"(?iU)^{_WS_CLASS}*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})"
                rf"(?:e[+-]?{_DIGITS})?|nan|inf|infinity){_WS_CLASS}*$")
# The plainest of them, which the quick pattern finds first.
_PLAIN_FLOAT_RE = r"^[0-9]+(?:\.[0-9]+)?\z"

# A text that is a project id as it stands, and the plainest of the accepted dates.
_WHOLE_PROJECT_ID = PROJECT_ID_PATTERN.removesuffix("$") + r"\z"
_PLAIN_DATE = r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:T(?:[01]?[0-9]|2[0-3]):[0-5]?[0-9]:[0-5]?[0-9]Z)?\z"


def as_column(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """str(v).strip(): remove leading and trailing white space of any kind
    (native ``trim(BOTH chars FROM v)``, no regex)."""
    return F.trim(as_column(c).cast("string"), F.lit(WHITESPACE))


def py_upper(c) -> Column:
    return F.upper(py_strip(c))


def is_missing(c, data_type: DataType | None = None) -> Column:
    """Python falsiness of a source value: null, empty string or empty list."""
    col = as_column(c)
    if isinstance(data_type, ArrayType):
        return col.isNull() | (F.size(col) == 0)
    return col.isNull() | (col.cast("string") == "")


def squeezed(c) -> Column:
    """The text without white space, in upper case (null as ``""``); a text that is an id already is left as it is."""
    text = F.coalesce(as_column(c).cast("string"), F.lit(""))
    return F.when(text.rlike(_WHOLE_PROJECT_ID), text).otherwise(F.upper(F.translate(text, WHITESPACE, "")))


def project_id_of(text: Column) -> Column:
    """The squeezed text if it is ``P`` + 6 digits."""
    return F.when(text.rlike(PROJECT_ID_PATTERN), text)


def normalize_project_id(c) -> Column:
    """Drop all white space, upper-case, keep only ``P`` + 6 digits."""
    return project_id_of(squeezed(c))


def date_of(stripped: Column) -> Column:
    """First of the accepted formats that parses the text, else null."""
    # A pattern is only tried on text of its shape: a failed parse throws and
    # catches an exception inside the JVM, which dominates the cost otherwise. Plain dates are cast, which is a tenth
    # of the work of a pattern and gives the same days, but for the year 0 that patterns refuse.
    plain = stripped.rlike(_PLAIN_DATE)
    parsed = F.coalesce(*[F.when(stripped.rlike(shape), F.try_to_date(stripped, p))
                          for p, shape in zip(SPARK_DATE_PATTERNS, DATE_SHAPES)])
    return F.when(plain, F.substring_index(stripped, "T", 1).try_cast("date")).otherwise(parsed)


def normalize_date(c) -> Column:
    """The date of the stripped text, see :func:`date_of`."""
    return date_of(py_strip(c))


# First digits of the decimal digit runs that a number's text may use beside 0-9 (ten code points each).
_DIGIT_ZEROS = (0x0660, 0x06F0, 0x07C0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0,
                0x1810, 0xFF10)
_DIGITS = ("".join(chr(z + d) for z in _DIGIT_ZEROS for d in range(10)), "0123456789" * len(_DIGIT_ZEROS))


def ascii_digits(c) -> Column:
    """Decimal digits of other scripts as 0-9 (a text without others is left as it is, without looking each letter up)."""
    text = as_column(c).cast("string")
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, *_DIGITS))


def _is_float(digits: Column) -> Column:
    return digits.rlike(_PLAIN_FLOAT_RE) | digits.rlike(_PY_FLOAT_RE)


def is_python_float(c) -> Column:
    return _is_float(ascii_digits(c))


def number_of(digits: Column) -> Column:
    """The number of a text in :func:`ascii_digits`; plain numbers are cast as they stand."""
    cleaned = F.regexp_replace(py_strip(digits), "_", "")
    return F.when(digits.rlike(_PLAIN_FLOAT_RE), digits.try_cast("double")).when(digits.rlike(_PY_FLOAT_RE), cleaned.try_cast("double"))


def number_error_of(digits: Column) -> Column:
    return digits.isNotNull() & (digits != "") & ~_is_float(digits)


def to_number(c) -> Column:
    """null / '' -> null; Python float syntax, in digits of any script -> double; anything else -> null
    (the caller flags it as a ValueError through :func:`to_number_error`)."""
    return number_of(ascii_digits(c))


def to_number_error(c) -> Column:
    return number_error_of(ascii_digits(c))


def join_list(c, data_type: DataType | None = None, sep: str = ", ") -> Column:
    """list -> joined text; scalar -> itself; falsy -> ''.

    A string column may carry a landed JSON array (text starting with ``[``),
    which is parsed and joined; any other string is kept as it is.
    """
    col = as_column(c)
    if isinstance(data_type, ArrayType):
        return F.coalesce(F.array_join(col, sep), F.lit(""))
    as_list = F.from_json(col, ArrayType(StringType()))
    return F.when(col.startswith("["), F.coalesce(F.array_join(as_list, sep), F.lit(""))) \
        .otherwise(F.coalesce(col.cast("string"), F.lit("")))


def python_text(c) -> Column:
    """f-string rendering of a possibly-null text value (None -> 'None')."""
    return F.coalesce(as_column(c).cast("string"), F.lit("None"))


def tokens(c, pattern: str) -> Column:
    """Distinct lower-case regex tokens of a text column, as an array."""
    return F.array_distinct(F.regexp_extract_all(F.lower(as_column(c)), F.lit(pattern), 0))
