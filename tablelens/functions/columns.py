"""Column -> Column helpers (projections, filters and scalar functions).

Every helper returns a built-in Catalyst expression, so it stays inside
whole-stage code generation; none of them is a Python UDF.  Helpers that need
to know a column's type take the DataFrame's schema field instead of
inspecting data.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --------------------------------------------------------------------------
# Projection by type (P1) and by name
# --------------------------------------------------------------------------

def is_numeric_type(dt: T.DataType) -> bool:
    """Numeric in the library's sense: Spark ``NumericType`` (no booleans)."""
    return isinstance(dt, T.NumericType)


def is_float_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def other_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]



# --------------------------------------------------------------------------
# Missing values (P4, P7; rule N1: NaN counts as missing for float columns)
# --------------------------------------------------------------------------

def normalized(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into null for float/double columns."""
    c = F.col(_quote(name))
    if is_float_type(df.schema[name].dataType):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(df: DataFrame, name: str) -> Column:
    c = F.col(_quote(name))
    if is_float_type(df.schema[name].dataType):
        return c.isNull() | F.isnan(c)
    return c.isNull()




def _quote(name: str) -> str:
    """Back-quote a column name so dots and spaces are taken literally."""
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    return F.col(_quote(name))


def sql_ident(name: str) -> str:
    """A column name as quoted SQL identifier."""
    return _quote(name)


def sql_str(value: str) -> str:
    """A Python string as SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_double(x: float) -> str:
    """A float as an exact SQL DOUBLE literal (round-trips through repr)."""
    x = float(x)
    if x != x:
        return "CAST('NaN' AS DOUBLE)"
    if x in (float("inf"), float("-inf")):
        return f"CAST('{'-' if x < 0 else ''}Infinity' AS DOUBLE)"
    return f"{x!r}D" if x >= 0 else f"({x!r}D)"


def normalized_sql(df: DataFrame, name: str) -> str:
    """SQL text of ``normalized``: NaN -> null for float columns."""
    c = _quote(name)
    if is_float_type(df.schema[name].dataType):
        return f"CASE WHEN NOT isnan({c}) THEN {c} END"
    return c


# --------------------------------------------------------------------------
# Filters (P3, P5)
# --------------------------------------------------------------------------

def equals(c: ColumnOrName, value) -> Column:
    return _col(c) == F.lit(value)


def outside(c: ColumnOrName, lo: ColumnOrName | float, hi: ColumnOrName | float) -> Column:
    """Strictly outside ``[lo, hi]``."""
    lo_c = lo if isinstance(lo, Column) else F.lit(lo)
    hi_c = hi if isinstance(hi, Column) else F.lit(hi)
    return (_col(c) < lo_c) | (_col(c) > hi_c)


# --------------------------------------------------------------------------
# Dates (P8-P14)
# --------------------------------------------------------------------------

def parse_date(c: ColumnOrName) -> Column:
    """Cast to DATE; text that is not a date becomes null instead of failing."""
    return _col(c).try_cast("date")


# Date layouts tried, in this order, after the ISO cast.
DATE_LAYOUTS = (
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy H:mm",
    "M/d/yyyy",
    "yyyy/M/d",
    "d.M.yyyy",
    "MMM d, yyyy",
    "MMMM d, yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
)


def coerce_timestamp(c: ColumnOrName, layouts=DATE_LAYOUTS) -> Column:
    """Parse to TIMESTAMP: the ISO cast first, then common date layouts;
    text that matches none becomes null instead of failing."""
    col = _col(c)
    text = col.cast("string")
    tries = [col.try_cast("timestamp")] + [F.try_to_timestamp(text, F.lit(fmt)) for fmt in layouts]
    return F.coalesce(*tries)


def month_of(c: ColumnOrName) -> Column:
    """First day of the month, as DATE."""
    return F.date_trunc("month", parse_date(c)).cast("date")


# C ``strftime`` directives and the equal Java date-time
# patterns used by Spark's ``date_format``.
STRFTIME_TO_JAVA = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%d": "dd",
    "%H": "HH",
    "%I": "hh",
    "%M": "mm",
    "%S": "ss",
    "%b": "MMM",
    "%B": "MMMM",
    "%a": "EEE",
    "%A": "EEEE",
    "%j": "DDD",
    "%p": "a",
    "%%": "%",
}


def strftime_pattern(fmt: str) -> str:
    """Translate a C ``strftime`` format into a Java date-time pattern."""
    out, i = [], 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in STRFTIME_TO_JAVA:
            out.append(STRFTIME_TO_JAVA[two])
            i += 2
            continue
        ch = fmt[i]
        out.append(f"'{ch}'" if ch.isalpha() else ("''" if ch == "'" else ch))
        i += 1
    return "".join(out)


def strftime(c: ColumnOrName, fmt: str) -> Column:
    return F.date_format(_col(c), strftime_pattern(fmt))


def month_year(c: ColumnOrName) -> Column:
    """``Jan 2024``."""
    return F.date_format(_col(c), "MMM yyyy")


def add_days(c: ColumnOrName, n: ColumnOrName | int) -> Column:
    return F.date_add(parse_date(c), n if isinstance(n, Column) else F.lit(n))


def add_days_if(cond: Column, c: ColumnOrName, n: ColumnOrName | int) -> Column:
    """``c + n days`` where ``cond`` holds, else null."""
    return F.when(cond, add_days(c, n))


def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    return F.datediff(parse_date(end), parse_date(start))


# --------------------------------------------------------------------------
# Numbers and text formatting
# --------------------------------------------------------------------------

def line_total(price: ColumnOrName, qty: ColumnOrName) -> Column:
    return F.round(_col(price) * _col(qty), 2)


def clamp_min(c: ColumnOrName, lo: float) -> Column:
    return F.greatest(_col(c), F.lit(lo))


def format_key(prefix: str, c: ColumnOrName, width: int) -> Column:
    """``C0001``-style keys; longer numbers are kept whole, never cut."""
    return F.format_string(f"{prefix.replace('%', '%%')}%0{int(width)}d", _col(c).cast("long"))


def title_label(name: str) -> str:
    """``total_amount`` -> ``Total Amount`` (driver side, for column names)."""
    return name.replace("_", " ").title()


def title_label_col(c: ColumnOrName) -> Column:
    return F.initcap(F.replace(_col(c), F.lit("_"), F.lit(" ")))


def format_measure(c: ColumnOrName) -> Column:
    """Thousands separators; ``$`` and no decimals above 100, else 2 decimals."""
    v = _col(c).cast("double")
    return F.when(v > 100, F.concat(F.lit("$"), F.format_number(v, 0))).otherwise(
        F.format_number(v, 2)
    )


def format_count(c: ColumnOrName) -> Column:
    """Integer with thousands separators."""
    return F.format_number(_col(c).cast("long"), 0)


def text_or_na(c: ColumnOrName) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit("N/A"))


def issue_line(table: ColumnOrName = "table", column: ColumnOrName = "column",
               kind: ColumnOrName = "anomaly_type", detail: ColumnOrName = "description") -> Column:
    return F.format_string(
        "Table: %s, Column: %s, Issue: %s, Detail: %s",
        _col(table), _col(column), _col(kind), _col(detail),
    )


# --------------------------------------------------------------------------
# Text cleaning (P23-P25).  Java regexes run with (?d) so that only \n ends a
# line, the same rule as Python's ``re`` and RE2.
# --------------------------------------------------------------------------

# The whitespace characters of Java's ``\s`` class.
WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(c: ColumnOrName) -> Column:
    """Trim whitespace of any kind at both ends (plain ``trim`` only drops
    spaces); a character-set trim, much cheaper than a regex on long texts."""
    return F.trim(_col(c), F.lit(WHITESPACE))


# Patterns that define what a code fence, a heading and emphasis are.
FENCE = r"```(?:sql)?\n?"
LAST_BACKTICKS = r"`+$"
HEADING = r"(?md)^#+\s*.+\n?"
EMPHASIS = r"(?d)\*{1,2}(.+?)\*{1,2}"


def strip_fences(c: ColumnOrName) -> Column:
    """Drop Markdown code fences and trailing backticks around a snippet."""
    no_fence = F.regexp_replace(_col(c), FENCE, "")
    return strip_ws(F.regexp_replace(strip_ws(no_fence), LAST_BACKTICKS, ""))


def strip_markdown(c: ColumnOrName) -> Column:
    """Drop ``#`` heading lines, unwrap ``*``/``**`` emphasis, drop backticks."""
    no_heads = F.regexp_replace(_col(c), HEADING, "")
    unwrapped = F.regexp_replace(no_heads, EMPHASIS, "$1")
    return strip_ws(F.replace(unwrapped, F.lit("`"), F.lit("")))


def first_lines(c: ColumnOrName, k: int = 5) -> Column:
    """Up to ``k`` non-empty, trimmed lines, as ARRAY<STRING>."""
    lines = F.transform(F.split(_col(c), "\n"), lambda x: strip_ws(x))
    return F.slice(F.filter(lines, lambda x: x != F.lit("")), 1, int(k))


def union_all_names(frames: Sequence[DataFrame]) -> DataFrame:
    """``unionByName`` over a non-empty list of frames."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
