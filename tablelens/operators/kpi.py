"""Headline KPI cards over a set of tables (K1-K5).

Column choice is schema metadata (names and types) and stays on the driver;
all values are computed by one aggregate per table on the executors.  The
cards of all tables are unioned, de-duplicated by label keeping the first
(O8), and the first ``max_cards`` are kept (O7).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.session import local_frame
from tablelens.functions.columns import (
    coerce_timestamp,
    format_count,
    format_measure,
    is_numeric_type,
    normalized,
    month_year,
    qcol,
    title_label,
)
from tablelens.operators.relational import keep_first, union_reports

KPI_FIELDS = "label string, value string, hint string"

# Name fragments that mark a money column, a person-id column
# and a date column, and the card labels and hints.
MONEY_WORDS = ("revenue", "amount", "total", "sales", "price", "spend")
PERSON_WORDS = ("customer", "user", "client", "member")
ID_WORD = "id"
DATE_WORD = "date"
DATE_SEPARATOR = " – "  # en dash
ROWS_LABEL = "Total Rows"
ROWS_HINT = "across {n} table(s)"
MONEY_LABEL = "Total {title}"
DATE_LABEL = "Date Range"
PEOPLE_LABEL = "Unique {title}"


def money_column(df: DataFrame) -> str | None:
    """First numeric column whose name contains a money word (K2)."""
    for f in df.schema.fields:
        if is_numeric_type(f.dataType) and any(w in f.name.lower() for w in MONEY_WORDS):
            return f.name
    return None


def date_candidates(df: DataFrame) -> list[str]:
    """Columns that are timestamps/dates or have "date" in the name (K3)."""
    out = []
    for f in df.schema.fields:
        temporal = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        if temporal or DATE_WORD in f.name.lower():
            out.append(f.name)
    return out


def person_id_column(df: DataFrame) -> str | None:
    """First column naming a person kind together with "id" (K4)."""
    for f in df.schema.fields:
        name = f.name.lower()
        if any(w in name for w in PERSON_WORDS) and ID_WORD in name:
            return f.name
    return None


def _as_timestamp(df: DataFrame, name: str) -> Column:
    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return qcol(name)
    return coerce_timestamp(qcol(name).cast("string"))


def table_kpis(df: DataFrame, table: str, table_pos: int, n_tables: int) -> DataFrame:
    """The K1-K4 cards of one table with an ordering key ``pos``."""
    cards: list[Column] = []
    base = table_pos * 10
    aggs = [F.count(F.lit(1)).alias("__rows")]
    cards.append(
        F.struct(
            F.lit(ROWS_LABEL).alias("label"),
            format_count(F.col("__rows")).alias("value"),
            F.lit(ROWS_HINT.format(n=n_tables)).alias("hint"),
            F.lit(base + 1).alias("pos"),
        )
    )
    money = money_column(df)
    if money is not None:
        # an empty or all-null column sums to 0, as a pandas sum does
        aggs.append(F.coalesce(F.sum(normalized(df, money)), F.lit(0)).alias("__money"))
        cards.append(
            F.struct(
                F.lit(MONEY_LABEL.format(title=title_label(money))).alias("label"),
                format_measure(F.col("__money")).alias("value"),
                F.lit(table).alias("hint"),
                F.lit(base + 2).alias("pos"),
            )
        )
    dates = date_candidates(df)
    if dates:
        for k, name in enumerate(dates):
            ts = _as_timestamp(df, name)
            aggs.append(F.min(ts).alias(f"__dmin{k}"))
            aggs.append(F.max(ts).alias(f"__dmax{k}"))
        # the first candidate with at least one parseable value wins
        first = F.coalesce(
            *[
                F.when(
                    F.col(f"__dmin{k}").isNotNull(),
                    F.struct(
                        F.concat(month_year(F.col(f"__dmin{k}")), F.lit(DATE_SEPARATOR),
                                 month_year(F.col(f"__dmax{k}"))).alias("value"),
                        F.lit(name).alias("hint"),
                    ),
                )
                for k, name in enumerate(dates)
            ]
        )
        cards.append(
            F.when(
                first.isNotNull(),
                F.struct(
                    F.lit(DATE_LABEL).alias("label"),
                    first["value"].alias("value"),
                    first["hint"].alias("hint"),
                    F.lit(base + 3).alias("pos"),
                ),
            )
        )
    person = person_id_column(df)
    if person is not None:
        aggs.append(F.count_distinct(normalized(df, person)).alias("__people"))
        cards.append(
            F.struct(
                F.lit(PEOPLE_LABEL.format(title=title_label(person))).alias("label"),
                format_count(F.col("__people")).alias("value"),
                F.lit(table).alias("hint"),
                F.lit(base + 4).alias("pos"),
            )
        )
    agg = df.agg(*aggs)
    return agg.select(F.explode(F.array(*cards)).alias("c")).filter(F.col("c").isNotNull()).select("c.*")


def kpis(tables: Mapping[str, DataFrame], max_cards: int = 4) -> DataFrame:
    """K5: the cards of all tables in alphabetical order, first of each label;
    ``max_cards`` is the number of cards shown."""
    names = sorted(tables)
    if not names:
        from pyspark.sql import SparkSession

        return local_frame(SparkSession.getActiveSession(), [], KPI_FIELDS)
    parts = [table_kpis(tables[n], n, i, len(names)) for i, n in enumerate(names)]
    cards = keep_first(union_reports(*parts), "label", F.col("pos"))
    return cards.orderBy("pos").limit(int(max_cards)).select("label", "value", "hint")
