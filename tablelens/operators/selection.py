"""Order statistics by radix selection.

A pass maps every value to one of at most ``CELLS`` cells by a function that
keeps the order, and counts each cell with its least and greatest value in one
grouped aggregate over one scan.  Running sums over a target's cells show the
cell that holds the wanted rank, and the next pass looks into that cell alone:

* the first pass takes the sign and the logarithm (cells 4.6 % wide, the same
  for all targets of a column),
* later passes cut the cell's exact range evenly, 16 bits at a time, so four
  passes tell all doubles apart,
* a cell of at most ``CELLS`` rows is counted value by value, which ends it.

A task sends at most ``CELLS`` counts a target, no values, whatever the size of
the table or the shape of the column; a target's cells are summed up in one
window of at most ``CELLS`` rows, and a row or two a target reach the driver.
A cast to DOUBLE keeps the order, so BIGINT and DECIMAL columns give the same
value as their own order statistic cast to DOUBLE.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.functions.columns import sql_double

CELLS = 1 << 16
# ln of a double lies between -744.5 and 709.8; shifted and stretched, it fills
# half the cells for either sign.
_SHIFT, _STRETCH = 746, 22


@dataclass
class _Target:
    column: int
    ranks: tuple[int, int]  # wanted ranks, counted from the bracket's first value
    low: float
    high: float
    rows: int


def _first_cell(x: str) -> str:
    size = f"CAST(floor(least((ln(abs({x})) + {_SHIFT}D) * {_STRETCH}D, 32767D)) AS DOUBLE)"
    return f"CASE WHEN {x} = 0D THEN 0D WHEN {x} > 0D THEN {size} ELSE -{size} END"


def _next_cell(x: str, t: _Target) -> str:
    if t.rows <= CELLS:
        return x
    low, width = sql_double(t.low), sql_double(t.high - t.low)
    return f"CAST(floor(least(({x} - {low}) / {width} * {CELLS}D, {CELLS - 1}D)) AS DOUBLE)"


def _cells(values: DataFrame, entries: list[str], wanted) -> list:
    """Rows (t, total, n, upto, low, high) of the cells with wanted ranks."""
    each = values.selectExpr(f"inline(array({', '.join(entries)}))").where("x is not null")
    counts = each.groupBy("t", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    whole = Window.partitionBy("t")
    upto = F.sum("n").over(whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(whole))
    return counts.where(wanted).orderBy("t", "upto").collect()  # one or two rows a target and rank


def _settle(target_ranks: tuple[int, int], cells: list) -> tuple[float, float] | tuple[int, object]:
    """Both values, or the cell (start, row) that holds both and is yet to be cut."""
    found = []
    for rank in target_ranks:
        cell = next(c for c in cells if c["upto"] - c["n"] <= rank < c["upto"])
        start = cell["upto"] - cell["n"]
        if cell["low"] == cell["high"] or rank == start:
            found.append(cell["low"])
        elif rank == cell["upto"] - 1:
            found.append(cell["high"])
        else:
            return start, cell
    return found[0], found[1]


def interpolated(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> list[tuple[int, list[float] | None]]:
    """(number of values, quantiles) of every column; ``columns`` are SQL
    texts of DOUBLE expressions without NaN.  Linear interpolation between the
    two values around ``(n - 1) * p``."""
    if not columns:
        return []
    values = df.select(*[F.expr(c).alias(f"c{k}") for k, c in enumerate(columns)])
    around = [f"CAST(floor((total - 1) * {sql_double(p)}) AS BIGINT)" for p in probs]
    hit = " OR ".join(f"(upto > {r} AND upto - n <= {r} + 1)" for r in around)
    entries = [f"named_struct('t', {k}, 'cell', {_first_cell(f'c{k}')}, 'x', c{k})" for k in range(len(columns))]
    by_column: dict[int, list] = {}
    for row in _cells(values, entries, F.expr(hit)):
        by_column.setdefault(row["t"], []).append(row)

    settled: dict[tuple[int, int], tuple[float, float]] = {}
    open_: dict[tuple[int, int], _Target] = {}
    totals = {k: rows[0]["total"] for k, rows in by_column.items()}
    for k, rows in by_column.items():
        for j, p in enumerate(probs):
            low = math.floor((totals[k] - 1) * p)
            _place(settled, open_, (k, j), (low, min(low + 1, totals[k] - 1)), k, rows)
    while open_:
        names = list(open_)
        entries, firsts, lasts = [], [], []
        for i, name in enumerate(names):
            t = open_[name]
            x = f"CASE WHEN c{t.column} BETWEEN {sql_double(t.low)} AND {sql_double(t.high)} THEN c{t.column} END"
            entries.append(f"named_struct('t', {i}, 'cell', {_next_cell(f'c{t.column}', t)}, 'x', {x})")
            firsts.append(str(t.ranks[0]))
            lasts.append(str(t.ranks[1]))
        hit = f"upto > array({', '.join(firsts)})[t] AND upto - n <= array({', '.join(lasts)})[t]"
        cells: dict[int, list] = {}
        for row in _cells(values, entries, F.expr(hit)):
            cells.setdefault(row["t"], []).append(row)
        before, open_ = open_, {}
        for i, name in enumerate(names):
            _place(settled, open_, name, before[name].ranks, before[name].column, cells[i])

    out = []
    for k in range(len(columns)):
        if k not in totals:
            out.append((0, None))
            continue
        q = []
        for j, p in enumerate(probs):
            h = (totals[k] - 1) * p
            low, high = settled[k, j]
            part = h - math.floor(h)
            q.append(low if not part else low + part * (high - low))
        out.append((totals[k], q))
    return out


def _place(settled, open_, name, ranks, column, cells) -> None:
    got = _settle(ranks, cells)
    if isinstance(got[1], float):
        settled[name] = got
    else:
        start, cell = got
        open_[name] = _Target(column, (ranks[0] - start, ranks[1] - start), cell["low"], cell["high"], cell["n"])


def smallest(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest 64-bit hash ``key`` (a column without nulls).

    The rank threshold is found as above, on the key's upper bits first; what
    lies below it is a filter.  Rows that share the threshold key are ordered
    by all their columns; equal rows count as one with a number of copies.
    """
    low, shift, left = None, 48, n
    inside = df.select(F.col(key).alias("k"))
    while True:
        cell = F.shiftright("k", shift)
        counts = inside.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        row = counts.withColumn("upto", upto).where(f"upto >= {left}").orderBy("cell").first()  # of at most CELLS rows
        if row is None:
            return df  # not more than n rows
        left -= row["upto"] - row["n"]
        low = row["cell"]
        if not shift:
            break
        inside = inside.where(cell == low)
        shift -= 16
    if left == row["n"]:
        return df.where(F.col(key) <= low)
    columns = [F.col(f"`{c}`") for c in df.columns]
    tied = df.where(F.col(key) == low).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tied = tied.withColumn("__n", F.least(F.col("__n"), F.lit(left) - before)).where("__n > 0")
    tied = tied.select(*columns, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__i")).drop("__i")
    return df.where(F.col(key) < low).unionByName(tied)
