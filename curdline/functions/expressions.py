"""Column expressions used by several operators. All of them are built-in Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curdline.schema import SEASONS

_FRACTION_BITS = 52


def stable_sql(value: str) -> str:
    """Drop float noise below 1e-9.

    Partial sums of doubles are merged in any order, so the last bits of a mean differ between two runs of
    the same job. Rounding the stored statistics keeps a flag from depending on that order.
    """
    return f"round({value}, 9)"


def trimmed(text: Column) -> Column:
    """Strip all surrounding white space (``trim`` strips blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def finite(value: Column) -> Column:
    """NaN and infinities become null: Spark orders NaN above every number, so ``NaN > 2`` would hold."""
    return F.when(F.abs(value) < float("inf"), value)


def season_of(month: Column) -> Column:
    summer, winter = SEASONS
    return F.when(month.between(4, 9), summer).otherwise(winter)


def month_index(year: Column, month: Column) -> Column:
    return year * 100 + month


def zscore(value: Column, mean: Column, std: Column) -> Column:
    flat = std.isNull() | F.isnan(std) | (std == 0)
    return F.when(flat, F.lit(0.0)).otherwise((value - mean) / std)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def quantile_sql(values: str, share: float) -> str:
    """Linear-interpolated quantile of a sorted array without nulls; null when empty."""
    position = f"((size({values}) - 1) * {share}D)"
    low = f"get({values}, int(floor({position})))"
    high = f"get({values}, int(least(floor({position}) + 1, size({values}) - 1)))"
    return f"{low} + ({high} - {low}) * ({position} - floor({position}))"


def median_sql(values: str) -> str:
    """Median of an array without nulls; null when empty."""
    n = f"size({values})"
    return f"(get(sort_array({values}), ({n} - 1) div 2) + get(sort_array({values}), {n} div 2)) / 2"


def most_frequent_sql(values: str) -> str:
    """Most frequent element of a short array, the smallest one on ties."""
    count = f"size(filter({values}, y -> y = x))"
    return f"array_min(transform(array_distinct({values}), x -> struct(-{count} AS n, x AS value))).value"


def most_frequent_by(count: Column, value: Column) -> Column:
    """The same over pre-counted rows, as an aggregate with constant state."""
    return F.min(F.when(value.isNotNull(), F.struct((-count).alias("n"), value.alias("value"))))["value"]


def fixed(value: str, digits: int, signed: bool = False) -> Column:
    """Fixed-point text of a column, rounded half to even on the exact binary value.

    ``format_string`` rounds the shortest decimal form half up and would print 8.125 as 8.13. Here the
    fraction is scaled to an integer of 52 bits, so that the tie test is exact. That is only done where the scaled
    value is large or so close to a half that plain arithmetic might fall on the wrong side.
    """
    unit, one = 10**digits, 1 << _FRACTION_BITS
    # Each intermediate value is bound once, as the variable of a one-element transform.
    steps = [
        ("x", f"abs({value})"),
        ("p", f"struct(floor(x) AS whole, (x - floor(x)) * {one}D AS bits)"),
        ("q", f"struct(p.whole AS whole, bigint(p.bits) * {unit}L AS high, (p.bits - double(bigint(p.bits))) * {unit} AS low)"),
        ("s", "struct(q.whole AS whole, q.high + bigint(q.low) AS scaled, q.low <> double(bigint(q.low)) AS inexact)"),
        ("t", f"struct(s.whole * {unit}L + shiftright(s.scaled, {_FRACTION_BITS}) AS down, s.inexact AS inexact,"
              f" s.scaled - shiftleft(shiftright(s.scaled, {_FRACTION_BITS}), {_FRACTION_BITS}) - {one // 2}L AS over)"),
        ("n", "CASE WHEN t.over > 0 OR (t.over = 0 AND (t.inexact OR t.down % 2 = 1)) THEN t.down + 1 ELSE t.down END"),
    ]
    text = f"concat(string(n div {unit}L), '.', lpad(string(n % {unit}L), {digits}, '0'))"
    for name, bound in reversed(steps):
        text = f"get(transform(array({bound}), {name} -> {text}), 0)"
    scaled = f"abs({value}) * {unit}"
    plain = f"bigint(rint({scaled}))"
    sure = f"abs({value}) < 1000000D AND abs({scaled} - floor({scaled}) - 0.5D) > 0.000001D"
    quick = f"concat(string({plain} div {unit}L), '.', lpad(string({plain} % {unit}L), {digits}, '0'))"
    sign = f"CASE WHEN {value} < 0 THEN '-' ELSE '{'+' if signed else ''}' END"
    return F.expr(f"concat({sign}, CASE WHEN {sure} THEN {quick} ELSE {text} END)")


def plain_number(value: Column) -> Column:
    """Text of a number; integral values carry no decimals."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def printed_date(value: Column) -> Column:
    return F.date_format(value, "dd-MM-yyyy")


def priority_rank(priority: Column) -> Column:
    """1 is the most urgent; unknown priorities come last."""
    return F.when(priority == "RESAMPLE", 1).when(priority == "REVIEW", 2).when(priority == "MONITOR", 3).otherwise(4)


def with_missing(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Add absent optional columns as typed nulls."""
    absent = {name: F.lit(None).cast(kind) for name, kind in types.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df
