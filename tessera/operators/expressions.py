"""Column templates of the series operators.

All are total under ANSI mode, where Spark raises on division by zero, overflow and the
like, since Spark may compute an argument for rows that a filter or a case drops. What
has no value of its type is null: whole numbers beyond 64 bits, casts of NaN and infinities, dates
outside the years 1 to 9999.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.codes import Code, MultiCodeString
from ..plans import nodes as n

SPARK_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string", datetime.date: "date"}


def spark_type(kind: type) -> str:
    return "string" if issubclass(kind, (Code, MultiCodeString)) else SPARK_TYPES[kind]


def literal(value) -> Column:
    if isinstance(value, Code):
        return F.lit(value.value)
    return F.lit(value).cast(spark_type(type(value)))


def null(kind: type) -> Column:
    return F.lit(None).cast(spark_type(kind))


def _neg(a: Column) -> Column:
    return F.try_multiply(a, F.lit(-1))


def _abs(a: Column) -> Column:
    return F.when(a >= 0, a).otherwise(_neg(a))


def _floordiv(a: Column, b: Column) -> Column:
    q = _div(a, b)
    return F.when((q >= -(2.0**63)) & (q < 2.0**63), F.floor(q)).cast("bigint")


def _amount(k: Column, most: int) -> Column:
    """``k`` as an int, null beyond what could lead from one date to another."""
    return F.when(k.between(-most, most), k).cast("int")


def _date(d: Column) -> Column:
    return F.when(d.between(F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")), d)


def _add_days(d: Column, k: Column) -> Column:
    return _date(F.date_add(d, _amount(k, 3_652_059)))


def _pow(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    bad = ((a == 0) & (b < 0)) | ((a < 0) & (b != F.floor(b)))
    return F.when(~bad, F.pow(F.when(bad, F.lit(1.0)).otherwise(a), b))


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def _months(start: Column, end: Column) -> Column:
    return (12 * (F.year(end) - F.year(start)) + F.month(end) - F.month(start) - F.when(F.day(end) < F.day(start), 1).otherwise(0)).cast("bigint")


def _years(start: Column, end: Column) -> Column:
    earlier = (F.month(end) < F.month(start)) | ((F.month(end) == F.month(start)) & (F.day(end) < F.day(start)))
    return (F.year(end) - F.year(start) - F.when(earlier, 1).otherwise(0)).cast("bigint")


def _add_months(d: Column, k: Column) -> Column:
    moved = F.add_months(d, _amount(k, 12 * 9999))  # keeps to the month's last day
    return _date(F.date_add(moved, F.when(F.day(moved) < F.day(d), 1).otherwise(0)))


def _add_years(d: Column, k: Column) -> Column:
    return _date(F.date_add(F.add_months(F.trunc(d, "MM"), 12 * _amount(k, 9999)), F.day(d) - 1))


def _skipping(fn: Callable) -> Callable:
    return lambda *args: fn(*args) if len(args) > 1 else args[0]


FUNCTIONS: dict[str, Callable[..., Column]] = {
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a, "is_null": lambda a: a.isNull(),
    "neg": _neg, "abs": _abs, "add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply,
    "div": _div, "floordiv": _floordiv, "pow": _pow,
    "to_int": lambda a: a.try_cast("bigint"), "to_float": lambda a: a.cast("double"),
    "add_days": _add_days, "add_months": _add_months, "add_years": _add_years,
    "diff_days": lambda a, b: F.datediff(b, a).cast("bigint"), "diff_months": _months, "diff_years": _years,
    "year": lambda d: F.year(d).cast("bigint"), "month": lambda d: F.month(d).cast("bigint"), "day": lambda d: F.day(d).cast("bigint"),
    "first_of_year": lambda d: F.trunc(d, "YEAR"), "first_of_month": lambda d: F.trunc(d, "MM"),
    "contains": F.contains, "contains_any": F.rlike, "greatest": _skipping(F.greatest), "least": _skipping(F.least),
}


def in_values(x: Column, members) -> Column:
    """Nothing is in an empty set, not even null."""
    return x.isin([m.value if isinstance(m, Code) else m for m in sorted(members, key=str)]) if members else F.lit(False)


def in_array(x: Column, members: Column) -> Column:
    return F.when(F.coalesce(F.size(members), F.lit(0)) <= 0, F.lit(False)).when(x.isNull(), F.lit(None).cast("boolean")).otherwise(F.array_contains(members, x))


#: Longer lists of event codes are joined as a table instead of standing in the plan.
LONG_LIST = 64


def long_list(x: n.Node) -> bool:
    """Whether ``x`` tests an event column for membership in a long list."""
    return isinstance(x, n.InSet) and len(x.members) > LONG_LIST and isinstance(x.value, n.Column) and not n.is_patient(x.value)


def compile_series(series: n.Series, leaf: Callable[[n.Node], Column], joined: Callable[[n.InSet], Column] | None = None) -> Column:
    """The Column of a series; ``leaf`` gives those of columns, aggregates and parameters, ``joined`` those of long lists that have been joined."""

    made: dict[n.Node, Column] = {}

    def make(x: n.Series) -> Column:
        if x in made:
            return made[x]
        if isinstance(x, n.Literal):
            out = literal(x.value)
        elif isinstance(x, (n.Column, n.Aggregate, n.Param)):
            out = leaf(x)
        elif isinstance(x, n.Call):
            out = FUNCTIONS[x.fn](*map(make, x.args))
        elif isinstance(x, n.InSet):
            out = joined(x) if joined and long_list(x) else in_values(make(x.value), x.members)
        elif isinstance(x, n.InSeries):
            out = in_array(make(x.value), leaf(n.Aggregate("set", x.members)))
        elif isinstance(x, n.Choice):
            out = None
            for c, v in x.cases:
                value = null(x.type) if v is None else make(v)
                out = F.when(make(c), value) if out is None else out.when(make(c), value)
            out = out.otherwise(null(x.type) if x.default is None else make(x.default))
        else:
            raise TypeError(f"{type(x).__name__} is not a series")
        made[x] = out
        return out

    return make(series)
