"""Measures: ratios of sums over intervals and groups, with small numbers suppressed.

All measures of one denominator and one list of intervals are one query: (patient, interval)
rows of numerators and groups, then one aggregation by grouping sets. There is no loop over
intervals, so a table is read once however many there are.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import BaseSeries, DummyDataConfig, Error, Parameter, to_date, to_node
from .operators.expressions import spark_type
from .plans import nodes as n
from .plans.nulls import validate_population
from .plans.planner import END, START, Planner

#: Counts up to SMALL become 0, all are rounded to the nearest ROUND.
SMALL, ROUND = 7, 5


class _Interval:
    """Stands for the interval in measure definitions: its two dates, or both together for is_during()."""

    start_date = Parameter(START, datetime.date)
    end_date = Parameter(END, datetime.date)

    def __iter__(self):
        return iter((self.start_date, self.end_date))

    def __getitem__(self, i):
        return (self.start_date, self.end_date)[i]

    def __repr__(self):
        return "INTERVAL"


INTERVAL = _Interval()


@dataclass(frozen=True)
class Measure:
    name: str
    numerator: n.Series
    denominator: n.Series
    group_by: tuple[tuple[str, n.Series], ...]
    intervals: tuple[tuple[datetime.date, datetime.date], ...]


@dataclass
class Measures:
    """A collection of measures; disclosure control is on until it is configured away."""

    _measures: dict[str, Measure] = field(default_factory=dict)
    _defaults: dict = field(default_factory=dict)
    disclosure_control: bool = True
    dummy_data_config: DummyDataConfig = field(default_factory=DummyDataConfig)

    def define_measure(self, name, numerator=None, denominator=None, group_by=None, intervals=None):
        """One measure; what is left out comes from define_defaults()."""
        if not re.fullmatch(r"[A-Za-z]\w*", name, re.ASCII):
            raise Error(f"measure names are letters, digits and underscores, a letter first; got {name!r}")
        if name in self._measures:
            raise Error(f"measure already defined with name: {name}")
        given = {k: v if v is not None else self._defaults.get(k) for k, v in (("numerator", numerator), ("denominator", denominator), ("group_by", group_by), ("intervals", intervals))}
        for k in ("numerator", "denominator", "intervals"):
            if given[k] is None:
                raise Error(f"no value supplied for '{k}' and no default defined")
        top, bottom = (_counted(given[k], k) for k in ("numerator", "denominator"))
        validate_population(_positive(bottom), Error)
        groups = tuple((k, _group(k, v)) for k, v in (given["group_by"] or {}).items())
        for k, v in groups:
            for other in self._measures.values():
                if dict(other.group_by).get(k, v) != v:
                    raise Error(f"inconsistent definitions for the group {k!r} in measures {other.name} and {name}")
        self._measures[name] = Measure(name, top, bottom, groups, _intervals(given["intervals"]))

    def define_defaults(self, numerator=None, denominator=None, group_by=None, intervals=None):
        if self._defaults:
            raise Error("the defaults have been defined already")
        self._defaults.update(numerator=numerator, denominator=denominator, group_by=group_by, intervals=intervals)

    def configure_disclosure_control(self, *, enabled=True):
        self.disclosure_control = enabled

    def configure_dummy_data(self, population_size=10, legacy=False, timeout=60, additional_population_constraint=None):
        self.dummy_data_config = DummyDataConfig(population_size, legacy, timeout, additional_population_constraint)

    def __iter__(self):
        return iter(self._measures.values())

    def __len__(self):
        return len(self._measures)


def create_measures() -> Measures:
    return Measures()


def _counted(series, what: str) -> n.Series:
    if not isinstance(series, BaseSeries) or not n.is_patient(series._node) or series._node.type not in (bool, int):
        raise TypeError(f"the {what} must be a boolean or integer series of one value a patient")
    return series._node


def _group(name, series) -> n.Series:
    if not isinstance(name, str) or not re.fullmatch(r"[A-Za-z]\w*", name, re.ASCII) or name in ("measure", "interval_start", "interval_end", "ratio", "numerator", "denominator", "patient_id"):
        raise Error(f"{name!r} cannot be the name of a group")
    if not isinstance(series, BaseSeries) or not n.is_patient(series._node):
        raise TypeError(f"the group {name!r} must be a series of one value a patient")
    return series._node


def _intervals(value) -> tuple:
    from .functions.durations import Duration

    if isinstance(value, Duration):
        raise TypeError(f"a list of intervals is needed; is {type(value).__name__}({value.value}).starting_on(...) or ending_on(...) meant?")
    out = set()
    for pair in value:
        start, end = map(to_date, pair)
        if not isinstance(start, datetime.date) or not isinstance(end, datetime.date):
            raise TypeError("intervals are pairs of dates")
        if start > end:
            raise Error(f"an interval ends before it starts: {start} {end}")
        out.add((start, end))
    if not out:
        raise Error("at least one interval is needed")
    return tuple(sorted(out))


def _positive(denominator: n.Series) -> n.Series:
    return denominator if denominator.type is bool else n.Call("gt", (denominator, n.Literal(0)))


def calculate(planner: Planner, measures: Measures, ready: Callable | None = None) -> DataFrame:
    """measure, interval_start, interval_end, ratio, numerator, denominator and all groups, one row for each that has a denominator.

    ready: checks and rewrites (population, series by name) of each query before it is planned.
    """
    if not len(measures):
        raise Error("no measures defined")
    groups = {k: v for m in measures for k, v in m.group_by}
    together: dict[tuple, list[Measure]] = {}
    for m in measures:
        together.setdefault((m.denominator, m.intervals), []).append(m)
    out = None
    for (denominator, intervals), members in together.items():
        part = _one_query(planner, denominator, intervals, members, groups, ready or (lambda *roots: roots))
        out = part if out is None else out.unionByName(part)
    return suppressed(out) if measures.disclosure_control else out


def _one_query(planner: Planner, denominator, intervals, members: list[Measure], groups: dict, ready: Callable) -> DataFrame:
    tops = {t: f"_n{i}" for i, t in enumerate(dict.fromkeys(m.numerator for m in members))}
    cols = dict(kv for m in members for kv in m.group_by)
    outputs = {"_d": denominator, **{name: t for t, name in tops.items()}, **{f"_g_{k}": v for k, v in cols.items()}}
    predicate, outputs = ready(_positive(denominator), outputs)
    rows = planner.over_intervals(predicate, outputs, intervals)
    ends = ["interval_start", "interval_end"]
    names = [f"_g_{k}" for k in cols]
    sets = list(dict.fromkeys(tuple(sorted(k for k, _ in m.group_by)) for m in members))
    sums = [F.sum(F.col(c).cast("bigint")).alias(c) for c in ("_d", *tops.values())]
    if names:
        grouped = rows.groupingSets([[F.col(c) for c in (*ends, *(f"_g_{k}" for k in s))] for s in sets], *ends, *names)
        summed = grouped.agg(*sums, F.grouping_id().alias("_set"))
    else:
        summed = rows.groupBy(*ends).agg(*sums).withColumn("_set", F.lit(0).cast("bigint"))

    def set_id(s) -> int:
        """Bits of the columns that are not grouped by, the first column highest."""
        return sum(1 << (len(names) - 1 - i) for i, k in enumerate(cols) if k not in s)

    def row(m: Measure):
        top = F.coalesce(F.col(tops[m.numerator]), F.lit(0).cast("bigint"))
        own = dict(m.group_by)
        shown = [(F.col(f"_g_{k}") if k in own else F.lit(None)).cast(spark_type(v.type)).alias(k) for k, v in groups.items()]
        return F.struct(F.lit(set_id([k for k, _ in m.group_by])).alias("set"), F.lit(m.name).alias("measure"), *ends, F.try_divide(top.cast("double"), F.col("_d")).alias("ratio"), top.alias("numerator"), F.col("_d").alias("denominator"), *shown)

    found = summed.where("_d > 0").select("_set", F.explode(F.array(*map(row, members))).alias("m")).where("m.set = _set")
    return found.select("m.*").drop("set")


def suppressed(df: DataFrame) -> DataFrame:
    """Small counts become 0, others multiples of ROUND, and the ratio follows from them."""

    def safe(c):
        return F.when(F.col(c) <= SMALL, 0).otherwise(F.floor((F.col(c) + ROUND // 2) / ROUND) * ROUND).cast("bigint").alias(c)

    safe_df = df.withColumns({c: safe(c) for c in ("numerator", "denominator")})
    return safe_df.withColumn("ratio", F.try_divide(F.col("numerator").cast("double"), F.col("denominator")))


def by_measure(df: DataFrame, measures: Measures) -> dict[str, DataFrame]:
    """A table for each measure, with its own groups only."""
    out = {}
    for m in measures:
        keep = [c for c in df.columns if c in ("interval_start", "interval_end", "ratio", "numerator", "denominator") or c in dict(m.group_by)]
        out[m.name] = df.where(F.col("measure") == m.name).select("measure", *keep)
    return out
