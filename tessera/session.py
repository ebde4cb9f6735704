"""Running definitions: datasets and measures against a catalog of tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import permissions
from .language import BaseFrame, BaseSeries, Dataset, Error
from .measures import Measures, by_measure, calculate
from .plans import nodes as n
from .plans.planner import Planner
from .sources.catalog import Catalog


class Engine:
    """Runs definitions on one catalog.

    semi_join: event scans are first restricted to the population, which pays where it is
    a small part of the patients. modify: a rewrite of (predicate, series by name) before
    planning, such as leaving out patients who opted out. granted: permissions, None for no
    check; what a definition claims for itself is no grant. Both concern every root of a
    definition: populations, variables, event tables, measures and what is shown.
    """

    def __init__(self, spark: SparkSession, catalog: Catalog | Callable[[n.Table], DataFrame], semi_join: bool = False, modify: Callable | None = None, granted: set[str] | None = None):
        self.spark, self.catalog, self.semi_join, self.modify, self.granted = spark, catalog, semi_join, modify, granted

    def planner(self) -> Planner:
        return Planner(self.spark, self.catalog, self.semi_join)

    def _ready(self, predicate: n.Series, series: dict, event_tables: bool = False) -> tuple[n.Series, dict]:
        """The roots of a query, checked against the granted permissions and rewritten."""
        if self.granted is not None:
            permissions.enforce(permissions.required(predicate, *series.values(), event_tables=event_tables), self.granted)
        return self.modify(predicate, series) if self.modify else (predicate, series)

    def _run(self, predicate: n.Series, variables: dict[str, n.Series], events: dict[str, dict[str, n.Series]]) -> dict[str, DataFrame]:
        flat = {("", k): x for k, x in variables.items()} | {(t, k): x for t, cols in events.items() for k, x in cols.items()}
        predicate, flat = self._ready(predicate, flat, bool(events))
        return self.planner().dataset(predicate, {k: flat["", k] for k in variables}, {t: {k: flat[t, k] for k in cols} for t, cols in events.items()})

    def tables(self, dataset: Dataset) -> dict[str, DataFrame]:
        """``dataset`` and each event table, as DataFrames that nothing has computed yet."""
        if dataset._population is None:
            raise Error("a population has not been defined; use define_population()")
        if not dataset._variables and not dataset._events:
            raise Error("no variables have been defined")
        return self._run(dataset._population, dict(dataset._variables), dataset._events)

    def dataset(self, dataset: Dataset) -> DataFrame:
        return self.tables(dataset)["dataset"]

    def measures(self, measures: Measures) -> DataFrame:
        return calculate(self.planner(), measures, self._ready)

    def measure_tables(self, measures: Measures) -> dict[str, DataFrame]:
        return by_measure(self.measures(measures), measures)

    def explain(self, definition: Dataset | Measures) -> None:
        """The physical plans, in place of a dump of SQL."""
        for df in self.tables(definition).values() if isinstance(definition, Dataset) else [self.measures(definition)]:
            df.explain("formatted")

    def show(self, element, head: int | None = None, tail: int | None = None, html: bool = False) -> str:
        """A series, frame or dataset as text or as an HTML table; a frame shows all its columns, a series only itself."""
        _grid = _table if html else _lines
        df = self._frame(element)
        ascending = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns]
        if head is None and tail is None:
            return _grid(df.columns, df.orderBy(*ascending).collect(), None)
        # only the rows shown leave the cluster
        head, tail = head or 0, tail or 0
        first = df.orderBy(*ascending).take(head + tail + 1)
        if len(first) <= head + tail:
            return _grid(df.columns, first, None)
        last = df.orderBy(*[F.col(f"`{c}`").desc_nulls_last() for c in df.columns]).take(tail) if tail else []
        return _grid(df.columns, first[:head] + last[::-1], head)

    def _frame(self, element) -> DataFrame:
        if isinstance(element, Dataset):
            return self.dataset(element)
        if isinstance(element, BaseSeries):
            cols, frame = {"value": element._node}, None
        elif isinstance(element, BaseFrame):
            frame = element._frame
            cols = {c: n.Column(frame, c) for c in frame.schema.names}
        else:
            raise TypeError("show takes series, tables and datasets")
        domain = next((d for d in map(n.domain, cols.values()) if d is not None), None)
        tables = list(dict.fromkeys(x for x in n.walk(*cols.values()) if isinstance(x, (n.Table, n.InlineTable))))
        if not tables:
            raise TypeError("a plain value has no rows to show")
        anyone = n.Aggregate("exists", tables[0])
        for t in tables[1:]:
            anyone = n.Call("or", (anyone, n.Aggregate("exists", t)))
        if domain is None:
            exists = n.Aggregate("exists", frame) if frame is not None else anyone
            return self._run(exists, cols, {})["dataset"]
        return self._run(anyone, {}, {"rows": cols})["rows"]


def in_time(spark: SparkSession, seconds: float | None, run: Callable):
    """What ``run`` returns; its Spark jobs are cancelled, and TimeoutError raised, once ``seconds`` have gone."""
    if seconds is None:
        return run()
    tag, late = f"tessera-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        out = run()
    except Exception:
        if late.is_set():
            raise TimeoutError(f"not done within {seconds:g} s") from None
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    return out


def _texts(columns: list[str], rows: list[tuple], gap: int | None) -> list[list[str]]:
    """``gap``: where rows have been left out."""
    text = [["" if v is None else ("T" if v else "F") if isinstance(v, bool) else str(v) for v in r] for r in rows]
    if gap is not None:
        text.insert(gap, ["…"] * len(columns))
    return text


def _table(columns: list[str], rows: list[tuple], gap: int | None) -> str:
    row = lambda values, tag: "<tr>" + "".join(f"<{tag}>{escape(v)}</{tag}>" for v in values) + "</tr>"
    return f"<table><thead>{row(columns, 'th')}</thead><tbody>{''.join(row(r, 'td') for r in _texts(columns, rows, gap))}</tbody></table>"


def _lines(columns: list[str], rows: list[tuple], gap: int | None) -> str:
    text = _texts(columns, rows, gap)
    width = [max(len(c), *(len(r[i]) for r in text)) if text else len(c) for i, c in enumerate(columns)]
    lines = [columns, ["-" * w for w in width], *text]
    return "\n".join(" | ".join(v.ljust(w) for v, w in zip(r, width)).rstrip() for r in lines)


_current: Engine | None = None


def use(engine: Engine | None) -> None:
    """The engine of show()."""
    global _current
    _current = engine


def show(element, *more, label: str | None = None, head: int | None = None, tail: int | None = None) -> None:
    """Prints rows of series, tables or datasets if an engine is in use; else does nothing, so definitions can keep it."""
    if _current is None:
        return
    if label:
        print(label)
    for x in (element, *more):
        print(_current.show(x, head=head, tail=tail))


_parameters: dict[str, str] = {}


def set_parameters(values: dict[str, str]) -> None:
    _parameters.clear()
    _parameters.update(values)


def get_parameter(name: str, type=str, default=None):
    """A parameter given when the definition is run."""
    if name in _parameters:
        return type(_parameters[name])
    if default is None:
        raise Error(f"no parameter {name!r} was given and it has no default")
    return default
