"""The language in which cohorts are written: typed series, frames, datasets.

Every operation makes nodes of the expression graph and nothing else; Spark is not touched.
"""

from __future__ import annotations

import datetime
import re
from pathlib import Path

from .functions.codes import Code, MultiCodeString, any_of_pattern
from .functions.durations import Duration, days, months, weeks, years
from .plans import nodes as n
from .plans.nulls import validate_population

__all__ = ["Dataset", "Error", "Series", "case", "create_dataset", "days", "maximum_of", "minimum_of", "months", "table", "table_from_file", "table_from_rows", "weeks", "when", "years"]


class Error(Exception):
    """A definition that cannot be run."""


def to_date(value):
    """ISO dates with hyphens become dates; other strings are an error, other values stay."""
    if isinstance(value, datetime.datetime):
        raise TypeError("dates are expected, not times")
    if isinstance(value, str):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            raise ValueError(f"{value!r} is not a date of the form YYYY-MM-DD")
        return datetime.date.fromisoformat(value)
    return value


def to_node(value, like: type | None = None) -> n.Series:
    """The node of a series, or a literal, cast to the type ``like`` where that is harmless."""
    if isinstance(value, BaseSeries):
        return value._node
    if isinstance(value, BaseFrame):
        raise TypeError("a table was given where one of its columns is needed")
    if isinstance(value, (Duration, DateDifference)):
        raise TypeError(f"{type(value).__name__} cannot be used here; take its .days, .months or .years")
    if callable(value) and not isinstance(value, type):
        raise TypeError(f"a function was given where a value is needed; was {getattr(value, '__name__', value)}() meant?")
    if like is not None:
        if issubclass(like, datetime.date):
            value = to_date(value)
        elif like is float and type(value) is int:
            value = float(value)
        elif issubclass(like, Code) and isinstance(value, str):
            value = like(value)
    if type(value) not in (bool, int, float, str, datetime.date) and not isinstance(value, Code):
        raise TypeError(f"{value!r} is not a value that a column can hold")
    return n.Literal(value)


def wrap(node: n.Series) -> BaseSeries:
    """The series object for a node, of the class of its type and level."""
    kind = next(c for t, c in _CLASSES if issubclass(node.type, t))
    return kind[n.is_patient(node)](node)


def call(fn: str, *args, like: type | None = None) -> BaseSeries:
    return wrap(n.Call(fn, tuple(to_node(a, like) for a in args)))


class BaseSeries:
    """What all series offer."""

    _node: n.Series

    def __init__(self, node: n.Series):
        self._node = node

    def __hash__(self):
        raise TypeError(f"{type(self).__name__} cannot be hashed; is it used as a dictionary key or set member?")

    def __bool__(self):
        raise TypeError("a series has no truth value of its own: write & for and, | for or, ~ for not, each side in parentheses")

    def _like(self) -> type:
        return self._node.type

    def __eq__(self, other):
        return call("eq", self, other, like=self._like())

    def __ne__(self, other):
        return call("ne", self, other, like=self._like())

    def is_null(self):
        """True where the value is missing."""
        return call("is_null", self)

    def is_not_null(self):
        return ~self.is_null()

    def when_null_then(self, other):
        """The value, or ``other`` where it is missing."""
        return case(when(self.is_not_null()).then(self), otherwise=other)

    def is_in(self, other):
        """Whether the value is in a collection, or among the patient's values of an event series."""
        if isinstance(other, BaseSeries):
            if n.is_patient(other._node):
                raise TypeError("is_in takes a collection of values or an event series")
            return wrap(n.InSeries(self._node, other._node))
        if isinstance(other, (str, bytes)):
            raise TypeError("is_in takes a collection, not a string")
        members = [to_node(x, self._like()) for x in (other.keys() if isinstance(other, dict) else other)]
        if not all(isinstance(m, n.Literal) for m in members):
            raise TypeError("is_in takes plain values")
        return wrap(n.InSet(self._node, frozenset(m.value for m in members)))

    def is_not_in(self, other):
        return ~self.is_in(other)

    def map_values(self, mapping: dict, default=None):
        """The value that ``mapping`` gives for each value, else ``default``."""
        groups: dict = {}
        for key, value in mapping.items():
            groups.setdefault((type(value), value), []).append(key)
        return case(*[when(self.is_in(keys) if len(keys) > 1 else self == keys[0]).then(value) for (_, value), keys in groups.items()], otherwise=default)


class EventSeries(BaseSeries):
    def count_distinct_for_patient(self):
        """How many different values, nulls aside, a patient has."""
        return wrap(n.Aggregate("count_distinct", self._node))


class PatientSeries(BaseSeries):
    pass


class Comparable:
    def __lt__(self, other):
        return call("lt", self, other, like=self._like())

    def __le__(self, other):
        return call("le", self, other, like=self._like())

    def __gt__(self, other):
        return call("gt", self, other, like=self._like())

    def __ge__(self, other):
        return call("ge", self, other, like=self._like())


class ComparableEvents(EventSeries):
    def minimum_for_patient(self):
        return wrap(n.Aggregate("min", self._node))

    def maximum_for_patient(self):
        return wrap(n.Aggregate("max", self._node))


class Boolean:
    def __and__(self, other):
        return call("and", self, other)

    def __or__(self, other):
        return call("or", self, other)

    def __rand__(self, other):
        return call("and", other, self)

    def __ror__(self, other):
        return call("or", other, self)

    def __invert__(self):
        return call("not", self)

    def as_int(self):
        return call("to_int", self)


class Numeric(Comparable):
    def __add__(self, other):
        return call("add", self, other, like=self._like())

    def __radd__(self, other):
        return self + other

    def __sub__(self, other):
        return call("sub", self, other, like=self._like())

    def __rsub__(self, other):
        return call("sub", other, self, like=self._like())

    def __mul__(self, other):
        return call("mul", self, other, like=self._like())

    def __rmul__(self, other):
        return self * other

    def __truediv__(self, other):
        """A float; null where ``other`` is zero."""
        return call("div", self, other, like=self._like())

    def __rtruediv__(self, other):
        return call("div", other, self, like=self._like())

    def __floordiv__(self, other):
        return call("floordiv", self, other, like=self._like())

    def __rfloordiv__(self, other):
        return call("floordiv", other, self, like=self._like())

    def __pow__(self, other):
        return call("pow", self, other, like=self._like())

    def __rpow__(self, other):
        return call("pow", other, self, like=self._like())

    def __neg__(self):
        return call("neg", self)

    def __abs__(self):
        return call("abs", self)

    def absolute(self):
        return abs(self)

    def as_int(self):
        """Rounded towards zero."""
        return call("to_int", self)

    def as_float(self):
        return call("to_float", self)


class NumericEvents(ComparableEvents):
    def sum_for_patient(self):
        return wrap(n.Aggregate("sum", self._node))

    def mean_for_patient(self):
        return wrap(n.Aggregate("mean", self._node))


class Text(Comparable):
    def contains(self, other):
        """Whether ``other`` occurs in the string, letter by letter."""
        return call("contains", self, other)


class Dated(Comparable):
    @property
    def year(self):
        return call("year", self)

    @property
    def month(self):
        return call("month", self)

    @property
    def day(self):
        return call("day", self)

    def to_first_of_year(self):
        return call("first_of_year", self)

    def to_first_of_month(self):
        return call("first_of_month", self)

    def is_before(self, other):
        return self < other

    def is_on_or_before(self, other):
        return self <= other

    def is_after(self, other):
        return self > other

    def is_on_or_after(self, other):
        return self >= other

    def is_between_but_not_on(self, start, end):
        return (self > start) & (self < end)

    def is_on_or_between(self, start, end):
        return (self >= start) & (self <= end)

    def is_during(self, interval):
        start, end = interval
        return self.is_on_or_between(start, end)

    def __add__(self, other):
        return other.added_to(self) if isinstance(other, Duration) else NotImplemented

    __radd__ = __add__

    def __sub__(self, other):
        if isinstance(other, Duration):
            return (-other).added_to(self)
        if isinstance(other, (datetime.date, str, BaseSeries)):
            return DateDifference(self, other)
        return NotImplemented

    def __rsub__(self, other):
        return DateDifference(other, self) if isinstance(other, (datetime.date, str)) else NotImplemented


class DateEvents(ComparableEvents):
    def count_episodes_for_patient(self, maximum_gap):
        """Episodes: runs of dates no more than ``maximum_gap`` (days or weeks) apart."""
        if not isinstance(maximum_gap, (days, weeks)) or not isinstance(maximum_gap.value, int) or maximum_gap.value < 0:
            raise TypeError("maximum_gap must be a number of days or weeks that is not negative")
        return wrap(n.Aggregate("episodes", self._node, maximum_gap.value * (7 if isinstance(maximum_gap, weeks) else 1)))


class DateDifference:
    """Whole elapsed time between two dates: .days, .weeks, .months or .years of it."""

    def __init__(self, end, start):
        self._dates = to_node(start, datetime.date), to_node(end, datetime.date)

    def _diff(self, unit: str):
        start, end = self._dates
        return wrap(n.Call(f"diff_{unit}", (start, end)))

    @property
    def days(self):
        return self._diff("days")

    @property
    def weeks(self):
        return self.days // 7

    @property
    def months(self):
        return self._diff("months")

    @property
    def years(self):
        return self._diff("years")


class Coded:
    def to_category(self, categorisation: dict, default=None):
        return self.map_values(categorisation, default)


#: Longer lists are searched by one pattern.
FEW_PARTS = 8


class MultiCoded:
    """Only searches make sense of several codes in one string."""

    def _refuse(self, *_):
        raise TypeError("use contains or contains_any_of: the column holds several codes in one string")

    __eq__ = __ne__ = is_in = is_not_in = map_values = _refuse
    __hash__ = BaseSeries.__hash__

    def contains(self, code):
        """Whether a code, or one that begins so, occurs."""
        return call("contains", self, self._node.type.part(code))

    def contains_any_of(self, codelist):
        parts = sorted({self._node.type.part(c) for c in codelist})
        if not parts:
            return wrap(n.InSet(call("contains", self, "")._node, frozenset()))
        if len(parts) > FEW_PARTS:
            return call("contains_any", self, any_of_pattern(parts))
        found = self.contains(parts[0])
        for p in parts[1:]:
            found = found | self.contains(p)
        return found


def _make(name: str, functions: type, events: type = EventSeries) -> tuple[type, type]:
    return type(f"{name}EventSeries", (functions, events), {}), type(f"{name}PatientSeries", (functions, PatientSeries), {})


class _Nothing:
    pass


_CLASSES = [
    (bool, _make("Bool", Boolean)),
    (int, _make("Int", Numeric, NumericEvents)),
    (float, _make("Float", Numeric, NumericEvents)),
    (str, _make("Str", Text, ComparableEvents)),
    (datetime.date, _make("Date", Dated, DateEvents)),
    (Code, _make("Code", Coded)),
    (MultiCodeString, _make("MultiCodeString", MultiCoded)),
]


# ---------------------------------------------------------------- frames


class BaseFrame:
    def __init__(self, frame: n.Frame):
        self._frame = frame

    def _select_column(self, name: str):
        return wrap(n.Column(self._frame, name))

    def exists_for_patient(self):
        """Whether the patient has a row; never null."""
        return wrap(n.Aggregate("exists", self._frame))

    def count_for_patient(self):
        """How many rows the patient has; 0 for none."""
        return wrap(n.Aggregate("count", self._frame))

    def __bool__(self):
        raise TypeError("a table has no truth value; is exists_for_patient() meant?")


class PatientFrame(BaseFrame):
    """A table of at most one row a patient."""


class EventFrame(BaseFrame):
    """A table of any number of rows a patient."""

    def where(self, condition):
        """Rows for which the condition is true."""
        return type(self)(n.Where(self._frame, to_node(condition)))

    def except_where(self, condition):
        """All other rows: those for which it is false or null."""
        c = to_node(condition)
        n.typed(c, bool)
        return type(self)(n.Where(self._frame, n.Call("or", (n.Call("not", (c,)), n.Call("is_null", (c,))))))

    def sort_by(self, *keys):
        """Ascending, the first key first, nulls before all; earlier sorts break ties."""
        if not keys:
            raise TypeError("sort_by takes at least one series")
        frame = self._frame
        for key in reversed(keys):
            if not isinstance(key, BaseSeries):
                raise TypeError("sort_by takes series")
            frame = n.SortBy(frame, key._node)
        return _derived(type(self), SortedFrame)(frame)


class SortedFrame:
    def first_for_patient(self):
        """The first row of each patient."""
        return _derived(type(self), PatientFrame)(n.Pick(self._frame, last=False))

    def last_for_patient(self):
        return _derived(type(self), PatientFrame)(n.Pick(self._frame, last=True))


def _derived(cls: type, kind: type) -> type:
    """The class of a sorted or picked frame: the table's columns and methods on another base."""
    own = getattr(cls, "_table_class", cls)
    bases = (SortedFrame, own) if kind is SortedFrame else (PatientFrame,)
    if kind is SortedFrame and issubclass(cls, SortedFrame):
        return cls
    body = {} if kind is SortedFrame else {k: v for c in reversed(own.__mro__) if issubclass(c, BaseFrame) and c not in (BaseFrame, EventFrame, PatientFrame) for k, v in vars(c).items() if isinstance(v, (Series, property)) or (callable(v) and not k.startswith("__"))}
    return type(own.__name__, bases, body | {"_table_class": own})


class Series:
    """A column of a table class: its type, and what is known of its values.

    dummy_data_constraints hold for made-up values alone, where they stand in for
    constraints of their kind. required and the notes are documentation.
    """

    def __init__(self, type_, description: str = "", constraints=(), required: bool = True, implementation_notes_to_add_to_description: str = "", notes_for_implementors: str = "", dummy_data_constraints=()):
        self.type_, self.description, self.constraints, self.dummy_data_constraints, self.required = type_, description, tuple(constraints), tuple(dummy_data_constraints), required
        for given in (self.constraints, self.dummy_data_constraints):
            kinds = [type(c) for c in given]
            if len(set(kinds)) < len(kinds):
                raise ValueError("a column may have one constraint of each kind")

    def __set_name__(self, owner, name):
        self.name = name

    def __get__(self, instance, owner):
        return self if instance is None else instance._select_column(self.name)


def _schema(cls: type) -> n.Schema:
    columns = {s.name: n.ColumnDef(s.type_, s.constraints, s.dummy_data_constraints) for c in reversed(cls.__mro__) for s in vars(c).values() if isinstance(s, Series)}
    if "patient_id" in columns:
        raise ValueError("patient_id is part of every table and not declared")
    if not columns:
        raise ValueError(f"{cls.__name__} has no columns")
    return n.Schema(tuple(columns.items()))


def _kind(cls: type) -> bool:
    if not isinstance(cls, type) or PatientFrame not in cls.__mro__ and EventFrame not in cls.__mro__:
        raise TypeError("a table class must inherit from PatientFrame or EventFrame")
    return issubclass(cls, PatientFrame)


def table(cls):
    """Makes a table of a class that lists its columns; its inner class _meta may set table_name, required_permission, activation_filter_field."""
    meta = {k: v for k, v in vars(getattr(cls, "_meta", _Nothing)).items() if not k.startswith("__")}
    unknown = set(meta) - {"table_name", "required_permission", "activation_filter_field"}
    if unknown:
        raise ValueError(f"_meta knows no {', '.join(sorted(unknown))}")
    return cls(n.Table(meta.get("table_name", cls.__name__), _schema(cls), _kind(cls), meta.get("required_permission"), meta.get("activation_filter_field")))


def table_from_rows(rows):
    """A patient table of literal rows, patient_id first."""
    if not hasattr(rows, "__iter__") or hasattr(rows, "__next__"):
        raise TypeError("rows must be a collection that can be read more than once")

    def made(cls):
        if not _kind(cls):
            raise TypeError("a table of rows must be a PatientFrame")
        schema = _schema(cls)
        checked = []
        for row in rows:
            row = tuple(row)
            if len(row) != len(schema.columns) + 1 or type(row[0]) is not int:
                raise ValueError(f"row {row!r} does not have patient_id and {len(schema.columns)} values")
            values = [None if v is None else to_node(v, d.type).value for v, (_, d) in zip(row[1:], schema.columns)]
            for v, (name, d) in zip(values, schema.columns):
                if v is not None and type(v) is not d.type:
                    raise TypeError(f"{name}: {v!r} is not of type {d.type.__name__}")
            checked.append((row[0], *values))
        if len({r[0] for r in checked}) < len(checked):
            raise ValueError("a patient has more than one row")
        return cls(n.InlineTable(tuple(checked), schema))

    return made


def table_from_file(path, *, columns: dict | None = None):
    """A patient table from a .csv, .csv.gz or .arrow file: with ``columns`` (name to type) at once, else as a class decorator."""
    from .sources.files import read_rows

    def load(schema: n.Schema):
        return list(read_rows(Path(path), schema))

    if columns is not None:
        cls = type("table_from_file", (PatientFrame,), {k: _named(k, t) for k, t in columns.items()})
        return table_from_rows(load(_schema(cls)))(cls)
    return lambda cls: table_from_rows(load(_schema(cls)))(cls)


def _named(name: str, type_) -> Series:
    s = type_ if isinstance(type_, Series) else Series(type_)
    s.name = name
    return s


# ---------------------------------------------------------------- cases


class when:
    """when(condition).then(value), for case(); or .otherwise(value) to end there."""

    def __init__(self, condition):
        self._condition = to_node(condition)
        n.typed(self._condition, bool)

    def then(self, value):
        return WhenThen(self._condition, value)


class WhenThen:
    def __init__(self, condition, value):
        self._condition, self._value = condition, value

    def otherwise(self, value):
        return case(self, otherwise=value)


def case(*when_thens, otherwise=None):
    """The value of the first condition that is true; ``otherwise`` if none is."""
    if not when_thens:
        raise TypeError("case takes at least one when(...).then(...)")
    for w in when_thens:
        if not isinstance(w, WhenThen):
            raise TypeError("case takes when(...).then(...); is a then() missing?")
    values = [w._value for w in when_thens] + [otherwise]
    like = next((v._node.type for v in values if isinstance(v, BaseSeries)), None)
    if like is None and any(type(v) is float for v in values):
        like = float
    made = [None if v is None else to_node(v, like) for v in values]
    return wrap(n.Choice(tuple((w._condition, v) for w, v in zip(when_thens, made)), made[-1]))


def _extreme(fn: str, values):
    like = next((v._node.type for v in values if isinstance(v, BaseSeries)), None)
    if like is None:
        raise TypeError("at least one argument must be a series")
    return wrap(n.Call(fn, tuple(to_node(v, like) for v in values)))


def maximum_of(value, other_value, *other_values):
    """The largest of the values that are not null."""
    return _extreme("greatest", (value, other_value, *other_values))


def minimum_of(value, other_value, *other_values):
    """The smallest of the values that are not null."""
    return _extreme("least", (value, other_value, *other_values))


def Parameter(name: str, type_: type):
    return wrap(n.Param(name, type_))


# ---------------------------------------------------------------- datasets

#: Names that an output column cannot have.
RESERVED = {"population", "variables", "patient_id", "add_column", "define_population", "add_event_table", "configure_dummy_data", "configure_experimental", "dummy_data_config", "events"}
_NAME = re.compile(r"[A-Za-z]+[A-Za-z0-9_]*")


def check_name(name: str, taken) -> None:
    if name in RESERVED:
        raise AttributeError(f"{name!r} is not allowed as a name")
    if not _NAME.fullmatch(name):
        raise AttributeError(f"{name!r} is not a name: letters, digits and underscores, a letter first")
    if name in taken:
        raise AttributeError(f"{name!r} is defined already")


class DummyDataConfig:
    """How many patients are made up, for how long that may go on, and what else must hold of them. legacy: rows do not look at the definition's values."""

    def __init__(self, population_size=10, legacy=False, timeout=60, additional_population_constraint=None):
        self.population_size, self.legacy, self.timeout, self.additional_population_constraint = population_size, legacy, timeout, additional_population_constraint


class Dataset:
    """A population and one column for each variable; event tables beside it."""

    def __init__(self):
        object.__setattr__(self, "_population", None)
        object.__setattr__(self, "_variables", {})
        object.__setattr__(self, "_events", {})
        object.__setattr__(self, "dummy_data_config", DummyDataConfig())

    def define_population(self, population_condition):
        """Patients for whom the condition is true. It must not be true of a patient of whom nothing is known."""
        if self._population is not None:
            raise AttributeError("define_population() must be called once")
        if not isinstance(population_condition, BaseSeries):
            raise TypeError("a population needs a boolean series; is exists_for_patient() missing?")
        validate_population(population_condition._node, Error)
        object.__setattr__(self, "_population", population_condition._node)

    def add_column(self, column_name: str, series):
        check_name(column_name, {*self._variables, *self._events})
        if not isinstance(series, BaseSeries):
            raise TypeError(f"{column_name!r} must be a series, not {type(series).__name__}")
        if not n.is_patient(series._node):
            raise TypeError(f"{column_name!r} has many values a patient: take the first or last row, or aggregate")
        if isinstance(series, MultiCoded):
            raise TypeError(f"{column_name!r} holds several codes in one string, which cannot be output")
        self._variables[column_name] = series._node

    def add_event_table(self, name: str, **columns):
        """An output table of event rows, for the population only; all columns from the same rows."""
        check_name(name, {*self._variables, *self._events})
        if not columns:
            raise TypeError("an event table needs columns")
        nodes = {}
        for key, series in columns.items():
            check_name(key, nodes)
            if not isinstance(series, BaseSeries):
                raise TypeError(f"{key!r} must be a series")
            nodes[key] = series._node
        n.together(*nodes.values())
        if all(map(n.is_patient, nodes.values())):
            raise TypeError("an event table needs an event series")
        self._events[name] = nodes
        return EventTable(self, name)

    def configure_dummy_data(self, population_size=10, legacy=False, timeout=60, additional_population_constraint=None):
        object.__setattr__(self, "dummy_data_config", DummyDataConfig(population_size, legacy, timeout, additional_population_constraint))

    def __setattr__(self, name, value):
        if name == "population":
            raise AttributeError("use define_population()")
        self.add_column(name, value)

    def __getattr__(self, name):
        if name == "population" and self._population is not None:
            return wrap(self._population)
        if name in self._variables:
            return wrap(self._variables[name])
        if name in self._events:
            return EventTable(self, name)
        raise AttributeError(f"no variable {name!r} has been defined")


class EventTable:
    def __init__(self, dataset, name):
        object.__setattr__(self, "_at", (dataset, name))

    def add_column(self, column_name, series):
        dataset, name = self._at
        nodes = dataset._events[name]
        check_name(column_name, nodes)
        n.together(*nodes.values(), series._node)
        nodes[column_name] = series._node

    __setattr__ = add_column

    def __getattr__(self, key):
        dataset, name = self._at
        if key in dataset._events[name]:
            return wrap(dataset._events[name][key])
        raise AttributeError(key)


def create_dataset() -> Dataset:
    return Dataset()
