"""The expression graph: immutable nodes, compared by value, checked when made.

A node is a frame (rows of a table) or a series (a column). Each has a domain: None for at
most one row a patient, else the table and the filters through which its rows have passed.
Event series combine only within one domain; patient series combine with anything.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from ..functions.codes import Code, MultiCodeString


class TypeError_(TypeError):
    """An operation on values of types that do not go together."""


class DomainError(ValueError):
    """A combination of series whose rows do not match."""


@dataclass(frozen=True)
class ColumnDef:
    type: type
    constraints: tuple = ()
    #: Further constraints, on made-up values alone.
    dummy: tuple = field(default=(), compare=False)

    def constraint(self, kind: type):
        return next((c for c in self.constraints if isinstance(c, kind)), None)


@dataclass(frozen=True)
class Schema:
    columns: tuple[tuple[str, ColumnDef], ...]

    @classmethod
    def of(cls, **columns) -> Schema:
        return cls(tuple((n, c if isinstance(c, ColumnDef) else ColumnDef(c)) for n, c in columns.items()))

    def __getitem__(self, name: str) -> ColumnDef:
        return dict(self.columns)[name]

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.columns)


class Node:
    """Nodes keep their hash, so that deep graphs with shared parts stay cheap to compare."""

    def __hash__(self) -> int:
        try:
            return self.__dict__["_hash"]
        except KeyError:
            value = hash((type(self).__name__, *(_key(getattr(self, f.name)) for f in fields(self) if f.compare)))
            object.__setattr__(self, "_hash", value)
            return value

    def __eq__(self, other) -> bool:
        if self is other:
            return True
        if type(self) is not type(other) or hash(self) != hash(other):
            return False
        return all(_key(getattr(self, f.name)) == _key(getattr(other, f.name)) for f in fields(self) if f.compare)

    @property
    def inputs(self) -> tuple[Node, ...]:
        return ()


def _key(value):
    """1, 1.0 and True are different literals."""
    if isinstance(value, tuple):
        return tuple(_key(v) for v in value)
    if isinstance(value, frozenset):
        return frozenset(_key(v) for v in value)
    return (type(value), value) if isinstance(value, (bool, int, float)) else value


def node(cls):
    cls = dataclass(frozen=True, eq=False)(cls)
    return cls


def walk(*roots: Node) -> Iterator[Node]:
    """Every node below the roots once, inputs first."""
    seen: set[Node] = set()
    stack = [(r, False) for r in reversed(roots)]
    while stack:
        n, ready = stack.pop()
        if ready:
            yield n
        elif n not in seen:
            seen.add(n)
            stack.append((n, True))
            stack += [(i, False) for i in reversed(n.inputs)]


# ---------------------------------------------------------------- frames


class Frame(Node):
    schema: Schema


@node
class Table(Frame):
    name: str
    schema: Schema
    one_row: bool = False
    required_permission: str | None = field(default=None, compare=False)
    activation_filter_field: str | None = field(default=None, compare=False)


@node
class InlineTable(Frame):
    rows: tuple[tuple, ...]
    schema: Schema
    one_row: bool = True


@node
class Where(Frame):
    source: Frame
    condition: Node

    def __post_init__(self):
        need(isinstance(self.source, Frame) and not is_patient(self.source), DomainError, "only event frames can be filtered")
        typed(self.condition, bool)
        inside(self.condition, self.source)

    @property
    def schema(self) -> Schema:
        return self.source.schema

    @property
    def inputs(self):
        return self.source, self.condition


@node
class SortBy(Frame):
    source: Frame
    key: Node

    def __post_init__(self):
        need(not is_patient(self.source), DomainError, "only event frames can be sorted")
        need(domain(self.key) is not None, DomainError, "cannot sort by a value that is the same for all rows of a patient")
        inside(self.key, self.source)

    @property
    def schema(self) -> Schema:
        return self.source.schema

    @property
    def inputs(self):
        return self.source, self.key


@node
class Pick(Frame):
    source: Frame
    last: bool

    def __post_init__(self):
        need(bool(sort_keys(self.source)), DomainError, "only sorted frames can be picked from")

    @property
    def schema(self) -> Schema:
        return self.source.schema

    @property
    def inputs(self):
        return (self.source,)


# ---------------------------------------------------------------- series


class Series(Node):
    type: type


@node
class Column(Series):
    frame: Frame
    name: str

    def __post_init__(self):
        need(self.name == "patient_id" or self.name in self.frame.schema.names, AttributeError, f"no column {self.name!r}")

    @property
    def type(self) -> type:
        return int if self.name == "patient_id" else self.frame.schema[self.name].type

    @property
    def inputs(self):
        return (self.frame,)


@node
class Literal(Series):
    value: object

    @property
    def type(self) -> type:
        return type(self.value)


@node
class Param(Series):
    name: str
    type: type


@node
class Call(Series):
    """A function of series; see ``SIGNATURES`` for the types that it takes and gives."""

    fn: str
    args: tuple[Series, ...]

    def __post_init__(self):
        takes, _ = SIGNATURES[self.fn]
        takes(self.fn, self.args)
        together(*self.args)

    @property
    def type(self) -> type:
        return SIGNATURES[self.fn][1](self.args)

    @property
    def inputs(self):
        return self.args


@node
class Choice(Series):
    """The value of the first condition that is true, else the default."""

    cases: tuple[tuple[Series, Series | None], ...]
    default: Series | None

    def __post_init__(self):
        values = [v for v in (*(v for _, v in self.cases), self.default) if v is not None]
        need(bool(values), TypeError_, "a case expression needs at least one value")
        need(len({c for c, _ in self.cases}) == len(self.cases), ValueError, "a case expression has a condition twice")
        for c, _ in self.cases:
            typed(c, bool)
        alike("case", values)
        together(*self.inputs)

    @property
    def type(self) -> type:
        return next(v for v in (*(v for _, v in self.cases), self.default) if v is not None).type

    @property
    def inputs(self):
        return tuple(x for x in (*(x for case in self.cases for x in case), self.default) if x is not None)


@node
class InSet(Series):
    value: Series
    members: frozenset

    def __post_init__(self):
        for m in self.members:
            need(type(m) is self.value.type, TypeError_, f"{m!r} is not of type {self.value.type.__name__}")

    type = bool

    @property
    def inputs(self):
        return (self.value,)


@node
class InSeries(Series):
    """Whether the value is among the patient's non-null values of an event series."""

    value: Series
    members: Series

    def __post_init__(self):
        need(self.value.type is self.members.type, TypeError_, "values and members differ in type")
        need(domain(self.members) is not None, DomainError, "members must be an event series")

    type = bool

    @property
    def inputs(self):
        return (self.value, Aggregate("set", self.members))


@node
class Aggregate(Series):
    """kind: exists, count (of a frame); count_distinct, episodes, min, max, sum, mean, set (of an event series)."""

    kind: str
    source: Node
    option: int | None = None

    def __post_init__(self):
        if self.kind in ("exists", "count"):
            need(isinstance(self.source, Frame), TypeError_, f"{self.kind} takes a frame")
            return
        need(domain(self.source) is not None, DomainError, f"{self.kind} takes an event series")
        t = self.source.type
        if self.kind in ("sum", "mean"):
            need(t in (int, float), TypeError_, f"{self.kind} takes numbers")
        elif self.kind in ("min", "max"):
            need(t in (int, float, str, datetime.date), TypeError_, f"{self.kind} does not take {t.__name__}")
        elif self.kind == "episodes":
            need(t is datetime.date, TypeError_, "episodes are counted over dates")

    @property
    def type(self) -> type:
        return {"exists": bool, "count": int, "count_distinct": int, "episodes": int, "mean": float}.get(self.kind) or self.source.type

    @property
    def inputs(self):
        return (self.source,)


# ---------------------------------------------------------------- checks


def need(ok: bool, error: type, message: str) -> None:
    if not ok:
        raise error(message)


def typed(series: Node, *types: type) -> None:
    need(isinstance(series, Series) and any(issubclass(series.type, t) for t in types), TypeError_, f"expected {' or '.join(t.__name__ for t in types)}, got {getattr(series, 'type', type(series)).__name__}")


def alike(fn: str, args) -> None:
    kinds = {a.type for a in args}
    need(len(kinds) == 1, TypeError_, f"{fn}: types differ: {', '.join(sorted(k.__name__ for k in kinds))}")


def is_patient(n: Node) -> bool:
    return domain(n) is None


def domain(n: Node) -> Frame | None:
    """The table and filters of an event-level node, without sorts; None at patient level."""
    if "_domain" not in n.__dict__:
        object.__setattr__(n, "_domain", _domain(n))
    return n.__dict__["_domain"]


def _domain(n: Node) -> Frame | None:
    if isinstance(n, (Table, InlineTable)):
        return None if n.one_row else n
    if isinstance(n, Where):
        return Where(domain(n.source), n.condition)
    if isinstance(n, SortBy):
        return domain(n.source)
    if isinstance(n, (Pick, Aggregate, Literal, Param)):
        return None
    if isinstance(n, Column):
        return domain(n.frame)
    if isinstance(n, InSeries):
        return domain(n.value)
    return next((d for d in map(domain, n.inputs) if d is not None), None)


def together(*series: Series) -> None:
    found = {d for d in map(domain, series) if d is not None}
    need(len(found) <= 1, DomainError, "these event series come from different tables or from differently filtered rows")


def inside(series: Series, frame: Frame) -> None:
    """A frame may be filtered or sorted by series of its own domain or of one it was filtered from."""
    d, at = domain(series), domain(frame)
    while d is not None and at is not None and at != d:
        at = at.source if isinstance(at, Where) else None
    need(d is None or at is not None, DomainError, "the series does not come from this frame or one that it was filtered from")


def base_table(frame: Frame) -> Frame:
    while isinstance(frame, (Where, SortBy, Pick)):
        frame = frame.source
    return frame


def conditions(frame: Frame) -> list[Series]:
    """The conditions of all filters below a frame, innermost first."""
    out = []
    while isinstance(frame, (Where, SortBy)):
        if isinstance(frame, Where):
            out.append(frame.condition)
        frame = frame.source
    return out[::-1]


def sort_keys(frame: Frame) -> list[Series]:
    """Sort keys, of the highest priority first: later sorts outrank earlier ones."""
    out = []
    while isinstance(frame, (Where, SortBy)):
        if isinstance(frame, SortBy):
            out.append(frame.key)
        frame = frame.source
    return out


def substitute(n, values: dict[str, object], made: dict | None = None):
    """The graph with parameters replaced by literals."""
    made = {} if made is None else made
    if isinstance(n, tuple):
        return tuple(substitute(x, values, made) for x in n)
    if not isinstance(n, Node):
        return n
    if n not in made:
        if isinstance(n, Param) and n.name in values:
            made[n] = Literal(values[n.name])
        else:
            new = {f.name: substitute(getattr(n, f.name), values, made) for f in fields(n)}
            made[n] = n if all(new[k] is getattr(n, k) for k in new) else type(n)(**new)
    return made[n]


# ---------------------------------------------------------------- signatures


def _types(*kinds):
    def check(fn, args):
        need(len(args) == len(kinds), TypeError_, f"{fn} takes {len(kinds)} arguments")
        for a, k in zip(args, kinds):
            typed(a, *(k if isinstance(k, tuple) else (k,)))

    return check


def _alike(n, *kinds):
    def check(fn, args):
        need(len(args) == n if n else len(args) > 0, TypeError_, f"{fn}: wrong number of arguments")
        for a in args:
            if kinds:
                need(a.type in kinds or any(issubclass(a.type, k) for k in kinds if k is Code), TypeError_, f"{fn} does not take {a.type.__name__}")
            need(not issubclass(a.type, MultiCodeString), TypeError_, f"{fn} does not take multi-code strings")
        alike(fn, args)

    return check


def _same(args):
    return args[0].type


def _is(t):
    return lambda args: t


_N, _D = (int, float), datetime.date
SIGNATURES = {
    **{f: (_alike(2), _is(bool)) for f in ("eq", "ne")},
    **{f: (_alike(2, int, float, str, _D, Code), _is(bool)) for f in ("lt", "le", "gt", "ge")},
    "and": (_types(bool, bool), _is(bool)),
    "or": (_types(bool, bool), _is(bool)),
    "not": (_types(bool), _is(bool)),
    "is_null": (_types(object), _is(bool)),
    **{f: (_alike(1, *_N), _same) for f in ("neg", "abs")},
    **{f: (_alike(2, *_N), _same) for f in ("add", "sub", "mul")},
    "div": (_alike(2, *_N), _is(float)),
    "floordiv": (_alike(2, *_N), _is(int)),
    "pow": (_alike(2, *_N), _is(float)),
    "to_int": (_types((int, float, bool)), _is(int)),
    "to_float": (_types(_N), _is(float)),
    **{f: (_types(_D, int), _is(_D)) for f in ("add_days", "add_months", "add_years")},
    **{f: (_types(_D, _D), _is(int)) for f in ("diff_days", "diff_months", "diff_years")},
    **{f: (_types(_D), _is(int)) for f in ("year", "month", "day")},
    **{f: (_types(_D), _is(_D)) for f in ("first_of_year", "first_of_month")},
    **{f: (_types((str, MultiCodeString), str), _is(bool)) for f in ("contains", "contains_any")},
    **{f: (_alike(0, int, float, str, _D, bool), _same) for f in ("greatest", "least")},
}
