"""What is known of an output column before anything runs: its type, categories and range."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions import constraints as k
from . import nodes as n

#: Rows of one patient are taken to be fewer than this.
MOST_ROWS = 65_535


@dataclass(frozen=True)
class ColumnSpec:
    type: type
    nullable: bool = True
    categories: tuple | None = None
    minimum: int | None = None
    maximum: int | None = None


def spec_of(x: n.Series) -> ColumnSpec:
    """Categories pass through columns, extremes, literals and cases; ranges through counts and ranged columns."""
    low, high = _range(x)
    return ColumnSpec(x.type, _nullable(x), _categories(x), low, high)


def specs_of(variables: dict[str, n.Series]) -> dict[str, ColumnSpec]:
    return {"patient_id": ColumnSpec(int, False), **{name: spec_of(x) for name, x in variables.items()}}


def _constraint(x: n.Node, kind: type):
    if isinstance(x, n.Column) and x.name != "patient_id":
        return x.frame.schema[x.name].constraint(kind)
    return None


def _categories(x: n.Series | None) -> tuple | None:
    if isinstance(x, n.Column):
        found = _constraint(x, k.Categorical)
        return found.values if found else None
    if isinstance(x, n.Literal):
        return (x.value,) if isinstance(x.value, str) else None
    if isinstance(x, n.Aggregate) and x.kind in ("min", "max"):
        return _categories(x.source)
    if isinstance(x, n.Choice):
        parts = [_categories(v) for v in (*(v for _, v in x.cases), x.default) if v is not None]
        if all(p is not None for p in parts):
            return tuple(dict.fromkeys(v for p in parts for v in p))
    return None


def _range(x: n.Series) -> tuple[int | None, int | None]:
    if isinstance(x, n.Aggregate) and x.kind in ("count", "count_distinct", "episodes"):
        return 0, MOST_ROWS
    if isinstance(x, n.Aggregate) and x.kind in ("min", "max"):
        return _range(x.source)
    found = _constraint(x, k.ClosedRange)
    return (found.minimum, found.maximum) if found else (None, None)


def _nullable(x: n.Series) -> bool:
    if isinstance(x, n.Aggregate):
        return x.kind not in ("exists", "count", "count_distinct", "episodes")
    if isinstance(x, n.Literal) or isinstance(x, n.Call) and x.fn == "is_null":
        return False
    if isinstance(x, n.Call) and x.fn in ("and", "or", "not", "eq", "ne", "lt", "le", "gt", "ge", "add", "sub", "mul", "neg", "abs", "to_int", "to_float"):
        return any(map(_nullable, x.args))
    return True


def output_options(variables: dict[str, n.Series]) -> dict[str, dict]:
    """The ``categories`` and ``ranges`` of write_table()."""
    specs = specs_of(variables)
    return {
        "categories": {c: s.categories for c, s in specs.items() if s.categories is not None and s.type is str},
        "ranges": {c: (s.minimum, s.maximum) for c, s in specs.items() if s.minimum is not None},
    }
