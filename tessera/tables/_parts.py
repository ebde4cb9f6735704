"""What several schemas declare alike."""

from __future__ import annotations

import datetime

from ..functions.constraints import Constraint
from ..language import Series, _named, case, when

#: Fixed value: the number of small areas that deprivation ranks count, from the most deprived.
AREAS = 32_844


def day(*after: str, since: datetime.date | None = None, **options) -> Series:
    """A date; in made-up data not before the columns ``after``, nor before ``since``."""
    made_up = ([Constraint.GeneralRange(minimum=since)] if since else []) + ([Constraint.DateAfter(after)] if after else [])
    return Series(datetime.date, dummy_data_constraints=made_up, **options)


def needed(kind: type) -> Series:
    return Series(kind, constraints=[Constraint.NotNull()])


def one_of(*values, kind: type = str) -> Series:
    return Series(kind, constraints=[Constraint.Categorical(values)])


def form(regex: str) -> Series:
    return Series(str, constraints=[Constraint.Regex(regex)])


def add_columns(cls: type, names, kind: type) -> None:
    """Columns of one type, for a class that is not a table yet."""
    for name in names:
        setattr(cls, name, _named(name, kind))


def deprivation_band(rank, bands: int):
    """1 for the most deprived part of all areas to ``bands`` for the least; ``unknown`` without a rank."""
    label = {1: "1 (most deprived)", bands: f"{bands} (least deprived)"}
    steps = [(AREAS * k // bands, label.get(k, str(k))) for k in range(1, bands + 1)]
    (first, lowest), *others = steps
    return case(when((rank >= 0) & (rank <= first)).then(lowest), *[when(rank <= most).then(name) for most, name in others], otherwise="unknown")
