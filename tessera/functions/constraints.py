"""What a table's author states of a column's values: used for output types and checks, not enforced in queries."""

from __future__ import annotations

import datetime
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Categorical:
    values: tuple

    def __post_init__(self):
        object.__setattr__(self, "values", tuple(self.values))

    def holds(self, v) -> bool:
        return v is None or v in self.values


@dataclass(frozen=True)
class NotNull:
    def holds(self, v) -> bool:
        return v is not None


@dataclass(frozen=True)
class Unique:
    def holds(self, v) -> bool:
        return True


@dataclass(frozen=True)
class FirstOfMonth:
    def holds(self, v) -> bool:
        return v is None or v.day == 1


@dataclass(frozen=True)
class Regex:
    regex: str

    def holds(self, v) -> bool:
        return v is None or re.fullmatch(self.regex, v) is not None


@dataclass(frozen=True)
class ClosedRange:
    minimum: int
    maximum: int
    step: int = 1

    def holds(self, v) -> bool:
        return v is None or self.minimum <= v <= self.maximum and (v - self.minimum) % self.step == 0


@dataclass(frozen=True)
class GeneralRange:
    minimum: object = None
    maximum: object = None
    includes_minimum: bool = True
    includes_maximum: bool = True

    def holds(self, v) -> bool:
        if v is None:
            return True
        low = self.minimum is None or v > self.minimum or self.includes_minimum and v == self.minimum
        return low and (self.maximum is None or v < self.maximum or self.includes_maximum and v == self.maximum)


@dataclass(frozen=True)
class DateAfter:
    """Dates not before those of the named columns."""

    column_names: tuple[str, ...]

    def __post_init__(self):
        object.__setattr__(self, "column_names", tuple(self.column_names))

    def holds(self, v: datetime.date | None) -> bool:
        return True


class Constraint:
    Categorical, NotNull, Unique, FirstOfMonth, Regex, ClosedRange, GeneralRange, DateAfter = Categorical, NotNull, Unique, FirstOfMonth, Regex, ClosedRange, GeneralRange, DateAfter
