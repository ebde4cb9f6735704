"""Lengths of time: days, weeks, months and years, added to dates or laid out as intervals."""

from __future__ import annotations

import calendar
import datetime


def add_months(date: datetime.date, n: int) -> datetime.date:
    """A day that the month lacks becomes the first of the next one."""
    m = date.year * 12 + date.month - 1 + n
    year, month = divmod(m, 12)
    if date.day > calendar.monthrange(year, month + 1)[1]:
        year, month = divmod(m + 1, 12)
        return datetime.date(year, month + 1, 1)
    return datetime.date(year, month + 1, date.day)


def add_years(date: datetime.date, n: int) -> datetime.date:
    """29 February becomes 1 March in years that lack it."""
    return add_months(date, 12 * n)


class Duration:
    unit, factor = "days", 1

    def __init__(self, value):
        from ..language import BaseSeries

        if type(value) is not int and not isinstance(value, BaseSeries):
            raise TypeError(f"{type(self).__name__} takes an integer or an integer series")
        self.value = value

    def __eq__(self, other):
        return self.value == other.value if type(other) is type(self) else NotImplemented

    def __ne__(self, other):
        return self.value != other.value if type(other) is type(self) else NotImplemented

    __hash__ = None

    def added_to(self, date):
        from ..language import BaseSeries, call, to_date

        date = to_date(date)
        if isinstance(date, datetime.date) and type(self.value) is int:
            n = self.value * self.factor
            return {"days": lambda: date + datetime.timedelta(n), "months": lambda: add_months(date, n), "years": lambda: add_years(date, n)}[self.unit]()
        if not isinstance(date, (datetime.date, BaseSeries)):
            raise TypeError(f"cannot add {type(self).__name__} to {type(date).__name__}")
        amount = self.value * self.factor if self.factor != 1 else self.value
        return call("add_" + self.unit, date, amount)

    def __add__(self, other):
        if isinstance(other, Duration):
            if type(other) is not type(self):
                raise TypeError(f"cannot add {type(self).__name__} and {type(other).__name__}")
            return type(self)(self.value + other.value)
        return self.added_to(other)

    def __radd__(self, other):
        return self.added_to(other)

    def __sub__(self, other):
        return self + -other if isinstance(other, Duration) else NotImplemented

    def __rsub__(self, other):
        return (-self).added_to(other)

    def __neg__(self):
        return type(self)(-self.value)

    def starting_on(self, date) -> list[tuple[datetime.date, datetime.date]]:
        """This many intervals of one unit each, the first of which starts on the date."""
        return self._intervals(date, 1, "starting_on")

    def ending_on(self, date) -> list[tuple[datetime.date, datetime.date]]:
        """This many intervals of one unit each, the last of which ends on the date."""
        return self._intervals(date, -1, "ending_on")

    def _intervals(self, date, sign: int, name: str):
        from ..language import to_date

        date = to_date(date)
        if not isinstance(date, datetime.date):
            raise TypeError(f"{name}() takes a date")
        if type(self.value) is not int:
            raise TypeError(f"{name}() needs a number of {type(self).__name__}, not a series")
        if self.value < 0:
            raise ValueError(f"{name}() needs a number of {type(self).__name__} that is not negative")
        one = datetime.timedelta(1)
        if sign > 0:
            cuts = [type(self)(i).added_to(date) for i in range(self.value + 1)]
            return [(a, b - one) for a, b in zip(cuts, cuts[1:])]
        cuts = [type(self)(-i).added_to(date) for i in range(self.value, -1, -1)]
        return [(a + one, b) for a, b in zip(cuts, cuts[1:])]


class days(Duration):
    pass


class weeks(Duration):
    factor = 7


class months(Duration):
    unit = "months"


class years(Duration):
    unit = "years"
