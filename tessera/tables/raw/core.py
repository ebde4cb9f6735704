"""Deaths as registered: a patient may have several rows."""

from __future__ import annotations

import datetime

from ...functions.codes import ICD10Code
from ...language import EventFrame, Series, table
from .._parts import add_columns

__all__ = ["ons_deaths"]


class _Deaths(EventFrame):
    date = Series(datetime.date)
    underlying_cause_of_death = Series(ICD10Code)


add_columns(_Deaths, (f"cause_of_death_{i:02}" for i in range(1, 16)), ICD10Code)


@table
class ons_deaths(_Deaths):
    class _meta:
        table_name = "ons_deaths_raw"
