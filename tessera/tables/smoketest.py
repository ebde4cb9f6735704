"""The smallest schema, for trying out a connection."""

from __future__ import annotations

import datetime

from ..functions.constraints import Constraint
from ..language import PatientFrame, Series, table

__all__ = ["patients"]


@table
class patients(PatientFrame):
    date_of_birth = Series(datetime.date, constraints=[Constraint.FirstOfMonth(), Constraint.NotNull()])
