"""Declared tables of common health-record schemas, and what is needed to declare more."""

from ..functions.constraints import Constraint
from ..language import EventFrame, PatientFrame, Series, table, table_from_file, table_from_rows

__all__ = ["Constraint", "EventFrame", "PatientFrame", "Series", "table", "table_from_file", "table_from_rows"]
