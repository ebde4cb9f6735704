"""Cohorts and per-patient datasets from longitudinal data, planned as Spark DataFrames.

    from tessera import create_dataset, days
    from tessera.tables.core import patients, clinical_events
"""

from .functions.codes import codelist_from_csv
from .language import Dataset, Error, case, create_dataset, days, maximum_of, minimum_of, months, table_from_file, table_from_rows, weeks, when, years
from .measures import INTERVAL, Measures, create_measures
from .permissions import claim_permissions
from .session import Engine, get_parameter, show

__all__ = [
    "INTERVAL", "Dataset", "Engine", "Error", "Measures", "case", "claim_permissions", "codelist_from_csv", "create_dataset", "create_measures", "days",
    "get_parameter", "maximum_of", "minimum_of", "months", "show", "table_from_file", "table_from_rows", "weeks", "when", "years",
]
