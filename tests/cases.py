"""Tables of the specification cases, and a helper that runs one."""

import datetime

from tessera import create_dataset
from tessera.functions.codes import ICD10MultiCodeString, SNOMEDCTCode
from tessera.language import EventFrame, PatientFrame, Series, table

from .conftest import engine_of


@table
class p(PatientFrame):
    i1 = Series(int)
    i2 = Series(int)
    b1 = Series(bool)
    b2 = Series(bool)
    c1 = Series(SNOMEDCTCode)
    m1 = Series(ICD10MultiCodeString)
    d1 = Series(datetime.date)
    d2 = Series(datetime.date)
    s1 = Series(str)
    s2 = Series(str)
    f1 = Series(float)
    f2 = Series(float)


@table
class e(EventFrame):
    i1 = Series(int)
    i2 = Series(int)
    i3 = Series(int)
    b1 = Series(bool)
    d1 = Series(datetime.date)
    s1 = Series(str)
    f1 = Series(float)
    c1 = Series(SNOMEDCTCode)


def results(spark, p_rows="patient_id|i1", e_rows="patient_id|i1", population=None, **variables):
    """{column: {patient_id: value}} of a dataset over everyone in either table."""
    dataset = create_dataset()
    dataset.define_population(p.exists_for_patient() | e.exists_for_patient() if population is None else population)
    for name, series in variables.items():
        dataset.add_column(name, series)
    rows = sorted(engine_of(spark, {p: p_rows, e: e_rows}).dataset(dataset).collect(), key=lambda r: r.patient_id)
    return {c: {r.patient_id: r[c] for r in rows} for c in variables}
