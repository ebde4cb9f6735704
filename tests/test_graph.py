"""What definitions are refused, and why; domains and types; populations; permissions; datasets."""

import datetime
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera import INTERVAL, Error, case, create_dataset, create_measures, days, maximum_of, months, table_from_rows, weeks, when, years
from tessera import permissions
from tessera.functions.codes import BNFCode, CTV3Code, ICD10Code, OPCS4Code, SNOMEDCTCode, codelist_from_csv
from tessera.language import EventFrame, PatientFrame, Series, table
from tessera.plans import nodes as n
from tessera.plans.nulls import evaluate

from .cases import e, p


@table
class other(EventFrame):
    i1 = Series(int)


REFUSED = [
    (n.DomainError, lambda: e.i1 + other.i1),
    (n.DomainError, lambda: e.where(e.i1 > 1).i1 + e.i1),
    (n.DomainError, lambda: e.where(other.i1 > 1)),
    (n.DomainError, lambda: e.where(e.where(e.i1 > 1).i2 > 2)),
    (n.DomainError, lambda: e.sort_by(p.i1)),
    (n.DomainError, lambda: e.sort_by(other.i1)),
    (TypeError, lambda: p.i1 + 1.5),
    (TypeError, lambda: p.i1 + p.f1),
    (TypeError, lambda: p.i1 == "a"),
    (TypeError, lambda: p.c1 == p.s1),
    (TypeError, lambda: p.b1 < p.b2),
    (TypeError, lambda: p.b1 & p.i1),
    (TypeError, lambda: p.b1 and p.b2),
    (TypeError, lambda: {p.i1: 1}),
    (TypeError, lambda: p.i1.is_in(p.i2)),
    (TypeError, lambda: p.i1.is_in(["a"])),
    (TypeError, lambda: p.i1 == p),
    (TypeError, lambda: case()),
    (TypeError, lambda: case(when(p.i1 > 1))),
    (TypeError, lambda: case(when(p.i1 > 1).then(None))),
    (TypeError, lambda: case(when(p.i1 > 1).then(1), when(p.i1 > 2).then("a"))),
    (ValueError, lambda: case(when(p.i1 > 1).then(1), when(p.i1 > 1).then(2))),
    (TypeError, lambda: maximum_of(1, 2)),
    (ValueError, lambda: p.d1 > "2020-1-1"),
    (ValueError, lambda: p.d1 > "20200101"),
    (TypeError, lambda: days(1) + months(1)),
    (TypeError, lambda: e.d1.count_episodes_for_patient(months(1))),
    (TypeError, lambda: days("1")),
    (ValueError, lambda: days(-1).starting_on("2020-01-01")),
    (AttributeError, lambda: e.first_for_patient()),
    (TypeError, lambda: table_from_rows(iter([(1, 2)]))),
    (ValueError, lambda: SNOMEDCTCode("012345")),
]


@pytest.mark.parametrize("i", range(len(REFUSED)))
def test_refused(i):
    error, build = REFUSED[i]
    with pytest.raises(error):
        build()


def test_allowed_combinations():
    f = e.where(e.i1 > 1)
    f.sort_by(e.i2).where(f.i2 > 0).first_for_patient()
    e.sort_by(e.i1).i1 + e.i2
    f.i1 + p.i1 + 1
    f.where(e.i1.is_in(e.i2))


def test_values_are_told_apart_by_type():
    assert n.Literal(1) != n.Literal(True) and n.Literal(10) != n.Literal(10.0) and n.Literal(1) == n.Literal(1)
    assert (p.i1 + 1)._node == (p.i1 + 1)._node and hash((p.i1 + 1)._node) == hash((p.i1 + 1)._node)


def test_shared_graphs_stay_cheap():
    x = p.i1
    for _ in range(200):
        x = x + x
    assert len(list(n.walk(x._node))) == 202


@pytest.mark.parametrize("bad", [lambda: p.i1.is_null(), lambda: ~e.exists_for_patient(), lambda: p.i1.is_not_in([]), lambda: e.count_for_patient() == 0, lambda: case(when(p.b1).then(False), otherwise=True)])
def test_populations_of_nobody_known(bad):
    with pytest.raises(Error):
        create_dataset().define_population(bad())


def test_population_type():
    for bad in (p.i1, e.b1, True, p):
        with pytest.raises((TypeError, Error)):
            create_dataset().define_population(bad)


def test_dataset_names():
    d = create_dataset()
    d.define_population(p.exists_for_patient())
    d.age = p.i1
    for bad in ("age", "population", "patient_id", "1x", "_x", "a b"):
        with pytest.raises(AttributeError):
            d.add_column(bad, p.i1)
    with pytest.raises(TypeError):
        d.many = e.i1
    with pytest.raises(TypeError):
        d.codes = p.m1
    with pytest.raises(AttributeError):
        d.define_population(p.exists_for_patient())
    assert d.age._node == p.i1._node
    with pytest.raises(AttributeError):
        d.unknown


def test_parameters_are_substituted():
    node = (p.d1 > INTERVAL.start_date)._node
    assert n.substitute(node, {"interval_start_date": datetime.date(2020, 1, 1)}) == (p.d1 > "2020-01-01")._node


def test_evaluator_without_data():
    assert evaluate((e.count_for_patient() + 1)._node) == 1
    assert evaluate(p.i1.is_in(e.i1)._node) is False
    assert evaluate((p.i1 + 1)._node) is None


def test_intervals():
    D = datetime.date
    assert months(2).starting_on("2020-01-31") == [(D(2020, 1, 31), D(2020, 2, 29)), (D(2020, 3, 1), D(2020, 3, 30))]
    assert weeks(2).ending_on("2020-01-14") == [(D(2020, 1, 1), D(2020, 1, 7)), (D(2020, 1, 8), D(2020, 1, 14))]
    assert years(1).starting_on(D(2020, 2, 29)) == [(D(2020, 2, 29), D(2021, 2, 28))]


def test_measure_definitions():
    m = create_measures()
    iv = months(1).starting_on("2020-01-01")
    m.define_defaults(intervals=iv)
    m.define_measure("a", numerator=p.b1, denominator=p.b2, group_by={"s": p.s1})
    bad = [dict(name="a", numerator=p.b1, denominator=p.b2), dict(name="b", numerator=p.f1, denominator=p.b2), dict(name="c", numerator=p.b1), dict(name="d", numerator=p.b1, denominator=p.b2, group_by={"s": p.s2}), dict(name="0", numerator=p.b1, denominator=p.b2), dict(name="f", numerator=p.b1, denominator=p.b2, intervals=months(1))]
    for kwargs in bad:
        with pytest.raises((Error, TypeError)):
            m.define_measure(**kwargs)


def test_permissions():
    @table
    class secret(PatientFrame):
        class _meta:
            required_permission = "special"

        x = Series(int)

    needed = permissions.required((secret.x > 1)._node, event_tables=True)
    assert needed == {"special": ["secret"], "event_level_data": ["event tables"]}
    with pytest.raises(permissions.PermissionsError):
        permissions.enforce(needed, {"special"})
    permissions.enforce(needed, {"special", "event_level_data"})


def test_code_forms():
    for kind, good, bad in [(BNFCode, "0101010B0AAAAAA", "01010"), (CTV3Code, "ABC..", "AB"), (ICD10Code, "A01X2", "a01"), (OPCS4Code, "A01", "I01"), (SNOMEDCTCode, "123456", "1")]:
        assert kind(good).value == good
        with pytest.raises(ValueError):
            kind(bad)


def test_codelists(tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("code,cat\n 123456 ,x\n,y\n123457,z\n")
    assert codelist_from_csv(f, column="code") == ["123456", "123457"]
    assert codelist_from_csv(f, column="code", category_column="cat") == {"123456": "x", "123457": "z"}
    with pytest.raises(ValueError):
        codelist_from_csv(f, column="nope")
    with pytest.raises(FileNotFoundError):
        codelist_from_csv(tmp_path / "none.csv", column="code")


@given(st.sets(st.text("AB01.", min_size=1, max_size=4), min_size=1, max_size=12), st.text("AB01. ", max_size=12))
def test_patterns_of_many_parts(parts, text):
    from tessera.functions.codes import any_of_pattern

    assert (re.search(any_of_pattern(list(parts)), text) is not None) == any(x in text for x in parts)


def test_what_is_known_of_outputs():
    from tessera.plans.specs import ColumnSpec, output_options, spec_of
    from tessera.tables.core import clinical_events, patients

    assert spec_of(patients.sex._node).categories == ("female", "male", "intersex", "unknown")
    assert spec_of(clinical_events.count_for_patient()._node) == ColumnSpec(int, False, None, 0, 65_535)
    assert spec_of(case(when(p.b1).then("x"), when(p.b2).then("y"), otherwise="x")._node).categories == ("x", "y")
    assert spec_of(case(when(p.b1).then("x"), otherwise=p.s1)._node).categories is None
    assert not spec_of(e.exists_for_patient()._node).nullable and spec_of(p.i1._node).nullable
    assert output_options({"s": patients.sex._node, "n": e.count_for_patient()._node}) == {"categories": {"s": ("female", "male", "intersex", "unknown")}, "ranges": {"n": (0, 65_535)}}


def test_rewrites():
    from tessera.plans import rewrites

    @table
    class sometimes(EventFrame):
        class _meta:
            activation_filter_field = "on"

        on = Series(bool)
        x = Series(int)

    @table
    class opted_out(PatientFrame):
        x = Series(int)

    predicate, variables = rewrites.both(rewrites.only_active, rewrites.without(opted_out))(sometimes.exists_for_patient()._node, {"v": sometimes.where(sometimes.x > 1).x.sum_for_patient()._node})
    active = sometimes.where(sometimes.on)
    assert predicate == (active.exists_for_patient() & ~opted_out.exists_for_patient())._node
    assert variables["v"] == active.where(active.x > 1).x.sum_for_patient()._node


def test_declared_schemas():
    from tessera.tables import core, emis, emisv2, raw, smoketest, tpp  # noqa: F401
    from tessera.tables.raw import core as raw_core
    from tessera.tables.raw import tpp as raw_tpp

    for module in (core, emis, emisv2, smoketest, tpp, raw_core, raw_tpp):
        assert sorted(module.__all__) == list(module.__all__) and all(getattr(module, x)._frame.schema.names for x in module.__all__)
    home = tpp.addresses.for_patient_on("2020-01-01")
    assert home.imd_quintile._node.type is str and home.imd_decile._node.type is str
    assert tpp.decision_support_values.electronic_frailty_index().numeric_value._node.type is float
    assert tpp.appointments._frame.required_permission == "appointments" and tpp.clinical_events._frame.activation_filter_field == "date"
    assert raw_tpp.isaric._frame.name == "isaric_raw" and not tpp.parents._frame.activation_filter_field
    assert tpp.ons_deaths.cause_of_death_is_in(["A01"])._node.type is bool


def test_bands_of_deprivation():
    from tessera.tables._parts import AREAS, deprivation_band

    node = deprivation_band(p.i1, 5)._node
    labels = [v.value for _, v in node.cases]
    assert labels == ["1 (most deprived)", "2", "3", "4", "5 (least deprived)"] and node.default.value == "unknown"
    assert [c.args[-1].value for c, _ in node.cases[1:]] == [AREAS * k // 5 for k in (2, 3, 4, 5)]
