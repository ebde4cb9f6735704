"""The meaning of each operator on small tables."""

import datetime

import pytest

from tessera import case, days, maximum_of, minimum_of, months, table_from_rows, weeks, when, years
from tessera.language import PatientFrame, Series

from .cases import e, p, results

D = datetime.date


def test_arithmetic_and_division(spark):
    rows = """patient_id|i1|i2|f1|f2
        1|101|111|101.3|111.5
        2|-1|2|-1.3|111.5
        3|-4|3|-10.3|1.5
        4||201||-1.5
        5|5|0|-10.3|0.0"""
    r = results(spark, rows, add=p.i1 + p.i2, rsub=1 - p.i1, mul=p.i1 * 2, div=p.i1 / p.i2, floor=p.i1 // p.i2, fdiv=p.f1 / p.f2, ffloor=p.f1 // p.f2, neg=-p.i1, size=abs(p.f1), rdiv=10 / p.i2)
    assert r["add"] == {1: 212, 2: 1, 3: -1, 4: None, 5: 5}
    assert r["rsub"] == {1: -100, 2: 2, 3: 5, 4: None, 5: -4}
    assert r["mul"][3] == -8 and r["neg"][3] == 4 and r["size"][2] == 1.3
    assert r["div"] == {1: pytest.approx(101 / 111), 2: -0.5, 3: pytest.approx(-4 / 3), 4: None, 5: None}
    assert r["floor"] == {1: 0, 2: -1, 3: -2, 4: None, 5: None}
    assert r["fdiv"][5] is None and r["ffloor"] == {1: 0, 2: -1, 3: -7, 4: None, 5: None}
    assert r["rdiv"][5] is None


def test_powers(spark):
    rows = """patient_id|f1|f2|i1|i2
        1|2.5|1.5|2|3
        3|-101.3|10.3|-2|3
        7|0.0|-20.3|0|-1
        8|-20.3|0.0|0|0"""
    r = results(spark, rows, f=p.f1**p.f2, i=p.i1**p.i2)
    assert r["f"] == {1: pytest.approx(2.5**1.5), 3: None, 7: None, 8: 1.0}
    assert r["i"] == {1: 8.0, 3: -8.0, 7: None, 8: 1.0}


def test_casts(spark):
    rows = """patient_id|f1|b1|i1
        1|32.3|T|3
        2|-6.7|F|
        3|0.5||1"""
    r = results(spark, rows, i=p.f1.as_int(), b=p.b1.as_int(), f=p.i1.as_float())
    assert r["i"] == {1: 32, 2: -6, 3: 0} and r["b"] == {1: 1, 2: 0, 3: None} and r["f"] == {1: 3.0, 2: None, 3: 1.0}


def test_logic_of_nulls(spark):
    rows = "patient_id|b1|b2\n" + "\n".join(f"{i}|{a}|{b}" for i, (a, b) in enumerate((a, b) for a in ("T", "", "F") for b in ("T", "", "F")))
    r = results(spark, rows, conj=p.b1 & p.b2, disj=p.b1 | p.b2, no=~p.b1, null=p.b1.is_null())
    assert list(r["conj"].values()) == [True, None, False, None, None, False, False, False, False]
    assert list(r["disj"].values()) == [True, True, True, True, None, None, True, None, False]
    assert r["no"] == {0: False, 1: False, 2: False, 3: None, 4: None, 5: None, 6: True, 7: True, 8: True}
    assert r["null"][3] is True and r["null"][0] is False


def test_membership(spark):
    r = results(spark, "patient_id|i1\n1|101\n2|201\n3|", hit=p.i1.is_in([101, 301]), miss=p.i1.is_not_in([101]), none=p.i1.is_in([]), all=p.i1.is_not_in([]))
    assert r["hit"] == {1: True, 2: False, 3: None} and r["miss"] == {1: False, 2: True, 3: None}
    assert set(r["none"].values()) == {False} and set(r["all"].values()) == {True}


def test_membership_in_event_series(spark):
    r = results(
        spark, "patient_id|i1\n1|101\n2|201\n3|301\n4|\n5|501\n6|", "patient_id|i1\n1|101\n2|201\n2|203\n2|301\n3|333\n3|334\n4|\n4|401\n5|\n5|101",
        hit=p.i1.is_in(e.i1), miss=p.i1.is_not_in(e.i1),
    )
    assert r["hit"] == {1: True, 2: True, 3: False, 4: None, 5: False, 6: False}
    assert r["miss"] == {1: False, 2: False, 3: True, 4: None, 5: True, 6: True}


def test_event_values_in_event_series(spark):
    r = results(spark, "patient_id|i1\n1|1", "patient_id|i1|i2\n1|5|6\n1|6|7\n1||9", n=e.where(e.i1.is_in(e.i2)).count_for_patient(), k=e.except_where(e.i1.is_in(e.i2)).count_for_patient())
    assert r == {"n": {1: 1}, "k": {1: 2}}


def test_contains(spark):
    rows = "patient_id|s1|s2\n1|/a%b_/|a%b_\n2|/ab_|a%b\n3|/a%bc|%b\n4||x\n5|x|"
    r = results(spark, rows, lit=p.s1.contains("a%b_"), col=p.s1.contains(p.s2), case_=p.s1.contains("A"))
    assert r["lit"] == {1: True, 2: False, 3: False, 4: None, 5: False}
    assert r["col"] == {1: True, 2: False, 3: True, 4: None, 5: None} and r["case_"][1] is False


def test_multi_code_strings(spark):
    r = results(spark, "patient_id|m1\n1|E119 J849\n2|J84\n3|", full=p.m1.contains("J849"), part=p.m1.contains("J84"), some=p.m1.contains_any_of(["M069", "E11"]))
    assert r["full"] == {1: True, 2: False, 3: None} and r["part"] == {1: True, 2: True, 3: None} and r["some"] == {1: True, 2: False, 3: None}
    for bad in (lambda: p.m1 == "J84", lambda: p.m1.is_in(["J84"]), lambda: p.m1.contains("j84%")):
        with pytest.raises((TypeError, ValueError)):
            bad()


def test_codes_to_categories(spark):
    r = results(spark, "patient_id|c1\n1|123456\n2|123457\n3|", cat=p.c1.to_category({"123456": "a"}, default="z"), is_=p.c1 == "123457")
    assert r["cat"] == {1: "a", 2: "z", 3: "z"} and r["is_"] == {1: False, 2: True, 3: None}


def test_cases(spark):
    r = results(
        spark, "patient_id|i1\n1|6\n2|7\n3|8\n4|",
        three=case(when(p.i1 < 7).then("small"), when(p.i1 < 8).then("mid"), otherwise="big"), none=case(when(p.i1 < 8).then(p.i1)), bool_=when(p.i1.is_null()).then(0).otherwise(p.i1),
        mapped=p.i1.map_values({6: "x", 7: "y", 8: "x"}), filled=p.i1.when_null_then(0),
    )
    assert r["three"] == {1: "small", 2: "mid", 3: "big", 4: "big"} and r["none"] == {1: 6, 2: 7, 3: None, 4: None}
    assert r["bool_"] == {1: 6, 2: 7, 3: 8, 4: 0} == r["filled"] and r["mapped"] == {1: "x", 2: "y", 3: "x", 4: None}


def test_largest_and_smallest_skip_nulls(spark):
    rows = "patient_id|i1|i2|d1|d2\n1|101|112|2001-01-01|2012-12-12\n2|211||2021-01-01|\n3||||"
    r = results(spark, rows, hi=maximum_of(p.i1, p.i2), lo=minimum_of(p.i1, p.i2, 150), d=maximum_of(p.d1, p.d2), lit=maximum_of(p.i1, 150))
    assert r["hi"] == {1: 112, 2: 211, 3: None} and r["lo"] == {1: 101, 2: 150, 3: 150} and r["lit"] == {1: 150, 2: 211, 3: 150} and r["d"][2] == D(2021, 1, 1)
    r = results(spark, "patient_id|i1\n1|5", "patient_id|i1|i2\n1|3|9\n1||1", top=maximum_of(e.i1, e.i2, p.i1).sum_for_patient())
    assert r["top"] == {1: 14}


ADD = [("2003-01-29", 1, "2003-03-01"), ("2004-01-29", 1, "2004-02-29"), ("2003-01-31", 1, "2003-03-01"), ("2004-01-31", 1, "2004-03-01"), ("2004-03-31", -1, "2004-03-01"), ("2000-10-31", 11, "2001-10-01"), ("2000-10-31", -11, "1999-12-01"), ("2003-12-15", 2, "2004-02-15")]
YEARS = [("2004-02-29", 1, "2005-03-01"), ("2004-02-29", -1, "2003-03-01"), ("2004-02-29", 4, "2008-02-29"), ("2004-02-29", -4, "2000-02-29"), ("2003-03-01", 1, "2004-03-01")]


@pytest.mark.parametrize(("unit", "cases"), [(months, ADD), (years, YEARS)])
def test_calendar_addition(spark, unit, cases):
    rows = "patient_id|d1|i1\n" + "\n".join(f"{i}|{d}|{k}" for i, (d, k, _) in enumerate(cases))
    r = results(spark, rows, out=p.d1 + unit(p.i1), back=p.d1 - unit(-p.i1))
    want = {i: D.fromisoformat(x) for i, (*_, x) in enumerate(cases)}
    assert r["out"] == want == r["back"]
    assert want == {i: D.fromisoformat(d) + unit(k) for i, (d, k, _) in enumerate(cases)}


OUTSIDE = [("2000-01-01", years, 8000), ("2000-01-01", years, -2000), ("2001-08-01", years, 8000), ("2000-01-01", months, 12 * 8000), ("2000-01-01", months, -12 * 3000), ("2000-01-01", days, 366 * 8000), ("2000-01-01", days, 1_500_000_000), ("9999-12-31", days, 1), ("0001-01-01", days, -1), ("9999-12-01", months, 1)]
INSIDE = [("1999-12-31", years, 8000, "9999-12-31"), ("2000-01-01", years, 7999, "9999-01-01"), ("2000-01-01", months, 12 * 8000 - 1, "9999-12-01"), ("9999-10-31", months, 1, "9999-12-01"), ("9999-12-30", days, 1, "9999-12-31"), ("0001-01-02", days, -1, "0001-01-01")]


def test_dates_end_with_the_year_9999(spark):
    """What lies beyond is null, as in the reference (test_run_with_handles_date_errors): no date that Python could not read."""
    for unit in (days, months, years):
        rows = [(d, k, None) for d, u, k in OUTSIDE if u is unit] + [(d, k, D.fromisoformat(x)) for d, u, k, x in INSIDE if u is unit]
        r = results(spark, "patient_id|d1|i1\n" + "\n".join(f"{i}|{d}|{k}" for i, (d, k, _) in enumerate(rows)), out=p.d1 + unit(p.i1), back=p.d1 - unit(-p.i1))
        assert r["out"] == {i: x for i, (*_, x) in enumerate(rows)} == r["back"]


def test_date_differences(spark):
    rows = """patient_id|d1|d2
        1|2004-02-29|2005-02-28
        2|2020-02-29|2021-02-28
        3|2020-02-29|2021-03-01
        4|2020-03-15|2020-03-01
        5|1990-01-30|"""
    diff = p.d2 - p.d1
    r = results(spark, rows, days=diff.days, weeks=diff.weeks, months=diff.months, years=diff.years, lit=("2021-01-30" - p.d1).years)
    assert r["days"] == {1: 365, 2: 365, 3: 366, 4: -14, 5: None} and r["weeks"] == {1: 52, 2: 52, 3: 52, 4: -2, 5: None}
    assert r["months"] == {1: 11, 2: 11, 3: 12, 4: -1, 5: None} and r["years"] == {1: 0, 2: 0, 3: 1, 4: -1, 5: None} and r["lit"][5] == 31


def test_date_parts_and_predicates(spark):
    r = results(
        spark, "patient_id|d1\n1|2020-02-29\n2|", y=p.d1.year, m=p.d1.month, d=p.d1.day, fy=p.d1.to_first_of_year(), fm=p.d1.to_first_of_month(), wk=p.d1 + weeks(1), dy=days(1) + p.d1,
        before=p.d1.is_before("2020-03-01"), on=p.d1.is_on_or_after("2020-02-29"), during=p.d1.is_during(("2020-02-01", "2020-02-28")), between=p.d1.is_between_but_not_on("2020-02-28", "2020-03-01"),
    )
    assert [r[k][1] for k in r] == [2020, 2, 29, D(2020, 1, 1), D(2020, 2, 1), D(2020, 3, 7), D(2020, 3, 1), True, True, False, True]
    assert {r[k][2] for k in r} == {None}


def test_filters_and_their_complements(spark):
    rows = "patient_id|i1|b1\n1|101|T\n1|102|T\n1|103|\n2|201|T\n2|202|\n2|203|F\n3|301|T\n3|302|T"
    r = results(spark, "patient_id|i1\n4|1", rows, yes=e.where(e.b1).i1.sum_for_patient(), no=e.except_where(e.b1).i1.sum_for_patient(), lit=e.where(True).count_for_patient(), never=e.where(False).exists_for_patient())
    assert r["yes"] == {1: 203, 2: 201, 3: 603, 4: None} and r["no"] == {1: 103, 2: 405, 3: None, 4: None}
    assert r["lit"] == {1: 3, 2: 3, 3: 2, 4: 0} and set(r["never"].values()) == {False}


def test_aggregates(spark):
    rows = "patient_id|i1|f1|d1|s1\n1|101|1.5|2020-01-01|b\n1|102||2020-01-02|a\n1|||2020-01-02|b\n2||||"
    r = results(
        spark, "patient_id|i1\n3|1", rows, n=e.count_for_patient(), some=e.exists_for_patient(), total=e.i1.sum_for_patient(), mean=e.i1.mean_for_patient(), lo=e.s1.minimum_for_patient(),
        hi=e.d1.maximum_for_patient(), kinds=e.s1.count_distinct_for_patient(), pn=p.count_for_patient(), pe=p.exists_for_patient(),
    )
    assert r["n"] == {1: 3, 2: 1, 3: 0} and r["some"] == {1: True, 2: True, 3: False} and r["total"] == {1: 203, 2: None, 3: None} and r["mean"] == {1: 101.5, 2: None, 3: None}
    assert r["lo"] == {1: "a", 2: None, 3: None} and r["hi"][1] == D(2020, 1, 2) and r["kinds"] == {1: 2, 2: 0, 3: 0} and r["pn"] == {1: 0, 2: 0, 3: 1} and r["pe"][3] is True


def test_episodes(spark):
    rows = "patient_id|d1\n1|2020-01-01\n1|2020-01-04\n1|2020-01-06\n1|2020-01-10\n1|2020-01-12\n2|2020-01-01\n3|\n4|2020-01-10\n4|\n4|\n4|2020-01-01"
    r = results(spark, "patient_id|i1\n5|1", rows, n=e.d1.count_episodes_for_patient(days(3)), w=e.d1.count_episodes_for_patient(weeks(2)))
    assert r["n"] == {1: 2, 2: 1, 3: 0, 4: 2, 5: 0} and r["w"] == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}


def test_picks(spark):
    rows = "patient_id|i1|i2|i3\n1||1|1\n1|102|1|5\n1|103|1|3\n2|203|2|8\n2|202|1|7\n2||4|"
    by = e.sort_by(e.i1)
    r = results(spark, "patient_id|i1\n3|1", rows, first=by.first_for_patient().i1, last=by.last_for_patient().i1, none=by.where(e.i1 > 500).first_for_patient().i1, gone=by.last_for_patient().exists_for_patient(), both=e.sort_by(e.i2, e.i1).last_for_patient().i3)
    assert r["first"] == {1: None, 2: None, 3: None} and r["last"] == {1: 103, 2: 203, 3: None} and set(r["none"].values()) == {None}
    assert r["gone"] == {1: True, 2: True, 3: False} and r["both"] == {1: 3, 2: None, 3: None}


def test_later_sorts_outrank_and_filters_interleave(spark):
    rows = "patient_id|i1|i2\n1|101|1\n1|102|2\n1|103|2\n1|104|1\n2|201|1\n2|202|2"
    f = e.sort_by(e.i1).where(e.i1 > 102).sort_by(e.i2).first_for_patient()
    assert results(spark, "patient_id|i1", rows, v=f.i1)["v"] == {1: 104, 2: 201}


def test_ties_are_broken_by_selected_columns(spark):
    rows = "patient_id|i1|i2|i3\n1|100|2|101\n1|100|1|103\n1|100|1|102"
    f = e.sort_by(e.i1).first_for_patient()
    assert results(spark, "patient_id|i1", rows, v=f.i3)["v"] == {1: 101}
    assert results(spark, "patient_id|i1", rows, v=f.i3, w=f.i2) == {"v": {1: 102}, "w": {1: 1}}


def test_patients_and_rows_together(spark):
    r = results(spark, "patient_id|i1|d1\n1|1|2020-01-02\n2||2020-01-01", "patient_id|i1|d1\n1|101|2020-01-01\n1|102|2020-01-03\n2|201|2020-01-01", s=(e.i1 + p.i1).sum_for_patient(), n=e.where(e.d1 >= p.d1).count_for_patient(), t=(e.i1 + 1).maximum_for_patient())
    assert r["s"] == {1: 205, 2: None} and r["n"] == {1: 1, 2: 1} and r["t"] == {1: 103, 2: 202}


def test_filters_on_results_of_results(spark):
    last = e.sort_by(e.d1).last_for_patient()
    near = e.where(e.d1 >= last.d1 - days(2)).sort_by(e.d1).first_for_patient()
    n = e.where(e.d1 == near.d1).count_for_patient()
    rows = "patient_id|i1|d1\n1|1|2020-01-01\n1|2|2020-01-09\n1|3|2020-01-09\n1|4|2020-01-10\n2|5|2020-01-01"
    assert results(spark, "patient_id|i1\n3|1", rows, n=n, d=near.d1) == {"n": {1: 2, 2: 1, 3: 0}, "d": {1: D(2020, 1, 9), 2: D(2020, 1, 1), 3: None}}


def test_populations(spark):
    rows = "patient_id|b1|b2|i1\n1|T|T|101\n2|F|T|201\n3||T|301"
    assert results(spark, rows, population=p.b1, v=p.i1)["v"] == {1: 101}
    assert results(spark, rows, population=~p.b1 & p.b2, v=p.i1)["v"] == {2: 201}
    assert results(spark, "patient_id|i1\n7|1", "patient_id|i1\n8|1", population=e.exists_for_patient() | p.exists_for_patient(), v=p.i1)["v"] == {7: 1, 8: None}
    assert results(spark, rows, "patient_id|i1\n9|1", population=e.exists_for_patient(), v=p.i1)["v"] == {9: None}


def test_inline_rows(spark):
    @table_from_rows([(1, 10, "2020-01-01"), (9, 90, None)])
    class t(PatientFrame):
        n = Series(int)
        d = Series(D)

    assert results(spark, "patient_id|i1\n1|1\n2|2", v=t.n, d=t.d) == {"v": {1: 10, 2: None}, "d": {1: D(2020, 1, 1), 2: None}}
    assert results(spark, "patient_id|i1\n1|1", population=t.n > 50, v=p.i1)["v"] == {9: None}


def test_population_on_rows_chosen_by_patient_columns(spark):
    dated = e.where(e.d1 > p.d1)
    r = results(spark, "patient_id|d1\n1|2020-01-01\n2|2020-06-01\n3|2020-01-01", "patient_id|i1|d1\n1|1|2020-02-01\n2|9|2020-02-01\n3|9|2020-02-01", population=dated.exists_for_patient(), n=e.where(e.i1 > 5).count_for_patient())
    assert r["n"] == {1: 0, 3: 1}
