"""Measures against a plain computation over random patients."""

import datetime
import random
from collections import defaultdict

import pytest

from tessera import INTERVAL, create_measures, months
from tessera.language import EventFrame, PatientFrame, Series, table
from tessera.measures import suppressed
from tessera.session import Engine

D = datetime.date


@table
class people(PatientFrame):
    sex = Series(str)


@table
class homes(EventFrame):
    date = Series(D)
    region = Series(str)


@table
class events(EventFrame):
    date = Series(D)
    code = Series(str)
    value = Series(int)


IV = months(3).starting_on("2021-01-01") + [(D(2021, 1, 15), D(2021, 2, 15))]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    sexes = [(i, rng.choice(["male", "female"])) for i in range(1, 40)]
    moved = [(i, D(2020, 1, 1) + datetime.timedelta(d), rng.choice("NSE")) for i, _ in sexes for d in rng.sample(range(600), rng.randint(1, 3))]
    seen = [(i, D(2021, 1, 1) + datetime.timedelta(rng.randrange(100)), rng.choice(["abc", "def"]), rng.randint(0, 9)) for i, _ in sexes for _ in range(max(0, rng.randint(-3, 6)))]
    return sexes, moved, seen


@pytest.fixture(scope="module")
def engine(spark, data):
    kinds = ["patient_id bigint, sex string", "patient_id bigint, date date, region string", "patient_id bigint, date date, code string, value bigint"]
    frames = dict(zip(("people", "homes", "events"), (spark.createDataFrame(rows, k) for rows, k in zip(data, kinds))))
    return Engine(spark, lambda t: frames[t.name])


def region_on(moved, i, day):
    past = sorted((d, r) for j, d, r in moved if j == i and d <= day)
    return past[-1][1] if past else None


def test_against_plain_python(engine, data):
    sexes, moved, seen = data
    here = events.where(events.date.is_during(INTERVAL))
    region = homes.where(homes.date <= INTERVAL.start_date).sort_by(homes.date).last_for_patient().region
    m = create_measures()
    m.configure_disclosure_control(enabled=False)
    m.define_measure("abc", numerator=here.where(here.code == "abc").exists_for_patient(), denominator=here.exists_for_patient(), group_by={"sex": people.sex, "region": region}, intervals=IV)
    m.define_measure("total", numerator=here.value.sum_for_patient(), denominator=here.exists_for_patient(), intervals=IV)
    m.define_measure("outside", numerator=people.sex == "male", denominator=people.exists_for_patient() & ~events.where((events.date < INTERVAL.start_date) | (events.date > INTERVAL.end_date)).exists_for_patient(), group_by={"sex": people.sex}, intervals=IV)
    want = defaultdict(lambda: [0, 0])
    for start, end in IV:
        for i, sex in sexes:
            own = [(c, v) for j, d, c, v in seen if j == i and start <= d <= end]
            if own:
                for key, top in ((("abc", start, end, sex, region_on(moved, i, start)), any(c == "abc" for c, _ in own)), (("total", start, end, None, None), sum(v for _, v in own))):
                    want[key][0] += top
                    want[key][1] += 1
            if all(start <= d <= end for j, d, *_ in seen if j == i):
                want["outside", start, end, sex, None][0] += sex == "male"
                want["outside", start, end, sex, None][1] += 1
    got = {(r.measure, r.interval_start, r.interval_end, r.sex, r.region): [r.numerator, r.denominator] for r in engine.measures(m).collect()}
    assert got == dict(want)
    tables = engine.measure_tables(m)
    assert tables["total"].columns == ["measure", "interval_start", "interval_end", "ratio", "numerator", "denominator"] and "sex" in tables["abc"].columns


def test_suppression(spark):
    rows = spark.createDataFrame([(n, d) for n, d in [(0, 6), (6, 8), (7, 12), (8, 13), (12, 17), (13, 100)]], "numerator bigint, denominator bigint")
    got = [(r.numerator, r.denominator, r.ratio) for r in suppressed(rows).collect()]
    assert got == [(0, 0, None), (0, 10, 0.0), (0, 10, 0.0), (10, 15, 10 / 15), (10, 15, 10 / 15), (15, 100, 0.15)]
