"""Serialisation, assurance tests and the command line."""

import datetime
import json

import pytest

from tessera import __main__ as cli
from tessera import assurance, case, create_dataset, days, when
from tessera.plans import serial
from tessera.tables.core import clinical_events, patients, practice_registrations

from .cases import e, p

DEFINITION = """
from tessera import create_dataset, get_parameter
from tessera.language import PatientFrame, Series, table

@table
class people(PatientFrame):
    sex = Series(str)

dataset = create_dataset()
dataset.define_population(people.sex == get_parameter("sex", default="M"))
dataset.sex = people.sex
"""


def test_graphs_come_back_from_json():
    last = e.where(e.d1 > "2020-01-01").sort_by(e.d1).last_for_patient()
    graphs = [
        (last.i1 + 1)._node, (last.d1 + days(p.i1))._node, p.c1.is_in(["123456"])._node, p.m1.contains("A01")._node, case(when(p.b1).then(1.5), otherwise=p.f1)._node,
        p.i1.is_in(e.i1)._node, patients.age_on("2020-01-01")._node, practice_registrations.for_patient_on("2020-01-01").practice_pseudo_id._node,
    ]
    assert serial.loads(serial.dumps(graphs)) == graphs
    x = p.i1
    for _ in range(100):
        x = x + x
    assert len(json.loads(serial.dumps(x._node))["nodes"]) == 102


def test_assurance(spark):
    d = create_dataset()
    d.define_population(patients.date_of_birth < "2000-01-01")
    d.n = clinical_events.count_for_patient()
    born = datetime.date(1990, 1, 1)
    good = {1: {patients: {"date_of_birth": born, "sex": "male"}, clinical_events: [{"date": born}, {"date": None}], "expected_columns": {"n": 2}}, 2: {patients: {"date_of_birth": datetime.date(2001, 1, 1), "sex": "female"}, "expected_in_population": False}}
    assert assurance.check(spark, d, good) == {"constraints": [], "results": []}
    bad = {1: {patients: {"date_of_birth": datetime.date(1990, 1, 2), "sex": "x"}, "expected_columns": {"n": 5}}}
    found = assurance.check(spark, d, bad)
    assert {x["constraint"] for x in found["constraints"]} == {"FirstOfMonth", "Categorical"} and found["results"] == [{"patient_id": 1, "column": "n", "expected": 5, "actual": 0}]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "people.csv").write_text("patient_id,sex\n1,M\n2,F\n")
    (tmp_path / "d.py").write_text(DEFINITION)
    base = ["generate-dataset", str(tmp_path / "d.py"), "--tables", str(tmp_path)]
    assert cli.main([*base, "--output", str(tmp_path / "o" / "x.csv"), "--", "--sex", "F"]) == 0
    assert (tmp_path / "o" / "x.csv").read_text() == "patient_id,sex\n2,F\n"
    assert cli.main(base) == 0 and capsys.readouterr().out == "patient_id,sex\n1,M\n"
    assert cli.main(["serialize-definition", str(tmp_path / "d.py")]) == 0
    (tmp_path / "bad.py").write_text("x = 1 +")
    assert cli.main(["generate-dataset", str(tmp_path / "bad.py")]) == cli.LOAD
    (tmp_path / "none.py").write_text("x = 1")
    assert cli.main(["generate-dataset", str(tmp_path / "none.py")]) == cli.DEFINITION
    with pytest.raises(SystemExit):
        cli.main(["unknown"])
    capsys.readouterr()
    (tmp_path / "shown.py").write_text(DEFINITION + "from tessera import show\nshow(people.sex, head=1)\n")
    assert cli.main(["debug", str(tmp_path / "shown.py"), "--tables", str(tmp_path)]) == 0
    assert capsys.readouterr().out.splitlines() == ["patient_id | value", "---------- | -----", "1          | M", "…          | …"]
    assert cli.main(["isolation-report"]) == 0 and "memory: limited" in capsys.readouterr().out
    assert cli.main(["test-connection", "--tables", str(tmp_path)]) == 0 and "1 tables found" in capsys.readouterr().out
    assert cli.main(["dump-example-data", "--output", str(tmp_path / "example" / ":csv")]) == 0
    assert cli.main(["test-connection", "--tables", str(tmp_path / "example")]) == 0 and "5 tables found" in capsys.readouterr().out


def test_definitions_are_confined(tmp_path, monkeypatch):
    from tessera.language import Error
    from tessera.loading import load_isolated

    monkeypatch.setenv("SECRET", "x")
    (tmp_path / "env.py").write_text(DEFINITION + "import os\nassert 'SECRET' not in os.environ\n")
    dataset, claimed, held = load_isolated(str(tmp_path / "env.py"), "dataset", {"sex": "F"})
    assert dataset._variables["sex"].name == "sex" and claimed == set() and {"memory", "cpu", "file size"} <= set(held)
    for text, said in (("x = bytearray(8 << 30)", "MemoryError"), ("raise ValueError('no')", "no"), ("", "does not define")):
        (tmp_path / "bad.py").write_text(text)
        with pytest.raises(Error, match=said):
            load_isolated(str(tmp_path / "bad.py"), "dataset")
    if "network" in held:
        (tmp_path / "net.py").write_text("import socket\nsocket.create_connection(('127.0.0.1', 22), 1)")
        with pytest.raises(Error):
            load_isolated(str(tmp_path / "net.py"), "dataset")


def test_measures_come_back_from_their_process(spark, tmp_path):
    from tessera.loading import pack, unpack

    from tessera import INTERVAL, create_measures, months

    m = create_measures()
    m.define_measure("seen", numerator=e.where(e.d1.is_during(INTERVAL)).count_for_patient(), denominator=p.exists_for_patient(), group_by={"s": p.s1}, intervals=months(2).starting_on("2020-01-01"))
    m.configure_dummy_data(population_size=3, additional_population_constraint=p.i1 > 1)
    back = unpack(pack(m))
    assert list(back) == list(m) and back.disclosure_control and back.dummy_data_config.additional_population_constraint._node == (p.i1 > 1)._node


def test_dummy_tables(spark):
    from tessera import Engine
    from tessera.dummy import dummy_tables

    d = create_dataset()
    d.define_population((patients.age_on("2020-01-01") >= 40) & (patients.sex == "female") & clinical_events.where(clinical_events.snomedct_code == "123456789").exists_for_patient())
    d.configure_dummy_data(population_size=15)
    d.n = clinical_events.count_for_patient()
    frames = dummy_tables(spark, d)
    assert Engine(spark, lambda t: frames[t.name]).dataset(d).count() == 15
    assert {r.sex for r in frames["patients"].collect()} == {"female"} and all(r.date_of_birth.day == 1 for r in frames["patients"].collect())
    again = dummy_tables(spark, d)
    assert sorted(map(tuple, again["patients"].collect()), key=str) == sorted(map(tuple, frames["patients"].collect()), key=str)
