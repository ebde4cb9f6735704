"""Round trips of every format, and what is said of files that do not fit."""

import datetime

import pytest

from tessera import create_dataset, table_from_file
from tessera.functions.constraints import Constraint
from tessera.language import EventFrame, PatientFrame, Series, table
from tessera.plans.nodes import ColumnDef, Schema
from tessera.session import Engine
from tessera.sources.catalog import Catalog, MappedTable, QueryTable
from tessera.sources.files import FileValidationError, read_rows, read_table, write_console, write_table, write_tables

ROWS = [(1, 5, 1.5, "a", True, datetime.date(2020, 1, 2)), (2, None, None, None, None, None), (3, -7, 0.0, 'q,"x', False, datetime.date(1999, 12, 31))]
KINDS = "patient_id bigint, i bigint, f double, s string, b boolean, d date"
SCHEMA = Schema.of(i=int, f=float, s=str, b=bool, d=datetime.date)


@pytest.mark.parametrize("ext", [".csv", ".csv.gz", ".arrow", ".parquet"])
def test_round_trip(spark, tmp_path, ext):
    path = tmp_path / f"t{ext}"
    write_table(spark.createDataFrame(ROWS, KINDS), path)
    assert sorted(read_rows(path, SCHEMA)) == ROWS
    got = read_table(spark, str(path), SCHEMA).select("patient_id", *SCHEMA.names)
    assert sorted(map(tuple, got.collect())) == ROWS


def test_arrow_types(spark, tmp_path):
    import pyarrow as pa

    path = tmp_path / "t.arrow"
    write_table(spark.createDataFrame(ROWS[:2], KINDS), path, categories={"s": ("b", "a")}, ranges={"i": (0, 100)})
    data = pa.ipc.open_file(path).read_all()
    assert data.schema.field("i").type == pa.int8() and data.schema.field("s").type == pa.dictionary(pa.int8(), pa.string(), ordered=True)
    assert data["s"].to_pylist() == ["a", None]


def test_csv_form(spark, tmp_path):
    write_table(spark.createDataFrame(ROWS[:2], KINDS), tmp_path / "t.csv")
    assert (tmp_path / "t.csv").read_text() == "patient_id,i,f,s,b,d\n1,5,1.5,a,T,2020-01-02\n2,,,,,\n"


@pytest.mark.parametrize(("text", "said"), [("patient_id,b\n1,X\n", "row 1, column 'b'"), ("patient_id\n1\n", "missing columns: b"), ("patient_id,b\nx,T\n", "patient_id")])
def test_bad_files(tmp_path, text, said):
    (tmp_path / "t.csv").write_text(text)
    with pytest.raises(FileValidationError, match=said):
        list(read_rows(tmp_path / "t.csv", Schema.of(b=bool)))
    with pytest.raises(FileValidationError):
        list(read_rows(tmp_path / "none.csv", Schema.of(b=bool)))
    with pytest.raises(FileValidationError):
        list(read_rows(tmp_path / "t.xlsx", Schema.of(b=bool)))


def test_categories_are_checked(tmp_path):
    (tmp_path / "t.csv").write_text("patient_id,s\n1,z\n")
    with pytest.raises(FileValidationError, match="not one of"):
        list(read_rows(tmp_path / "t.csv", Schema.of(s=ColumnDef(str, (Constraint.Categorical(("a", "b")),)))))


def test_table_from_file(tmp_path):
    (tmp_path / "t.csv").write_text("patient_id,n,extra\n1,5,x\n2,,y\n")
    assert table_from_file(tmp_path / "t.csv", columns={"n": int})._frame.rows == ((1, 5), (2, None))

    @table_from_file(tmp_path / "t.csv")
    class t(PatientFrame):
        extra = Series(str)

    assert t._frame.rows == ((1, "x"), (2, "y"))


@table
class people(PatientFrame):
    sex = Series(str)
    gone = Series(int)


@table
class scores(EventFrame):
    score = Series(int)


def test_directory_of_files_and_targets(spark, tmp_path, capsys):
    (tmp_path / "people.csv").write_text("patient_id,sex,ignored\n1,M,x\n2,F,y\n")
    (tmp_path / "scores.csv").write_text("patient_id,score\n1,5\n1,7\n")
    d = create_dataset()
    d.define_population(people.exists_for_patient())
    d.sex, d.gone, d.top = people.sex, people.gone, scores.score.maximum_for_patient()
    d.add_event_table("rows", score=scores.score)
    tables = Engine(spark, Catalog(spark, str(tmp_path))).tables(d)
    assert sorted(map(tuple, tables["dataset"].collect())) == [(1, "M", None, 7), (2, "F", None, None)]
    write_tables(tables, str(tmp_path / "out" / ":csv"))
    assert sorted((tmp_path / "out" / "rows.csv").read_text().splitlines()) == ["1,5", "1,7", "patient_id,score"]
    write_console({"a": tables["dataset"].orderBy("patient_id")})
    assert capsys.readouterr().out.splitlines()[1] == "1,M,,7"
    with pytest.raises(FileValidationError):
        write_tables(tables, str(tmp_path / "x.csv"))


def test_mapped_and_query_tables(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("id,v\n1,5\n2,6\n")
    tables = {"people": MappedTable("raw", {"sex": "v"}, "id"), "scores": QueryTable("SELECT CAST(id AS bigint) AS patient_id, CAST(v AS bigint) * 2 AS score FROM {raw}", materialize=True)}
    d = create_dataset()
    d.define_population(people.exists_for_patient())
    d.sex, d.n = people.sex, scores.score.sum_for_patient()
    assert sorted(map(tuple, Engine(spark, Catalog(spark, str(tmp_path), tables)).dataset(d).collect())) == [(1, "5", 10), (2, "6", 12)]


def test_show(spark, tmp_path):
    (tmp_path / "people.csv").write_text("patient_id,sex\n1,M\n2,F\n3,F\n")
    (tmp_path / "scores.csv").write_text("patient_id,score\n1,5\n1,7\n")
    engine = Engine(spark, Catalog(spark, str(tmp_path)))
    assert engine.show(people.sex, head=1, tail=1).splitlines() == ["patient_id | value", "---------- | -----", "1          | M", "…          | …", "3          | F"]
    assert len(engine.show(scores).splitlines()) == 4
    assert engine.show(scores.sort_by(scores.score).last_for_patient()).splitlines()[-1] == "1          | 7"
