"""Queries that go through sources, sinks and tools: files of each format, rewrites, permissions, serialisation, the command line."""

from __future__ import annotations

import atexit
import contextlib
import datetime
import io
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from . import INTERVAL, Engine, assurance, case, create_dataset, create_measures, days, maximum_of, months, permissions, quiz, session, table_from_file, weeks, when, years
from .functions.codes import ICD10MultiCodeString, SNOMEDCTCode, codelist_from_csv
from .functions.constraints import Constraint
from .language import Error, EventFrame, PatientFrame, Series, table
from .plans import graphs, rewrites, serial
from .plans.nodes import ColumnDef, Schema
from .queries import NUM, ROLL, D, activity, custom, customers, engine, everyone, in_interval, nation, orders, query, some_date
from .sources.catalog import Catalog, QueryTable
from .sources.files import FileValidationError, read_rows, read_table, write_console, write_tables


def folder(spark: SparkSession) -> Path:
    """A new folder for files that the driver writes and all executors see, removed when the driver ends."""
    shared = urlparse(spark.sparkContext.getConf().get("spark.checkpoint.dir") or "")
    if shared.scheme not in ("", "file") or not shared.path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("these queries need a mounted folder that the driver and all executors share in spark.checkpoint.dir")
    made = Path(tempfile.mkdtemp(prefix="tessera-", dir=shared.path or None))
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


# ---------------------------------------------------------------- values beyond their type

huge = customers.balance * 1e300
endless = huge * 1e300
query(
    "casts_out_of_range", everyone, "SELECT patient_id, CASE WHEN balance = 0 THEN 0 END::BIGINT AS large, CASE WHEN balance = 0 THEN 0 END::BIGINT AS endless, CASE WHEN balance = 0 THEN 0 END::BIGINT AS nan, CASE WHEN balance = 0 THEN 0 END::BIGINT AS floor_nan, CASE WHEN balance = 0 THEN 0 END::BIGINT AS floor_large FROM {c}",
    large=huge.as_int(), endless=endless.as_int(), nan=(endless - endless).as_int(), floor_nan=(endless - endless) // 2.0, floor_large=huge // 2.0,
)
top = nation * 2**62
query(
    "overflow_null", everyone,
    "SELECT patient_id, CASE nation WHEN 0 THEN 0 WHEN 1 THEN 4611686018427387904 END::BIGINT AS product, CASE nation WHEN 0 THEN 4611686018427387904 END::BIGINT AS total, CASE nation WHEN 0 THEN -9223372036854775807 END::BIGINT AS difference, CASE WHEN nation = 1 THEN NULL WHEN nation = 0 THEN 9223372036854775807 ELSE NULL END::BIGINT AS negative FROM {c}",
    product=top, total=top + 2**62, difference=-(2**63 - 1) - top, negative=-(-(2**63 - 1) - nation),
)
query("sum_overflow_null", everyone, "SELECT c.patient_id, CASE WHEN count(date) = 0 THEN NULL WHEN count(date) = 1 THEN 4611686018427387904 END::BIGINT AS total FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY 1", total=(orders.orderkey * 0 + 2**62).sum_for_patient())
query(
    "dates_out_of_range", everyone, f"SELECT patient_id, CASE WHEN nation = 0 THEN d END AS far, CASE WHEN nation <= 8 THEN {ROLL.replace('{n}', '12000 * nation')} END AS later, CASE WHEN nation = 0 THEN d END AS earlier FROM {D}",
    far=some_date + days(nation * 10**9), later=some_date + years(nation * 1000), earlier=some_date - months(nation * 10**6),
)

# ---------------------------------------------------------------- rewrites, permissions, planning options


@table
class switched(EventFrame):
    class _meta:
        activation_filter_field = "on"
        required_permission = "switched"

    on = Series(bool)
    date = Series(datetime.date)
    value = Series(float)


@table
class opted_out(PatientFrame):
    reason = Series(str)


SW = "(SELECT user_id AS patient_id, event_type = 'click' AS \"on\", ts::DATE AS date, value FROM events)"


def switching(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """The engine of the test tables with a table that is active in part, and one of opt-outs: customers of nation 3."""
    out = engine(spark, sf_dir, **options)
    out.catalog.tables |= {
        "switched": QueryTable("SELECT user_id AS patient_id, event_type = 'click' AS on, CAST(ts AS date) AS date, value FROM {events}"),
        "opted_out": QueryTable("SELECT c_custkey AS patient_id, 'asked' AS reason FROM {customer} WHERE c_nationkey = 3"),
    }
    return out


rewrite = rewrites.both(rewrites.only_active, rewrites.without(opted_out))


def _modified(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.n = switched.count_for_patient()
    dataset.add_event_table("rows", date=switched.date, value=switched.value)
    return switching(spark, sf_dir, modify=rewrite, granted={"switched", permissions.EVENT_LEVEL}).tables(dataset)[which]


custom("modified_dataset", lambda s, d: _modified(s, d, "dataset"), f"SELECT c.patient_id, count(s.date) AS n FROM {{c}} c LEFT JOIN {SW} s ON s.patient_id = c.patient_id AND s.\"on\" WHERE nation <> 3 GROUP BY 1")
custom("modified_event_table", lambda s, d: _modified(s, d, "rows"), f"SELECT s.patient_id, date, value FROM {SW} s JOIN {{c}} c USING (patient_id) WHERE s.\"on\" AND nation <> 3")


def _modified_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = create_measures()
    measures.configure_disclosure_control(enabled=False)
    measures.define_measure("seen", numerator=switched.count_for_patient(), denominator=everyone, group_by={"segment": customers.segment}, intervals=months(1).starting_on("1996-01-01"))
    return switching(spark, sf_dir, modify=rewrite, granted={"switched"}).measures(measures)


custom(
    "modified_measure", _modified_measure,
    f"""SELECT 'seen' AS measure, DATE '1996-01-01' AS interval_start, DATE '1996-01-31' AS interval_end, sum(n)::DOUBLE / count(*) AS ratio, sum(n)::BIGINT AS numerator, count(*) AS denominator, segment
    FROM (SELECT segment, (SELECT count(*) FROM {SW} s WHERE s.patient_id = c.patient_id AND s."on") AS n FROM {{c}} c WHERE nation <> 3) GROUP BY segment""",
)


@table
class visits(EventFrame):
    class _meta:
        activation_filter_field = "date"

    date = Series(datetime.date)
    value = Series(float)


@table
class activated(PatientFrame):
    end_date = Series(datetime.date)


def _activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.n, dataset.last = visits.count_for_patient(), visits.date.maximum_for_patient()
    own = engine(spark, sf_dir, modify=rewrites.both(rewrites.only(activated), rewrites.up_to(activated.end_date)))
    own.catalog.tables |= {
        "visits": QueryTable("SELECT user_id AS patient_id, CAST(ts AS date) AS date, value FROM {events}"),
        "activated": QueryTable("SELECT c_custkey AS patient_id, CASE WHEN c_nationkey > 2 THEN DATE '2024-01-15' END AS end_date FROM {customer} WHERE c_nationkey < 20"),
    }
    return own.dataset(dataset)


custom("activated_up_to_a_day", _activated, "SELECT c.patient_id, count(date) AS n, max(date) AS last FROM {c} c LEFT JOIN {a} a ON a.patient_id = c.patient_id AND date <= DATE '2024-01-15' WHERE nation > 2 AND nation < 20 GROUP BY 1")


def _outcome(run: Callable, *errors: type) -> str:
    try:
        run()
    except errors as e:
        return type(e).__name__
    return "allowed"


def _permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.n = switched.count_for_patient()
    events = create_dataset()
    events.define_population(everyone)
    events.add_event_table("rows", date=orders.date)
    measures = create_measures()
    measures.define_measure("m", numerator=switched.count_for_patient(), denominator=everyone, intervals=months(1).starting_on("1996-01-01"))
    permissions.claim_permissions("switched", permissions.EVENT_LEVEL)  # a claim grants nothing
    rows = []
    for granted in (set(), {"switched"}, {"switched", permissions.EVENT_LEVEL}):
        own = switching(spark, sf_dir, granted=granted)
        for what, run in (("dataset", lambda: own.tables(dataset)), ("events", lambda: own.tables(events)), ("measures", lambda: own.measures(measures)), ("show", lambda: own._frame(switched))):  # noqa: B023
            rows.append((len(granted), what, _outcome(run, permissions.PermissionsError)))
    return spark.createDataFrame(rows, "granted int, what string, outcome string")


custom(
    "permissions_enforced", _permissions,
    "SELECT g::INT AS granted, what, CASE WHEN g = 2 OR what IN ('dataset', 'measures') AND g = 1 THEN 'allowed' ELSE 'PermissionsError' END AS outcome FROM range(3) r(g), (VALUES ('dataset'), ('events'), ('measures'), ('show')) v(what)",
)


def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population((customers.segment == "BUILDING") & (nation < 4))
    dataset.n, dataset.last = orders.count_for_patient(), orders.date.maximum_for_patient()
    return engine(spark, sf_dir, semi_join=True).dataset(dataset)


custom("semi_join_to_population", _semi, "SELECT c.patient_id, count(date) AS n, max(date) AS last FROM {c} c LEFT JOIN {o} o USING (patient_id) WHERE segment = 'BUILDING' AND nation < 4 GROUP BY 1")

# ---------------------------------------------------------------- codes and categories


@table
class admissions(PatientFrame):
    codes = Series(ICD10MultiCodeString)


def _codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.catalog.tables["admissions"] = QueryTable("SELECT c_custkey AS patient_id, CASE WHEN c_nationkey < 20 THEN concat('||A0', c_nationkey % 4, ' ,B1', c_nationkey % 3, '0||') END AS codes FROM {customer}")
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.one, dataset.beginning = admissions.codes.contains("A01"), admissions.codes.contains("B1")
    dataset.long = admissions.codes.contains_any_of([f"{c}{i:02}" for c in "ABC" for i in range(1, 100, 3)] + ["A0", "B110"])
    dataset.some, dataset.none = admissions.codes.contains_any_of(["A02", "B110"]), admissions.codes.contains_any_of([])
    return own.dataset(dataset)


custom(
    "multi_code_contains", _codes,
    """SELECT patient_id, contains(codes, 'A01') AS one, contains(codes, 'B1') AS beginning, contains(codes, 'A02') OR contains(codes, 'B110') AS some, false AS none, regexp_matches(codes, 'A0|B110|[ABC](01|04|07|10|13|16|19)') AS long
    FROM (SELECT patient_id, CASE WHEN nation < 20 THEN '||A0' || (nation % 4) || ' ,B1' || (nation % 3) || '0||' END AS codes FROM {c})""",
)


@table
class coded(EventFrame):
    code = Series(SNOMEDCTCode)


CODED = "(SELECT o_custkey AS patient_id, (100000 + o_orderkey % 50)::VARCHAR AS code FROM orders)"


def _category(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) / "codes.csv"
    path.write_text("code,group\n" + "".join(f" {100000 + i},{'low' if i < 20 else 'high'}\n" for i in range(40)) + ",none\n")
    own = engine(spark, sf_dir)
    own.catalog.tables["coded"] = QueryTable("SELECT o_custkey AS patient_id, CAST(100000 + o_orderkey % 50 AS string) AS code FROM {orders}")
    listed, groups = codelist_from_csv(path, column="code"), codelist_from_csv(path, column="code", category_column="group")
    latest = coded.sort_by(coded.code).last_for_patient()
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.n_listed = coded.where(coded.code.is_in(listed)).count_for_patient()
    dataset.category = latest.code.to_category(groups, default="other")
    return own.dataset(dataset)


custom(
    "codelist_from_csv_to_category", _category,
    f"SELECT c.patient_id, count(*) FILTER (code < '100040') AS n_listed, CASE WHEN max(code) < '100020' THEN 'low' WHEN max(code) < '100040' THEN 'high' ELSE 'other' END AS category FROM {{c}} c LEFT JOIN {CODED} o USING (patient_id) GROUP BY 1",
)
many = [str(100_000 + i) for i in range(0, 200_000, 2)]


def _long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.catalog.tables["coded"] = QueryTable("SELECT o_custkey AS patient_id, CASE WHEN o_orderkey % 11 > 0 THEN CAST(100000 + o_orderkey AS string) END AS code FROM {orders}")
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.n_in, dataset.n_out = coded.where(coded.code.is_in(many)).count_for_patient(), coded.where(coded.code.is_not_in(many)).count_for_patient()
    dataset.first_in = coded.where(coded.code.is_in(many)).sort_by(coded.code).first_for_patient().code
    return own.dataset(dataset)


custom(
    "is_in_hundred_thousand_codes", _long_list,
    """SELECT c.patient_id, count(*) FILTER (k % 11 > 0 AND k % 2 = 0 AND k < 200000) AS n_in, count(*) FILTER (k % 11 > 0 AND (k % 2 = 1 OR k >= 200000)) AS n_out, min((100000 + k)::VARCHAR) FILTER (k % 11 > 0 AND k % 2 = 0 AND k < 200000) AS first_in
    FROM {c} c LEFT JOIN (SELECT o_custkey AS patient_id, o_orderkey AS k FROM orders) o USING (patient_id) GROUP BY 1""",
)

# ---------------------------------------------------------------- measures


def _integer_denominator(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = create_measures()
    measures.configure_disclosure_control(enabled=False)
    measures.define_defaults(intervals=weeks(3).ending_on("1997-12-31"))
    all_before = orders.where(orders.date < INTERVAL.start_date)
    measures.define_measure("share", numerator=in_interval.count_for_patient(), denominator=all_before.count_for_patient(), group_by={"segment": customers.segment})
    return engine(spark, sf_dir).measures(measures)


custom(
    "measure_integer_denominator_ending_on", _integer_denominator,
    """SELECT 'share' AS measure, s AS interval_start, s + 6 AS interval_end, sum(n)::DOUBLE / sum(d) AS ratio, sum(n)::BIGINT AS numerator, sum(d)::BIGINT AS denominator, segment FROM (
    SELECT segment, s, (SELECT count(*) FROM {o} o WHERE o.patient_id = c.patient_id AND date BETWEEN s AND s + 6) AS n, (SELECT count(*) FROM {o} o WHERE o.patient_id = c.patient_id AND date < s) AS d
    FROM {c} c, (VALUES (DATE '1997-12-11'), (DATE '1997-12-18'), (DATE '1997-12-25')) v(s)) WHERE d > 0 GROUP BY s, segment""",
)


def _one_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = create_measures()
    measures.configure_disclosure_control(enabled=False)
    for name, groups in (("by_segment", {"segment": customers.segment}), ("by_nation", {"nation": nation})):
        measures.define_measure(name, numerator=in_interval.count_for_patient(), denominator=everyone, group_by=groups, intervals=months(2).starting_on("1996-01-01"))
    return engine(spark, sf_dir).measure_tables(measures)["by_nation"]


custom("measure_tables", _one_table, f"SELECT 'by_nation' AS measure, s AS interval_start, e AS interval_end, sum(n)::DOUBLE / count(*) AS ratio, sum(n)::BIGINT AS numerator, count(*) AS denominator, nation FROM {NUM} WHERE s < DATE '1996-03-01' GROUP BY s, e, nation")


def _time_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = create_measures()
    measures.define_measure("m", numerator=in_interval.count_for_patient(), denominator=everyone, intervals=months(1).starting_on("1996-01-01"))
    own = engine(spark, sf_dir)
    slow = spark.range(10**13).selectExpr("sum(id % 7 % 5 % 3)")  # hours, were it not stopped
    rows = [("enough", _outcome(lambda: session.in_time(spark, 600, lambda: own.measures(measures).collect()), TimeoutError)), ("too little", _outcome(lambda: session.in_time(spark, 0.5, slow.collect), TimeoutError))]
    return spark.createDataFrame(rows, "time string, outcome string")


custom("measures_time_limit", _time_limit, "SELECT * FROM (VALUES ('enough', 'allowed'), ('too little', 'TimeoutError')) v(time, outcome)")

# ---------------------------------------------------------------- files


def _through_files(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """Writes both logical tables with the sink ``folder/:kind``, then runs a dataset on what it wrote."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        source, where = engine(spark, sf_dir).catalog, folder(spark)
        write_tables({"customers": source(customers._frame), "orders": source(orders._frame)}, f"{where}/:{kind}")
        dataset = create_dataset()
        dataset.define_population(customers.exists_for_patient())
        dataset.name, dataset.balance, dataset.n = customers.name, customers.balance, orders.count_for_patient()
        dataset.last, dataset.paid = orders.date.maximum_for_patient(), orders.sort_by(orders.date).last_for_patient().price
        return Engine(spark, Catalog(spark, str(where))).dataset(dataset)

    return run


LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date DESC, price DESC) AS rn FROM {o}) WHERE rn = 1)"
FILES = f"SELECT c.patient_id, name, balance, (SELECT count(*) FROM {{o}} o WHERE o.patient_id = c.patient_id) AS n, l.date AS last, l.price AS paid FROM {{c}} c LEFT JOIN {LAST} l USING (patient_id)"
for _kind in ("csv", "csv.gz", "arrow", "parquet"):
    custom(f"files_{_kind.replace('.', '_')}", _through_files(_kind), FILES)


def _console(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(nation < 2)
    dataset.name, dataset.n = customers.name, orders.count_for_patient()
    out = io.StringIO()
    write_console({"dataset": engine(spark, sf_dir).dataset(dataset)}, out)
    path = folder(spark) / "said.csv"
    path.write_text(out.getvalue())
    return read_table(spark, str(path), Schema.of(name=str, n=int))


custom("console_output", _console, "SELECT c.patient_id, name, count(date) AS n FROM {c} c LEFT JOIN {o} o USING (patient_id) WHERE nation < 2 GROUP BY ALL")


def _file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark) / "given.csv"
    path.write_text("patient_id,ignored,label,since\n1,x,a,1997-01-01\n4,y,,1996-06-30\n7,z,c,\n100000000,w,d,1990-01-01\n")

    @table_from_file(path)
    class given(PatientFrame):
        label = Series(str)
        since = Series(datetime.date)

    dataset = create_dataset()
    dataset.define_population(given.exists_for_patient() & everyone)
    dataset.label, dataset.n = given.label, orders.where(orders.date >= given.since).count_for_patient()
    return engine(spark, sf_dir).dataset(dataset)


custom("table_from_file", _file_table, "SELECT g.patient_id, label, count(o.date) AS n FROM (VALUES (1, 'a', DATE '1997-01-01'), (4, NULL, DATE '1996-06-30'), (7, 'c', NULL)) g(patient_id, label, since) JOIN {c} c USING (patient_id) LEFT JOIN {o} o ON o.patient_id = g.patient_id AND date >= since GROUP BY ALL")


def _spark_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = engine(spark, sf_dir).catalog
    for name, t in (("customers", customers), ("orders", orders)):
        source(t._frame).createOrReplaceTempView(name)
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.segment, dataset.n = customers.segment, orders.count_for_patient()
    return Engine(spark, Catalog(spark)).dataset(dataset)


custom("default_catalog", _spark_tables, "SELECT c.patient_id, segment, count(date) AS n FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY ALL")


def _materialized(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    own.catalog.tables["switched"] = QueryTable.from_function(lambda c: "SELECT user_id AS patient_id, event_type = 'click' AS on, CAST(ts AS date) AS date, value FROM {events}")
    own.catalog.tables["activity"] = QueryTable("SELECT user_id AS patient_id, CAST(ts AS date) AS date, event_type AS kind, value FROM {events} WHERE value > 1", materialize=True)
    dataset = create_dataset()
    dataset.define_population(everyone)
    dataset.n, dataset.later = activity.count_for_patient(), activity.where(activity.date > switched.date.minimum_for_patient()).count_for_patient()
    return own.dataset(dataset)


custom(
    "materialized_and_function_tables", _materialized,
    "SELECT c.patient_id, count(a.date) AS n, count(*) FILTER (a.date > first) AS later FROM {c} c LEFT JOIN (SELECT patient_id, min(date) AS first FROM {a} GROUP BY 1) f USING (patient_id) LEFT JOIN (SELECT * FROM {a} WHERE value > 1) a ON a.patient_id = c.patient_id GROUP BY 1",
)


def _bad_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow as pa

    where = folder(spark)
    bad = {"bool.csv": "patient_id,b\n1,yes\n", "int.csv": "patient_id,i\n1,1.5\n", "date.csv": "patient_id,d\n1,2020-1-2\n", "category.csv": "patient_id,s\n1,z\n", "no_id.csv": "b\nT\n", "good.csv": "patient_id,b,i,d,s\n1,T,5,2020-01-02,a\n2,,,,\n"}
    for name, text in bad.items():
        (where / name).write_text(text)
    with pa.ipc.new_file(str(where / "type.arrow"), pa.schema([("patient_id", pa.int64()), ("i", pa.string())])) as out:
        out.write_batch(pa.record_batch({"patient_id": [1], "i": ["x"]}))
    schemas = {"bool.csv": {"b": bool}, "int.csv": {"i": int}, "date.csv": {"d": datetime.date}, "category.csv": {"s": ColumnDef(str, (Constraint.Categorical(("a", "b")),))}, "no_id.csv": {"b": bool}, "type.arrow": {"i": int}}
    rows = []
    for name in [*bad, "type.arrow"]:
        schema = Schema.of(**schemas.get(name, {k: v for x in list(schemas)[:4] for k, v in schemas[x].items()}))
        for where_read, read in (("executors", lambda: read_table(spark, str(where / name), schema).collect()), ("driver", lambda: list(read_rows(where / name, schema)))):  # noqa: B023
            rows.append((name, where_read, _outcome(read, Exception) == "allowed"))
    (where / "good.parquet").write_bytes(b"")
    rows.append(("two formats", "catalog", _outcome(lambda: Catalog(spark, str(where)).stored("good"), FileValidationError) == "allowed"))
    return spark.createDataFrame(rows, "file string, reader string, accepted boolean")


custom(
    "file_validation", _bad_files,
    "SELECT file, reader, file = 'good.csv' AS accepted FROM (VALUES ('bool.csv'), ('int.csv'), ('date.csv'), ('category.csv'), ('no_id.csv'), ('good.csv'), ('type.arrow')) f(file), (VALUES ('executors'), ('driver')) r(reader) UNION ALL SELECT 'two formats', 'catalog', false",
)

# ---------------------------------------------------------------- tools


def wide_dataset(above: int = 2):
    dataset = create_dataset()
    dataset.define_population(everyone & (nation > above))
    latest = orders.where(orders.price > customers.balance).sort_by(orders.date, orders.orderkey).last_for_patient()
    dataset.key, dataset.top = latest.orderkey, maximum_of(latest.price, customers.balance)
    dataset.kind = case(when(latest.status.is_in(["F", "O"])).then("known"), when(latest.date > "1997-01-01").then("late"), otherwise="other")
    return dataset


WIDE = """WITH l AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.patient_id ORDER BY date DESC, orderkey DESC) AS rn FROM {o} o JOIN {c} c USING (patient_id) WHERE price > balance) WHERE rn = 1)
SELECT c.patient_id, l.orderkey AS key, greatest(l.price, balance) AS top, CASE WHEN status IN ('F', 'O') THEN 'known' WHEN date > DATE '1997-01-01' THEN 'late' ELSE 'other' END AS kind FROM {c} c LEFT JOIN l USING (patient_id) WHERE nation > 2"""


def _round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = wide_dataset()
    back = serial.loads(serial.dumps({"p": graph._population, "v": graph._variables}))
    return engine(spark, sf_dir).planner().dataset(back["p"], back["v"])["dataset"]


custom("graph_json_round_trip", _round_trip, WIDE)

DEFINITION = """
import datetime
from tessera import create_dataset, get_parameter, claim_permissions
from tessera.language import EventFrame, PatientFrame, Series, table

@table
class customers(PatientFrame):
    nation = Series(int)
    name = Series(str)

@table
class orders(EventFrame):
    date = Series(datetime.date)

dataset = create_dataset()
dataset.define_population(customers.nation < get_parameter("below", int, 2))
dataset.name = customers.name
dataset.n = orders.where(orders.date.is_after("1995-01-01")).count_for_patient()
"""
DEFINED = "SELECT c.patient_id, name, count(date) AS n FROM {c} c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND date > DATE '1995-01-01' WHERE nation < 3 GROUP BY ALL"


def _isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .loading import load_isolated

    path = folder(spark) / "definition.py"
    path.write_text(DEFINITION)
    dataset, _, _ = load_isolated(str(path), "dataset", {"below": "3"})
    return engine(spark, sf_dir).dataset(dataset)


custom("isolated_definition", _isolated, DEFINED)


def _command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import __main__ as cli

    source, where = engine(spark, sf_dir).catalog, folder(spark)
    (where / "definition.py").write_text(DEFINITION)
    write_tables({"customers": source(customers._frame), "orders": source(orders._frame)}, f"{where}/tables/:csv.gz")
    status = cli.main(["generate-dataset", str(where / "definition.py"), "--tables", f"{where}/tables", "--output", f"{where}/out.arrow", "--", "--below", "3"])
    if status:
        raise Error(f"exit status {status}")
    return read_table(spark, f"{where}/out.arrow", Schema.of(name=str, n=int))


custom("command_line_dataset", _command_line, DEFINED)


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import __main__ as cli

    where = folder(spark)
    texts = {"broken": "x = 1 +", "empty": "x = 1", "refused": DEFINITION.replace("customers.nation < get", "customers.nation.is_null() | get")}
    texts["secret"] = DEFINITION.replace("class customers(PatientFrame):", "class customers(PatientFrame):\n    class _meta:\n        required_permission = 'special'\n").replace("dataset = create", "claim_permissions('special')\ndataset = create")
    source = engine(spark, sf_dir).catalog
    write_tables({"customers": source(customers._frame), "orders": source(orders._frame)}, f"{where}/tables/:parquet")
    rows = []
    with contextlib.redirect_stderr(io.StringIO()), contextlib.redirect_stdout(io.StringIO()):
        for name, text in texts.items():
            (where / f"{name}.py").write_text(text)
            rows.append((name, cli.main(["generate-dataset", str(where / f"{name}.py"), "--tables", f"{where}/tables", "--output", f"{where}/x.csv"])))
        (where / "good.py").write_text(DEFINITION)
        rows.append(("several formats", cli.main(["generate-dataset", str(where / "good.py"), "--tables", f"{where}/tables", "--output", f"{where}/x.xlsx"])))
        rows.append(("good", cli.main(["generate-dataset", str(where / "good.py"), "--tables", f"{where}/tables", "--output", f"{where}/x.csv"])))
        rows.append(("graph", cli.main(["graph-query", str(where / "good.py"), "--output", f"{where}/x.svg"])))
    return spark.createDataFrame(rows, "run string, status int")


custom("exit_statuses", _statuses, "SELECT run, status::INT AS status FROM (VALUES ('broken', 10), ('empty', 10), ('refused', 10), ('secret', 12), ('several formats', 11), ('good', 0), ('graph', 0)) v(run, status)")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(customers.exists_for_patient())
    dataset.debt = customers.balance < 0.0
    roots = {"population": dataset._population, **dataset._variables}
    lines = [x.strip() for x in graphs.dot(roots).splitlines() if " -> n" in x]
    import xml.etree.ElementTree as tree

    boxes = len(tree.fromstring(graphs.svg(roots)).findall("{http://www.w3.org/2000/svg}g"))
    return spark.createDataFrame([("edges", len(lines)), ("boxes", boxes)], "part string, n int")


# exists -> customers, lt -> balance and 0.0, balance -> customers, and two roots
custom("graph_pictures", _graph, "SELECT part, n::INT AS n FROM (VALUES ('edges', 6), ('boxes', 7)) v(part, n)")


def _assured(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(customers.nation > 0)
    dataset.n = orders.count_for_patient()
    day = datetime.date(2020, 1, 1)
    cases = {
        1: {customers: {"nation": 1}, orders: [{"date": day}, {"date": day}], "expected_columns": {"n": 2}},
        2: {customers: {"nation": 0}, "expected_in_population": False},
        3: {customers: {"nation": 5}, "expected_columns": {"n": 7}},
        4: {customers: {"nation": None}, "expected_in_population": True},
    }
    found = assurance.check(spark, dataset, cases)["results"]
    return spark.createDataFrame([(x["patient_id"], x["column"], str(x["expected"]), str(x["actual"])) for x in found], "patient_id int, column string, expected string, actual string")


custom("assurance_results", _assured, "SELECT patient_id::INT AS patient_id, \"column\", expected, actual FROM (VALUES (3, 'n', '7', '0'), (4, NULL, 'True', 'False')) v(patient_id, \"column\", expected, actual)")


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    text = own.show(customers.segment, head=3, tail=2) + "\n" + own.show(customers.segment, head=2, html=True)
    return spark.createDataFrame(list(enumerate(x.strip() for x in text.splitlines())), "line long, text string")


custom(
    "show_head_and_tail", _shown,
    """WITH r AS (SELECT patient_id, segment, row_number() OVER (ORDER BY patient_id) AS a, row_number() OVER (ORDER BY patient_id DESC) AS z, length(max(patient_id) OVER (ORDER BY patient_id DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::VARCHAR) AS w FROM {c})
    SELECT 0::BIGINT AS line, 'patient_id | value' AS text UNION ALL SELECT 1, '---------- | ' || repeat('-', (SELECT max(length(segment)) FROM r WHERE a <= 3 OR z <= 2)::INT)
    UNION ALL SELECT 1 + a, rpad(patient_id::VARCHAR, 10, ' ') || ' | ' || segment FROM r WHERE a <= 3 UNION ALL SELECT 5, '…          | …'
    UNION ALL SELECT 8 - z, rpad(patient_id::VARCHAR, 10, ' ') || ' | ' || segment FROM r WHERE z <= 2
    UNION ALL SELECT 8, '<table><thead><tr><th>patient_id</th><th>value</th></tr></thead><tbody>' || (SELECT string_agg('<tr><td>' || patient_id || '</td><td>' || segment || '</td></tr>', '' ORDER BY a) FROM r WHERE a <= 2) || '<tr><td>…</td><td>…</td></tr></tbody></table>'""",
)


def _quiz(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = engine(spark, sf_dir)
    right, wide = customers.nation, wide_dataset()
    fewer = create_dataset()
    fewer.define_population(everyone & (nation > 2))
    fewer.key = orders.count_for_patient()
    rows = [("same", customers.nation + 0, right), ("kind", customers, right), ("values", customers.nation + 1, right), ("patients", wide_dataset(5), wide), ("columns", fewer, wide), ("none", ..., right), ("dataset", wide_dataset(), wide)]
    said = [(name, quiz.check(own, a, b).split(" ")[0].rstrip("!.")) for name, a, b in rows]
    return spark.createDataFrame(said, "answer string, verdict string")


custom("quiz_answers", _quiz, "SELECT * FROM (VALUES ('same', 'Correct'), ('kind', 'A'), ('values', 'Wrong'), ('patients', 'Missing'), ('columns', 'Missing'), ('none', 'There'), ('dataset', 'Correct')) v(answer, verdict)")


def _dummy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dummy import dummy_tables

    @table
    class people(PatientFrame):
        sex = Series(str, constraints=(Constraint.Categorical(("f", "m", "x")),), dummy_data_constraints=(Constraint.Categorical(("f", "m")),))
        born = Series(datetime.date, constraints=(Constraint.NotNull(), Constraint.FirstOfMonth()))

    dataset = create_dataset()
    dataset.define_population((people.sex == "f") & orders.exists_for_patient())
    dataset.configure_dummy_data(population_size=12)
    dataset.day, dataset.n = people.born.day, orders.count_for_patient()
    frames = dummy_tables(spark, dataset)
    out = Engine(spark, lambda t: frames[t.name]).dataset(dataset)
    kinds = {r.sex for r in frames["people"].collect()}
    return out.selectExpr("count(*) AS patients", "bool_and(day = 1) AS first_days", "bool_and(n > 0) AS rows", f"{'true' if kinds <= {'f', 'm'} else 'false'} AS constrained")


custom("dummy_population", _dummy, "SELECT 12::BIGINT AS patients, true AS first_days, true AS rows, true AS constrained")

REFUSALS: dict[str, tuple[type, Callable]] = {
    "two event tables": (Exception, lambda: orders.orderkey + switched.value.as_int()),
    "other filter": (Exception, lambda: orders.where(orders.price > 1.0).orderkey + orders.orderkey),
    "foreign filter": (Exception, lambda: orders.where(switched.on)),
    "int and float": (TypeError, lambda: customers.nation + 1.5),
    "int and str": (TypeError, lambda: customers.nation == "a"),
    "bool order": (TypeError, lambda: (nation > 1) < (nation > 2)),
    "bool and int": (TypeError, lambda: (nation > 1) & nation),
    "python and": (TypeError, lambda: (nation > 1) and (nation > 2)),
    "members": (TypeError, lambda: nation.is_in(["a"])),
    "patient members": (TypeError, lambda: nation.is_in(customers.nation)),
    "empty case": (TypeError, lambda: case()),
    "mixed case": (TypeError, lambda: case(when(nation > 1).then(1), when(nation > 2).then("a"))),
    "loose date": (ValueError, lambda: orders.date > "2020-1-1"),
    "durations": (TypeError, lambda: days(1) + months(1)),
    "episodes": (TypeError, lambda: orders.date.count_episodes_for_patient(months(1))),
    "pick unsorted": (AttributeError, lambda: orders.first_for_patient()),
    "bad code": (ValueError, lambda: SNOMEDCTCode("012345")),
    "search codes by equality": (TypeError, lambda: admissions.codes == "A01"),
    "population of anyone": (Exception, lambda: create_dataset().define_population(~customers.exists_for_patient())),
    "event column": (TypeError, lambda: create_dataset().add_column("x", orders.orderkey)),
    "allowed": (Exception, lambda: orders.where(orders.price > customers.balance).orderkey + nation),
}


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(name, _outcome(build, error) != "allowed") for name, (error, build) in REFUSALS.items()]
    return spark.createDataFrame(rows, "case string, refused boolean")


custom("refused_definitions", _refusals, "SELECT \"case\", \"case\" <> 'allowed' AS refused FROM (VALUES " + ", ".join(f"('{x}')" for x in REFUSALS) + ') v("case")')
