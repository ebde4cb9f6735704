"""Queries over the star-schema test tables, one for each operator, and the same in plain SQL."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import INTERVAL, Engine, case, create_dataset, create_measures, days, maximum_of, minimum_of, months, table_from_rows, weeks, when, years
from .language import EventFrame, PatientFrame, Series, table
from .sources.catalog import Catalog, MappedTable, QueryTable


@table
class customers(PatientFrame):
    nation = Series(int)
    balance = Series(float)
    segment = Series(str)
    name = Series(str)


@table
class orders(EventFrame):
    orderkey = Series(int)
    date = Series(datetime.date)
    price = Series(float)
    status = Series(str)
    priority = Series(str)


@table
class lineitems(EventFrame):
    orderkey = Series(int)
    quantity = Series(float)
    flag = Series(str)
    shipdate = Series(datetime.date)


@table
class activity(EventFrame):
    date = Series(datetime.date)
    kind = Series(str)
    value = Series(float)


def engine(spark: SparkSession, sf_dir: str, **options) -> Engine:
    """The test tables under logical names: dates from timestamps, patients from customers and users."""
    whole = Catalog(spark, sf_dir)

    def dated(name: str, column: str) -> Callable:
        return lambda c: c.stored(name).withColumn(column, F.to_date(column))

    def ordered(c: Catalog) -> DataFrame:
        return dated("orders", "o_orderdate")(c).select(F.col("o_custkey").alias("patient_id"), F.col("o_orderkey").alias("orderkey"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))

    def users(c: Catalog) -> DataFrame:
        return dated("events", "ts")(c).select(F.col("user_id").alias("patient_id"), F.col("ts").alias("date"), F.col("event_type").alias("kind"), "value")

    whole.tables = {
        "customers": MappedTable("customer", {"nation": "c_nationkey", "balance": "c_acctbal", "segment": "c_mktsegment", "name": "c_name"}, "c_custkey"),
        "orders": QueryTable(ordered),
        "activity": QueryTable(users),
        "lineitems": QueryTable("SELECT o_custkey AS patient_id, l_orderkey AS orderkey, l_quantity AS quantity, l_returnflag AS flag, CAST(l_shipdate AS date) AS shipdate FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"),
    }
    return Engine(spark, whole, **options)


C = "(SELECT c_custkey AS patient_id, c_nationkey::BIGINT AS nation, c_acctbal AS balance, c_mktsegment AS segment, c_name AS name FROM customer)"
O = "(SELECT o_custkey AS patient_id, o_orderkey AS orderkey, o_orderdate::DATE AS date, o_totalprice AS price, o_orderstatus AS status, o_orderpriority AS priority FROM orders)"  # noqa: E741
A = "(SELECT user_id AS patient_id, ts::DATE AS date, event_type AS kind, value FROM events)"
L = "(SELECT o_custkey AS patient_id, l_orderkey AS orderkey, l_quantity AS quantity, l_returnflag AS flag, l_shipdate::DATE AS shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

everyone = customers.exists_for_patient()
late = orders.where(orders.date >= "1997-01-01")
by_date = orders.sort_by(orders.date)


def query(name: str, population, sql: str, **variables) -> None:
    """Registers a dataset of ``variables``; in ``sql``, {c} {o} {a} {l} are the logical tables."""
    dataset = create_dataset()
    dataset.define_population(population)
    for column, series in variables.items():
        dataset.add_column(column, series)
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir).dataset(dataset)
    ORACLE_SQL[name] = sql.replace("{c}", C).replace("{o}", O).replace("{a}", A).replace("{l}", L)


def custom(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = run
    ORACLE_SQL[name] = sql.replace("{c}", C).replace("{o}", O).replace("{a}", A).replace("{l}", L)


# ---------------------------------------------------------------- filters and aggregates of rows

urgent = orders.where(orders.priority == "1-URGENT")
query("where_exists", everyone, "SELECT patient_id, EXISTS (SELECT 1 FROM {o} o WHERE o.patient_id = c.patient_id AND priority = '1-URGENT') AS has_urgent FROM {c} c", has_urgent=urgent.exists_for_patient())

maybe = case(when(orders.status == "O").then(True), when(orders.status == "F").then(False))
query(
    "except_where_null_complement", everyone,
    "SELECT c.patient_id, count(*) FILTER (status = 'O') AS n_where, count(status) FILTER (status <> 'O') AS n_except FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY 1",
    n_where=orders.where(maybe).count_for_patient(), n_except=orders.except_where(maybe).count_for_patient(),
)
query("count_for_patient", everyone, "SELECT c.patient_id, count(date) AS n FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY 1", n=orders.count_for_patient())
query("count_distinct", everyone, "SELECT c.patient_id, count(DISTINCT status) AS n FROM {c} c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND date >= DATE '1997-01-01' GROUP BY 1", n=late.status.count_distinct_for_patient())
query("sum_null_when_empty", everyone, "SELECT c.patient_id, sum(orderkey)::BIGINT AS total FROM {c} c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND priority = '1-URGENT' GROUP BY 1", total=urgent.orderkey.sum_for_patient())
query("mean", everyone, "SELECT c.patient_id, sum(orderkey)::DOUBLE / count(orderkey) AS mean_key FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY 1", mean_key=orders.orderkey.mean_for_patient())
query(
    "min_max_date", everyone, "SELECT c.patient_id, min(date) AS first_date, max(date) AS last_date, max(priority) AS top, min(price) AS low FROM {c} c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND date >= DATE '1997-01-01' GROUP BY 1",
    first_date=late.date.minimum_for_patient(), last_date=late.date.maximum_for_patient(), top=late.priority.maximum_for_patient(), low=late.price.minimum_for_patient(),
)
query(
    "count_episodes", everyone,
    """WITH g AS (SELECT patient_id, date, lag(date) OVER (PARTITION BY patient_id ORDER BY date) AS before FROM {o})
    SELECT c.patient_id, count(*) FILTER (date IS NOT NULL AND (before IS NULL OR date - before > 30)) AS days_30, count(*) FILTER (date IS NOT NULL AND (before IS NULL OR date - before > 70)) AS weeks_10 FROM {c} c LEFT JOIN g USING (patient_id) GROUP BY 1""",
    days_30=orders.date.count_episodes_for_patient(days(30)), weeks_10=orders.date.count_episodes_for_patient(weeks(10)),
)

# ---------------------------------------------------------------- sorting and picking

FIRST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY {keys}) AS rn FROM {o} WHERE {test}) WHERE rn = 1"


def pick(test: str, keys: str) -> str:
    return "(" + FIRST.replace("{test}", test).replace("{keys}", keys) + ")"


first, last = by_date.first_for_patient(), by_date.last_for_patient()
query("first_pick", everyone, f"SELECT c.patient_id, o.orderkey, o.date FROM {{c}} c LEFT JOIN {pick('true', 'date, orderkey')} o USING (patient_id)", orderkey=first.orderkey, date=first.date)
query(
    "last_pick_tiebreak", everyone, f"SELECT c.patient_id, o.price, o.status FROM {{c}} c LEFT JOIN {pick('true', 'date DESC, price DESC, status DESC')} o USING (patient_id)",
    price=last.price, status=last.status,
)
inner = orders.sort_by(orders.priority).where(orders.price > 100000.0).sort_by(orders.status).where(orders.status != "P").first_for_patient()
query("pick_after_interleaved_filter", everyone, f"SELECT c.patient_id, o.orderkey FROM {{c}} c LEFT JOIN {pick(chr(39).join(['price > 100000 AND status <> ', 'P', '']), 'status, priority, orderkey')} o USING (patient_id)", orderkey=inner.orderkey)
multi = orders.sort_by(orders.status, orders.priority, orders.date).last_for_patient()
query("multi_sort_pick", everyone, f"SELECT c.patient_id, o.orderkey FROM {{c}} c LEFT JOIN {pick('true', 'status DESC, priority DESC, date DESC, orderkey DESC')} o USING (patient_id)", orderkey=multi.orderkey)
unknown = case(when(orders.status == "O").then(orders.date))
nulls_first = orders.sort_by(unknown).first_for_patient()
query("sort_nulls_first", everyone, f"SELECT c.patient_id, o.orderkey FROM {{c}} c LEFT JOIN {pick('true', 'CASE WHEN status = ' + chr(39) + 'O' + chr(39) + ' THEN date END NULLS FIRST, orderkey')} o USING (patient_id)", orderkey=nulls_first.orderkey)
query(
    "pick_exists_and_count", everyone, "SELECT c.patient_id, count(date) > 0 AS found, CASE WHEN count(date) > 0 THEN 1 ELSE 0 END::BIGINT AS n FROM {c} c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND date >= DATE '1997-01-01' GROUP BY 1",
    found=late.sort_by(late.date).last_for_patient().exists_for_patient(), n=late.sort_by(late.date).first_for_patient().count_for_patient(),
)

# ---------------------------------------------------------------- rows and patients together

query(
    "event_filter_on_patient_column", everyone, "SELECT c.patient_id, count(date) AS n FROM {c} c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND price > balance * 20 GROUP BY 1",
    n=orders.where(orders.price > customers.balance * 20.0).count_for_patient(),
)
query(
    "combine_event_and_patient", everyone, "SELECT c.patient_id, max(o.orderkey + c.nation) AS top FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY 1",
    top=(orders.orderkey + customers.nation).maximum_for_patient(),
)
seen = activity.date.maximum_for_patient()
before = orders.where(orders.date <= seen).sort_by(orders.date, orders.orderkey).last_for_patient()
query(
    "asof_last_before_patient_date", everyone,
    """WITH s AS (SELECT patient_id, max(date) AS seen FROM {a} GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY o.patient_id ORDER BY date DESC, orderkey DESC) AS rn FROM {o} o JOIN s USING (patient_id) WHERE date <= seen)
    SELECT c.patient_id, p.orderkey, p.date FROM {c} c LEFT JOIN p ON p.patient_id = c.patient_id AND rn = 1""",
    orderkey=before.orderkey, date=before.date,
)
follow = orders.where(orders.date > first.date).where(orders.date <= first.date + days(180))
query(
    "cascaded_picks", everyone,
    """WITH f AS (SELECT patient_id, min(date) AS d FROM {o} GROUP BY 1) SELECT c.patient_id, count(o.date) AS n, max(o.date) AS last_date FROM {c} c LEFT JOIN f USING (patient_id)
    LEFT JOIN {o} o ON o.patient_id = c.patient_id AND o.date > f.d AND o.date <= f.d + 180 GROUP BY 1""",
    n=follow.count_for_patient(), last_date=follow.date.maximum_for_patient(),
)

# ---------------------------------------------------------------- membership and strings

query("is_in_literal", everyone, "SELECT patient_id, segment IN ('BUILDING', 'MACHINERY') AS hit, segment NOT IN ('BUILDING') AS miss FROM {c}", hit=customers.segment.is_in(["BUILDING", "MACHINERY"]), miss=customers.segment.is_not_in(["BUILDING"]))
null_segment = case(when(customers.nation < 10).then(customers.segment))
query("is_in_empty", everyone, "SELECT patient_id, false AS hit, true AS miss, CASE WHEN nation < 10 THEN segment = 'BUILDING' END AS one FROM {c}", hit=null_segment.is_in([]), miss=null_segment.is_not_in([]), one=null_segment.is_in(["BUILDING"]))
keys = list(range(0, 60000, 7))
query("is_in_large_list", everyone, "SELECT c.patient_id, count(*) FILTER (orderkey % 7 = 0 AND orderkey < 60000) AS n FROM {c} c LEFT JOIN {o} o USING (patient_id) GROUP BY 1", n=orders.where(orders.orderkey.is_in(keys)).count_for_patient())
kind_of = case(when(customers.nation < 8).then("1-URGENT"), when(customers.nation < 16).then("5-LOW"))
MEMBER = "SELECT c.patient_id, count(o.date) AS k, bool_or(priority = v) AS hit, any_value(v) AS v FROM (SELECT *, CASE WHEN nation < 8 THEN '1-URGENT' WHEN nation < 16 THEN '5-LOW' END AS v FROM {c}) c LEFT JOIN {o} o ON o.patient_id = c.patient_id AND date >= DATE '1998-01-01' GROUP BY 1"
query("is_in_event_series", everyone, f"SELECT patient_id, CASE WHEN k = 0 THEN false WHEN v IS NULL THEN NULL ELSE hit END AS hit FROM ({MEMBER})", hit=kind_of.is_in(orders.where(orders.date >= "1998-01-01").priority))
query("is_not_in_event_series", everyone, f"SELECT patient_id, NOT CASE WHEN k = 0 THEN false WHEN v IS NULL THEN NULL ELSE hit END AS miss FROM ({MEMBER})", miss=kind_of.is_not_in(orders.where(orders.date >= "1998-01-01").priority))
query("contains_literal_wildcards", everyone, "SELECT patient_id, contains(name, '#') AS a, contains(name, '%') AS b, contains(segment, 'IN') AS c, contains(segment, 'in') AS d FROM {c}", a=customers.name.contains("#"), b=customers.name.contains("%"), c=customers.segment.contains("IN"), d=customers.segment.contains("in"))
query("contains_column", everyone, "SELECT patient_id, contains(segment, CASE WHEN nation < 5 THEN 'B' WHEN nation < 15 THEN 'U' END) AS hit FROM {c}", hit=customers.segment.contains(case(when(customers.nation < 5).then("B"), when(customers.nation < 15).then("U"))))

# ---------------------------------------------------------------- expressions

nation = customers.nation
small = case(when(nation > 3).then(nation - 12))
query("case_when", everyone, "SELECT patient_id, CASE WHEN balance < 0 THEN 'debt' WHEN balance < 5000 THEN 'some' ELSE 'more' END AS band, CASE WHEN nation = 1 THEN 'x' END AS rare FROM {c}", band=case(when(customers.balance < 0).then("debt"), when(customers.balance < 5000).then("some"), otherwise="more"), rare=case(when(nation == 1).then("x")))
query("map_values", everyone, "SELECT patient_id, CASE segment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 1 WHEN 'FURNITURE' THEN 2 ELSE 0 END::BIGINT AS code FROM {c}", code=customers.segment.map_values({"BUILDING": 1, "MACHINERY": 1, "FURNITURE": 2}, default=0))
query("coalesce_when_null_then", everyone, "SELECT patient_id, coalesce(CASE WHEN nation > 3 THEN nation - 12 END, -1) AS v FROM {c}", v=small.when_null_then(-1))
query("maximum_of_ignore_null", everyone, "SELECT patient_id, greatest(CASE WHEN nation > 3 THEN nation - 12 END, nation - 5) AS top, CASE WHEN nation > 3 THEN nation - 12 END AS self FROM {c}", top=maximum_of(small, nation - 5), self=maximum_of(small, small))
query("minimum_of", everyone, "SELECT patient_id, least(CASE WHEN nation > 3 THEN nation - 12 END, nation - 5, 2) AS low FROM {c}", low=minimum_of(small, nation - 5, 2))
query("truediv_zero_null", everyone, "SELECT patient_id, nation::DOUBLE / nullif(nation - 5, 0) AS q, balance / nullif(nation - 5, 0) AS f FROM {c}", q=nation / (nation - 5), f=customers.balance / (nation - 5).as_float())
query("floordiv_negative", everyone, "SELECT patient_id, floor((nation - 12)::DOUBLE / nullif(nation - 5, 0))::BIGINT AS q FROM {c}", q=(nation - 12) // (nation - 5))
query("power_domain_errors", everyone, "SELECT patient_id, CASE WHEN nation = 12 THEN NULL ELSE pow((nation - 12)::DOUBLE, -2) END AS p, CASE WHEN nation - 12 < 0 THEN NULL ELSE pow((nation - 12)::DOUBLE, 0.5) END AS r FROM {c}", p=(nation - 12) ** -2, r=(nation - 12).as_float() ** 0.5)
query("casts", everyone, "SELECT patient_id, trunc(balance)::BIGINT AS i, nation::DOUBLE AS f, CASE WHEN nation > 5 THEN 1 ELSE 0 END::BIGINT AS b FROM {c}", i=customers.balance.as_int(), f=nation.as_float(), b=(nation > 5).as_int())
query("negate_abs", everyone, "SELECT patient_id, -(nation - 12) AS neg, abs(nation - 12) AS size, 10 - nation AS rsub, 3 * nation + 1 AS lin FROM {c}", neg=-(nation - 12), size=abs(nation - 12), rsub=10 - nation, lin=3 * nation + 1)
yes = case(when(nation < 8).then(True), when(nation < 16).then(False))
no = case(when(customers.balance < 0).then(True), when(customers.balance < 5000).then(False))
query(
    "bool_kleene", everyone, "SELECT patient_id, a AND b AS both, a OR b AS either, NOT a AS neither, a IS NULL AS gone FROM (SELECT patient_id, CASE WHEN nation < 8 THEN true WHEN nation < 16 THEN false END AS a, CASE WHEN balance < 0 THEN true WHEN balance < 5000 THEN false END AS b FROM {c})",
    both=yes & no, either=yes | no, neither=~yes, gone=yes.is_null(),
)
query("comparisons", everyone, "SELECT patient_id, nation < 8 AS lt, nation <= 8 AS le, nation > 8 AS gt, nation >= 8 AS ge, nation = 8 AS eq, segment <> 'BUILDING' AS ne FROM {c}", lt=nation < 8, le=nation <= 8, gt=nation > 8, ge=nation >= 8, eq=nation == 8, ne=customers.segment != "BUILDING")
some_date = first.date
D = "(SELECT c.patient_id, nation, d FROM {c} c LEFT JOIN (SELECT patient_id, min(date) AS d FROM {o} GROUP BY 1) USING (patient_id))"
query("date_parts", everyone, f"SELECT patient_id, year(d) AS y, month(d) AS m, day(d) AS dd FROM {D}", y=some_date.year, m=some_date.month, dd=some_date.day)
query("first_of_month_year", everyone, f"SELECT patient_id, date_trunc('month', d)::DATE AS m, date_trunc('year', d)::DATE AS y FROM {D}", m=some_date.to_first_of_month(), y=some_date.to_first_of_year())
query("add_days_weeks", everyone, f"SELECT patient_id, d + 40 AS a, d - 21 AS b, d + nation::INT AS c FROM {D}", a=some_date + days(40), b=some_date - weeks(3), c=some_date + days(nation))
ROLL = "CASE WHEN day(d + INTERVAL ({n}) MONTH) < day(d) THEN (d + INTERVAL ({n}) MONTH)::DATE + 1 ELSE (d + INTERVAL ({n}) MONTH)::DATE END"
query("add_months_rollover", everyone, f"SELECT patient_id, {ROLL.replace('{n}', '1')} AS a, {ROLL.replace('{n}', '-5')} AS b, {ROLL.replace('{n}', 'nation')} AS c FROM {D}", a=some_date + months(1), b=some_date - months(5), c=some_date + months(nation))
query("add_years_leap", everyone, f"SELECT patient_id, {ROLL.replace('{n}', '12')} AS a, {ROLL.replace('{n}', '-36')} AS b FROM {D}", a=some_date + years(1), b=some_date - years(3))
query(
    "date_differences", everyone,
    f"""SELECT patient_id, (DATE '2000-02-29' - d)::BIGINT AS n_days, floor((DATE '2000-02-29' - d) / 7.0)::BIGINT AS n_weeks, (12 * (2000 - year(d)) + 2 - month(d) - CASE WHEN 29 < day(d) THEN 1 ELSE 0 END)::BIGINT AS n_months,
    (2000 - year(d) - CASE WHEN month(d) > 2 OR month(d) = 2 AND day(d) > 29 THEN 1 ELSE 0 END)::BIGINT AS n_years FROM {D}""",
    n_days=("2000-02-29" - some_date).days, n_weeks=("2000-02-29" - some_date).weeks, n_months=("2000-02-29" - some_date).months, n_years=("2000-02-29" - some_date).years,
)
query(
    "date_predicates", everyone, f"SELECT patient_id, d < DATE '1994-01-01' AS a, d <= DATE '1993-06-01' AS b, d > DATE '1992-03-01' AS c, d > DATE '1992-02-01' AND d < DATE '1993-01-01' AS e, d BETWEEN DATE '1992-02-01' AND DATE '1993-01-01' AS f FROM {D}",
    a=some_date.is_before("1994-01-01"), b=some_date.is_on_or_before("1993-06-01"), c=some_date.is_after("1992-03-01"), e=some_date.is_between_but_not_on("1992-02-01", "1993-01-01"), f=some_date.is_during(("1992-02-01", "1993-01-01")),
)

# ---------------------------------------------------------------- populations, inline tables, outputs

query(
    "population_union_two_tables", urgent.exists_for_patient() | activity.exists_for_patient(),
    "SELECT p AS patient_id, (SELECT count(*) FROM {a} a WHERE a.patient_id = p) AS n FROM (SELECT patient_id AS p FROM {o} WHERE priority = '1-URGENT' UNION SELECT patient_id FROM {a})",
    n=activity.count_for_patient(),
)
query("population_set_membership", customers.segment.is_in(orders.where(orders.price > 300000.0).priority) | (customers.balance < 0), "SELECT patient_id, nation FROM {c} WHERE balance < 0", nation=nation)


@table_from_rows([(1, "a", 1.5), (4, "b", None), (7, None, -2.0), (100000000, "z", 0.0)])
class extra(PatientFrame):
    label = Series(str)
    weight = Series(float)


query("inline_table_join", everyone & (nation < 20), "SELECT patient_id, label, weight FROM {c} LEFT JOIN (VALUES (1, 'a', 1.5::DOUBLE), (4, 'b', NULL), (7, NULL, -2.0)) v(patient_id, label, weight) USING (patient_id) WHERE nation < 20", label=extra.label, weight=extra.weight)
query("sql_defined_table", everyone, "SELECT c.patient_id, sum(quantity)::BIGINT AS total, count(*) FILTER (flag = 'R') AS returned FROM {c} c LEFT JOIN {l} l USING (patient_id) GROUP BY 1", total=lineitems.quantity.as_int().sum_for_patient(), returned=lineitems.where(lineitems.flag == "R").count_for_patient())


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = create_dataset()
    dataset.define_population(customers.segment == "BUILDING")
    recent = orders.where(orders.date >= "1997-01-01").where(orders.price > customers.balance)
    dataset.add_event_table("rows", orderkey=recent.orderkey, since=("1998-12-31" - recent.date).days, nation=nation)
    return engine(spark, sf_dir).tables(dataset)["rows"]


custom("event_table_output", _event_rows, "SELECT o.patient_id, orderkey, (DATE '1998-12-31' - date)::BIGINT AS since, nation FROM {o} o JOIN {c} c USING (patient_id) WHERE segment = 'BUILDING' AND date >= DATE '1997-01-01' AND price > balance")
query(
    "dataset_wide", (customers.segment == "BUILDING") & orders.where(orders.date.year == 1997).exists_for_patient(),
    """SELECT c.patient_id, count(date) AS n_orders, sum(orderkey)::BIGINT AS key_sum, max(date) AS last_date, count(*) FILTER (status = 'F') AS n_f, count(DISTINCT priority) AS n_kinds,
    (SELECT count(*) FROM {a} a WHERE a.patient_id = c.patient_id AND kind = 'click') AS clicks FROM {c} c JOIN {o} o USING (patient_id) WHERE segment = 'BUILDING' GROUP BY c.patient_id HAVING bool_or(year(date) = 1997)""",
    n_orders=orders.count_for_patient(), key_sum=orders.orderkey.sum_for_patient(), last_date=orders.date.maximum_for_patient(), n_f=orders.where(orders.status == "F").count_for_patient(),
    n_kinds=orders.priority.count_distinct_for_patient(), clicks=activity.where(activity.kind == "click").count_for_patient(),
)

# ---------------------------------------------------------------- measures

MONTHS = months(24).starting_on("1996-01-01")
in_interval = orders.where(orders.date.is_during(INTERVAL))


def _measures(group_by, intervals, control=False, numerator=None, denominator=None):
    measures = create_measures()
    measures.configure_disclosure_control(enabled=control)
    for name, groups in group_by.items():
        measures.define_measure(name, numerator=in_interval.count_for_patient() if numerator is None else numerator, denominator=everyone if denominator is None else denominator, group_by=groups, intervals=intervals)
    return lambda spark, sf_dir: engine(spark, sf_dir).measures(measures)


IV = "(SELECT s::DATE AS s, (s + INTERVAL 1 MONTH)::DATE - 1 AS e FROM range(TIMESTAMP '1996-01-01', TIMESTAMP '1998-01-01', INTERVAL 1 MONTH) r(s))"
NUM = "(SELECT c.*, s, e, (SELECT count(*) FROM {o} o WHERE o.patient_id = c.patient_id AND date BETWEEN s AND e) AS n FROM {c} c, " + IV + " i)"
custom("measure_no_groups", _measures({"orders": None}, MONTHS), f"SELECT 'orders' AS measure, s AS interval_start, e AS interval_end, sum(n)::DOUBLE / count(*) AS ratio, sum(n)::BIGINT AS numerator, count(*) AS denominator FROM {NUM} GROUP BY s, e")
custom(
    "measure_grouping_sets", _measures({"by_segment": {"segment": customers.segment}, "by_both": {"segment": customers.segment, "nation": nation}, "all": None}, MONTHS[:3]),
    f"""SELECT CASE grouping_id(segment, nation) WHEN 0 THEN 'by_both' WHEN 1 THEN 'by_segment' ELSE 'all' END AS measure, s AS interval_start, e AS interval_end, sum(n)::DOUBLE / count(*) AS ratio, sum(n)::BIGINT AS numerator, count(*) AS denominator, segment, nation
    FROM {NUM} WHERE s < DATE '1996-04-01' GROUP BY GROUPING SETS ((s, e, segment, nation), (s, e, segment), (s, e))""",
)
custom(
    "measure_monthly_intervals", _measures({"spread": {"segment": customers.segment}}, MONTHS, numerator=in_interval.exists_for_patient(), denominator=orders.where(orders.date < INTERVAL.start_date).exists_for_patient()),
    f"""SELECT 'spread' AS measure, s AS interval_start, e AS interval_end, count(*) FILTER (n > 0)::DOUBLE / count(*) AS ratio, count(*) FILTER (n > 0) AS numerator, count(*) AS denominator, segment FROM {NUM} x
    WHERE EXISTS (SELECT 1 FROM {{o}} o WHERE o.patient_id = x.patient_id AND date < s) GROUP BY s, e, segment""",
)
custom(
    "measure_disclosure_control", _measures({"safe": {"nation": nation}}, MONTHS[:6], control=True),
    f"""SELECT 'safe' AS measure, s AS interval_start, e AS interval_end, n::DOUBLE / nullif(d, 0) AS ratio, n AS numerator, d AS denominator, nation FROM (
    SELECT s, e, nation, CASE WHEN sum(n) <= 7 THEN 0 ELSE floor((sum(n) + 2) / 5) * 5 END::BIGINT AS n, CASE WHEN count(*) <= 7 THEN 0 ELSE floor((count(*) + 2) / 5) * 5 END::BIGINT AS d FROM {NUM} WHERE s < DATE '1996-07-01' GROUP BY s, e, nation)""",
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["dataset_wide"](spark, sf_dir)
