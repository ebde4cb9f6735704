"""From expression graphs to DataFrames.

Whatever a patient-level expression takes from tables is a *leaf*: a column of a patient
table, of a picked row, or an aggregate of event rows. Leaves are laid in levels (a leaf
whose filter or argument uses other leaves comes after them), and all leaves of a level on one
table are computed by one aggregation of one scan, each with its own filter. Their results
are left-joined on the patient. Over intervals, those leaves that mention the interval are
computed for (patient, interval) in the same way, from rows that a filter on the array of
intervals has dealt out to those that they concern.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expressions import compile_series, literal, long_list, spark_type
from . import nodes as n

PID, INTERVAL = "patient_id", "_interval"
START, END = "interval_start_date", "interval_end_date"


def leaves(*roots: n.Node) -> list[n.Series]:
    """The patient-level leaves that expressions use directly, at any depth of expression but not of leaf."""
    found: dict[n.Series, None] = {}
    seen: set[n.Node] = set()
    stack = list(roots)
    while stack:
        x = stack.pop()
        if x in seen:
            continue
        seen.add(x)
        if isinstance(x, n.Aggregate) or isinstance(x, n.Column) and n.is_patient(x):
            found[x] = None
        elif isinstance(x, n.InSeries):
            stack.append(x.value)
            found[n.Aggregate("set", x.members)] = None
        elif isinstance(x, n.Series) and not isinstance(x, n.Column):
            stack += x.inputs
    return list(found)


def frame_of(leaf: n.Series) -> n.Frame:
    """The frame whose rows a leaf reads."""
    if isinstance(leaf, n.Column):
        return leaf.frame
    if isinstance(leaf.source, n.Frame):
        return leaf.source
    return n.domain(leaf.source)


def inner(leaf: n.Series) -> list[n.Series]:
    """The series evaluated on the rows that a leaf reads."""
    frame = frame_of(leaf)
    own = [leaf.source] if isinstance(leaf, n.Aggregate) and isinstance(leaf.source, n.Series) else []
    if isinstance(frame, n.Pick):
        return own + n.conditions(frame.source) + n.sort_keys(frame.source)
    return own + n.conditions(frame)


class Planner:
    """Plans over one catalog: ``table(node)`` gives the DataFrame of a base table, patient_id and declared columns."""

    def __init__(self, spark: SparkSession, table, semi_join: bool = False):
        self.spark, self._table, self.semi_join = spark, table, semi_join
        self._names: dict[n.Node, str] = {}
        self._levels: dict[n.Series, int] = {}
        self._timed: dict[n.Node, bool] = {}

    # ------------------------------------------------------------ small helpers

    def name(self, x: n.Node) -> str:
        return self._names.setdefault(x, f"_v{len(self._names)}")

    def level(self, leaf: n.Series) -> int:
        if leaf not in self._levels:
            self._levels[leaf] = 1 + max((self.level(x) for x in leaves(*inner(leaf))), default=-1)
        return self._levels[leaf]

    def timed(self, x: n.Node) -> bool:
        """Whether an interval's bounds occur anywhere below."""
        if x not in self._timed:
            self._timed[x] = any(isinstance(y, n.Param) for y in n.walk(x))
        return self._timed[x]

    def base(self, frame: n.Frame) -> DataFrame:
        if isinstance(frame, n.InlineTable):
            schema = ", ".join(["patient_id bigint", *(f"`{c}` {spark_type(d.type)}" for c, d in frame.schema.columns)])
            rows = [tuple(str(v) if isinstance(v, n.Code) else v for v in r) for r in frame.rows]
            return self.spark.createDataFrame(rows, schema)
        return self._table(frame)

    def column(self, x: n.Series) -> Column:
        return compile_series(x, self._leaf, self._joined)

    def _joined(self, x: n.InSet) -> Column:
        return F.when(self._leaf(x.value).isNotNull(), F.col(self.name(x)).isNotNull())

    def with_lists(self, df: DataFrame, table: n.Frame, roots: Iterable[n.Node]) -> DataFrame:
        """Event rows of ``table`` with a column for each long list that ``roots`` test them against: not null where the value is a member.

        A list becomes a table of its distinct members, broadcast or shuffled as its size has it.
        """
        import pyarrow as pa

        for x in dict.fromkeys(y for y in n.walk(*roots) if long_list(y) and n.base_table(y.value.frame) == table):
            own, plain = self.name(x), [str(m) if isinstance(m, n.Code) else m for m in x.members]
            members = self.spark.createDataFrame(pa.table({own: pa.array(plain).unique()}))
            df = df.join(members, self._leaf(x.value) == F.col(own), "left")
        return df

    def _leaf(self, x: n.Node) -> Column:
        if isinstance(x, n.Param):
            return F.col(f"{INTERVAL}.{'start' if x.name == START else 'end'}")
        if isinstance(x, n.Column) and not n.is_patient(x):
            return F.col("_e_" + x.name)
        return F.col(self.name(x))

    # ------------------------------------------------------------ the layers

    def closure(self, roots: Iterable[n.Node]) -> list[n.Series]:
        """All leaves that the roots need, in order of level."""
        found: dict[n.Series, None] = {}
        stack = leaves(*roots)
        while stack:
            x = stack.pop()
            if x not in found:
                found[x] = None
                stack += leaves(*inner(x))
        return sorted(found, key=self.level)

    def picked_columns(self, roots: Iterable[n.Node]) -> dict[n.Pick, list[str]]:
        """The columns selected of each picked row anywhere in the query; they break ties."""
        out: dict[n.Pick, set[str]] = {}
        for x in n.walk(*roots):
            if isinstance(x, n.Pick):
                out.setdefault(x, set())
            elif isinstance(x, n.Column) and isinstance(x.frame, n.Pick):
                out.setdefault(x.frame, set()).add(x.name)
        return {k: sorted(v) for k, v in out.items()}

    def add(self, patients: DataFrame, wanted: list[n.Series], picked: dict[n.Pick, list[str]], known: set[n.Series], semi: bool = False, intervals=None) -> DataFrame:
        """``patients`` with a column for each wanted leaf that is not known."""
        wanted = [x for x in wanted if x not in known]
        for level in sorted({self.level(x) for x in wanted}):
            groups: dict[tuple, list[n.Series]] = {}
            for x in (x for x in wanted if self.level(x) == level):
                groups.setdefault((n.base_table(frame_of(x)), self.timed(x)), []).append(x)
            for (table, timed), members in groups.items():
                if not timed and leaves(*(y for x in members for y in inner(x))):
                    patients = self.extended(table, members, patients, picked)
                    continue
                part = self.one_scan(table, members, patients, picked, semi, intervals if timed else None)
                patients = patients.join(part, [PID, "_interval_no"] if timed else PID, "left")
                zero = {"exists": F.lit(False), "count": F.lit(0), "count_distinct": F.lit(0), "episodes": F.lit(0)}
                fill = {self.name(x): F.coalesce(F.col(self.name(x)), zero[x.kind].cast(spark_type(x.type))) for x in members if isinstance(x, n.Aggregate) and x.kind in zero}
                patients = patients.withColumns(fill) if fill else patients
            known |= {x for x in wanted if self.level(x) == level}
        return patients

    def one_scan(self, table: n.Frame, members: list[n.Series], patients: DataFrame | None, picked, semi: bool, intervals) -> DataFrame:
        """patient_id (and interval) and a column for each member, from one read of ``table``."""
        df = self.base(table)
        if table.one_row:
            cols = [F.col(x.name).alias(self.name(x)) if isinstance(x, n.Column) else (F.lit(True) if x.kind == "exists" else F.lit(1).cast("bigint")).alias(self.name(x)) for x in members]
            return df.select(PID, *cols)
        df = self.rows(table, members, picked)
        lower = leaves(*(y for x in members for y in inner(x)))
        if lower:  # an event row of a patient outside the population is of no use
            need = [self.name(x) for x in lower]
            timed_need = intervals is not None and any(self.timed(x) for x in lower)
            keys = [PID, "_interval_no", INTERVAL] if timed_need else [PID]
            side = patients.select(*keys, *need)
            df = df.join(side if timed_need or intervals is None else side.distinct(), PID)
        elif semi and patients is not None:
            df = df.join(patients.select(PID).distinct() if intervals is not None else patients.select(PID), PID, "left_semi")
        tests = {x: self._test(frame_of(x)) for x in members}
        group = [PID]
        if intervals is not None:
            group.append("_interval_no")
            if INTERVAL not in df.columns:
                df = self._deal(df, [frame_of(x) for x in members], intervals)
        conditions = [self._all(t) for t in dict.fromkeys(tests.values()) if t]
        if () not in tests.values() and conditions:
            any_of = conditions[0]
            for c in conditions[1:]:
                any_of = any_of | c
            df = df.where(any_of)  # pushed down to the scan where it only uses the table's own columns
        return df.groupBy(*group).agg(*self._aggregates(members, tests, picked)).select(*group, *[self._result(x).alias(self.name(x)) for x in members])

    def rows(self, table: n.Frame, members: list[n.Series], picked) -> DataFrame:
        """The columns of ``table`` that the members use, under names of their own."""
        used = {x.name for x in n.walk(*members) if isinstance(x, n.Column) and not n.is_patient(x) and n.base_table(x.frame) == table}
        used |= {c for x in members if isinstance(f := frame_of(x), n.Pick) for c in picked.get(f, ())}
        return self.with_lists(self.base(table).select(PID, *[F.col(c).alias("_e_" + c) for c in sorted(used)]), table, members)

    def extended(self, table: n.Frame, members: list[n.Series], patients: DataFrame, picked) -> DataFrame:
        """``patients`` with members whose rows or values depend on columns that it has already.

        One join and one aggregation on the patient, in which ``patients`` occurs once: were
        it also joined to the result, each further layer would double the plan.
        """
        tests = {x: self._test(frame_of(x)) for x in members}
        events = self.rows(table, members, picked).withColumnRenamed(PID, "_event_pid").withColumn("_hit", F.lit(True))
        on = F.col(PID) == F.col("_event_pid")
        conditions = [self._all(t) for t in dict.fromkeys(tests.values()) if t]
        if () not in tests.values() and conditions:
            any_of = conditions[0]
            for c in conditions[1:]:
                any_of = any_of | c
            on = on & any_of
        kept = [c for c in patients.columns if c != PID]
        both = patients.join(events, on, "left").groupBy(PID)
        out = both.agg(*[F.first(c).alias(c) for c in kept], *self._aggregates(members, tests, picked, F.col("_hit")))
        return out.select(PID, *kept, *[self._result(x).alias(self.name(x)) for x in members])

    def _test(self, frame: n.Frame) -> tuple[n.Series, ...]:
        """A frame's filters, innermost first."""
        return tuple(n.conditions(frame.source if isinstance(frame, n.Pick) else frame))

    def _all(self, tests: tuple[n.Series, ...], leaf=None) -> Column:
        out = compile_series(tests[0], leaf or self._leaf, self._joined)
        for t in tests[1:]:
            out = out & compile_series(t, leaf or self._leaf, self._joined)
        return out

    def _deal(self, df: DataFrame, frames: list[n.Frame], intervals) -> DataFrame:
        """Each row once for each interval in which one of the frames may keep it."""

        def hit(iv: Column) -> Column:
            def leaf(x: n.Node) -> Column:
                return iv["start" if x.name == START else "end"] if isinstance(x, n.Param) else self._leaf(x)

            out = None
            for f in frames:
                t = self._test(f)
                if not t:
                    return F.lit(True)
                c = F.coalesce(self._all(t, leaf), F.lit(False))
                out = c if out is None else out | c
            return out

        dealt = df.withColumn(INTERVAL, F.explode(F.filter(interval_array(intervals), hit)))
        return dealt.withColumn("_interval_no", F.col(f"{INTERVAL}.no"))

    def _aggregates(self, members, tests, picked, hit: Column | None = None) -> list[Column]:
        """``hit``: true for rows that are there, where a left join adds rows of nulls."""
        out, done = [], set()
        for x in members:
            test = self._all(tests[x]) if tests[x] else None
            test = hit if test is None else test if hit is None else hit & test
            on = (lambda c: c) if test is None else (lambda c, test=test: F.when(test, c))
            frame = frame_of(x)
            if isinstance(frame, n.Pick):
                if frame not in done:
                    done.add(frame)
                    out.append(self._pick(frame, on, picked.get(frame, ())).alias(self.name(frame)))
                continue
            value = self.column(x.source) if isinstance(x.source, n.Series) else F.lit(1)
            fn = {"exists": F.count, "count": F.count, "count_distinct": F.collect_set, "set": F.collect_set, "episodes": F.collect_set, "min": F.min, "max": F.max, "sum": F.try_sum, "mean": F.avg}[x.kind]
            out.append(fn(on(value)).alias("_a" + self.name(x)))
        return out

    def _pick(self, frame: n.Pick, on, columns) -> Column:
        """The first or last row as a struct; null if no row passes the filters. Nulls sort first, as in structs."""
        keys = n.sort_keys(frame.source)
        direct = {k.name for k in keys if isinstance(k, n.Column)}
        order = F.struct(*[self.column(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.col("_e_" + c).alias(f"t{i}") for i, c in enumerate(columns) if c not in direct])
        row = F.struct(F.lit(True).alias("hit"), *[F.col("_e_" + c).alias(c) for c in columns])
        return (F.max_by if frame.last else F.min_by)(row, on(order))

    def _result(self, x: n.Series) -> Column:
        frame = frame_of(x)
        if isinstance(frame, n.Pick):
            row = F.col(self.name(frame))
            if isinstance(x, n.Column):
                return row[x.name]
            return row.isNotNull() if x.kind == "exists" else F.when(row.isNotNull(), 1).otherwise(0).cast("bigint")
        c = F.col("_a" + self.name(x))
        if x.kind == "exists":
            return c > 0
        if x.kind == "count_distinct":
            return F.size(c).cast("bigint")
        if x.kind == "episodes":
            dates = F.array_sort(c)
            starts = F.transform(dates, lambda d, i: F.when((i == 0) | (F.datediff(d, F.get(dates, i - 1)) > x.option), 1).otherwise(0))
            return F.aggregate(starts, F.lit(0).cast("bigint"), lambda a, b: a + b)
        return c.cast("double") if x.kind == "mean" else c

    # ------------------------------------------------------------ whole queries

    def universe(self, predicate: n.Series, wanted: list[n.Series], picked, known: set) -> DataFrame:
        """Every patient for whom the predicate can be true.

        If it requires a row that a leaf of level 0 counts, that leaf's aggregation gives the
        patients, together with all other leaves of level 0 on the table. Else: the ids of
        the one table that it requires, or of all that it reads.
        """
        leaf = _required(predicate)
        must = None if leaf is None else n.base_table(frame_of(leaf))
        if leaf in wanted and self.level(leaf) == 0 and not self.timed(leaf):
            members = [x for x in wanted if self.level(x) == 0 and not self.timed(x) and n.base_table(frame_of(x)) == must]
            known |= set(members)
            return self.one_scan(must, members, None, picked, False, None)
        tables = [must] if must is not None else list(dict.fromkeys(x for x in n.walk(predicate) if isinstance(x, (n.Table, n.InlineTable))))
        if not tables:
            return self.spark.createDataFrame([], "patient_id bigint")
        ids = [self.base(t).select(PID) for t in tables]
        out = ids[0]
        for more in ids[1:]:
            out = out.union(more)
        return out if len(tables) == 1 and tables[0].one_row else out.distinct()

    def population(self, predicate: n.Series, outputs: Iterable[n.Node]) -> tuple[DataFrame, dict, set]:
        outputs = list(outputs)
        picked, known = self.picked_columns([predicate, *outputs]), set()
        patients = self.universe(predicate, self.closure([predicate, *(x for x in outputs if n.is_patient(x))]), picked, known)
        patients = self.add(patients, self.closure([predicate]), picked, known)
        return patients.where(self.column(predicate)), picked, known

    def dataset(self, predicate: n.Series, variables: dict[str, n.Series], events: dict[str, dict[str, n.Series]] | None = None) -> dict[str, DataFrame]:
        """The table ``dataset``, one row a patient, and the event tables by name."""
        events = events or {}
        every = [*variables.values(), *(x for cols in events.values() for x in cols.values())]
        patients, picked, known = self.population(predicate, every)
        wide = self.add(patients, self.closure(variables.values()), picked, set(known), semi=self.semi_join)
        out = {"dataset": wide.select(PID, *[self.column(x).cast(spark_type(x.type)).alias(c) for c, x in variables.items()])}
        for name, cols in events.items():
            frame = next(d for d in map(n.domain, cols.values()) if d is not None)
            rows = [*cols.values(), *n.conditions(frame)]
            side = self.add(patients, self.closure(rows), picked, set(known), semi=self.semi_join)
            used = sorted({x.name for x in n.walk(*rows) if isinstance(x, n.Column) and not n.is_patient(x)} - {PID})
            table = self.base(n.base_table(frame)).select(PID, *[F.col(c).alias("_e_" + c) for c in used], F.col(PID).alias("_e_" + PID))
            table = self.with_lists(table, n.base_table(frame), rows)
            need = [self.name(x) for x in leaves(*rows)]
            table = table.join(side.select(PID, *need), PID) if need else table.join(side.select(PID), PID, "left_semi")
            test = self._test(frame)
            table = table.where(self._all(test)) if test else table
            out[name] = table.select(PID, *[self.column(x).cast(spark_type(x.type)).alias(c) for c, x in cols.items()])
        return out

    def over_intervals(self, predicate: n.Series, outputs: dict[str, n.Series], intervals) -> DataFrame:
        """patient_id, interval_start, interval_end and outputs, where the predicate is true in the interval."""
        roots = [predicate, *outputs.values()]
        picked, known = self.picked_columns(roots), set()
        wanted = self.closure(roots)
        patients = self.universe(predicate, [x for x in wanted if not self.timed(x)], picked, known)
        patients = self.add(patients, [x for x in wanted if not self.timed(x)], picked, known)
        patients = patients.withColumn(INTERVAL, F.explode(interval_array(intervals))).withColumn("_interval_no", F.col(f"{INTERVAL}.no"))
        patients = self.add(patients, wanted, picked, known, intervals=intervals)
        ends = [F.col(f"{INTERVAL}.start").alias("interval_start"), F.col(f"{INTERVAL}.end").alias("interval_end")]
        return patients.where(self.column(predicate)).select(PID, *ends, *[self.column(x).alias(c) for c, x in outputs.items()])


def interval_array(intervals) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("no"), literal(a).alias("start"), literal(b).alias("end")) for i, (a, b) in enumerate(intervals)])


def _required(predicate: n.Series) -> n.Series | None:
    """A leaf that must have found a row for the predicate to be true; of a patient table, if there is one."""
    if isinstance(predicate, n.Call) and predicate.fn == "and":
        found = [x for x in map(_required, predicate.args) if x is not None]
        return next((x for x in found if n.base_table(frame_of(x)).one_row), found[0] if found else None)
    if isinstance(predicate, n.Aggregate) and predicate.kind == "exists" or isinstance(predicate, n.Column) and n.is_patient(predicate):
        return predicate
    if isinstance(predicate, n.Call) and predicate.fn in ("eq", "ne", "lt", "le", "gt", "ge", "contains"):
        for a in predicate.args:
            if isinstance(a, n.Column) or isinstance(a, n.Aggregate) and a.kind in ("min", "max", "sum", "mean"):
                return a
    return None
