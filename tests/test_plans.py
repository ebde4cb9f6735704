"""Shapes of plans, and random expressions against the plain evaluator."""

import datetime
import random

from tessera import case, create_dataset, days, months, when
from tessera.plans.nulls import evaluate

from .cases import e, p
from .conftest import engine_of, rows_of


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_aggregates_of_a_table_share_a_scan(spark, tmp_path):
    from tessera.session import Engine
    from tessera.sources.catalog import Catalog

    spark.createDataFrame([(i % 9, i, i % 3, i % 5, i % 2 == 0, None, "x", 0.5, "123456") for i in range(90)], "patient_id bigint, i1 bigint, i2 bigint, i3 bigint, b1 boolean, d1 date, s1 string, f1 double, c1 string").write.parquet(str(tmp_path / "e.parquet"))
    d = create_dataset()
    d.define_population(e.exists_for_patient())
    late = e.where(e.i1 > 50)
    d.a, d.b, d.c, d.d = late.count_for_patient(), late.i2.sum_for_patient(), late.sort_by(e.i1).last_for_patient().i3, late.i3.count_distinct_for_patient()
    plan = plan_of(Engine(spark, Catalog(spark, str(tmp_path))).dataset(d))
    assert plan.count("FileScan") == 1 and plan.count("Exchange hash") == 1 and "Join" not in plan
    assert "s1" not in plan.split("ReadSchema")[1]
    only = create_dataset()
    only.define_population(late.exists_for_patient())
    only.a, only.b = late.count_for_patient(), late.where(late.i2 == 1).i3.maximum_for_patient()
    plan = plan_of(Engine(spark, Catalog(spark, str(tmp_path))).dataset(only))
    assert plan.count("FileScan") == 1 and "GreaterThan(i1,50)" in plan


def test_semi_join_gives_the_same(spark):
    from tessera.session import Engine

    engine = engine_of(spark, {p: "patient_id|i1\n1|1\n2|2", e: "patient_id|i1\n1|5\n2|6\n3|7"})
    d = create_dataset()
    d.define_population(p.i1 > 1)
    d.v = e.i1.sum_for_patient()
    slow, fast = (sorted(map(tuple, Engine(spark, engine.catalog, semi_join=s).dataset(d).collect())) for s in (False, True))
    assert slow == fast == [(2, 6)]


def test_random_expressions(spark):
    rng = random.Random(5)

    def value(kind):
        if rng.random() < 0.25:
            return ""
        return {"i": str(rng.randint(-4, 4)), "f": str(rng.randint(-8, 8) / 2), "b": rng.choice("TF"), "d": str(datetime.date(2016, 1, 25) + datetime.timedelta(rng.randrange(60))), "s": rng.choice(["a", "ab", "b"])}[kind]

    names = ["i1", "i2", "b1", "b2", "d1", "d2", "s1", "s2", "f1", "f2"]
    text = "patient_id|" + "|".join(names) + "\n" + "\n".join(f"{i}|" + "|".join(value(c[0]) for c in names) for i in range(60))

    def grow(kind, depth):
        if depth == 0 or rng.random() < 0.15:
            return getattr(p, rng.choice([c for c in names if c[0] == kind]))
        sub = lambda k: grow(k, depth - 1)
        same = rng.choice("ifds")
        if kind == "b":
            return rng.choice([lambda: sub("b") & sub("b"), lambda: sub("b") | sub("b"), lambda: ~sub("b"), lambda: sub(same) < sub(same), lambda: sub(same) == sub(same), lambda: sub(same).is_null(), lambda: sub("s").contains(sub("s")), lambda: sub("i").is_in([1, 2])])()
        if kind == "i":
            return rng.choice([lambda: sub("i") + sub("i"), lambda: sub("i") // sub("i"), lambda: -sub("i"), lambda: sub("f").as_int(), lambda: sub("b").as_int(), lambda: (sub("d") - sub("d")).months, lambda: (sub("d") - sub("d")).years, lambda: sub("d").day, lambda: case(when(sub("b")).then(sub("i")), otherwise=3)])()
        if kind == "f":
            return rng.choice([lambda: sub("f") * sub("f"), lambda: sub("i") / sub("i"), lambda: sub("i").as_float(), lambda: sub("f") - sub("f"), lambda: abs(sub("f")), lambda: p.f1 ** p.i1.as_float()])()
        if kind == "d":
            return rng.choice([lambda: sub("d") + days(p.i1), lambda: sub("d") + months(p.i2), lambda: sub("d").to_first_of_month(), lambda: sub("d").when_null_then(sub("d"))])()
        return sub("s").when_null_then("z")

    series = {f"v{i}": grow(rng.choice("bifd"), 3) for i in range(40)}
    d = create_dataset()
    d.define_population(p.exists_for_patient())
    for k, s in series.items():
        d.add_column(k, s)
    got = {r.patient_id: r for r in engine_of(spark, {p: text}).dataset(d).collect()}
    for row in rows_of(text, p._frame.schema):
        for k, s in series.items():
            want = evaluate(s._node, lambda x: row.get(x.name))
            have = got[row["patient_id"]][k]
            assert have == want or isinstance(want, float) and abs(have - want) <= 1e-9 * max(1, abs(want)), (k, row, have, want)
