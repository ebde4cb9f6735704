import datetime
import os
import re
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from tessera import Engine  # noqa: E402
from tessera.operators.expressions import spark_type  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def rows_of(text: str, schema) -> list[tuple]:
    """Rows of a small drawn table: patient_id first, | between fields, empty for null, T and F."""
    lines = [x.strip() for x in text.strip().splitlines() if x.strip()]
    head, out = [c.strip() for c in lines[0].split("|")], []
    for line in lines[1:]:
        fields = [x.strip() for x in re.split(r"\|", line)] + [""] * len(head)
        row = {"patient_id": int(fields[0])}
        for name, v in zip(head[1:], fields[1:]):
            kind = schema[name].type
            row[name] = None if v == "" else v == "T" if kind is bool else datetime.date.fromisoformat(v) if kind is datetime.date else kind(v) if kind in (int, float) else v
        out.append(row)
    return out


def engine_of(spark, tables: dict) -> Engine:
    """An engine over drawn tables: table object to text."""
    frames = {}
    for t, text in tables.items():
        schema = t._frame.schema
        names = ["patient_id", *schema.names]
        kinds = ", ".join(["patient_id bigint", *(f"`{c}` {spark_type(d.type)}" for c, d in schema.columns)])
        frames[t._frame.name] = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows_of(text, schema)], kinds)
    return Engine(spark, lambda node: frames[node.name])
