"""Times the cohort queries at $BENCH_SF_DIR in Spark and their SQL in DuckDB, side by side; prints a Markdown table."""

from __future__ import annotations

import os
import time

import duckdb
from pyspark.sql import SparkSession

from bench import HEADLINE
from tessera.queries import ORACLE_SQL, QUERIES


def least(run, times: int = 3) -> float:
    """Seconds of the fastest of several runs."""
    took = []
    for _ in range(times):
        start = time.perf_counter()
        run()
        took.append(time.perf_counter() - start)
    return min(took)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect(config={"threads": int(cpus)})
    con.sql("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    print("| Query | Spark, s | DuckDB, s |\n|-|-|-|")
    for name in [x for x in HEADLINE if x in QUERIES]:
        ours = least(lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())  # noqa: B023
        print(f"| `{name}` | {ours:.2f} | {least(lambda: con.sql(ORACLE_SQL[name]).fetchall()):.2f} |")  # noqa: B023


if __name__ == "__main__":
    main()
