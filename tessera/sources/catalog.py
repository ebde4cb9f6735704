"""Where tables come from: directories of files, renamed tables, SQL or functions that give DataFrames."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.expressions import spark_type
from ..plans import nodes as n
from .files import EXTENSIONS, FileValidationError, read_table


@dataclass(frozen=True)
class MappedTable:
    """A stored table under other column names: logical to physical."""

    source: str
    columns: dict[str, str]
    patient_id: str = "patient_id"

    def load(self, catalog: Catalog) -> DataFrame:
        df = catalog.stored(self.source)
        return df.select(F.col(self.patient_id).alias("patient_id"), *[F.col(c).alias(name) for name, c in self.columns.items()])


@dataclass(frozen=True)
class QueryTable:
    """A table that SQL over the stored tables, or a function of the catalog, defines. ``materialize`` keeps it once computed."""

    query: str | Callable[[Catalog], DataFrame | str]
    materialize: bool = False

    @classmethod
    def from_function(cls, fn: Callable) -> QueryTable:
        return cls(fn)

    def load(self, catalog: Catalog) -> DataFrame:
        df = self.query(catalog) if callable(self.query) else self.query
        df = catalog.sql(df) if isinstance(df, str) else df
        return df.persist() if self.materialize else df


class Catalog:
    """Finds the DataFrame of a logical table: a mapping first, else a stored table of its name.

    Stored tables are Spark's own, or files of ``directory``: one format there for each
    name. Declared columns that a file lacks read as null; a column is cast to its type.
    """

    def __init__(self, spark: SparkSession, directory: str | None = None, tables: dict[str, MappedTable | QueryTable | DataFrame] | None = None):
        self.spark, self.directory, self.tables = spark, directory, tables or {}
        self._loaded: dict[str, DataFrame] = {}

    def stored(self, name: str, schema: n.Schema | None = None) -> DataFrame:
        if self.directory is None:
            return self.spark.table(name)
        found = [path for ext in EXTENSIONS if self._exists(path := f"{self.directory}/{name}{ext}")]
        if not found:
            raise FileNotFoundError(f"no file of the table {name!r} in {self.directory}")
        if len(found) > 1:
            raise FileValidationError(f"{self.directory}: the table {name!r} is there in several formats")
        return read_table(self.spark, found[0], schema)

    def reachable(self) -> int:
        """How many tables can be opened: mapped ones are loaded, others found by name."""
        for given in self.tables.values():
            _ = given.schema if isinstance(given, DataFrame) else given.load(self).schema
        if self.directory is None:
            return len(self.tables) + len(self.spark.catalog.listTables())
        names = os.listdir(self.directory) if "://" not in self.directory else []
        return len(self.tables) + sum(any(x.endswith(e) for e in EXTENSIONS) for x in names)

    def _exists(self, path: str) -> bool:
        """Whether a file or folder is there, by Spark's own file systems where it is not a plain local path."""
        if "://" not in path:
            return os.path.exists(path)
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)

    def sql(self, text: str) -> DataFrame:
        """SQL in which {name} stands for a stored table."""
        import string

        names = {f for _, f, _, _ in string.Formatter().parse(text) if f}
        return self.spark.sql(text, **{x: self.stored(x) for x in names})

    def __call__(self, table: n.Table) -> DataFrame:
        if table.name not in self._loaded:
            given = self.tables.get(table.name)
            df = given if isinstance(given, DataFrame) else self.stored(table.name, table.schema) if given is None else given.load(self)
            self._loaded[table.name] = df
        df = self._loaded[table.name]
        have = set(df.columns)
        cols = [(F.col(c) if c in have else F.lit(None)).cast(spark_type(d.type)).alias(c) for c, d in table.schema.columns]
        return df.select(F.col("patient_id").cast("bigint"), *cols)
