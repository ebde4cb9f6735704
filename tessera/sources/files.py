"""Reading and writing tables of rows: .csv, .csv.gz, .arrow and Parquet."""

from __future__ import annotations

import csv
import datetime
import gzip
import io
import sys
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import Code
from ..operators.expressions import spark_type
from ..plans import nodes as n

# Executors need not have this package installed: the readers travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

EXTENSIONS = (".parquet", ".arrow", ".csv", ".csv.gz")
#: Rows of an Arrow batch, and level of gzip.
BATCH_ROWS, GZIP_LEVEL = 64_000, 6


class FileValidationError(Exception):
    """A file that does not fit its declared columns."""


def extension(path) -> str:
    name = Path(path).name
    for ext in sorted(EXTENSIONS, key=len, reverse=True):
        if name.endswith(ext):
            return ext
    raise FileValidationError(f"{name}: the format must be one of {', '.join(EXTENSIONS)}")


# ---------------------------------------------------------------- rows on the driver


def parse(value: str, kind: type):
    """A CSV field: empty is null, T and F are booleans, dates are ISO."""
    if value == "":
        return None
    if kind is bool:
        if value not in ("T", "F"):
            raise ValueError(f"invalid boolean {value!r}, must be 'T' or 'F'")
        return value == "T"
    if kind is datetime.date:
        return datetime.date.fromisoformat(value)
    return kind(value)


def _open(path: Path, mode: str):
    if path.name.endswith(".gz"):
        return gzip.open(path, mode + "t", newline="", encoding="utf-8", **({"compresslevel": GZIP_LEVEL} if mode == "w" else {}))
    return path.open(mode, newline="", encoding="utf-8")


def read_rows(path: Path, schema: n.Schema) -> Iterator[tuple]:
    """patient_id and the declared columns of each row, checked; for files that a definition holds itself."""
    ext = extension(path)
    if not path.exists():
        raise FileValidationError(f"missing file: {path}")
    columns = [("patient_id", n.ColumnDef(int)), *schema.columns]
    if ext in (".csv", ".csv.gz"):
        with _open(path, "r") as f:
            reader = csv.reader(f)
            head = next(reader, [])
            missing = [c for c, _ in columns if c not in head]
            if missing:
                raise FileValidationError(f"missing columns: {', '.join(missing)}")
            at = [head.index(c) for c, _ in columns]
            for number, row in enumerate(reader, 1):
                out = []
                for (name, d), i in zip(columns, at):
                    try:
                        out.append(_checked(parse(row[i], d.type), d))
                    except (ValueError, IndexError) as e:
                        raise FileValidationError(f"row {number}, column {name!r}: {e}") from e
                yield tuple(out)
        return
    import pyarrow as pa
    import pyarrow.parquet as pq

    data = pa.ipc.open_file(path).read_all() if ext == ".arrow" else pq.read_table(path)
    missing = [c for c, _ in columns if c not in data.column_names]
    if missing:
        raise FileValidationError(f"missing columns: {', '.join(missing)}")
    for row in zip(*(data[c].to_pylist() for c, _ in columns)):
        out = []
        for v, (name, d) in zip(row, columns):
            v = d.type(v) if v is not None and issubclass(d.type, Code) else float(v) if d.type is float and type(v) is int else v
            if v is not None and type(v) is not d.type:
                raise FileValidationError(f"column {name!r}: {v!r} is not of type {d.type.__name__}")
            out.append(_checked(v, d))
        yield tuple(out)


def _checked(value, d: n.ColumnDef):
    from ..functions.constraints import Categorical

    known = d.constraint(Categorical)
    if known and value is not None and value not in known.values:
        raise ValueError(f"{value!r} is not one of {', '.join(map(repr, known.values))}")
    return value


# ---------------------------------------------------------------- tables in Spark


def read_table(spark: SparkSession, path: str, schema: n.Schema | None = None) -> DataFrame:
    """A file or folder of one format as a DataFrame; declared columns that it has take their types and are checked.

    CSV fields are read by the executors; an invalid one fails the query with its column and
    value. Arrow files must say the declared types; the driver reads their schema, executors the batches.
    """
    ext = extension(path)
    if ext == ".arrow":
        return _read_arrow(spark, str(path), schema)
    df = spark.read.parquet(path) if ext == ".parquet" else spark.read.csv(path, header=True, nullValue="", emptyValue="", escape='"', enforceSchema=False)
    declared = [("patient_id", n.ColumnDef(int)), *(schema.columns if schema else ())]
    if "patient_id" not in df.columns and schema:
        raise FileValidationError(f"{path}: missing column: patient_id")
    text = [c for c, t in df.dtypes if t == "string"]
    return df.withColumns({name: checked_column(name, d, name in text) for name, d in declared if name in df.columns})


def checked_column(name: str, d: n.ColumnDef, text: bool) -> Column:
    """The column as its declared type. Text must have the type's form; what is not among declared categories is refused."""
    from ..functions.constraints import Categorical

    c = F.col(f"`{name}`")

    def must(ok: Column, value: Column, what: str) -> Column:
        said = F.concat(F.lit(f"column {name!r}: "), c.cast("string"), F.lit(f" {what}"))
        return F.when(c.isNull() | F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(said).cast(spark_type(d.type)))

    value = c.cast(spark_type(d.type)) if not text else c.try_cast(spark_type(d.type))
    if text and d.type is bool:
        value = must(c.isin("T", "F"), c == "T", "is an invalid boolean, must be T or F")
    elif text and d.type is datetime.date:
        value = must(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.isNotNull(), value, "is no date of the form YYYY-MM-DD")
    elif text and d.type in (int, float):
        value = must(value.isNotNull(), value, f"is no {d.type.__name__}")
    known = d.constraint(Categorical)
    if known:
        value = must(value.isin(*[str(v) if isinstance(v, Code) else v for v in known.values]), value, f"is not one of {', '.join(map(repr, known.values))}")
    return value


def arrow_file(path: str):
    """An open Arrow file, local or in any store that Arrow reads."""
    import pyarrow as pa
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return pa.ipc.open_file(where.open_input_file(name))


def _read_arrow(spark: SparkSession, path: str, schema: n.Schema | None) -> DataFrame:
    import pyarrow as pa

    with arrow_file(path) as f:
        found, batches = f.schema, f.num_record_batches

    def plain(t: pa.DataType) -> pa.DataType:
        t = t.value_type if pa.types.is_dictionary(t) else t
        return pa.int64() if pa.types.is_integer(t) else pa.float64() if pa.types.is_floating(t) else pa.string() if pa.types.is_large_string(t) else t

    kinds = {pa.int64(): "bigint", pa.float64(): "double", pa.string(): "string", pa.date32(): "date", pa.bool_(): "boolean"}
    target = pa.schema([(f.name, plain(f.type)) for f in found if plain(f.type) in kinds])
    want = {"patient_id": "bigint", **({c: spark_type(d.type) for c, d in schema.columns} if schema else {})}
    for name, kind in want.items():
        have = [f for f in found if f.name == name]
        got = kinds.get(plain(have[0].type)) if have else None
        if schema and name == "patient_id" and not have or have and got != kind and (got, kind) != ("bigint", "double"):
            raise FileValidationError(f"{path}: column {name!r} " + (f"is of type {have[0].type}, not {kind}" if have else "is missing"))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            with arrow_file(path) as f:
                for i in part["batch"].to_pylist():
                    batch = f.get_batch(i)
                    yield pa.RecordBatch.from_arrays([batch[c.name].cast(c.type) for c in target], schema=target)

    jobs = spark.range(batches, numPartitions=max(1, min(batches, 10_000))).withColumnRenamed("id", "batch")
    df = jobs.mapInArrow(read, ", ".join(f"`{c.name}` {kinds[c.type]}" for c in target))
    declared = [("patient_id", n.ColumnDef(int)), *(schema.columns if schema else ())]
    return df.withColumns({name: checked_column(name, d, False) for name, d in declared if name in df.columns})


def _text(value) -> str:
    return "" if value is None else ("T" if value else "F") if isinstance(value, bool) else str(value)


def write_table(df: DataFrame, path, categories: dict[str, tuple] | None = None, ranges: dict[str, tuple[int, int]] | None = None) -> None:
    """Writes a result. Parquet is written by the executors; single-file formats are streamed through the driver."""
    ext = extension(path)
    if ext == ".parquet":
        df.write.mode("overwrite").parquet(str(path))
    elif ext == ".arrow":
        _write_arrow(df, Path(path), categories or {}, ranges or {})
    else:
        with _open(Path(path), "w") as f:
            _write_csv(df, f)


def _write_csv(df: DataFrame, f) -> None:
    rows = csv.writer(f, lineterminator="\n")
    rows.writerow(df.columns)
    for r in df.toLocalIterator(prefetchPartitions=True):
        rows.writerow(map(_text, r))


def _write_arrow(df: DataFrame, path: Path, categories: dict, ranges: dict) -> None:
    """Zstandard IPC in batches; known ranges take the least integer width, known categories a dictionary."""
    import pyarrow as pa

    plain = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "date": pa.date32(), "boolean": pa.bool_()}
    widths = [(pa.int8(), 7), (pa.int16(), 15), (pa.int32(), 31), (pa.int64(), 63)]
    kinds = {}
    for name, t in df.dtypes:
        kinds[name] = plain[t]
        if name in ranges and t == "bigint":
            low, high = ranges[name]
            kinds[name] = next(k for k, bits in widths if -(1 << bits) <= low and high < 1 << bits)
        if name in categories and t == "string":
            index = next(k for k, bits in widths if len(categories[name]) <= 1 << bits)
            kinds[name] = pa.dictionary(index, pa.string(), ordered=True)
    schema = pa.schema(list(kinds.items()))
    options = pa.ipc.IpcWriteOptions(compression="zstd", emit_dictionary_deltas=False)
    with pa.ipc.new_file(path, schema, options=options) as out:
        rows = []
        for r in df.toLocalIterator(prefetchPartitions=True):
            rows.append(tuple(r))
            if len(rows) == BATCH_ROWS:
                out.write_batch(_batch(rows, schema, categories))
                rows = []
        out.write_batch(_batch(rows, schema, categories))


def _batch(rows: list[tuple], schema, categories):
    import pyarrow as pa

    columns = []
    for i, f in enumerate(schema):
        values = [r[i] for r in rows]
        if pa.types.is_dictionary(f.type):
            known = {v: k for k, v in enumerate(categories[f.name])}
            codes = pa.array([None if v is None else known[v] for v in values], f.type.index_type)
            columns.append(pa.DictionaryArray.from_arrays(codes, pa.array(categories[f.name], pa.string()), ordered=True))
        else:
            columns.append(pa.array(values, f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def write_tables(tables: dict[str, DataFrame], target: str | None, categories=None, ranges=None) -> None:
    """Several tables: to the console, to ``dir/:ext`` (one file a table), or, if there is one, to a single file."""
    if target is None:
        write_console(tables)
    elif Path(target).name.startswith(":"):
        folder, ext = Path(target).parent, "." + Path(target).name[1:].lstrip(".")
        extension("x" + ext)
        folder.mkdir(parents=True, exist_ok=True)
        for name, df in tables.items():
            write_table(df, folder / f"{quote(name, safe='')}{ext}", categories, ranges)
    elif len(tables) > 1:
        raise FileValidationError("several tables need a target of the form folder/:csv")
    else:
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        write_table(next(iter(tables.values())), target, categories, ranges)


def write_console(tables: dict[str, DataFrame], stream=None) -> None:
    """CSV on standard output; several tables are set apart by a blank line and their names."""
    out = stream or sys.stdout
    for i, (name, df) in enumerate(tables.items()):
        if len(tables) > 1:
            out.write(("\n" if i else "") + name + "\n")
        text = io.StringIO()
        _write_csv(df, text)
        out.write(text.getvalue())
