"""python -m tessera COMMAND DEFINITION: runs definition files.

generate-dataset, generate-measures, create-dummy-tables, explain, serialize-definition, assure,
graph-query, test-connection, dump-example-data, isolation-report, debug.
A definition runs in a process of its own that gives back its graph, unless --in-process says otherwise.
Without --tables, datasets and measures are made from dummy tables, for which the permissions
count that a definition claims; with --tables only those that the environment
variable TESSERA_PERMISSIONS grants, a JSON list. What follows ``--`` are parameters for
get_parameter(), as --name value.
"""

from __future__ import annotations

import argparse
import json
import os
import runpy
import sys

from . import permissions, session
from .language import Dataset, Error
from .measures import Measures
from .permissions import PermissionsError
from .plans.specs import output_options
from .sources.files import FileValidationError

#: Exit statuses: a definition that fails to load or is refused, a file that does not fit, a missing permission, a failed assurance test, a time limit.
LOAD = DEFINITION = 10
FILES, PERMISSION, ASSURANCE, LATE = 11, 12, 13, 14
#: Seconds that measures may take: three days.
MEASURES_LIMIT = 259_200


def load(path: str, name: str, kind: type):
    module = runpy.run_path(path)
    if not isinstance(module.get(name), kind):
        raise Error(f"{path} does not define {name!r} as a {kind.__name__}")
    return module[name], module


def arguments(argv: list[str]) -> tuple[argparse.Namespace, dict[str, str]]:
    cut = argv.index("--") if "--" in argv else len(argv)
    rest = argv[cut + 1 :]
    if len(rest) % 2 or any(not k.startswith("--") for k in rest[::2]):
        raise SystemExit("parameters are given as -- --name value ...")
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("generate-dataset", "generate-measures", "create-dummy-tables", "explain", "serialize-definition", "assure", "graph-query", "test-connection", "dump-example-data", "isolation-report", "debug"):
        c = commands.add_parser(name)
        if name not in ("test-connection", "dump-example-data", "isolation-report"):
            c.add_argument("definition")
        c.add_argument("--tables", help="folder with one file for each table")
        c.add_argument("--output", help="file, or folder/:ext for several tables; else the console")
        c.add_argument("--measures", action="store_true", help="the definition is one of measures")
        c.add_argument("--semi-join", action="store_true", help="restrict event scans to the population first")
        c.add_argument("--in-process", action="store_true", help="load the definition in this process, without limits")
        c.add_argument("--time-limit", type=float, default=MEASURES_LIMIT, help="seconds that measures may take")
    return parser.parse_args(argv[:cut]), {k[2:]: v for k, v in zip(rest[::2], rest[1::2])}


def run(argv: list[str]) -> None:
    from .sources.catalog import Catalog
    from .sources.files import write_console, write_tables

    args, parameters = arguments(argv)
    session.set_parameters(parameters)
    if args.command == "test-connection":
        from pyspark.sql import SparkSession

        found = Catalog(SparkSession.builder.appName("tessera").getOrCreate(), args.tables)
        print(f"{found.reachable()} tables found")
        return
    if args.command == "isolation-report":
        from .loading import isolation_report

        print(isolation_report())
        return
    if args.command == "dump-example-data":
        from .dummy import write_example

        write_example(args.output or "example-data/:csv")
        return
    if args.command == "debug":
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("tessera").getOrCreate()
        session.use(session.Engine(spark, Catalog(spark, args.tables)))
        try:
            runpy.run_path(args.definition)  # what it shows is printed as it runs
        finally:
            session.use(None)
        return
    of_measures = args.measures or args.command == "generate-measures"
    what = ("measures", Measures) if of_measures else ("dataset", Dataset)
    if args.in_process or args.command == "assure":  # the expectations of an assurance test are objects of the definition
        definition, module = load(args.definition, *what)
        claims = permissions.claimed()
    else:
        from .loading import load_isolated

        definition, claims, _ = load_isolated(args.definition, what[0], parameters)
    if args.command == "serialize-definition":
        from .plans.serial import dumps

        print(dumps([m.denominator for m in definition] if of_measures else {"population": definition._population, "variables": dict(definition._variables), "events": {k: dict(v) for k, v in definition._events.items()}}))
        return
    if args.command == "graph-query":
        from .plans.graphs import dot, svg

        roots = {f"{m.name}.{k}": x for m in definition for k, x in (("numerator", m.numerator), ("denominator", m.denominator))} if of_measures else {"population": definition._population, **definition._variables}
        text = (svg if (args.output or "").endswith(".svg") else dot)(roots)
        if args.output:
            with open(args.output, "w", encoding="utf-8") as f:
                f.write(text)
        else:
            print(text)
        return
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args.command == "create-dummy-tables":
        from .dummy import dummy_tables

        write_tables(dummy_tables(spark, definition), args.output or f"{args.tables}/:csv")
        return
    if args.tables is None and args.command.startswith("generate"):
        from .dummy import dummy_tables

        frames = dummy_tables(spark, definition)
        engine = session.Engine(spark, lambda t: frames[t.name], granted=claims)
    else:
        engine = session.Engine(spark, Catalog(spark, args.tables), semi_join=args.semi_join, granted=set(json.loads(os.environ.get("TESSERA_PERMISSIONS") or "[]")))
    if args.command == "explain":
        engine.explain(definition)
    elif args.command == "assure":
        from .assurance import check

        found = check(spark, definition, module["test_data"])
        for kind, items in found.items():
            print(f"{kind}: {'all as expected' if not items else ''}")
            for x in items:
                print("  ", x)
        if any(found.values()):
            raise SystemExit(ASSURANCE)
    else:
        tables = {"measures": engine.measures(definition)} if of_measures else engine.tables(definition)
        options = output_options(dict(definition._variables)) if len(tables) == 1 and not of_measures else {}
        session.in_time(spark, args.time_limit if of_measures else None, lambda: write_tables(tables, args.output, **options) if args.output else write_console(tables))


def main(argv: list[str]) -> int:
    try:
        run(argv)
    except PermissionsError as e:
        print(f"error: {e}", file=sys.stderr)
        return PERMISSION
    except TimeoutError as e:
        print(f"error: {e}", file=sys.stderr)
        return LATE
    except FileValidationError as e:
        print(f"error: {e}", file=sys.stderr)
        return FILES
    except Error as e:
        print(f"error: {e}", file=sys.stderr)
        return DEFINITION
    except (SyntaxError, ImportError, NameError, AttributeError, TypeError, ValueError) as e:
        print(f"error in {argv[1] if len(argv) > 1 else 'the definition'}: {type(e).__name__}: {e}", file=sys.stderr)
        return LOAD
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
