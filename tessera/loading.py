"""Definitions loaded in a process of their own.

A definition is a program. Loaded here, it runs in a child process with a stripped
environment, no inherited files, limits on memory, CPU time and file size, and, where the kernel
lets an unprivileged process have one, a network namespace of its own. What it defines comes back as
JSON of the graph, which can hold nothing but nodes, literals and names.
"""

from __future__ import annotations

import json
import os
import resource
import subprocess
import sys
import tempfile
from pathlib import Path

from .functions.durations import Duration  # noqa: F401 durations are resolved before graphs are written
from .language import Dataset, DummyDataConfig, Error, wrap
from .measures import Measure, Measures
from .plans import serial

#: Bytes of memory, seconds of CPU and bytes of a file that a definition may use, and seconds that it may take.
MEMORY, CPU_SECONDS, FILE_BYTES, SECONDS = 4 << 30, 120, 64 << 20, 300
#: Variables of the environment that the child may see.
PASSED = ("PATH", "PYTHONPATH", "HOME", "LANG", "TZ")
CLONE_NEWUSER, CLONE_NEWNET = 0x10000000, 0x40000000


def pack(definition: Dataset | Measures) -> str:
    """All of a definition as JSON."""
    config = definition.dummy_data_config
    extra = config.additional_population_constraint
    dummy = [config.population_size, config.legacy, config.timeout, None if extra is None else extra._node]
    if isinstance(definition, Dataset):
        return serial.dumps({"kind": "dataset", "population": definition._population, "variables": dict(definition._variables), "events": {k: dict(v) for k, v in definition._events.items()}, "dummy": dummy})
    rows = [[m.name, m.numerator, m.denominator, m.group_by, m.intervals] for m in definition]
    return serial.dumps({"kind": "measures", "measures": rows, "control": definition.disclosure_control, "dummy": dummy})


def unpack(text: str) -> Dataset | Measures:
    data = serial.loads(text)
    if data["kind"] == "dataset":
        out = Dataset()
        for name, value in (("_population", data["population"]), ("_variables", data["variables"]), ("_events", data["events"])):
            object.__setattr__(out, name, value)
    else:
        out = Measures(disclosure_control=data["control"])
        out._measures = {r[0]: Measure(*r) for r in data["measures"]}
    size, legacy, timeout, extra = data["dummy"]
    object.__setattr__(out, "dummy_data_config", DummyDataConfig(size, legacy, timeout, None if extra is None else wrap(extra)))
    return out


def confine() -> list[str]:
    """Limits this process for good; the names of those that hold."""
    held = []
    for name, kind, most in (("memory", resource.RLIMIT_AS, MEMORY), ("cpu", resource.RLIMIT_CPU, CPU_SECONDS), ("file size", resource.RLIMIT_FSIZE, FILE_BYTES), ("core files", resource.RLIMIT_CORE, 0)):
        _, hard = resource.getrlimit(kind)
        resource.setrlimit(kind, (most if hard == resource.RLIM_INFINITY else min(most, hard),) * 2)
        held.append(name)
    try:
        os.unshare(CLONE_NEWUSER | CLONE_NEWNET)  # no network but an unconnected one
        held.append("network")
    except (AttributeError, OSError):
        pass
    return held


_CHILD = """
import json, runpy, sys
from tessera import loading, permissions, session
path, name, parameters = sys.argv[1], sys.argv[2], json.loads(sys.argv[3])
session.set_parameters(parameters)
held = loading.confine()
said, sys.stdout = sys.stdout, sys.stderr  # what the definition prints is not the result
found = runpy.run_path(path).get(name)
if type(found).__name__ not in ("Dataset", "Measures"):
    sys.exit(f"{path} does not define {name!r}")
json.dump({"definition": loading.pack(found), "claimed": sorted(permissions.claimed()), "held": held}, said)
"""


def load_isolated(path: str, name: str, parameters: dict[str, str] | None = None) -> tuple[Dataset | Measures, set[str], list[str]]:
    """(definition, permissions it claims, limits that held); Error with what the child said if it does not load."""
    env = {k: os.environ[k] for k in PASSED if k in os.environ}
    env["PYTHONPATH"] = os.pathsep.join(filter(None, (str(Path(__file__).resolve().parent.parent), env.get("PYTHONPATH"))))
    with tempfile.TemporaryFile() as out:  # a regular file, so that its size is limited too
        try:
            run = subprocess.run([sys.executable, "-c", _CHILD, str(path), name, json.dumps(parameters or {})], env=env, stdin=subprocess.DEVNULL, stdout=out, stderr=subprocess.PIPE, timeout=SECONDS, close_fds=True, start_new_session=True)
        except subprocess.TimeoutExpired as e:
            raise Error(f"{path}: not loaded within {SECONDS} s") from e
        if run.returncode:
            raise Error(f"{path} failed to load:\n{run.stderr.decode(errors='replace')[-4000:].strip()}")
        out.seek(0)
        data = json.load(out)
    return unpack(data["definition"]), set(data["claimed"]), data["held"]


def isolation_report() -> str:
    """Which limits hold for definitions on this machine."""
    with tempfile.TemporaryDirectory() as folder:
        path = Path(folder) / "empty.py"
        path.write_text("from tessera import create_measures\nmeasures = create_measures()\n")
        _, _, held = load_isolated(str(path), "measures")
    return "\n".join(f"{x}: {'limited' if x in held else 'NOT limited'}" for x in ("memory", "cpu", "file size", "core files", "network"))
