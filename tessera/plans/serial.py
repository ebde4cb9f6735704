"""Expression graphs as JSON and back: shared nodes are written once, each before those that use it."""

from __future__ import annotations

import datetime
import json
from dataclasses import fields, is_dataclass

from ..functions import codes, constraints
from . import nodes as n

_TYPES = {t.__name__: t for t in (bool, int, float, str, datetime.date, *(c for c in vars(codes).values() if isinstance(c, type) and issubclass(c, (codes.Code, codes.MultiCodeString))))}
_NODES = {c.__name__: c for c in vars(n).values() if isinstance(c, type) and issubclass(c, n.Node)}
_PARTS = {c.__name__: c for c in (n.Schema, n.ColumnDef, *(c for c in vars(constraints).values() if isinstance(c, type) and is_dataclass(c)))}


def dumps(value) -> str:
    """JSON of a node, or of lists and dicts that hold nodes."""
    table: list = []
    place: dict[n.Node, int] = {}

    def pack(x):
        if isinstance(x, n.Node):
            for y in n.walk(x):
                if y not in place:
                    table.append({"node": type(y).__name__, **{f.name: pack(getattr(y, f.name)) for f in fields(y)}})
                    place[y] = len(table) - 1
            return {"ref": place[x]}
        if isinstance(x, tuple):
            return {"tuple": [pack(v) for v in x]}
        if isinstance(x, frozenset):
            return {"set": [pack(v) for v in sorted(x, key=str)]}
        if isinstance(x, list):
            return [pack(v) for v in x]
        if isinstance(x, dict):
            return {"dict": [[pack(k), pack(v)] for k, v in x.items()]}
        if isinstance(x, type):
            return {"type": x.__name__}
        if isinstance(x, datetime.date):
            return {"date": x.isoformat()}
        if isinstance(x, codes.Code):
            return {"code": [type(x).__name__, x.value]}
        if is_dataclass(x):
            return {"part": type(x).__name__, "of": {f.name: pack(getattr(x, f.name)) for f in fields(x)}}
        if x is None or isinstance(x, (bool, int, float, str)):
            return x
        raise TypeError(f"cannot write {type(x).__name__}")

    root = pack(value)
    return json.dumps({"nodes": table, "value": root})


def loads(text: str):
    data = json.loads(text)
    made: list[n.Node] = []

    def unpack(x):
        if isinstance(x, list):
            return [unpack(v) for v in x]
        if not isinstance(x, dict):
            return x
        if "ref" in x:
            return made[x["ref"]]
        if "tuple" in x:
            return tuple(unpack(v) for v in x["tuple"])
        if "set" in x:
            return frozenset(unpack(v) for v in x["set"])
        if "dict" in x:
            return {unpack(k): unpack(v) for k, v in x["dict"]}
        if "type" in x:
            return _TYPES[x["type"]]
        if "date" in x:
            return datetime.date.fromisoformat(x["date"])
        if "code" in x:
            return _TYPES[x["code"][0]](x["code"][1])
        return _PARTS[x["part"]](**{k: unpack(v) for k, v in x["of"].items()})

    for x in data["nodes"]:
        cls = _NODES[x.pop("node")]
        made.append(cls(**{k: unpack(v) for k, v in x.items()}))
    return unpack(data["value"])
