"""Pictures of expression graphs: DOT text, and SVG drawn by layers."""

from __future__ import annotations

import datetime
from dataclasses import fields
from html import escape

from . import nodes as n

#: Sizes of the drawing, in pixels.
WIDE, HIGH, GAP_X, GAP_Y, SHOWN = 170, 34, 24, 46, 26


def parts(x: n.Node) -> list[tuple[str, n.Node]]:
    """The nodes that ``x`` uses, each with the name of its place."""
    out: list[tuple[str, n.Node]] = []

    def look(name: str, v) -> None:
        if isinstance(v, n.Node):
            out.append((name, v))
        elif isinstance(v, tuple):
            for i, y in enumerate(v):
                look(f"{name}.{i}", y)

    for f in fields(x):
        look(f.name, getattr(x, f.name))
    return out


def label(x: n.Node) -> str:
    """Kind of node and its plain values."""
    own = []
    for f in fields(x):
        v = getattr(x, f.name)
        if isinstance(v, (bool, int, float, str, datetime.date)):
            own.append(str(v))
        elif isinstance(v, frozenset):
            own.append(f"{len(v)} values")
    return " ".join([type(x).__name__, *own])


def _numbered(roots: dict[str, n.Node]) -> dict[n.Node, int]:
    return {x: i for i, x in enumerate(n.walk(*roots.values()))}


def dot(roots: dict[str, n.Node]) -> str:
    """A directed graph in the DOT language; shared nodes stand once, the roots above all others."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    ids = _numbered(roots)
    lines = ["digraph definition {", "  { rank = min; " + " ".join(f"r{i} [label={quote(name)}, shape=box];" for i, name in enumerate(roots)) + " }"]
    lines += [f"  n{i} [label={quote(label(x))}];" for x, i in ids.items()]
    lines += [f"  r{i} -> n{ids[x]};" for i, x in enumerate(roots.values())]
    lines += [f"  n{i} -> n{ids[y]} [label={quote(name)}];" for x, i in ids.items() for name, y in parts(x)]
    return "\n".join([*lines, "}", ""])


def svg(roots: dict[str, n.Node]) -> str:
    """The graph as a picture: each node stands a layer below the lowest one that uses it."""
    ids = _numbered(roots)
    depth: dict[n.Node, int] = {}
    for x in sorted(ids, key=ids.get, reverse=True):  # users have higher numbers than what they use
        depth.setdefault(x, 1)
        for _, y in parts(x):
            depth[y] = max(depth.get(y, 1), depth[x] + 1)
    layers: dict[int, list] = {0: list(roots)}
    for x in ids:
        layers.setdefault(depth[x], []).append(x)
    place = {(k, x): (GAP_X + i * (WIDE + GAP_X), GAP_Y + k * (HIGH + GAP_Y)) for k, xs in layers.items() for i, x in enumerate(xs)}
    at = {x: xy for (_, x), xy in place.items()}
    width = 2 * GAP_X + max(map(len, layers.values())) * (WIDE + GAP_X)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{2 * GAP_Y + len(layers) * (HIGH + GAP_Y)}" font-family="sans-serif" font-size="11">']

    def line(a: tuple[int, int], b: tuple[int, int], name: str) -> None:
        x1, y1, x2, y2 = a[0] + WIDE // 2, a[1] + HIGH, b[0] + WIDE // 2, b[1]
        out.append(f'<line x1="{x1}" y1="{y1}" x2="{x2}" y2="{y2}" stroke="gray"/><text x="{(x1 + x2) // 2}" y="{(y1 + y2) // 2}" fill="gray">{escape(name)}</text>')

    for name, x in roots.items():
        line(at[name], at[x], "")
    for x in ids:
        for name, y in parts(x):
            line(at[x], at[y], name)
    for x, (left, top) in at.items():
        text = x if isinstance(x, str) else label(x)
        short = text if len(text) <= SHOWN else text[: SHOWN - 1] + "…"
        out.append(f'<g><title>{escape(text)}</title><rect x="{left}" y="{top}" width="{WIDE}" height="{HIGH}" fill="white" stroke="black"/><text x="{left + 6}" y="{top + 21}">{escape(short)}</text></g>')
    return "\n".join([*out, "</svg>", ""])
