"""Sinks for small results."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = True) -> None:
    """CSV with a header; one file unless told otherwise."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines."""
    df.write.mode("overwrite").json(path)


def write_document(results: dict[str, DataFrame], path: str) -> None:
    """One indented JSON document of small tables."""
    with open(path, "w") as f:
        json.dump({k: [r.asDict(recursive=True) for r in v.collect()] for k, v in results.items()}, f, indent=2, default=str)


def write_parquet(df: DataFrame, path: str, by: str | None = "network") -> None:
    """Parquet, partitioned by network."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def report(df: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """``line``: a formatted text for each row."""
    return df.select(F.format_string(pattern, *[F.col(c) for c in columns]).alias("line"))


#: Rows of a panel that are drawn at most; larger tables raise, as nobody could tell their marks apart.
MARKS = 20_000
_KINDS = ("points", "line", "bars", "cells")
_SIZE, _EDGE = 320, 40


@dataclass(frozen=True)
class Panel:
    """A table of plot data and how it is drawn.

    ``points`` and ``line`` use columns ``x`` and ``y`` (points are shaded by
    ``value``, if given), ``bars`` start at ``x``, are ``value`` wide and ``y``
    high, ``cells`` have names ``x`` and ``y`` and are shaded by ``value``.
    """

    table: DataFrame
    kind: str
    x: str
    y: str
    value: str | None = None
    title: str = ""


def _shade(v: float, lo: float, hi: float) -> str:
    part = (v - lo) / (hi - lo) if hi > lo else 0.5
    return f"rgb({round(68 + 185 * part)},{round(1 + 230 * part)},{round(84 - 47 * part)})"


def _panel(panel: Panel, left: int) -> list[str]:
    if panel.kind not in _KINDS:
        raise ValueError(f"kind must be one of {_KINDS}")
    if panel.value is None and panel.kind in ("bars", "cells"):
        raise ValueError(f"{panel.kind} need a value")
    rows = panel.table.select(panel.x, panel.y, *([panel.value] if panel.value else [])).na.drop().limit(MARKS + 1).collect()
    if len(rows) > MARKS:
        raise ValueError(f"a panel has {MARKS} marks at most")
    room, out = _SIZE - 2 * _EDGE, [f'<text x="{left + _EDGE}" y="24">{escape(panel.title)}</text>']
    shades = [float(r[2]) for r in rows] if panel.value else [0.0]
    lo, hi = min(shades, default=0.0), max(shades, default=0.0)
    if panel.kind == "cells":
        names = sorted({r[0] for r in rows} | {r[1] for r in rows}, key=str)
        at, side = {n: i for i, n in enumerate(names)}, room / max(1, len(names))
        for a, b, v in rows:
            out.append(f'<rect x="{left + _EDGE + at[a] * side:.2f}" y="{_EDGE + at[b] * side:.2f}" width="{side:.2f}" height="{side:.2f}" fill="{_shade(float(v), lo, hi)}"><title>{escape(f"{a}, {b}: {v}")}</title></rect>')
        return out
    bars = panel.kind == "bars"
    xs = [float(r[0]) for r in rows] + ([float(r[0]) + float(r[2]) for r in rows] if bars else [])
    ys = [float(r[1]) for r in rows] + ([0.0] if bars else [])
    x0, x1, y0, y1 = (f(v, default=0.0) for v in (xs, ys) for f in (min, max))
    px = lambda v: left + _EDGE + room * ((v - x0) / (x1 - x0) if x1 > x0 else 0.5)
    py = lambda v: _SIZE - _EDGE - room * ((v - y0) / (y1 - y0) if y1 > y0 else 0.5)
    out.append(f'<path class="frame" d="M{left + _EDGE} {_EDGE}V{_SIZE - _EDGE}H{left + _SIZE - _EDGE}" fill="none" stroke="#888"/>')
    for v, x, y in ((x0, left + _EDGE, _SIZE - 22), (x1, left + _SIZE - _EDGE - 30, _SIZE - 22), (y0, left + 2, _SIZE - _EDGE), (y1, left + 2, _EDGE + 10)):
        out.append(f'<text x="{x}" y="{y}" font-size="9">{v:.4g}</text>')
    if panel.kind == "line":
        path = " ".join(f"{px(x):.2f},{py(y):.2f}" for x, y in sorted((float(r[0]), float(r[1])) for r in rows))
        out.append(f'<polyline points="{path}" fill="none" stroke="rgb(31,119,180)"/>')
    elif bars:
        for x, y, w in rows:
            out.append(f'<rect x="{px(float(x)):.2f}" y="{py(float(y)):.2f}" width="{px(float(x) + float(w)) - px(float(x)):.2f}" height="{py(0.0) - py(float(y)):.2f}" fill="rgb(31,119,180)"/>')
    else:
        for r in rows:
            out.append(f'<circle cx="{px(float(r[0])):.2f}" cy="{py(float(r[1])):.2f}" r="2" fill="{_shade(float(r[2]), lo, hi) if panel.value else "rgb(31,119,180)"}"/>')
    return out


def write_figure(panels: Sequence[Panel], path: str) -> None:
    """One SVG file with the panels in a row, from tables of ``operators.plotdata``; only what is drawn reaches the driver."""
    marks = [m for i, p in enumerate(panels) for m in _panel(p, i * _SIZE)]
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{_SIZE * max(1, len(panels))}" height="{_SIZE}" font-family="sans-serif" font-size="12">\n' + "\n".join(marks) + "\n</svg>\n")
