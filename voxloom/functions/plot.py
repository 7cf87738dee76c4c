"""Small line plots of collected results: SVG text or an uncompressed TGA picture."""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

COLORS = ("#1f77b4", "#d62728", "#2ca02c", "#9467bd", "#8c564b", "#17becf")


def ticks(low: float, high: float, target: int = 8) -> list[float]:
    """Round values that cover [low, high] in about ``target`` steps."""
    span = high - low
    if not span > 0:
        return [low]
    raw = span / target
    base = 10.0 ** math.floor(math.log10(raw))
    step = next(m * base for m in (1, 2, 5, 10) if m * base >= raw * (1 - 1e-9))
    return [k * step for k in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


@dataclass
class Plot:
    series: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    functions: list[Callable[[np.ndarray], np.ndarray]] = field(default_factory=list)

    def add(self, y: Sequence[float], x: Sequence[float] | None = None) -> "Plot":
        y = np.asarray(y, float)
        self.series.append((np.arange(len(y), dtype=float) if x is None else np.asarray(x, float), y))
        return self

    def add_function(self, f: Callable[[np.ndarray], np.ndarray]) -> "Plot":
        self.functions.append(f)
        return self

    def _lines(self, points: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[float, float, float, float]]:
        xs = np.concatenate([x for x, _ in self.series]) if self.series else np.array([0.0, 1.0])
        x0, x1 = float(xs.min()), float(xs.max())
        at = np.linspace(x0, x1 if x1 > x0 else x0 + 1, points)
        lines = [*self.series, *[(at, np.asarray(f(at), float)) for f in self.functions]]
        ys = np.concatenate([y[np.isfinite(y)] for _, y in lines]) if lines else np.array([0.0, 1.0])
        y0, y1 = (float(ys.min()), float(ys.max())) if len(ys) else (0.0, 1.0)
        return lines, (x0, x1 if x1 > x0 else x0 + 1, y0, y1 if y1 > y0 else y0 + 1)

    def svg(self, width: int = 640, height: int = 400, margin: int = 48) -> str:
        lines, (x0, x1, y0, y1) = self._lines(width)
        sx = lambda v: margin + (v - x0) / (x1 - x0) * (width - 2 * margin)
        sy = lambda v: height - margin - (v - y0) / (y1 - y0) * (height - 2 * margin)
        parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-size="11" font-family="sans-serif">', f'<rect width="{width}" height="{height}" fill="white"/>']
        for t in ticks(x0, x1):
            parts.append(f'<line x1="{sx(t):.1f}" x2="{sx(t):.1f}" y1="{margin}" y2="{height - margin}" stroke="#e0e0e0"/><text x="{sx(t):.1f}" y="{height - margin + 16}" text-anchor="middle">{t:g}</text>')
        for t in ticks(y0, y1):
            parts.append(f'<line x1="{margin}" x2="{width - margin}" y1="{sy(t):.1f}" y2="{sy(t):.1f}" stroke="#e0e0e0"/><text x="{margin - 6}" y="{sy(t) + 4:.1f}" text-anchor="end">{t:g}</text>')
        for k, (x, y) in enumerate(lines):
            ok = np.isfinite(y)
            path = " ".join(f"{sx(a):.1f},{sy(b):.1f}" for a, b in zip(x[ok], y[ok], strict=True))
            parts.append(f'<polyline points="{path}" fill="none" stroke="{COLORS[k % len(COLORS)]}" stroke-width="1.5"/>')
        return "\n".join([*parts, "</svg>"])

    def tga(self, width: int = 640, height: int = 400) -> bytes:
        """24 bits a pixel, bottom row first."""
        lines, (x0, x1, y0, y1) = self._lines(width)
        picture = np.full((height, width, 3), 255, np.uint8)
        for k, (x, y) in enumerate(lines):
            color = [int(COLORS[k % len(COLORS)][i : i + 2], 16) for i in (5, 3, 1)]  # blue, green, red
            order = np.argsort(x, kind="stable")
            at = np.linspace(x0, x1, width * 4)
            v = np.interp(at, x[order], y[order])
            col = ((at - x0) / (x1 - x0) * (width - 1)).astype(int)
            row = ((v - y0) / (y1 - y0) * (height - 1)).clip(0, height - 1).astype(int)
            inside = (at >= x.min()) & (at <= x.max()) & np.isfinite(v)
            picture[row[inside], col[inside]] = color
        return struct.pack("<3B5xHHHHBB", 0, 0, 2, 0, 0, width, height, 24, 0) + picture.tobytes()

    def write(self, path: str, width: int = 640, height: int = 400) -> None:
        if path.endswith(".tga"):
            with open(path, "wb") as out:
                out.write(self.tga(width, height))
        elif path.endswith(".svg"):
            with open(path, "w") as out:
                out.write(self.svg(width, height))
        else:
            raise ValueError("a plot is written as .svg or .tga")
