"""Dense blocks of an image with a halo, for operators that read around a voxel.

An image of any size is cut into blocks of about ``BLOCK_VOXELS`` voxels; a voxel goes to its
own block and to those whose halo holds it. With a halo of one voxel in three dimensions that
is 1.2 rows a voxel, where a row for each reader would be 27. One shuffle, numpy within a block.
"""

from __future__ import annotations

import inspect
import itertools
import re
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Voxels of a block without its halo: some hundreds of KB a block.
BLOCK_VOXELS = 32_768
#: Samples that meet one copy of a block; a block that more of them read is copied.
BLOCK_SAMPLES = 131_072


def block_edge(axes: int) -> int:
    return max(2, round(BLOCK_VOXELS ** (1 / axes)))


def bounded(index: Column, n: int, boundary: str) -> Column:
    """Where a place beyond the image is read: wrapped around, else at the border."""
    return F.pmod(index, F.lit(n)) if boundary == "wrap" else F.least(F.greatest(index, F.lit(0)), F.lit(n - 1))


def bounded_index(index: np.ndarray, n: int, boundary: str) -> np.ndarray:
    return index % n if boundary == "wrap" else np.clip(index, 0, n - 1)


def _to_blocks(df: DataFrame, axes: list[str], dims: list[int], radius: int, boundary: str, edge: int) -> DataFrame:
    """df with a row for each block (_b0, _b1, …) that holds the voxel or has it in its halo."""
    for i, (axis, n) in enumerate(zip(axes, dims, strict=True)):
        at = F.col(axis).cast("long")
        near = F.array(*[F.floor(bounded(at + d, n, boundary) / edge).cast("long") for d in range(-radius, radius + 1)])
        df = df.filter(at.between(0, n - 1)).withColumn(f"_b{i}", F.explode(F.array_distinct(near)))
    return df


def _tile(rows: pd.DataFrame, axes: list[str], dims: list[int], block: tuple, radius: int, boundary: str, edge: int, value: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block with its halo as an array, and for each axis the indices of the image that its places stand for, ascending."""
    held = [np.unique(bounded_index(np.arange(b * edge - radius, min((b + 1) * edge, n) + radius), n, boundary)) for n, b in zip(dims, block, strict=True)]
    values = rows[value].to_numpy()
    tile = np.zeros([len(h) for h in held], values.dtype)
    tile[tuple(np.searchsorted(h, rows[a].to_numpy()) for h, a in zip(held, axes, strict=True))] = values
    return tile, held


class View:
    """What the voxels of a block see: see(offset) is one array, padded the block with its halo."""

    def __init__(self, padded: np.ndarray, radius: int):
        self.padded, self.radius = padded, radius

    def __call__(self, offset: tuple[int, ...]) -> np.ndarray:
        return self.padded[tuple(slice(self.radius + o, n - self.radius + o) for o, n in zip(offset, self.padded.shape, strict=True))]


def around(df: DataFrame, axes: list[str], dims: list[int], radius: int, outputs: str, work: Callable, value: str | list[str] = "v", keep: list[str] | None = None, outside: str = "clamp") -> DataFrame:
    """Rows (keep, axes, outputs) of each voxel of df, from what lies within the radius along each axis.

    work(view, …), with a View for each value, returns an array for each output; beyond the image the
    border is repeated (or all is 0, outside="zero"). With an argument ``first`` it gets the index
    of the block's first voxel too. A voxel without a row or with a null counts as 0.
    """
    keep, edge = keep or [], block_edge(len(axes))
    values = [value] if isinstance(value, str) else value
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(*keep, *axes, *[F.coalesce(F.col(v), F.lit(0).cast(kinds[v])).alias(v) for v in values])
    names = [o.split()[0] for o in re.split(r",(?![^<]*>)", outputs)]
    blocks = [f"_b{i}" for i in range(len(axes))]
    placed = "first" in inspect.signature(work).parameters

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        block = tuple(int(rows[b].iloc[0]) for b in blocks)
        spans = [(b * edge, min((b + 1) * edge, n)) for b, n in zip(block, dims, strict=True)]
        reach = [np.arange(lo - radius, hi + radius) for lo, hi in spans]
        views = []
        for v in values:
            tile, held = _tile(rows, axes, dims, block, radius, "clamp", edge, v)
            padded = tile[np.ix_(*[np.searchsorted(h, np.clip(r, 0, n - 1)) for h, r, n in zip(held, reach, dims, strict=True)])]
            if outside == "zero":
                padded = padded * reduce(np.multiply.outer, [(r >= 0) & (r < n) for r, n in zip(reach, dims, strict=True)])
            views.append(View(padded, radius))
        own = np.logical_and.reduce([rows[a].between(lo, hi - 1).to_numpy() for a, (lo, hi) in zip(axes, spans, strict=True)])
        rows = rows.loc[own, [*keep, *axes]]
        at = tuple(rows[a].to_numpy() - lo for a, (lo, _) in zip(axes, spans, strict=True))
        found = work(*views, first=tuple(lo for lo, _ in spans)) if placed else work(*views)
        return rows.assign(**{n: list(out[at]) if out.dtype == object else out[at] for n, out in zip(names, found, strict=True)})

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in (*keep, *axes)], outputs])
    return _to_blocks(rows, axes, dims, radius, "clamp", edge).groupBy(*keep, *blocks).applyInPandas(run, schema)


Weights = list[Callable[[np.ndarray], np.ndarray] | None]


def sample(samples: DataFrame, image: DataFrame, at: dict[str, Column], dims: dict[str, int], keys: list[str], steps: list[int], place: Callable[[np.ndarray], np.ndarray], weights: Weights | dict[str, Weights | tuple[str, Weights]], boundary: str, value: str = "v") -> DataFrame:
    """(keys, value): the weighted sum of the voxels around each sample's continuous index.

    The voxels read are place(u) + steps along each axis, with the product of the axes' weights of u - voxel.
    With weights by name there is a column for each of them (a value and its slopes) from one look, of
    the image's column that a pair (column, weights) names.
    Boundary: wrap, clamp (the border is repeated), anything else leaves places beyond it out.
    Samples meet the block of their voxel; a block that many samples read is copied and its
    samples are dealt over the copies. Samples without a finite index give no row.
    """
    axes, radius, edge = list(at), max(abs(s) for s in steps), block_edge(len(at))
    named = weights if isinstance(weights, dict) else {value: weights}
    outputs = {n: w if isinstance(w, tuple) else (value, w) for n, w in named.items()}
    columns = list(dict.fromkeys(c for c, _ in outputs.values()))
    sizes = [dims[a] for a in axes]
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema}
    blocks, ats = [f"_b{i}" for i in range(len(axes))], [f"_u{i}" for i in range(len(axes))]
    rows = samples.select(*keys, *[at[a].cast("double").alias(u) for a, u in zip(axes, ats, strict=True)])
    for u, b, n in zip(ats, blocks, sizes, strict=True):
        rows = rows.filter(F.abs(u) < F.lit(2.0**52))
        home = F.floor(F.col(u) + F.lit(float(place(np.array([0.5]))[0]) / 2))  # place rounds down (0) or to the nearest (1)
        rows = rows.withColumn(b, F.floor(bounded(home, n, boundary) / edge).cast("long"))
    # voxels that compress well look small to the planner: only joins that can broadcast nothing but the list of blocks
    copies = rows.groupBy(*blocks).agg(F.ceil(F.count("*") / BLOCK_SAMPLES).cast("int").alias("_copies"))
    hot, several = F.broadcast(copies.filter("_copies > 1")), F.coalesce("_copies", F.lit(1))  # a row for BLOCK_SAMPLES samples at most
    dealt = rows.join(hot, blocks, "left").withColumn("_copy", F.pmod(F.xxhash64(*keys, *ats), several).cast("int")).drop("_copies")
    voxels = _to_blocks(image.select(*axes, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_v{k}") for k, c in enumerate(columns)]), axes, sizes, radius, boundary, edge)
    voxels = voxels.join(copies.select(*blocks), blocks, "left_semi").join(hot, blocks, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), several - 1))).drop("_copies")

    def run(rows: pd.DataFrame, voxels: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: [] for c in (*keys, *outputs)})
        block = tuple(int(rows[b].iloc[0]) for b in blocks)
        tiles = [_tile(voxels, axes, sizes, block, radius, boundary, edge, f"_v{k}") for k in range(len(columns))]
        places = tiles[0][1]
        read = [[place(rows[u].to_numpy()).astype(np.int64) + s for s in steps] for u in ats]
        found = [[np.minimum(np.searchsorted(p, bounded_index(r, n, boundary)), len(p) - 1) for r in line] for line, n, p in zip(read, sizes, places, strict=True)]
        inside = [[np.ones(len(rows)) if boundary in ("wrap", "clamp") else ((r >= 0) & (r < n)).astype(float) for r in line] for line, n in zip(read, sizes, strict=True)]
        corners = list(itertools.product(range(len(steps)), repeat=len(axes)))
        seen = {c: {corner: tile[tuple(found[k][i] for k, i in enumerate(corner))] for corner in corners} for c, (tile, _) in zip(columns, tiles, strict=True)}
        out = {}
        for name, (column, own) in outputs.items():
            weighed = [[(weight(rows[u].to_numpy() - r) if weight else 1.0) * ok for r, ok in zip(line, oks, strict=True)] for u, line, oks, weight in zip(ats, read, inside, own, strict=True)]
            total = np.zeros(len(rows))
            for corner, values in seen[column].items():
                w = np.prod([weighed[k][c] for k, c in enumerate(corner)], axis=0)
                total += np.where(w != 0, w * values, 0.0)
            out[name] = total
        return rows[keys].assign(**out)

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keys], *[f"`{c}` double" for c in outputs]])
    group = [*blocks, "_copy"]
    return dealt.groupBy(*group).cogroup(voxels.groupBy(*group)).applyInPandas(run, schema)
