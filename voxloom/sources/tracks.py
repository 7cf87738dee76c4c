"""Fibre tracks: TrackVis and DFT files to (track_id, pt_idx, x, y, z)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..model import Geometry
from .files import base_name, binary, expand

POINTS = "file string, track_id long, pt_idx int, x float, y float, z float"


def decode_trackvis(data: bytes, reference: Geometry | None = None) -> list[np.ndarray]:
    """Point arrays in physical space: vox_to_ras where it is set, else the reference's affine."""
    if data[:5] != b"TRACK":
        raise ValueError("not a TrackVis file")
    if struct.unpack_from("<i", data, 996)[0] != 1000:
        raise ValueError("byte-swapped or damaged header")
    spacing = np.array(struct.unpack_from("<3f", data, 12))
    spacing[spacing == 0] = 1
    (n_scalars,), (n_props,) = struct.unpack_from("<h", data, 36), struct.unpack_from("<h", data, 238)
    affine = np.array(struct.unpack_from("<16f", data, 440)).reshape(4, 4)
    out, at = [], 1000
    while at + 4 <= len(data):
        (n,) = struct.unpack_from("<i", data, at)
        width = 3 + n_scalars
        p = np.frombuffer(data, "<f4", n * width, at + 4).reshape(n, width)[:, :3] / spacing
        at += 4 + 4 * (n * width + n_props)
        out.append(_place(p, affine, reference))
    return out


def _place(p: np.ndarray, affine: np.ndarray, reference: Geometry | None) -> np.ndarray:
    if affine[3, 3] != 0:
        return p @ affine[:3, :3].T + affine[:3, 3]
    if reference is None:
        return p
    return (p * reference.spacing[:3]) @ reference.direction[:3, :3].T + reference.origin[:3]


def encode_trackvis(tracks: list[np.ndarray], spacing=(1.0, 1.0, 1.0), dims=(1, 1, 1)) -> bytes:
    head = bytearray(1000)
    head[:6] = b"TRACK\0"
    struct.pack_into("<3h", head, 6, *dims)
    struct.pack_into("<3f", head, 12, *spacing)
    struct.pack_into("<16f", head, 440, *np.eye(4).ravel())
    struct.pack_into("<i", head, 988, len(tracks))
    struct.pack_into("<i", head, 992, 2)
    struct.pack_into("<i", head, 996, 1000)
    return bytes(head) + b"".join(struct.pack("<i", len(t)) + (np.asarray(t) * spacing).astype("<f4").tobytes() for t in tracks)


def decode_dft(data: bytes, reference: Geometry | None = None) -> list[np.ndarray]:
    """Curves of a duff fibre track file, little or big endian by its magic."""
    magic = data[:8].rstrip(b"\0 ")
    if not magic.startswith((b"DFT_LE", b"DFT_BE")):
        raise ValueError("not a DFT file")
    order = "<" if magic.startswith(b"DFT_LE") else ">"
    head_size, data_start = struct.unpack_from(order + "ii", data, 12)[0], struct.unpack_from(order + "i", data, 16)[0]
    (n,) = struct.unpack_from(order + "i", data, 28)
    out, at = [], data_start or head_size
    for _ in range(n):
        (count,) = struct.unpack_from(order + "i", data, at)
        p = np.frombuffer(data, order + "f4", 3 * count, at + 4).reshape(count, 3).astype(float)
        at += 4 + 12 * count
        out.append(_place(p / (reference.spacing[:3] if reference is not None else 1), np.zeros((4, 4)), reference))
    return out


def encode_dft(tracks: list[np.ndarray], order: str = "<") -> bytes:
    head = bytearray(32)
    head[:8] = b"DFT_LE\0\0" if order == "<" else b"DFT_BE\0\0"
    struct.pack_into("4B", head, 8, 1, 0, 0, 3)
    struct.pack_into(order + "5i", head, 12, 32, 32, 0, 0, len(tracks))
    return bytes(head) + b"".join(struct.pack(order + "i", len(t)) + np.asarray(t).astype(order + "f4").tobytes() for t in tracks)


def read_tracks(spark: SparkSession, path: str, reference: Geometry | None = None) -> DataFrame:
    """The format is told by the first bytes, not by the name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                data = expand(p, c)
                tracks = decode_dft(data, reference) if data[:4] == b"DFT_" else decode_trackvis(data, reference)
                for k, t in enumerate(tracks):
                    yield pd.DataFrame({"file": base_name(p), "track_id": np.int64(k), "pt_idx": np.arange(len(t), dtype=np.int32), "x": t[:, 0].astype(np.float32), "y": t[:, 1].astype(np.float32), "z": t[:, 2].astype(np.float32)})

    return binary(spark, path).mapInPandas(run, POINTS)
