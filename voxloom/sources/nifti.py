"""NIfTI-1 and NIfTI-2: headers to metadata rows, pixels to voxel rows, and back.

The layouts are those of the published standard. Values are kept raw (scl_slope and
scl_inter are reported, not applied) unless ``scaled`` is asked for. A NIfTI-1 dimension has 16 bits;
a longer first axis is written the way FreeSurfer does it: dim[1] is -1 and glmin holds the length.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import META, Geometry
from .files import base_name, binary, expand

#: Data type codes of the standard and how pixels are stored.
CODES = {
    2: ("UINT8", "u1"), 4: ("INT16", "i2"), 8: ("INT32", "i4"), 16: ("FLOAT32", "f4"), 32: ("COMPLEX64", "c8"), 64: ("FLOAT64", "f8"),
    128: ("RGB24", "V3"), 256: ("INT8", "i1"), 512: ("UINT16", "u2"), 768: ("UINT32", "u4"), 1024: ("INT64", "i8"), 1280: ("UINT64", "u8"),
    1536: ("FLOAT128", "f16"), 1792: ("COMPLEX128", "c16"), 2048: ("COMPLEX256", "c32"), 2304: ("RGBA32", "V4"),
}
BY_NAME = {name: code for code, (name, _) in CODES.items()}
ORDERS = {0: "UNKNOWN", 1: "SEQ", 2: "RSEQ", 3: "ALT", 4: "RALT", 5: "ALT_SHFT", 6: "RALT_SHFT"}

#: name: (offset, struct format) of the fields used, for the 348 and the 540 byte header.
_V1 = {"dim_info": (39, "B"), "dim": (40, "8h"), "datatype": (70, "h"), "bitpix": (72, "h"), "slice_start": (74, "h"), "pixdim": (76, "8f"), "vox_offset": (108, "f"), "scl_slope": (112, "f"), "scl_inter": (116, "f"), "slice_end": (120, "h"), "slice_code": (122, "B"), "xyzt_units": (123, "B"), "slice_duration": (132, "f"), "glmin": (144, "i"), "qform_code": (252, "h"), "sform_code": (254, "h"), "quatern": (256, "3f"), "qoffset": (268, "3f"), "srow": (280, "12f")}
_V2 = {"datatype": (12, "h"), "bitpix": (14, "h"), "dim": (16, "8q"), "pixdim": (104, "8d"), "vox_offset": (168, "q"), "scl_slope": (176, "d"), "scl_inter": (184, "d"), "slice_duration": (208, "d"), "slice_start": (224, "q"), "slice_end": (232, "q"), "qform_code": (344, "i"), "sform_code": (348, "i"), "quatern": (352, "3d"), "qoffset": (376, "3d"), "srow": (400, "12d"), "slice_code": (496, "i"), "xyzt_units": (500, "i"), "dim_info": (524, "B")}
#: The longest dimension of 16 bits, and what stands for a longer first one.
SHORT_MOST, LONG_AXIS = 32767, -1
_SPACE, _TIME = {0: "", 1: "m", 2: "mm", 3: "um"}, {0: "", 8: "s", 16: "ms", 24: "us"}


class NotNifti(ValueError):
    pass


def read_header(data: bytes) -> dict:
    """Fields of either version and the byte order."""
    for order in "<>":
        (size,) = struct.unpack_from(order + "i", data, 0)
        if size in (348, 540):
            fields = _V1 if size == 348 else _V2
            out = {k: v if len(v := struct.unpack_from(order + f, data, at)) > 1 else v[0] for k, (at, f) in fields.items()}
            return out | {"order": order, "version": 1 if size == 348 else 2}
    raise NotNifti("neither a 348 nor a 540 byte header")


def _rotation(b: float, c: float, d: float, qfac: float) -> np.ndarray:
    a = np.sqrt(max(0.0, 1 - b * b - c * c - d * d))
    r = np.array([[a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c)], [2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b)], [2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - c * c - b * b]])
    r[:, 2] *= -1 if qfac < 0 else 1
    return r


def geometry(header: dict) -> Geometry:
    """Placement from the quaternion form where it is set, else the affine form, else pixel sizes."""
    n = max(1, min(int(header["dim"][0]), 7))
    dims = tuple(max(1, int(x)) for x in header["dim"][1 : n + 1])
    if header["version"] == 1 and header["dim"][1] == LONG_AXIS:
        if header["glmin"] < 1:
            raise NotNifti("dim[1] is -1, but glmin holds no length")
        dims = (header["glmin"], *dims[1:])
    spacing = np.array([abs(s) or 1.0 for s in header["pixdim"][1 : n + 1]])
    origin, direction = np.zeros(n), np.eye(n)
    k = min(n, 3)
    if header["qform_code"] > 0:
        direction[:k, :k] = _rotation(*header["quatern"], header["pixdim"][0])[:k, :k]
        origin[:k] = header["qoffset"][:k]
    elif header["sform_code"] > 0:
        m = np.array(header["srow"]).reshape(3, 4)
        length = np.linalg.norm(m[:, :3], axis=0)
        length[length == 0] = 1
        direction[:k, :k] = (m[:, :3] / length)[:k, :k]
        spacing[:k], origin[:k] = length[:k], m[:k, 3]
    units = header["xyzt_units"]
    names = tuple([_SPACE.get(units & 7, "")] * min(n, 3) + [_TIME.get(units & 56, "")] * max(0, n - 3))
    return Geometry(dims, spacing, origin, direction, CODES[header["datatype"]][0], names, ORDERS.get(header["slice_code"], "UNKNOWN"), float(header["slice_duration"]))


def pixels(data: bytes, header: dict, geo: Geometry, scaled: bool = False) -> np.ndarray:
    """The array, first dimension first; complex as complex numbers, colours as a trailing dimension."""
    kind = CODES[header["datatype"]][1]
    n, at = int(np.prod(geo.dims)), int(header["vox_offset"]) or (352 if header["version"] == 1 else 544)
    if kind.startswith("V"):
        raw = np.frombuffer(data, np.uint8, n * int(kind[1]), at).reshape(n, int(kind[1]))
        return np.stack([raw[:, c].reshape(geo.dims, order="F") for c in range(raw.shape[1])], axis=-1)
    out = np.frombuffer(data, np.dtype(header["order"] + kind), n, at).reshape(geo.dims, order="F")
    slope = header["scl_slope"]
    return out * slope + header["scl_inter"] if scaled and slope and np.isfinite(slope) else out


def header_bytes(geo: Geometry, version: int = 1) -> bytes:
    """All that comes before the pixels in a file of either version, quaternion and affine forms both set."""
    if version == 1 and max(geo.dims[1:], default=0) > SHORT_MOST:
        raise ValueError(f"a NIfTI-1 dimension other than the first is at most {SHORT_MOST}; version 2 has no such limit")
    long_axis = version == 1 and geo.dims[0] > SHORT_MOST
    code = BY_NAME[geo.ptype]
    kind = CODES[code][1]
    fields, size, offset = (_V1, 348, 352) if version == 1 else (_V2, 540, 544)
    out = bytearray(offset)
    n, k = geo.ndim, min(geo.ndim, 3)
    d = np.eye(3)
    d[:k, :k] = geo.direction[:k, :k]
    u, s, v = np.linalg.svd(d)
    r = u @ v if s.min() > 1e-8 else np.eye(3)
    qfac = -1.0 if np.linalg.det(r) < 0 else 1.0
    r[:, 2] *= qfac
    w = np.sqrt(max(0.0, 1 + r[0, 0] + r[1, 1] + r[2, 2])) / 2
    if w > 1e-4:
        quatern = [(r[2, 1] - r[1, 2]) / (4 * w), (r[0, 2] - r[2, 0]) / (4 * w), (r[1, 0] - r[0, 1]) / (4 * w)]
    else:  # a half turn: the axis is the eigenvector of 1
        values, vectors = np.linalg.eig(r)
        quatern = np.real(vectors[:, np.argmin(np.abs(values - 1))]).tolist()
    spacing, origin = np.ones(3), np.zeros(3)
    spacing[:k], origin[:k] = geo.spacing[:k], geo.origin[:k]
    affine = np.column_stack([d * spacing, origin])
    units = {v: c for c, v in _SPACE.items()}.get((geo.units or ("",))[0], 0) | ({v: c for c, v in _TIME.items()}.get(geo.units[3], 0) if len(geo.units) > 3 else 0)
    values = {
        "dim": [n, LONG_AXIS if long_axis else geo.dims[0], *geo.dims[1:], *[1] * (7 - n)], "datatype": [code], "bitpix": [np.dtype(kind).itemsize * 8], "pixdim": [qfac, *geo.spacing, *[1.0] * (7 - n)],
        "vox_offset": [offset], "scl_slope": [1.0], "scl_inter": [0.0], "qform_code": [1], "sform_code": [1], "quatern": quatern, "qoffset": origin,
        "srow": affine.ravel(), "xyzt_units": [units], "slice_duration": [geo.slice_duration], "slice_code": [{v: c for c, v in ORDERS.items()}.get(geo.slice_order, 0)],
    }
    if long_axis:
        values["glmin"] = [geo.dims[0]]
    struct.pack_into("<i", out, 0, size)
    for name, value in values.items():
        at, form = fields[name]
        whole = form[-1] in "hqiB"
        struct.pack_into("<" + form, out, at, *[int(x) if whole else float(x) for x in value])
    if version == 1:
        out[344:348] = b"n+1\0"
    else:
        out[4:12] = b"n+2\0\r\n\x1a\n"
    return bytes(out)


def write_bytes(array: np.ndarray, geo: Geometry, version: int = 1) -> bytes:
    """A file of either version, whole; images of any size are written by ``ndimage.write_images``."""
    kind = CODES[BY_NAME[geo.ptype]][1]
    if kind.startswith("V"):
        body = np.stack([array[..., c].ravel(order="F") for c in range(array.shape[-1])], axis=1).astype(np.uint8).tobytes()
    else:
        body = np.asarray(array).astype(np.dtype("<" + kind)).ravel(order="F").tobytes()
    return header_bytes(geo, version) + body


# ---- rows --------------------------------------------------------------------------


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    """A metadata row for each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [geometry(read_header(expand(p, c))).row(base_name(p)) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=META.names)

    return binary(spark, path).mapInPandas(run, META)


def read_packed(spark: SparkSession, path: str, scaled: bool = False, slab: int = 50_000) -> DataFrame:
    """(img_id, x, y, z, ts): a row a voxel, all further dimensions as its series.

    Slabs of voxels leave the task one after the other; complex pixels give their real part.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                data = expand(p, content)
                header = read_header(data)
                geo = geometry(header)
                a = pixels(data, header, geo, scaled)
                a = a.real if np.iscomplexobj(a) else a
                shape = (*a.shape, 1, 1, 1)[:3]
                series = a.reshape(int(np.prod(shape)), -1).astype(float)
                index = np.indices(shape).reshape(3, -1)
                for lo in range(0, len(series), slab):
                    x, y, z = index[:, lo : lo + slab].astype(np.int32)
                    yield pd.DataFrame({"img_id": base_name(p), "x": x, "y": y, "z": z, "ts": list(series[lo : lo + slab])})

    return binary(spark, path).mapInPandas(run, "img_id string, x int, y int, z int, ts array<double>")


def read_voxels(spark: SparkSession, path: str, scaled: bool = False) -> DataFrame:
    return read_packed(spark, path, scaled).select("img_id", "x", "y", "z", F.posexplode("ts").alias("t", "v"))


def encode(packed: DataFrame, geometries: dict[str, Geometry], version: int = 1, suffix: str = ".nii") -> DataFrame:
    """(name, content): one file an image; an image is assembled in one task, as its file format needs."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        geo = geometries[key[0]]
        shape = (*geo.dims, 1, 1, 1)[:3]
        tail = geo.dims[3:]
        a = np.zeros((*shape, int(np.prod(tail)) if tail else 1))
        a[rows["x"], rows["y"], rows["z"]] = np.stack(rows["ts"].to_numpy())
        return pd.DataFrame({"name": [key[0].removesuffix(".nii") + suffix], "content": [write_bytes(a.reshape(geo.dims), geo, version)]})

    return packed.groupBy("img_id").applyInPandas(build, "name string, content binary")
