"""NIfTI images as a Spark data source: byte ranges to read, slabs to write.

``spark.read.format("ndimage")`` reads files by partitions of ``sliceBytes`` bytes of pixels, so
one image of any size is read by many tasks, each of which holds one slab of voxels:

* ``form`` voxels (by default): img_id, x, y, z, t, v;
* ``form`` series: img_id, x, y, z, ts, all further dimensions of a voxel in order;
* ``form`` header: a metadata row a file, no pixel is read.

Columns that a given schema leaves out aren't made. Options ``x``, ``y`` and ``z`` of the form
``low:high`` read a box: slabs outside of it aren't touched. (Filters aren't pushed: Spark 4.1
keeps a pushed filter with the source, where the next query of the same frame meets it.)
Compressed files have no ranges: one task reads such a file as a stream, a slab at a time.

``write_images`` is the way back. Voxels go to the task of their slab; each slab is written
aside under the name of its attempt, and the commit names those of the attempts that count;
abort deletes what a failed job wrote. Then one task an image copies its slabs behind one header
into a file aside and renames it, so a reader sees a whole file or none. Nothing but names goes
through the driver, and no task holds more than a slab.

Paths are what pyarrow's file systems open: local and mounted folders, hdfs, s3, gs.
"""

from __future__ import annotations

import gzip
import json
import re
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..model import META, Geometry
from .files import base_name
from .nifti import BY_NAME, CODES, geometry, header_bytes, read_header

#: Bytes of pixels of one partition, and voxels of one batch that it gives.
SLICE_BYTES, BATCH = 32 << 20, 1 << 16
#: Level of compressed files: 9 takes ten times as long for 2 % less of such pixels, in the one task of an image.
GZIP = 6
#: Headers that one task reads.
HEADERS = 256
HEADER_BYTES = 544

VOXELS = "img_id string, x int, y int, z int, t int, v double"
SERIES = "img_id string, x int, y int, z int, ts array<double>"


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9+.-]+:", path) else f"file://{path}")


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the file, of all files right below a folder, or of those a last part with ``*`` names."""
    files, base = open_path(path)
    prefix = path[: len(path) - len(base)] if path.endswith(base) else ""
    head, _, tail = base.rpartition("/")
    if "*" in tail:
        like = re.compile(".*".join(map(re.escape, tail.split("*"))) + r"\Z")
        found = [f for f in files.get_file_info(fs.FileSelector(head)) if like.match(f.base_name)]
    else:
        info = files.get_file_info(base)
        found = files.get_file_info(fs.FileSelector(base)) if info.type == fs.FileType.Directory else [info]
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
    found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((prefix + f.path, f.size) for f in found)


def _head(path: str) -> dict:
    files, base = open_path(path)
    with files.open_input_stream(base, compression=None) as file:
        start = file.read(HEADER_BYTES)
        if start[:2] == b"\x1f\x8b":
            more = zlib.decompressobj(31)
            data = more.decompress(start)
            while len(data) < HEADER_BYTES and (part := file.read(4096)):
                data += more.decompress(part)
            return read_header(data) | {"packed": True}
    return read_header(start) | {"packed": False}


@dataclass
class Slab(InputPartition):
    """Voxels lo to hi (x fastest, then y, then z) of one file, with all their further dimensions."""

    path: str
    header: dict
    lo: int
    hi: int


@dataclass
class Heads(InputPartition):
    paths: list[str]


def _shape(geo: Geometry) -> tuple[tuple[int, int, int], tuple[int, ...]]:
    return (*geo.dims[:3], 1, 1, 1)[:3], tuple(geo.dims[3:])


def _tail_order(tail: tuple[int, ...]) -> np.ndarray:
    """Place in the file of each entry of a series, the last dimension fastest in a series."""
    return np.arange(int(np.prod(tail))).reshape(tail, order="F").ravel() if tail else np.zeros(1, np.int64)


class _Ranges:
    """read(at, n) of an open file; a compressed one is read as a stream, forward only."""

    def __init__(self, path: str, packed: bool):
        files, base = open_path(path)
        self.packed, self.at = packed, 0
        self.file = gzip.GzipFile(fileobj=files.open_input_file(base)) if packed else files.open_input_file(base)

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(n)
        if len(data) != n:
            raise EOFError(f"{n} bytes of pixels expected, {len(data)} found")
        return data


class ImageReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.schema, self.form = options["path"], schema, options.get("form", "voxels")
        self.slice_bytes, self.scaled = int(options.get("slicebytes", SLICE_BYTES)), options.get("scaled", "false").lower() == "true"
        self.bounds = {a: [int(v) for v in options[a].split(":")] for a in "xyz" if a in options}

    def partitions(self) -> list[InputPartition]:
        paths = [p for p, _ in list_files(self.path)]
        if self.form == "header":
            return [Heads(paths[k : k + HEADERS]) for k in range(0, len(paths), HEADERS)] or [Heads([])]
        with ThreadPoolExecutor(32) as pool:
            heads = list(pool.map(_head, paths))
        out: list[InputPartition] = []
        for path, header in zip(paths, heads, strict=True):
            geo = geometry(header)
            space, tail = _shape(geo)
            lo, hi = self._span(space)
            size = np.dtype(CODES[header["datatype"]][1]).itemsize * int(np.prod(tail, initial=1))
            step = hi - lo if header["packed"] else max(1, self.slice_bytes // size)
            out += [Slab(path, header, a, min(a + step, hi)) for a in range(lo, hi, step or 1)]
        return out or [Heads([])]

    def _span(self, space: tuple[int, int, int]) -> tuple[int, int]:
        """First and last voxel + 1 between which all voxels within the bounds lie."""
        nx, ny, nz = space
        spans = [self.bounds.get(a, (0, n - 1)) for a, n in zip("xyz", space, strict=True)]
        low, high = [max(0, a) for a, _ in spans], [min(n - 1, b) for (_, b), n in zip(spans, space, strict=True)]
        if any(a > b for a, b in zip(low, high, strict=True)):
            return 0, 0
        return low[0] + nx * (low[1] + ny * low[2]), high[0] + nx * (high[1] + ny * high[2]) + 1

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, Heads):
            if partition.paths:
                rows = [dict(zip(META.names, geometry(_head(p)).row(base_name(p)), strict=True)) for p in partition.paths]
                kind = pa.schema([("img_id", pa.string()), ("ndim", pa.int32()), ("dims", pa.list_(pa.int32())), ("ptype", pa.string()), ("spacing", pa.list_(pa.float64())), ("origin", pa.list_(pa.float64())), ("direction", pa.list_(pa.list_(pa.float64()))), ("units", pa.list_(pa.string())), ("slice_order", pa.string()), ("slice_duration", pa.float64())])
                yield pa.RecordBatch.from_pylist(rows, kind).select(self.schema.names)
            return
        header = partition.header
        geo = geometry(header)
        (nx, ny, _), tail = _shape(geo)
        kind, names = CODES[header["datatype"]][1], self.schema.names
        order, n_space = _tail_order(tail), int(np.prod(_shape(geo)[0]))
        item, channels = np.dtype(kind).itemsize, int(kind[1]) if kind.startswith("V") else 0
        first = int(header["vox_offset"]) or (352 if header["version"] == 1 else 544)
        values = np.dtype(header["order"] + kind) if not channels else np.dtype((np.uint8, channels))
        slope, inter = header["scl_slope"], header["scl_inter"]
        file = _Ranges(partition.path, header["packed"])
        step = max(1, min(BATCH, self.slice_bytes // (item * len(order)))) if self.form == "series" else BATCH
        wants = not {"v", "ts"}.isdisjoint(names)

        def segment(t: int, lo: int, hi: int) -> np.ndarray:
            a = np.frombuffer(file.read(first + (t * n_space + lo) * item, (hi - lo) * item), values)
            a = a.real if np.iscomplexobj(a) else a
            a = a.astype(float)
            return a * slope + inter if self.scaled and slope and np.isfinite(slope) else a

        def batch(lo: int, hi: int, more: dict[str, pa.Array]) -> pa.RecordBatch:
            at = np.arange(lo, hi)
            inside = np.logical_and.reduce([np.ones(hi - lo, bool), *[(k >= self.bounds[a][0]) & (k <= self.bounds[a][1]) for a, k in (("x", at % nx), ("y", at // nx % ny), ("z", at // (nx * ny))) if a in self.bounds]])
            made = {"img_id": lambda: pa.array([base_name(partition.path)] * (hi - lo)), "x": lambda: at % nx, "y": lambda: at // nx % ny, "z": lambda: at // (nx * ny)}
            columns = [more[c] if c in more else made[c]() for c in names]
            out = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)) for c in columns], names)
            return out if inside.all() else out.filter(pa.array(inside))

        if self.form == "series":
            if header["packed"]:  # a stream can't go back for the next time: one pass, all of it
                whole = np.stack([segment(t, partition.lo, partition.hi) for t in range(len(order))]) if wants else None
            for lo in range(partition.lo, partition.hi, step):
                hi, more = min(lo + step, partition.hi), {}
                if wants:
                    a = whole[:, lo - partition.lo : hi - partition.lo] if header["packed"] else np.stack([segment(t, lo, hi) for t in range(len(order))])
                    a = np.moveaxis(a[order], 0, 1)  # voxel, time and then channel
                    flat = np.ascontiguousarray(a).reshape(hi - lo, -1)
                    more = {"ts": pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))}
                yield batch(lo, hi, more)
            return
        place = np.argsort(order)
        for t in range(len(order)):
            for lo in range(partition.lo, partition.hi, step):
                hi = min(lo + step, partition.hi)
                a = segment(t, lo, hi).reshape(hi - lo, -1) if wants else np.zeros((hi - lo, channels or 1))
                for c in range(a.shape[1]):
                    told = np.full(hi - lo, place[t] * a.shape[1] + c, np.int32)
                    yield batch(lo, hi, {"t": pa.array(told), "v": pa.array(np.ascontiguousarray(a[:, c]))})


# ---- writing -----------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class SlabWriter(DataSourceArrowWriter):
    """Rows (img_id, slab, lo, n, x, y, z, ts), all of a slab one behind the other, to one file a slab.

    A slab's file holds its n voxels from the flat place lo on, one after the other for each
    further place; voxels without a row are 0.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.images = {k: (tuple(shape), kind, tuple(tail)) for k, (shape, kind, tail) in json.loads(options["images"]).items()}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        files, base = open_path(self.path)
        attempt, done, now, slab = TaskContext.get().taskAttemptId(), [], None, None

        def close() -> None:
            if slab is not None:
                name = f"{now[0]}/{now[1]:08d}.{attempt}"
                files.create_dir(f"{base}/{now[0]}", recursive=True)
                with files.open_output_stream(f"{base}/{name}") as out:
                    out.write(slab.tobytes())
                done.append(name)

        for batch in iterator:
            ids, slabs = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((slabs[1:] != slabs[:-1]) | np.array([a != b for a, b in zip(ids[1:], ids, strict=False)], bool)) + 1).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                key = (ids[a], int(slabs[a]))
                (nx, ny, _), kind, tail = self.images[key[0]]
                order = _tail_order(tail)
                rows = batch.slice(a, b - a)
                lo, n = rows.column(2)[0].as_py(), rows.column(3)[0].as_py()
                if key != now:
                    close()
                    now, slab = key, np.zeros((len(order), n), np.dtype(kind))
                x, y, z = (rows.column(k).to_numpy() for k in (4, 5, 6))
                at = x.astype(np.int64) + nx * (y.astype(np.int64) + ny * z.astype(np.int64)) - lo
                series = rows.column(7)
                flat = series.flatten().to_numpy(zero_copy_only=False).reshape(b - a, len(order), *slab.shape[2:])
                slab[order[:, None], at] = np.moveaxis(flat, 0, 1).astype(slab.dtype)
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        """The slabs that count, by name; what attempts that don't count left is deleted."""
        files, base = open_path(self.path)
        good = {name for m in messages if m for name in m.names}
        for info in files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
            if info.type == fs.FileType.File and info.path[len(base) + 1 :] not in good:
                files.delete_file(info.path)
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/_slabs") as out:
            out.write("\n".join(sorted(good)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, base = open_path(self.path)
        if files.get_file_info(base).type == fs.FileType.Directory:
            files.delete_dir(base)


class NdImageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ndimage"

    def schema(self) -> str | T.StructType:
        form = self.options.get("form", "voxels")
        return {"voxels": VOXELS, "series": SERIES, "header": META}[form]

    def reader(self, schema: T.StructType) -> ImageReader:
        return ImageReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> SlabWriter:
        return SlabWriter(dict(self.options))


def images(spark: SparkSession, path: str, form: str = "voxels", columns: str | None = None, **options) -> DataFrame:
    """Read through the data source; columns (a schema of some of the form's) keeps others from being made."""
    spark.dataSource.register(NdImageSource)
    reader = spark.read.format("ndimage").option("form", form)
    if columns:
        reader = reader.schema(columns)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)


def write_images(series: DataFrame, geometries: dict[str, Geometry], folder: str, version: int = 1, suffix: str = ".nii", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write (img_id, x, y, z, ts) as one file an image below folder; rows (uri, bytes), a row an image.

    geometries: name → geometry of every image to write, an image without rows included. Voxels
    outside their image are an error; of a voxel given twice one row counts.
    """
    spark = series.sparkSession
    spark.dataSource.register(NdImageSource)
    folder = folder.rstrip("/")
    folder = folder if re.match(r"^[a-z0-9+.-]+:", folder) else f"file://{folder}"
    aside, told, plans = f"{folder}/_slabs-{zlib.crc32(repr(sorted(geometries)).encode()):08x}", {}, []
    for name, geo in geometries.items():
        space, tail = _shape(geo)
        kind, times = CODES[BY_NAME[geo.ptype]][1], int(np.prod(tail, initial=1))
        kind = f"({kind[1]},)u1" if kind.startswith("V") else f"<{kind}"
        step = max(1, slice_bytes // (np.dtype(kind).itemsize * times))
        told[name] = (space, kind, tail)
        plans.append((name, *space, step, times, np.dtype(kind).itemsize, header_bytes(geo, version), f"{folder}/{name.removesuffix('.gz').removesuffix('.nii')}{suffix}"))
    plan = spark.createDataFrame(plans, "img_id string, nx int, ny int, nz int, step long, times int, item int, head binary, uri string")
    c = F.col
    at = c("x") + c("nx") * (c("y") + c("ny") * c("z").cast("long"))
    inside = c("x").between(0, c("nx") - 1) & c("y").between(0, c("ny") - 1) & c("z").between(0, c("nz") - 1)
    at = F.when(inside, at).otherwise(F.raise_error(F.concat(F.lit("a voxel lies outside of image "), c("img_id"))))
    rows = series.select("img_id", *[c(a).cast("int").alias(a) for a in "xyz"], c("ts").cast("array<double>").alias("ts"))
    rows = rows.join(F.broadcast(plan.drop("head", "uri")), "img_id").withColumn("slab", F.floor(at / c("step")).cast("long"))
    lo = c("slab") * c("step")
    rows = rows.select("img_id", "slab", lo.alias("lo"), F.least(c("step"), c("nx").cast("long") * c("ny") * c("nz") - lo).alias("n"), "x", "y", "z", "ts")
    rows = rows.repartition("img_id", "slab").sortWithinPartitions("img_id", "slab")
    try:
        rows.write.format("ndimage").mode("append").option("images", json.dumps(told)).save(aside)
        return _join_all(spark, plan, aside, len(plans))
    finally:  # what a failed job or a lost attempt wrote aside goes too
        files, base = open_path(aside)
        if files.get_file_info(base).type == fs.FileType.Directory:
            files.delete_dir(base)
        files, base = open_path(folder)
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if re.search(r"\.nii(\.gz)?\.\d+\Z", info.path):
                files.delete_file(info.path)


def _join_all(spark: SparkSession, plan: DataFrame, aside: str, n: int) -> DataFrame:

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_join(row, aside)], pa.schema([("uri", pa.string()), ("bytes", pa.int64())]))

    done = plan.repartition(max(1, min(n, 1024)), "img_id").mapInArrow(join, "uri string, bytes long").collect()  # a row an image
    return spark.createDataFrame(done, "uri string, bytes long")


def _join(row: dict, aside: str) -> dict:
    """One image's slabs behind its header, streamed into a file that then takes its name."""
    from pyspark import TaskContext

    files, base = open_path(aside)
    with files.open_input_stream(f"{base}/_slabs", compression=None) as file:
        names = [n for n in file.read().decode().splitlines() if n.rpartition("/")[0] == row["img_id"]]
    slabs = {int(n.rpartition("/")[2].split(".")[0]): f"{base}/{n}" for n in names}
    _, path = open_path(row["uri"])
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part, voxels = f"{path}.{TaskContext.get().taskAttemptId()}", row["nx"] * row["ny"] * row["nz"]
    with files.open_output_stream(part, compression=None) as raw:
        out = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=GZIP, mtime=0) if row["uri"].endswith(".gz") else raw
        out.write(row["head"])
        for t in range(row["times"]):
            for k in range(-(-voxels // row["step"])):
                n = min(row["step"], voxels - k * row["step"])
                if k in slabs:
                    with files.open_input_file(slabs[k]) as file:
                        file.seek(t * n * row["item"])
                        out.write(file.read(n * row["item"]))
                else:
                    out.write(bytes(n * row["item"]))
        if out is not raw:
            out.close()
    files.move(part, path)
    return {"uri": row["uri"], "bytes": files.get_file_info(path).size}


def join_files(plan: DataFrame, aside: str, n: int) -> DataFrame:
    """(uri, bytes): for each row (img_id, head, tail, uri) the files below aside/img_id=… in order of their names, as one file between head and tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([_stream(row, aside)], pa.schema([("uri", pa.string()), ("bytes", pa.int64())]))

    done = plan.repartition(max(1, min(n, 1024)), "img_id").mapInArrow(run, "uri string, bytes long").collect()  # a row an image
    return plan.sparkSession.createDataFrame(done, "uri string, bytes long")


def _stream(row: dict, aside: str) -> dict:
    from urllib.parse import quote

    from pyspark import TaskContext

    files, base = open_path(f"{aside}/img_id={quote(row['img_id'], safe=' ._-')}")
    parts = [f for f in files.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("part-")]
    _, path = open_path(row["uri"])
    files.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(part, compression=None) as out:
        out.write(row["head"])
        for found in sorted(parts, key=lambda f: f.base_name):
            with files.open_input_stream(found.path, compression=None) as file:
                while data := file.read(1 << 20):
                    out.write(data)
        out.write(row["tail"])
    files.move(part, path)
    return {"uri": row["uri"], "bytes": files.get_file_info(path).size}
