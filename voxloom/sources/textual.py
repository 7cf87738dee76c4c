"""JSON and delimited images, numeric tables, and their writers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_row, parse_table, to_integer, to_number
from ..model import Geometry
from .files import base_name, expand, lines

#: Keys of a JSON image.
JSON_KEYS = ("version", "comment", "type", "size", "spacing", "origin", "direction", "values")


def json_geometry(doc: dict) -> Geometry:
    unknown = set(doc) - set(JSON_KEYS)
    if unknown:
        raise ValueError(f"unknown keys {sorted(unknown)}")
    dims = tuple(int(x) for x in doc["size"])
    n = len(dims)
    direction = np.array(doc["direction"], float).reshape(n, n) if doc.get("direction") else None
    return Geometry(dims, doc.get("spacing"), doc.get("origin"), direction, doc.get("type", "FLOAT32"))


#: Bytes of text that a task parses, of a JSON file's head and tail that are looked through for its keys.
RANGE_BYTES, EDGE_BYTES = 32 << 20, 1 << 16
#: Bytes that numbers are made of, NaN and Infinity included.
_NUMBER = np.zeros(256, bool)
_NUMBER[[ord(c) for c in "0123456789+-.eEaINfinty"]] = True


def _json_parts(path: str) -> tuple[dict, int, int]:
    """The keys of a JSON image but its values, and where the text of the values begins and ends."""
    from .ndimage import open_path

    files, base = open_path(path)
    size = files.get_file_info(base).size
    with files.open_input_file(base) as file:
        head = file.read(min(EDGE_BYTES, size))
        file.seek(max(0, size - EDGE_BYTES))
        tail = file.read()
    found = re.search(rb'"values"\s*:\s*', head)
    if not found:
        raise ValueError(f"no values among the first {EDGE_BYTES} bytes of {path}")
    low = found.end()
    skip = max(0, low - max(0, size - EDGE_BYTES))  # of the tail, what lies before the values
    named = re.compile(rb',\s*"(?:' + b"|".join(k.encode() for k in JSON_KEYS) + rb')"\s*:')
    after = named.search(tail, skip)
    high = size - len(tail) + (after.start() if after else tail.rindex(b"}"))
    doc = json.loads(head[: found.start()] + b'"values": 0' + tail[high - (size - len(tail)) :])
    return {k: v for k, v in doc.items() if k != "values"}, low, high


def read_json_images(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(img_id, x, y, z, t, v) of JSON images, the last dimension fastest in ``values``.

    A plain file is parsed by ranges: a first pass counts the numbers that begin in each, so that the
    second knows the place of each range's first number. A compressed file is parsed by one task.
    """
    from .ndimage import list_files

    kind = "img_id string, x int, y int, z int, t int, v double"

    def voxels(name: str, dims: tuple[int, ...], first: int, values: np.ndarray) -> pa.RecordBatch:  # Arrow keeps NaN apart from null
        index = np.unravel_index(np.arange(first, first + len(values)), dims)
        zero = np.zeros(len(values), np.int32)
        return pa.RecordBatch.from_arrays([pa.array([name] * len(values)), *[pa.array(index[k].astype(np.int32) if k < len(dims) else zero) for k in range(4)], pa.array(values)], ["img_id", *"xyzt", "v"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc = json.loads(expand(p, content))
                yield voxels(base_name(p), json_geometry(doc).dims, 0, np.array(doc["values"], float).ravel())

    def text(row: dict) -> tuple[bytes, np.ndarray]:
        """The range's text from its first number that begins there to the end of its last, and where numbers begin."""
        from .ndimage import open_path

        files, base = open_path(row["path"])
        with files.open_input_file(base) as file:
            file.seek(row["lo"] - 1)
            data = file.read(row["hi"] - row["lo"] + 1)
            while len(data) and _NUMBER[data[-1]] and file.tell() < row["end"]:
                data += file.read(min(32, row["end"] - file.tell()))
        inside = _NUMBER[np.frombuffer(data, np.uint8)]
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        return data, begins[begins <= row["hi"] - row["lo"]]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["path", "lo"]].assign(n=[len(text(row)[1]) for row in batch.to_dict("records")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, begins = text(row)
                if not len(begins):
                    continue
                end = int(begins[-1])
                while end < len(data) and _NUMBER[data[end]]:
                    end += 1
                values = np.array(data[int(begins[0]) : end].translate(_BLANKED).split(), float)
                for lo in range(0, len(values), 1 << 16):
                    yield voxels(base_name(row["path"]), tuple(row["dims"]), int(row["first"]) + lo, values[lo : lo + (1 << 16)])

    paths = [p for p, _ in list_files(path)]
    packed, ranges = [p for p in paths if p.endswith(".gz")], []
    for p in paths:
        if not p.endswith(".gz"):
            doc, low, high = _json_parts(p)
            ranges += [(p, lo, min(lo + range_bytes, high), high, list(json_geometry(doc).dims)) for lo in range(low, high, range_bytes)]
    out = []
    if packed:
        out.append(spark.read.format("binaryFile").load(packed).select("path", "content").mapInArrow(whole, kind))
    if ranges:
        rows = spark.createDataFrame(ranges, "path string, lo long, hi long, end long, dims array<int>").repartition(len(ranges), "path", "lo")
        before = Window.partitionBy("path").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        firsts = rows.mapInPandas(count, "path string, lo long, n long").select("path", "lo", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
        placed = spark.createDataFrame(rows.join(firsts, ["path", "lo"]).collect(), "path string, lo long, hi long, end long, dims array<int>, first long")
        out.append(placed.repartition(len(ranges), "path", "lo").mapInArrow(parse, kind))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], kind)


#: Brackets and commas become blanks.
_BLANKED = bytes.maketrans(b"[],", b"   ")


def write_json_images(voxels: DataFrame, geometries: dict[str, Geometry], folder: str, oriented: bool = True) -> DataFrame:
    """Write (img_id, x, y, z, t, v) as one JSON file an image, of any size; rows (uri, bytes).

    Lines along the last dimension are written aside in order by many tasks; one task an image streams
    them behind the keys into its file.
    """
    from .ndimage import join_files, open_path

    spark, plans = voxels.sparkSession, []
    folder = folder.rstrip("/") if re.match(r"^[a-z0-9+.-]+:", folder) else f"file://{folder.rstrip('/')}"
    for name, geo in geometries.items():
        doc = {"version": 1, "type": geo.ptype, "size": [int(n) for n in geo.dims]}
        if oriented:
            doc |= {"spacing": geo.spacing.tolist(), "origin": geo.origin.tolist(), "direction": geo.direction.ravel().tolist()}
        plans.append((name, [int(n) for n in geo.dims], json.dumps(doc)[:-1] + ', "values": ', f"{folder}/{name.removesuffix('.json')}.json"))
    plan = spark.createDataFrame(plans, "img_id string, dims array<int>, head string, uri string")
    known = F.broadcast(plan.select("img_id", "dims"))
    c, n = F.col, F.size("dims")
    line = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), F.lit(0).cast("long"), lambda a, k: F.when(k < n - 1, a * F.get("dims", k) + F.get(F.array(*[c(x).cast("long") for x in "xyzt"]), k)).otherwise(a))
    rows = voxels.join(known, "img_id").select("img_id", line.alias("line"), F.get(F.array(*[c(x) for x in "xyzt"]), n - 1).alias("k"), c("v").cast("double").alias("v"))
    held = rows.groupBy("img_id", "line").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    lines_of = F.aggregate(F.slice("dims", 1, n - 1), F.lit(1).cast("long"), lambda a, d: a * d)
    every = known.select("img_id", "dims", F.explode(F.sequence(F.lit(0).cast("long"), lines_of - 1)).alias("line"))
    told = F.array_join(F.transform(F.sequence(F.lit(0), F.element_at("dims", -1) - 1), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)).cast("string")), ", ")
    # how many of the outer dimensions begin, or end, with this line
    strides = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda k: F.aggregate(F.slice("dims", k, F.greatest(n - k, F.lit(0))), F.lit(1).cast("long"), lambda a, d: a * d))
    begins = F.when(n > 1, F.size(F.filter(strides, lambda s: c("line") % s == 0))).otherwise(0)
    ends = F.when(n > 1, F.size(F.filter(strides, lambda s: (c("line") + 1) % s == 0))).otherwise(0)
    value = F.concat(F.repeat(F.lit("["), begins + 1), told, F.repeat(F.lit("]"), ends + 1), F.when(c("line") + 1 < lines_of, ",").otherwise(""))
    aside = f"{folder}/_lines"
    try:
        out = every.join(held, ["img_id", "line"], "left").select("img_id", "line", value.alias("value"))
        out = out.repartitionByRange(F.col("img_id"), F.col("line")).sortWithinPartitions("img_id", "line")
        out.select("value", "img_id").write.partitionBy("img_id").text(aside)
        return join_files(plan.select("img_id", c("head").cast("binary").alias("head"), F.lit("}").cast("binary").alias("tail"), "uri"), aside, len(plans))
    finally:
        files, base = open_path(aside)
        if files.get_file_info(base).type.name == "Directory":
            files.delete_dir(base)


def encode_json(voxels: DataFrame, geometries: dict[str, Geometry], oriented: bool = True) -> DataFrame:
    """(name, content): one JSON file an image."""

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        geo = geometries[key[0]]
        a = np.zeros(geo.dims)
        a[tuple(rows[c].to_numpy() for c in "xyzt"[: geo.ndim])] = rows["v"].to_numpy()
        doc = {"version": 1, "type": geo.ptype, "size": list(geo.dims)}
        if oriented:
            doc |= {"spacing": geo.spacing.tolist(), "origin": geo.origin.tolist(), "direction": geo.direction.ravel().tolist()}
        return pd.DataFrame({"name": [key[0].removesuffix(".json") + ".json"], "content": [json.dumps(doc | {"values": a.tolist()}).encode()]})

    return voxels.groupBy("img_id").applyInPandas(build, "name string, content binary")


def read_table(spark: SparkSession, path: str, delimiters: str | None = None, comment: str = "#") -> DataFrame:
    """(row, fields) of a delimited file, its delimiter found over the whole file if none is given; rows count lines with fields."""
    rows = parse_table(lines(spark, path, is_row(comment=comment)), delimiters, comment=comment)
    return rows.select(F.col("nth").alias("row"), "fields")


def read_numbers(spark: SparkSession, path: str, delimiters: str | None = None) -> DataFrame:
    """(row, values array<double>); text that isn't a number is 0."""
    return read_table(spark, path, delimiters).select("row", F.transform("fields", to_number).alias("values"))


def infer_type(table: DataFrame) -> str:
    """UINT32, INT32 or FLOAT32: the narrowest that holds every field (hexadecimal and octal count as whole)."""
    whole = F.forall("fields", lambda f: to_integer(f).isNotNull())
    low = F.array_min(F.transform("fields", lambda f: to_integer(f)))
    row = table.agg(F.min(whole.cast("int")), F.min(low)).first()
    return "FLOAT32" if not row[0] else "INT32" if row[1] is not None and row[1] < 0 else "UINT32"


def read_text_image(spark: SparkSession, path: str) -> DataFrame:
    """(x, y, v): lines are the first dimension, fields the second; of a folder the files follow one another by name."""
    table = read_table(spark, path)
    whole = infer_type(table) != "FLOAT32"
    return table.select(F.col("row").cast("int").alias("x"), "fields").select("x", F.posexplode("fields").alias("y", "f")).select("x", "y", (to_integer(F.col("f")).cast("double") if whole else to_number(F.col("f"))).alias("v"))


def csv_lines(voxels: DataFrame) -> DataFrame:
    """One text line for each x, values in order of the other axes, a comma after each."""
    rest = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "z", "t", "v"))), lambda s: F.concat(s["v"].cast("string"), F.lit(","))), "")
    return voxels.groupBy("img_id", "x").agg(rest.alias("value"))


def flatten_numbers(text: str) -> list[float]:
    """Numbers of nested brackets in order."""
    out: list[float] = []
    stack = [json.loads(text)]
    while stack:
        item = stack.pop()
        if isinstance(item, list):
            stack.extend(reversed(item))
        else:
            out.append(float(item))
    return out
