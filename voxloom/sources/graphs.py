"""Graph files: edges as CSV (list or dense) and a compact binary form; block matrices."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import base_name, binary, expand

EDGES = "graph string, src long, dst long, w double"

#: Fixed values of the binary form: magic of a list and of a dense file, size of the header,
#: codes of the number types.
LIST_MAGIC, DENSE_MAGIC, HEADER = b"NPLGLIST", b"NPLGDMAT", 512
TYPES = {1: "<u1", 33: "<i1", 2: "<u2", 34: "<i2", 4: "<u4", 36: "<i4", 8: "<u8", 40: "<i8", 132: "<f4", 136: "<f8"}
_CODE = {v: k for k, v in TYPES.items()}


def encode_binary(edges: np.ndarray, names: list[str], dense: bool = False) -> bytes:
    """edges: rows of (src, dst, w). Header, node names as length and text, then list or matrix (doubles)."""
    n, raw = len(names), [x.encode() for x in names]
    meta = b"".join(struct.pack("<q", len(x)) + x for x in raw)
    rec = np.zeros(len(edges), np.dtype([("s", "<u8"), ("d", "<u8"), ("w", "<f8")]))
    if len(edges):
        rec["s"], rec["d"], rec["w"] = edges.T
    head = (DENSE_MAGIC if dense else LIST_MAGIC) + struct.pack("<qqqq", n, HEADER + len(meta), HEADER, 8 if dense else rec.itemsize)
    head += struct.pack("<i", _CODE["<f8"]) if dense else struct.pack("<iiq", _CODE["<u8"], _CODE["<f8"], len(rec))
    if dense:
        m = np.zeros((n, n))
        m[rec["s"].astype(int), rec["d"].astype(int)] = rec["w"]
        return head.ljust(HEADER, b"\0") + meta + m.astype("<f8").tobytes()
    return head.ljust(HEADER, b"\0") + meta + rec.tobytes()


def decode_binary(data: bytes) -> tuple[list[str], np.ndarray]:
    """Names of the nodes and rows of (src, dst, w)."""
    magic, (n, start, at, _) = data[:8], struct.unpack_from("<4q", data, 8)
    if magic not in (LIST_MAGIC, DENSE_MAGIC):
        raise ValueError("not a graph file")
    names = []
    for _ in range(n):
        (length,) = struct.unpack_from("<q", data, at)
        names.append(data[at + 8 : at + 8 + length].decode())
        at += 8 + length
    if magic == DENSE_MAGIC:
        (code,) = struct.unpack_from("<i", data, 40)
        m = np.frombuffer(data, TYPES[code], n * n, start).reshape(n, n).astype(float)
        s, d = np.nonzero(m)
        return names, np.column_stack([s, d, m[s, d]])
    index, code, count = struct.unpack_from("<iiq", data, 40)
    rec = np.frombuffer(data, np.dtype([("s", TYPES[index]), ("d", TYPES[index]), ("w", TYPES[code])]), count, start)
    return names, np.column_stack([rec["s"].astype(float), rec["d"].astype(float), rec["w"].astype(float)])


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, c in zip(batch["path"], batch["content"], strict=True):
                _, e = decode_binary(expand(p, c))
                yield pd.DataFrame({"graph": base_name(p), "src": e[:, 0].astype(np.int64), "dst": e[:, 1].astype(np.int64), "w": e[:, 2]})

    return binary(spark, path).mapInPandas(run, EDGES)


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.filter("w <> 0").select("src", "dst", "w").write.mode("overwrite").csv(path)


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("src long, dst long, w double").csv(path)


def dense_table(edges: DataFrame, n: int) -> DataFrame:
    """One row a source node, a column for each target: the dense CSV form of a small graph."""
    return edges.groupBy("src").pivot("dst", list(range(n))).agg(F.sum("w")).na.fill(0.0)


def write_blocks(matrix: DataFrame, path: str, block_columns: int = 1024) -> None:
    """(col, values) columns of a tall matrix as Parquet, partitioned by column block."""
    matrix.withColumn("col_block", F.floor(F.col("col") / block_columns).cast("int")).write.mode("overwrite").partitionBy("col_block").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("col bigint, values array<double>, col_block int").parquet(path)


def check_blocks(matrix: DataFrame, rows: int) -> DataFrame:
    """Column blocks whose columns haven't the given number of rows, or are there twice."""
    return matrix.groupBy("col_block").agg(F.count("*").alias("n"), F.countDistinct("col").alias("columns"), F.min(F.size("values")).alias("least"), F.max(F.size("values")).alias("most")).filter((F.col("n") != F.col("columns")) | (F.col("least") != rows) | (F.col("most") != rows))


def decode_matrix_map(data: bytes) -> np.ndarray:
    """A binary map: number of rows and columns, then doubles by column."""
    r, c = struct.unpack_from("<qq", data, 0)
    if len(data) != 16 + 8 * r * c:
        raise ValueError("size and shape of the map differ")
    return np.frombuffer(data, "<f8", r * c, 16).reshape(r, c, order="F")


def encode_matrix_map(m: np.ndarray) -> bytes:
    return struct.pack("<qq", *m.shape) + np.asarray(m, "<f8").tobytes(order="F")
