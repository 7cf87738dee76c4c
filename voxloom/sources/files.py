"""Files as rows: reading through Spark's own readers, writing through pyarrow's file systems.

Reading uses ``binaryFile`` and ``text``, so any store that Spark opens works, .gz included.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content)."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def expand(path: str, content: bytes) -> bytes:
    return gzip.decompress(content) if path.endswith(".gz") or content[:2] == b"\x1f\x8b" else content


def base_name(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".gz")


def lines(spark: SparkSession, path: str, keep: Column | None = None) -> DataFrame:
    """(value, nth): lines (those to keep) with their number from 0, over the file or over a folder's files in order of their names.

    A task numbers the lines of its ranges of files; the ranges' line counts, one row each, are
    summed up in order and broadcast. So a file of any size is numbered by many tasks.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"))
    rows = rows if keep is None else rows.filter(keep)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            at = []
            for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n = n + 1 if key == last else 0
                last = key
                at.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], ["value", "_path", "_start", "_at"])

    numbered = rows.mapInArrow(number, "value string, _path string, _start long, _at long")
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a range of a file
    counts = rows.groupBy("_path", "_start").agg(F.count("*").alias("_n"))
    base = counts.select("_path", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return numbered.join(F.broadcast(base), ["_path", "_start"]).select("value", (F.col("_base") + F.col("_at")).alias("nth"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save(contents: DataFrame, folder: str) -> DataFrame:
    """Write (name, content) rows as files below the folder; one row a file written. .gz names are compressed.

    A file is written aside and renamed, so a repeated task replaces it whole.
    """
    folder = folder if ":" in folder.split("/")[0] else f"file://{folder}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        for batch in batches:
            done = []
            for name, content in zip(batch["name"], batch["content"], strict=True):
                files, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                files.create_dir(path.rpartition("/")[0], recursive=True)
                aside = f"{path}.{TaskContext.get().taskAttemptId()}"
                data = gzip.compress(content, mtime=0) if name.endswith(".gz") else content
                with files.open_output_stream(aside, compression=None) as out:
                    out.write(data)
                files.move(aside, path)
                done.append((f"{folder}/{name}", len(data)))
            yield pd.DataFrame(done, columns=["uri", "bytes"])

    return contents.select("name", "content").mapInPandas(run, "uri string, bytes long")
