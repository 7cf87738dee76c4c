"""Best-fit packing (operator 10): minimum bin slack over the histogram of lengths.

Only lengths decide how pieces combine, so the packing is solved on the histogram of
piece lengths (at most ``capacity`` numbers, whatever the corpus): take the longest
length left, find by a bitset subset-sum over the lengths available the combination
that fills the bin fullest, remove it as many times as the counts allow, go on. Pieces
then find their place by their rank among the pieces of equal length. Ranks come from
running counts by task, kept in a stored table, so a length that a third of all pieces
share is no hot group, and nothing unbounded meets in one task or on the driver.

Defined results: a null or empty text is the end id alone; a text longer than the
capacity is cut into full pieces with the shorter remainder first; every row, repeated
or not, is packed; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranges, stored, text_chunks, text_column
from .tokens import TOGETHER, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of every whole text, with their number among the task's pieces of equal length.

    (task, length, nth) names a piece; the table has to be stored before it is used.
    with_ids adds the ids themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = text_column(batch.column(1))
            for lo, hi, _, _ in text_chunks(texts, TOGETHER):
                flat, first = encoder(tokenizer).encode(texts[lo:hi])
                flat = np.insert(flat, first[1:], np.uint32(end_id)).astype("<u4")
                n = np.diff(first) + 1
                first = np.cumsum(n) - n
                pieces = -(-n // capacity)
                piece = ranges(pieces)
                rest = np.repeat(n - (pieces - 1) * capacity, pieces)  # the first piece takes what full ones leave
                start = np.where(piece == 0, 0, rest + (piece - 1) * capacity)
                length = np.where(piece == 0, rest, capacity)
                at = (np.repeat(first, pieces) + start) * 4
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                counts = np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(length), np.int64)
                nth[order] = seen[length[order]] + ranges(counts[counts > 0])
                seen += counts
                rows = pa.array(np.repeat(np.arange(hi - lo), pieces))
                out = [batch.column(0)[lo:hi].take(rows), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), task), pa.int32()), pa.array(nth)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    return rows.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def fullest(available: list[tuple[int, int]], room: int) -> dict[int, int]:
    """The combination of (length, count) that fills room fullest; longer lengths are preferred.

    Bitset subset sum: bit s of a row says that the sum s is reachable with the items so
    far. Counts are split by powers of two, so every count up to the available is tried.
    """
    items, rows, reach, mask = [], [], 1, (1 << (room + 1)) - 1
    for length, count in sorted(available):
        most, part = min(count, room // length), 1
        while most > 0:
            take = min(part, most)
            items.append((length, take))
            rows.append(reach)
            reach |= reach << (length * take) & mask
            most, part = most - take, part * 2
    best, out = reach.bit_length() - 1, {}
    for (length, take), before in zip(reversed(items), reversed(rows), strict=True):
        size = length * take
        if best >= size and before >> (best - size) & 1:
            out[length] = out.get(length, 0) + take
            best -= size
        if not best:
            break
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin with their numbers, how many such bins), until no length is left.

    At most one pattern for each length and power of two of its count: each round uses
    one length up, or halves what a pattern can take.
    """
    left, out = {k: n for k, n in counts.items() if n}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        room = capacity - longest
        pattern = fullest([(k, n) for k, n in rest.items() if n and k <= room], room) if room else {}
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to stored pieces."""
    spark = pieces.sparkSession
    by_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows

    rows, sequence, rank = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in plan_bins(counts, capacity):
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            rows.append((length, rank[length], rank[length] + copies * times, copies, sequence, offset))
            rank[length] += copies * times
            offset += length * copies
        sequence += times
    kind = "at_length long, low long, high long, copies long, first_sequence long, first_offset long"
    plan = F.broadcast(spark.createDataFrame(rows, kind))  # as long as the plan: bounded by the capacity, not by the input
    ranked = pieces.join(base, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    at = F.col("rank") - F.col("low")
    return ranked.join(plan, (F.col("length") == F.col("at_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select(
        *[c for c in pieces.columns if c not in ("task", "nth")],
        (F.col("first_sequence") + F.floor(at / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + at % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(stored(cut_pieces(docs, tokenizer, end_id, capacity, with_ids)), capacity)
