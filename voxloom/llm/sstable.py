"""Token-ID output (operator 6): sorted-string-table shards.

A shard is one file: data blocks, a block index, a Bloom filter, a footer.

* Data block: zstd frame over entries in key order. An entry is ``shared, suffix
  length, value length`` (unsigned LEB128), the key's suffix and the value; every
  ``RESTART`` entries the key is written whole, and the block ends with the places of
  those entries (u32 each) and their count (u32), so a reader can search by halves.
* Key: 8 bytes, big-endian, sign bit flipped (byte order is number order); a null
  identifier is the empty key and comes first.
* Value: one byte, the width of an id in bytes (2 or 4), then the ids, little-endian.
* Index: for each block u64 offset, u64 length, u16 key length, first key.
* Bloom filter: ``bits`` (u64), ``hashes`` (u32), then the bit array.
* Footer, 56 bytes: index offset and length, filter offset and length, number of
  entries, number of ids (u64 each), 8 bytes ``VXSST001``.

Shards are cut by ranges of (identifier, text hash), so ascending shards hold ascending
identifiers and even one identifier repeated over many rows spreads over shards. A
task writes under a temporary name and renames at the end: a task that runs again
after a lost executor replaces the file with the same bytes.

Defined results: a null text is empty (end id only); repeated identifiers are kept as
neighbouring entries; an empty table gives no shard and an empty result; extra
columns are left out.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import estimated_bytes, partitions, scratch, stored, text_chunks, text_column
from .tokens import TOGETHER, encoder

MAGIC = b"VXSST001"
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_HASHES = 1 << 18, 16, 10, 7
#: Bytes of documents (as Spark estimates them from the files) that one shard is made of at most.
SHARD_BYTES = 256 << 20
FOOTER = struct.Struct("<6Q8s")


def encode_key(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def decode_key(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return [(a + k * b) % bits for k in range(hashes)]


class Writer:
    """Writes entries given in key order; memory is one block plus index and keys' filter."""

    def __init__(self, out, compress):
        self.out, self.compress, self.at = out, compress, 0
        self.index: list[tuple[int, int, bytes]] = []
        self.keys = array("I")  # two hashes of each key, 8 bytes a document
        self.n_ids = 0
        self._reset()

    @property
    def n_keys(self) -> int:
        return len(self.keys) // 2

    def _reset(self) -> None:
        self.block, self.restarts, self.last, self.first, self.n = bytearray(), [], b"", None, 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.n % RESTART == 0:
            self.restarts.append(len(self.block))
            shared = 0
        else:
            shared = next((k for k, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        if self.first is None:
            self.first = key
        narrow = not len(ids) or int(ids.max()) < 1 << 16
        value = (b"\x02" + ids.astype("<u2").tobytes()) if narrow else (b"\x04" + ids.astype("<u4").tobytes())
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.n = key, self.n + 1
        self.keys.extend((zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1))
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            tail = struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            frame = self.compress(bytes(self.block) + tail)
            self.index.append((self.at, len(frame), self.first))
            self.out.write(frame)
            self.at += len(frame)
        self._reset()

    def close(self) -> None:
        self._flush()
        index = b"".join(struct.pack("<QQH", a, n, len(k)) + k for a, n, k in self.index)
        bits = max(64, BLOOM_BITS * self.n_keys)
        filled = np.zeros((bits + 7) // 8 * 8, bool)
        if self.keys:
            a, b = np.frombuffer(self.keys, np.uint32).reshape(-1, 2).T.astype(np.uint64)
            for k in range(BLOOM_HASHES):
                filled[((a + np.uint64(k) * b) % np.uint64(bits)).astype(np.int64)] = True
        bloom = struct.pack("<QI", bits, BLOOM_HASHES) + np.packbits(filled, bitorder="little").tobytes()
        self.out.write(index + bloom + FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.n_keys, self.n_ids, MAGIC))


@dataclass
class Shard:
    """An open shard: get() looks one key up, entries() runs over all of them in order."""

    file: pa.NativeFile

    def __post_init__(self):
        import zstandard

        self.expand = zstandard.ZstdDecompressor().decompress
        size = self.file.size()
        index_at, index_n, bloom_at, bloom_n, self.n_entries, self.n_ids, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        raw, at = self._read(index_at, index_n), 0
        self.blocks: list[tuple[int, int]] = []
        self.firsts: list[bytes] = []
        while at < len(raw):
            place, length, n = struct.unpack_from("<QQH", raw, at)
            at += 18
            self.blocks.append((place, length))
            self.firsts.append(raw[at : at + n])
            at += n
        bloom = self._read(bloom_at, bloom_n)
        (self.bits, self.hashes), self.bloom = struct.unpack_from("<QI", bloom), bloom[12:]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bits, self.hashes))

    @staticmethod
    def _entry(data: bytes, at: int, last: bytes) -> tuple[bytes, int, int, int]:
        shared, at = _read_varint(data, at)
        suffix, at = _read_varint(data, at)
        length, at = _read_varint(data, at)
        key = last[:shared] + data[at : at + suffix]
        return key, at + suffix, length, at + suffix + length

    @staticmethod
    def _ids(data: bytes, at: int, length: int) -> np.ndarray:
        return np.frombuffer(data, f"<u{data[at]}", (length - 1) // data[at], at + 1).astype(np.uint32)

    def _block(self, k: int) -> tuple[bytes, list[int], int]:
        data = self.expand(self._read(*self.blocks[k]))
        (n,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 * (n + 1)
        return data, list(struct.unpack_from(f"<{n}I", data, end)), end

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The id arrays under this identifier, in file order; none if it isn't there."""
        key, found = encode_key(doc_id), []
        if not self.may_hold(key):
            return found
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), bisect.bisect_right(self.firsts, key)):
            data, restarts, end = self._block(k)
            lo, hi = 0, len(restarts) - 1
            while lo < hi:  # the last restart whose key is smaller
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if self._entry(data, restarts[mid], b"")[0] < key else (lo, mid - 1)
            at, last = restarts[lo], b""
            while at < end:
                last, value, length, at = self._entry(data, at, last)
                if last > key:
                    break
                if last == key:
                    found.append(self._ids(data, value, length))
        return found

    def entries(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            data, _, end = self._block(k)
            at, last = 0, b""
            while at < end:
                last, value, length, at = self._entry(data, at, last)
                yield decode_key(last), self._ids(data, value, length)


def open_shard(uri: str) -> Shard:
    files, path = fs.FileSystem.from_uri(uri)
    return Shard(files.open_input_file(path))


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shards: int | None = None, to: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and write the shards; a stored table (shard, uri, n_docs, n_ids).

    shards: their number, by default as many as shuffle partitions, or more where one would
    hold over SHARD_BYTES.
    to: a folder all executors can write, any URI that pyarrow opens; new and below
    spark.checkpoint.dir by default.
    """
    spark = docs.sparkSession
    shards = shards or max(partitions(spark), -(-(estimated_bytes(docs) or 0) // SHARD_BYTES))
    to = to or scratch(spark)
    to = to if ":" in to.split("/")[0] else f"file://{to}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        task = TaskContext.get()
        shard, files, writer, n = task.partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files, path = fs.FileSystem.from_uri(f"{to}/shard-{shard:06d}.sst")
                files.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{task.taskAttemptId()}"
                out = files.open_output_stream(part)
                writer = Writer(out, zstandard.ZstdCompressor(level=1).compress)
            texts = text_column(batch.column(1))
            for lo, hi, _, _ in text_chunks(texts, TOGETHER):
                flat, first = encoder(tokenizer).encode(texts[lo:hi])
                flat = np.insert(flat, first[1:], np.uint32(end_id))
                first = (first + np.arange(len(first))).tolist()
                for doc_id, a, b in zip(batch.column(0)[lo:hi].to_pylist(), first[:-1], first[1:], strict=True):
                    writer.add(encode_key(doc_id), flat[a:b])
            n += batch.num_rows
        if writer is not None:
            writer.close()
            out.close()
            files.move(part, path)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "uri": [f"{to}/shard-{shard:06d}.sst"], "n_docs": [n], "n_ids": [writer.n_ids]}, pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    rows = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].cast("string").alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(shards, "k", "h").sortWithinPartitions("k", "h").select("k", "t")
    return stored(rows.mapInArrow(run, "shard int, uri string, n_docs long, n_ids long"))


def read_shards(shards: DataFrame) -> DataFrame:
    """Read the files back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    One task reads one shard; a shard's own start comes from a running sum over the
    table of shards, whose size is the number of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, uri, start in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = []
                for doc_id, ids in open_shard(uri).entries():
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), shard))
                    start += len(ids)
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    # one row for each file: a single running sum over a table as long as the list of files
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", "uri", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).cast("long").alias("start"))
    n = partitions(shards.sparkSession)
    return starts.repartitionByRange(n, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard int")


def _rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
