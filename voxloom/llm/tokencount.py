"""Token counts (operator 12): a cache of counts under content and tokenizer digests.

Each text is normalised in the way its tokenizer is known not to notice, and digested. Digests
are joined to the counts stored for this tokenizer version; only distinct contents that
aren't there are encoded, once each, and appended to the cache. All rows then take their
count from the cache.

* The cache is a folder of Parquet files, (version, digest, n_tokens), partitioned by version;
  any number of jobs may append to it, and a content stored twice counts once. A failed job
  leaves no rows behind.
* The version is the SHA-256 of the tokenizer file, the library's name and version and the
  rule of normalisation, so a changed file or library never meets old counts.
* Normalisation: for a tokenizer that drops white space (``tokens.cut_words``), runs of ASCII
  white space become one space and none is left at the ends. For others texts stay as they are.
* Texts move once, to the task of their digest, after copies within a task have become one; what is
  known already doesn't move where the misses are few enough to be broadcast.

Defined results: a null or empty text has no byte and no token; repeated rows each get their row;
a null identifier stays null; an empty table gives no row; extra columns are left out. Special
strings inside texts are handled as the library does by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib import metadata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import exists, forget, join_hot, scratch, stored, text_chunks, text_column
from .tokens import TOGETHER, encoder, kind_of

CACHE = "digest binary, n_tokens long, version string"
#: Misses (32 bytes each) up to this number are broadcast, so that only their texts move.
BROADCAST_MISSES = 200_000

_pieces: dict[str, object] = {}


def library_of(tokenizer: str) -> str:
    return "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"


def blank_free(tokenizer: str) -> bool:
    """Whether counts don't depend on how much ASCII white space is where some is, or at the ends."""
    return library_of(tokenizer) == "tokenizers" and kind_of(tokenizer) == "words"


def version_of(tokenizer: str) -> str:
    """Digest of the tokenizer file, its library and the rule of normalisation."""
    name = library_of(tokenizer)
    said = hashlib.sha256(f"{name} {metadata.version(name)} {'blanks' if blank_free(tokenizer) else 'as is'}\n".encode())
    with open(tokenizer, "rb") as file:
        for part in iter(lambda: file.read(1 << 20), b""):
            said.update(part)
    return said.hexdigest()


def normalised(text: Column, tokenizer: str) -> Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")) if blank_free(tokenizer) else text


def count_texts(texts: pa.Array, tokenizer: str) -> np.ndarray:
    """Number of tokens of every text by the file's library."""
    if library_of(tokenizer) == "tokenizers":
        return np.diff(encoder(tokenizer).encode(texts)[1])
    if tokenizer not in _pieces:
        import sentencepiece

        _pieces[tokenizer] = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
    return np.array([len(x) for x in _pieces[tokenizer].encode(texts.to_pylist(), num_threads=1)], np.int64)


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest and n_tokens of what is stored for this version, one row a content."""
    rows = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == version)
    return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def encode_missing(contents: DataFrame, misses: DataFrame, tokenizer: str) -> DataFrame:
    """digest and n_tokens of the contents (digest, content) that misses names, each encoded once."""
    few = misses.count() <= BROADCAST_MISSES
    if few:
        contents = contents.join(F.broadcast(misses), "digest", "left_semi")
    once = contents.groupBy("digest").agg(F.first("content").alias("content"))
    if not few:
        once = once.join(misses, "digest", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(1))
            for lo, hi, _, _ in text_chunks(texts, TOGETHER):
                found = pa.array(count_texts(texts[lo:hi], tokenizer), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], found], ["digest", "n_tokens"])

    return once.select("digest", "content").mapInArrow(run, "digest binary, n_tokens long")


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row.

    cache: a folder that all executors share, made if it isn't there; a new one below
    spark.checkpoint.dir by default.
    """
    spark, version = docs.sparkSession, version_of(tokenizer)
    cache = cache or scratch(spark)
    if not exists(spark, cache):
        spark.createDataFrame([], CACHE).write.mode("append").partitionBy("version").parquet(cache)
    content = normalised(docs[text_col], tokenizer)
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    n_bytes = F.coalesce(F.octet_length(docs[text_col].cast("string")), F.lit(0)).cast("long")
    rows = stored(docs.select(docs[id_col].cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), digest.alias("digest")))
    wanted = rows.groupBy("digest").agg(F.count("*").alias("n"))
    misses = stored(wanted.join(cached(spark, cache, version), "digest", "left_anti").select("digest"))
    found = encode_missing(docs.select(digest.alias("digest"), content.alias("content")), misses, tokenizer)
    found.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(cache)
    forget(misses)
    counts = stored(wanted.join(cached(spark, cache, version), "digest"))
    n_tokens = F.col("n_tokens")
    return join_hot(rows, counts, ["digest"], "n").select("doc_id", "n_bytes", n_tokens, (n_tokens > limit).alias("over_limit"))
