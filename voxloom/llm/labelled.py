"""The bounded labelled sample that the two classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of text that a fit takes at most, beside its bound on rows; a text above a quarter of it isn't fitted on.
SAMPLE_BYTES, LARGEST_SHARE = 48 << 20, 4


def fold(id_col: Column, of: int) -> Column:
    """crc32 of the identifier as text, modulo ``of``."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


def sample(docs: DataFrame, labels: DataFrame, label_col: str, of: int, out: int, per_class: int, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, label) of labelled rows outside the held-out fold, as a stored table.

    At most per_class rows of either class and at most most_bytes of text in all, both taken
    by the smallest hashes, so the sample doesn't depend on the partitioning. These are the
    documented bounds of what a fit holds: only ids of that many rows are broadcast, and
    only their texts are fetched. Where the bytes are too many, texts longer than
    most_bytes / LARGEST_SHARE are left out first, so none of them keeps the others away. Rows without a label or an id are left out; of a doc_id
    with several texts the one with the smallest hash counts.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), of) != out)).distinct()
    order = [F.xxhash64("doc_id"), "doc_id", "label"]
    taken = [rows.filter(F.col("label") == c).orderBy(*order).limit(per_class) for c in (0, 1)]
    picked = F.broadcast(taken[0].unionByName(taken[1]))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = stored(found.select("doc_id", "text", "label"))
    whole = found.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    if whole <= most_bytes:
        return found
    size = F.octet_length("text").cast("long")
    # a running sum over the sample: at most 2 * per_class rows
    upto = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return found.filter(size <= most_bytes // LARGEST_SHARE).select("doc_id", "label", "text", upto.alias("upto")).filter(F.col("upto") <= most_bytes).select("doc_id", "text", "label")
