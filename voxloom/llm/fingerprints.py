"""Document fingerprints (operator 1): SimHash, with DataFrame functions only.

Terms are the runs of three consecutive words of the whole text (the whole sequence where
there are fewer; between neighbouring blanks stands an empty word). Each occurrence votes, so a term's weight is its frequency: two 64-bit
hashes of the term give 128 signed votes. For each 127 terms, 16 longs of eight byte lanes
count them; the lanes are then added up, two to a long (32 bits each). All sums run in
generated code and hold for texts of up to 2**31 words. A
fingerprint bit is set when more than half of the votes are for it.

The next document is found over narrow rows: identifiers are cut into sorted ranges, each
range's last identifier is followed by the next range's first. Texts are shuffled once, by
identifier; of the next document only the prefix that the edit needs travels.

search() finds all pairs of fingerprints within a Hamming radius through permuted block
tables; equal fingerprints are one entry there, so copies cost nothing. Two documents of one
text, or texts of equal terms, have one fingerprint and one print_class.

Defined results: a null or blank text has no term, fingerprint all zeros, and likeness 1 to
another such text. Rows that share a doc_id are followed by the same row, the first by
text hash of the next greater doc_id. After the last the first follows; a single document
follows itself. A null doc_id is in no order: nothing follows it (the edit takes the empty
text, near_next is likeness to the empty text; print_class is null where all ids of the class
are). Repeated rows are each returned. Extra columns of any name are left out. A text of any
length is counted whole.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, partitions, stored

TERM, BITS, RADIUS = 3, 128, 3
#: Fingerprints in a bucket of a block table beyond which the bucket is cut by a second level of tables.
SPLIT = 512
#: Terms of a row counted together: no byte lane, the signed top one included, holds more.
CHUNK = 127
_LANES, _PAIR = 0x0101010101010101, 0x000000FF000000FF


def fingerprints(texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, f1, f2 for each row; the keys name one row each.

    No shuffle of its own where the input is already dealt by one of the keys; otherwise
    votes are summed before the shuffle.
    """
    # splitting at one character needs no regular expression; a run of blanks gives empty words
    spaced = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.col(text_col))
    listed = texts.select(*keys, spaced.alias("s")).select(*keys, F.split("s", " ").alias("w"), (F.trim("s") == "").alias("blank"))
    n = F.size("w")
    kind = "array<struct<" + ",".join(f"t{k}:string" for k in range(TERM)) + ">>"
    whole = F.array(F.struct(F.array_join("w", " "), *[F.lit("")] * (TERM - 1)))
    terms = F.when(n >= TERM, F.arrays_zip(*[F.slice("w", k + 1, F.greatest(n - TERM + 1, F.lit(0))) for k in range(TERM)]).cast(kind)).otherwise(whole.cast(kind))
    terms = listed.select(*keys, "blank", F.posexplode(terms).alias("nth", "t"))
    h1 = F.xxhash64(*[F.col(f"t.t{k}") for k in range(TERM)])
    votes = terms.select(*keys, "blank", "nth", h1.alias("h1")).withColumn("h2", F.xxhash64("h1", F.lit(1)))
    # terms by the CHUNK: eight byte lanes of a long count eight bits, 16 sums for 128 bits
    lanes = [F.expr(f"sum(shiftrightunsigned({h}, {i}) & {_LANES}L) AS {h}_{i}") for h in ("h1", "h2") for i in range(8)]
    votes = votes.withColumn("chunk", F.expr(f"cast(nth / {CHUNK} AS int)"))
    chunks = votes.groupBy(*keys, "chunk").agg(F.count("*").alias("m"), F.max("blank").alias("blank"), *lanes)
    # then the lanes of all chunks, two to a long
    pairs = [F.expr(f"sum(shiftrightunsigned({h}_{i}, {8 * j}) & {_PAIR}L) AS {h}_{i}_{j}") for h in ("h1", "h2") for i in range(8) for j in range(4)]
    counted = chunks.groupBy(*keys).agg(F.sum("m").alias("_votes"), F.max("blank").alias("blank"), *pairs)

    def word(h: str) -> Column:
        low = [f"shiftleft(cast(({h}_{i}_{j} & 4294967295L) * 2 > _votes AS bigint), {i + 8 * j})" for i in range(8) for j in range(4)]
        high = [f"shiftleft(cast(shiftrightunsigned({h}_{i}_{j}, 32) * 2 > _votes AS bigint), {i + 8 * j + 32})" for i in range(8) for j in range(4)]
        return F.expr(f"if(blank, 0L, {' | '.join(low + high)})")

    return counted.select(*keys, word("h1").alias("f1"), word("h2").alias("f2"))


def hexed(f1: Column, f2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def likeness(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Share of equal bits."""
    differ = F.bit_count(a1.bitwiseXOR(b1)) + F.bit_count(a2.bitwiseXOR(b2))
    return 1 - differ.cast("double") / BITS


def followers(ids: DataFrame) -> DataFrame:
    """(k, next, prev) of distinct identifiers in order, the last followed by the first.

    ids (k) is distinct and not null. Ranges come from a stored range partitioning, so a
    window never spans more than one range; the ranges themselves are few.
    """
    n = partitions(ids.sparkSession)
    dealt = stored(ids.repartitionByRange(n, "k").select("k", F.spark_partition_id().alias("part")))
    ends = dealt.groupBy("part").agg(F.min("k").alias("low"), F.max("k").alias("high"))  # one row a range
    order, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("low").over(order), F.first("low").over(every)).alias("after"), F.coalesce(F.lag("high").over(order), F.last("high").over(every)).alias("before"))
    own = Window.partitionBy("part").orderBy("k")
    return dealt.join(F.broadcast(ends), "part").select("k", F.coalesce(F.lead("k").over(own), "after").alias("next"), F.coalesce(F.lag("k").over(own), "before").alias("prev"))


def simhash_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, print_class, n_within.

    print_class: the smallest doc_id with this fingerprint; n_within: how many other
    fingerprints of the table lie within RADIUS bits of it.
    """
    c, zero = F.col, F.lit(0).cast("long")
    parts = partitions(docs.sparkSession)
    rows = docs.select(c(id_col).cast("long").alias("k"), F.coalesce(c(text_col).cast("string"), F.lit("")).alias("text"))
    # a row is named by its id (0 for null) and a hash of id and text
    rows = rows.select("*", F.coalesce("k", zero).alias("i"), F.xxhash64("k", "text", c("k").isNull()).alias("u"))
    key = ["i", "u"]
    narrow = stored(rows.groupBy(*key).agg(F.first("k").alias("k"), F.first(F.char_length("text").cast("long")).alias("n"), F.count("*").alias("copies")))

    ordered = narrow.filter("k is not null")
    heads = ordered.groupBy("k").agg(F.min("u").alias("head"))
    order = followers(heads.select("k")).select("k", "next")
    links = ordered.select("k", c("u").alias("to"), F.floor(c("n") / 4).cast("int").alias("need"))
    links = stored(links.join(order, "k").join(heads.select(c("k").alias("next"), "head"), "next").select(c("k").alias("to_k"), "to", "need", "next", "head"))

    texts = rows.select(*key, "text").repartition(parts, *key).dropDuplicates(key)
    prefixes = texts.join(links, (c("i") == c("next")) & (c("u") == c("head"))).select("to_k", "to", F.substring("text", F.lit(1), c("need")).alias("prefix"))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 4).cast("int")), F.coalesce("prefix", F.lit("")))
    both = texts.join(prefixes, (c("i") == c("to_k")) & (c("u") == c("to")), "left").select(*key, "text", edited.alias("edited"))
    # text and edit of a row are two rows of one task
    sides = F.array(F.struct(F.lit(False).alias("new"), F.lit("").alias("sha"), c("text").alias("t")), F.struct(F.lit(True).alias("new"), F.sha2(c("edited").cast("binary"), 256).alias("sha"), c("edited").alias("t")))
    prints = fingerprints(both.select(*key, F.inline(sides)), [*key, "new", "sha"], "t")
    side = lambda x, new: F.max(F.when(c("new") == new, c(x)))
    prints = prints.groupBy(*key).agg(side("sha", True).alias("sha"), *[side(f, new).alias(f"{'e' if new else 'f'}{f[1]}") for new in (False, True) for f in ("f1", "f2")])
    prints = stored(prints.join(narrow, key))

    # search: what lies within the radius of each fingerprint, over one row a fingerprint
    reps = stored(prints.groupBy("f1", "f2").agg(F.min("k").alias("rep"), F.count("*").alias("rows")).withColumn("rid", F.xxhash64("f1", "f2")))
    pairs = search(reps.select("rid", "f1", "f2"), RADIUS)
    links_of = pairs.select(F.explode(F.array(F.struct("a1", "a2"), F.struct(c("b1").alias("a1"), c("b2").alias("a2")))).alias("x")).groupBy(c("x.a1").alias("f1"), c("x.a2").alias("f2")).agg(F.count("*").alias("n_within"))
    classes = stored(reps.join(links_of, ["f1", "f2"], "left").select("f1", "f2", "rep", "rows", F.coalesce("n_within", zero).alias("n_within")))

    after = links.join(prints.select(c("i").alias("next"), c("u").alias("head"), c("f1").alias("g1"), c("f2").alias("g2")), ["next", "head"]).select("to_k", "to", "g1", "g2")
    out = join_hot(prints, classes, ["f1", "f2"], "rows").join(after, (c("i") == c("to_k")) & (c("u") == c("to")), "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), c("copies").cast("int"))))
    g1, g2 = F.coalesce("g1", zero), F.coalesce("g2", zero)
    return out.select(
        c("k").alias("doc_id"), c("n").alias("n_chars"), c("sha").alias("edited_sha256"),
        hexed(c("f1"), c("f2")).alias("fingerprint"), hexed(c("e1"), c("e2")).alias("edited_fingerprint"),
        likeness(c("f1"), c("f2"), c("e1"), c("e2")).alias("near_edited"), likeness(c("f1"), c("f2"), g1, g2).alias("near_next"),
        c("rep").alias("print_class"), "n_within",
    )


def _masks(bits: list[int], radius: int, cuts: int) -> list[tuple[int, int]]:
    """Each choice of cuts - radius of the blocks that the bits are cut into, as masks of the two longs."""
    edges = [len(bits) * k // cuts for k in range(cuts + 1)]
    out = []
    for choice in combinations(range(cuts), cuts - radius):
        chosen = {b for k in choice for b in bits[edges[k] : edges[k + 1]]}
        words = (sum(1 << b for b in chosen if b < 64), sum(1 << (b - 64) for b in chosen if b >= 64))
        out.append(tuple(w - (1 << 64) if w >> 63 else w for w in words))
    return out


def search(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, a1, a2, b1, b2, distance): all pairs of the fingerprints within the radius.

    prints: rid (any name of the row, a < b in the result), f1, f2, one row a fingerprint. The
    128 bits are cut into ``blocks`` blocks (radius + 2 by default); two prints within the
    radius agree on at least blocks - radius of them, so each choice of that many blocks,
    moved to the front, is one table: an equi-join on those bits. A pair is reported by the
    first table it meets in. A bucket of more than SPLIT prints is cut again: its prints
    agree on the front bits, so the bits behind are cut into blocks for tables of the second
    level. Only prints that agree on both levels' bits ever meet.
    """
    c = F.col
    blocks = blocks or radius + 2
    first = _masks(list(range(128)), radius, blocks)
    tables = F.array(*[F.struct(F.lit(i).alias("i"), F.xxhash64(F.lit(i), c("f1").bitwiseAND(F.lit(m)), c("f2").bitwiseAND(F.lit(n))).alias("key")) for i, (m, n) in enumerate(first)])
    posted = prints.select("rid", "f1", "f2", F.inline(tables))
    sizes = stored(posted.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    shared = stored(join_hot(posted, sizes, ["key"], "m"))
    x1, x2 = c("a1").bitwiseXOR(c("b1")), c("a2").bitwiseXOR(c("b2"))
    distance = F.bit_count(x1) + F.bit_count(x2)

    def met(rows: DataFrame, key: list[str]) -> DataFrame:
        left = rows.select(c("rid").alias("a"), c("f1").alias("a1"), c("f2").alias("a2"), *key)
        right = rows.select(c("rid").alias("b"), c("f1").alias("b1"), c("f2").alias("b2"), *key)
        agree = [(x1.bitwiseAND(F.lit(m)) == 0) & (x2.bitwiseAND(F.lit(n)) == 0) for m, n in first]
        earliest = reduce(lambda later, i: F.when(agree[i], F.lit(i)).otherwise(later), range(len(first) - 1, -1, -1), F.lit(-1))
        return left.join(right, key).filter((c("a") < c("b")) & (distance <= radius) & (earliest == c("i")))

    out = ["a", "b", "a1", "a2", "b1", "b2", distance.cast("int").alias("distance")]
    pairs = met(shared.filter(c("m") <= SPLIT), ["key", "i"]).select(*out)
    large = shared.filter(c("m") > SPLIT)
    if large.isEmpty():
        return pairs
    # second level: tables over the bits that the first level's choice leaves; one row of masks a choice
    second = []
    for i, (m, n) in enumerate(first):
        fixed = (m & (1 << 64) - 1) | (n & (1 << 64) - 1) << 64
        second.append((i, _masks([b for b in range(128) if not fixed >> b & 1], radius, max(2 * radius, 1))))
    masks = F.broadcast(prints.sparkSession.createDataFrame(second, "i int, ms array<struct<m1: bigint, m2: bigint>>"))
    fine = large.join(masks, "i").select("rid", "f1", "f2", "i", "key", F.posexplode("ms").alias("j", "mask"))
    fine = fine.withColumn("key2", F.xxhash64("key", "j", c("f1").bitwiseAND(c("mask.m1")), c("f2").bitwiseAND(c("mask.m2")))).drop("mask")
    found = met(fine, ["key", "key2", "i", "j"]).join(masks, "i")
    # of the second tables too, the first in which the pair agrees reports it
    again = F.expr("exists(slice(ms, 1, j), x -> ((a1 ^ b1) & x.m1) = 0 and ((a2 ^ b2) & x.m2) = 0)")
    return pairs.unionByName(found.filter(~again).select(*out))


def within_radius(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All pairs of different fingerprints within the radius, through permuted block tables.

    prints: doc_id, fingerprint (hex). Returns (members: doc_id, rep) and (pairs of
    representatives: a, b, distance); rep is the smallest doc_id with that fingerprint, so a
    group of equal fingerprints is one entry.
    """
    long = lambda at: F.conv(F.substring("fingerprint", at, 16), 16, -10).cast("long")
    reps = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")))
    members = join_hot(prints.select("doc_id", "fingerprint"), reps, ["fingerprint"], "rows").select("doc_id", "rep")
    pairs = search(reps.select(F.col("rep").alias("rid"), long(1).alias("f1"), long(17).alias("f2")), radius, blocks)
    return members, pairs.select("a", "b", "distance")
