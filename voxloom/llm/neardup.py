"""MinHash near-dedup (operator 9): signature-coordinate inverted join.

1. Each whole text gives its distinct 5-word shingles (64-bit hashes), their number, a
   128-bit digest of the set and a signature of ``COORDS`` minima. Equal sets form a class;
   only class representatives (smallest doc_id) go on, so copies cost nothing below.
2. Representatives are posted under each coordinate-value pair. Pairs linked at 85 % agree
   in at least ``MATCHES`` coordinates but for a chance of 1.3 in a million at exactly 85 %,
   so they share one of the COORDS-MATCHES+1 rarest postings of either (prefix); postings of
   one representative and the commonest ones are skipped, so a passage that thousands of
   documents share makes no candidates.
3. Collisions are counted within postings. A posting's members are first held against its
   smallest member; where that leaves a posting in one piece, it is done. The others are
   dealt out in blocks, and blocks of one posting meet: pairs with MATCHES equal coordinates
   or more join their members into groups. A block reports at most one link for each of its
   members, whatever the number of pairs. Every candidate pair lies inside a group, and to be
   in one group takes a chain of candidates, not of single shared values.
4. Groups are dealt out in blocks of bounded text; a pair of blocks is one task: it counts
   collisions against an inverted table of the block, and confirms pairs above the match
   threshold on the full sets, all pairs but those already in one component.

In 3 and 4, blocks first meet themselves and the first block of their posting or group; only
members that these links leave apart from the largest component meet every other block.
Members are dealt to blocks by hash, postings and groups with many rows are met by
join_hot(), components come from hash-to-minimum joins on stored tables; nothing is collected.

Defined results: a text without words (null, empty, blank) has n_shingles 0 and is linked with
nothing; with fewer than five words the whole sequence is the one shingle; a text of any length
is used whole; repeated rows are copies of
each other (same doc_id: both rows stay rows, kept is doc_id = component_id); a doc_id
repeated with other texts has a class for each, linked by its own text only, and components
with the same smallest doc_id show the same component_id; a null
doc_id is reported alone (component_id null, kept true, or kept only if it isn't a copy's
larger id: it never represents a class with other members); an empty table gives no row;
extra columns of any name are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hot, lower_ascii, mix, partitions, ranges, span_hash, stored, text_chunks, text_column, window_hash, word_spans

SHINGLE, PERCENT, COORDS, MATCHES = 5, 85, 24, 11
#: Shingles and members in a block of a group: what one task holds of one side (8 bytes a shingle).
BLOCK_SHINGLES, BLOCK_MEMBERS = 1_000_000, 3000
#: Members in a block of a posting, which holds signatures only (192 bytes each).
BLOCK_SIGNATURES = 6000
#: Groups of several blocks up to which their names are broadcast (8 bytes each).
BROADCAST_GROUPS = 100_000

_rng = np.random.default_rng(85)
_SEEDS = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, one after the other, and their numbers."""
    data = lower_ascii(data)
    start, end, first = word_spans(data, offsets)
    words = span_hash(data, start, end)
    counts = np.diff(first)
    owner = np.repeat(np.arange(len(counts)), counts)
    if len(words) >= n:
        at = np.flatnonzero(owner[: len(words) - n + 1] == owner[n - 1 :])
        value, own = window_hash(words, n)[at], owner[at]
    else:
        value, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the sequence as one shingle; its length keeps it apart from others
        whole = [mix(np.bitwise_xor.reduce(mix(words[first[d] : first[d + 1]] + np.arange(counts[d], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))) + counts[d].astype(np.uint64)) for d in short]
        value, own = np.append(value, np.array(whole, np.uint64)), np.append(own, short)
        order = np.argsort(own, kind="stable")
        value, own = value[order], own[order]
    sizes = np.bincount(own, minlength=len(counts))
    out, number, at = [], np.zeros(len(counts), np.int64), 0
    for d, size in enumerate(sizes.tolist()):
        if size:
            s = np.sort(value[at : at + size])
            s = s[np.append(True, s[1:] != s[:-1])]
            out.append(s)
            number[d] = len(s)
            at += size
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), number


def signatures(value: np.ndarray, number: np.ndarray) -> np.ndarray:
    """One row of COORDS minima for each document with shingles."""
    full = np.flatnonzero(number)
    begin = (np.cumsum(number) - number)[full]
    return np.stack([np.minimum.reduceat(mix(value ^ seed), begin) for seed in _SEEDS], axis=1) if len(full) else np.zeros((0, COORDS), np.uint64)


SKETCH = "doc_id long, h long, n_shingles long, d1 long, d2 long, sig array<long>"


def text_hash() -> Column:
    """Tells the texts of a repeated doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def sketch(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_chunks(text_column(batch.column(1))):
                value, number = shingle_sets(data, offsets)
                upto = np.append(0, np.cumsum(number))
                digests = [np.append(np.uint64(0), np.cumsum(mix(value + np.uint64(k)), dtype=np.uint64)) for k in (0x51ED27, 0xA0761D)]
                d1, d2 = ((c[upto[1:]] - c[upto[:-1]]).view(np.int64) for c in digests)
                sig = signatures(value, number).view(np.int64)
                places = np.append(0, np.cumsum(np.where(number > 0, COORDS, 0)))
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(sig.ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(number), pa.array(d1), pa.array(d2), lists], ["doc_id", "h", "n_shingles", "d1", "d2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("h")).mapInArrow(run, SKETCH)


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each connected component; edges (a, b), any direction.

    Alternating large-star and small-star steps on stored tables until every component is a star
    round its smallest node: O(log^2) rounds of linear work; one row per edge at any time. The
    smallest neighbours are stored before they are joined, so the join has two plain inputs: it is
    a broadcast where they are few, else a shuffle whose hubs adaptive execution splits.
    """
    both = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    current = stored(both)
    while True:
        ways = current.select(F.col("b").alias("u"), F.col("a").alias("v")).unionByName(current.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = stored(ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") < F.col("u")).alias("down"), F.count_if(F.col("v") > F.col("u")).alias("up")))
        if low.filter("down > 1 or down > 0 and up > 0").isEmpty():
            forget(current)
            return low.select(F.col("u").alias("id"), F.col("m").alias("comp"))
        # large star: neighbours larger than the node move to the node's smallest neighbour
        large = stored(ways.filter("v > u").join(low.filter("up > 0").select("u", "m"), "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        least = stored(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least, "b").select(F.col("m").alias("x"), "a", "b")
        now = stored(small.select(F.col("x").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a < b").distinct())
        for done in (current, low, large, least):
            forget(done)
        current = now


def prefix_postings(reps: DataFrame) -> DataFrame:
    """(v, id): each representative under its rarest shared coordinate values, as far as the prefix goes."""
    posts = reps.select("id", F.explode("sig").alias("v"))
    shared = stored(posts.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1"))
    mine = join_hot(posts, shared, ["v"], "n").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("found"))
    # values that nobody else has come first in the order and use the prefix up
    taken = mine.filter(F.size("found") >= MATCHES).select("id", F.expr(f"slice(found, 1, greatest({COORDS - MATCHES + 1} - ({COORDS} - size(found)), 0))").alias("found"))
    return taken.select("id", F.explode("found.v").alias("v"))


def candidate_groups(reps: DataFrame) -> DataFrame:
    """(id, comp): groups such that any two representatives with MATCHES equal coordinates are in one group."""
    sigs = reps.select("id", "sig")
    posts = stored(prefix_postings(reps))
    lows = stored(posts.groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1"))
    pairs = stored(join_hot(posts, lows, ["v"], "n").filter("id <> low").select("low", "id").distinct())
    stars = stored(pairs.groupBy("low").agg(F.count("*").alias("n")).join(sigs.select(F.col("id").alias("low"), F.col("sig").alias("low_sig")), "low"))
    held = join_hot(pairs, stars, ["low"], "n").join(sigs, "id")
    equal = F.size(F.filter(F.zip_with("sig", "low_sig", lambda x, y: x == y), lambda same: same))
    links = stored(held.filter(equal >= MATCHES).select(F.col("low").alias("a"), F.col("id").alias("b")))
    comps = components(links)

    named = stored(posts.join(comps, "id", "left").select("v", "id", F.coalesce("comp", "id").alias("comp")))
    mixed = stored(named.groupBy("v").agg(F.min("comp").alias("first"), F.max("comp").alias("last"), F.count("*").alias("n")).filter("first <> last").select("v", "n"))
    if mixed.isEmpty():
        return comps
    open_ = join_hot(named, mixed, ["v"], "n").join(sigs, "id")
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(F.col("n") / BLOCK_SIGNATURES))
    members = stored(open_.select(F.col("v").alias("grp"), block.cast("long").alias("block"), "id", "comp", "sig"))
    return components(links.unionByName(meet_blocks(members, BLOCK_SIGNATURES, links)))


def _unions(parent: np.ndarray, a: int, b: int) -> bool:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


class Block:
    """Members of a posting or group: ids, components so far, signatures and, in a group, full sets."""

    def __init__(self, ids: list[int], comps: list[int], sigs: list[bytes], sets: list[bytes]):
        self.ids, self.comps = np.array(ids, np.int64), np.array(comps, np.int64)
        self.sig = np.frombuffer(b"".join(sigs), np.int64).reshape(-1, COORDS)
        self.size = np.array([len(x) // 8 for x in sets], np.int64)
        self.value = np.frombuffer(b"".join(sets), np.uint64)
        self.at = np.append(0, np.cumsum(self.size))

    def tables(self) -> None:
        """Inverted tables: coordinate value → members, and shingle → members."""
        # a value counts under its own coordinate only
        values = mix(self.sig.view(np.uint64) + np.arange(COORDS, dtype=np.uint64)).ravel()
        order = np.argsort(values, kind="stable")
        self.post_value, self.post_member = values[order], order // COORDS
        self.posted = values.reshape(-1, COORDS)
        order = np.argsort(self.value, kind="stable")
        self.set_value, self.set_member = self.value[order], np.repeat(np.arange(len(self.ids)), self.size)[order]


def _lookup(values: np.ndarray, members: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """How many of the keys each of n members has."""
    lo, hi = np.searchsorted(values, keys, "left"), np.searchsorted(values, keys, "right")
    counts = hi - lo
    return np.bincount(members[np.repeat(lo, counts) + ranges(counts)], minlength=n)


def links_between(left: Block, right: Block, exact: bool) -> list[tuple[int, int]]:
    """Links that join components, over all pairs of a left and a right member; exact: confirmed on the full sets.

    A link leads from the smallest of the joined components to another, so links form stars.
    """
    left.tables()
    if right is not left:
        right.tables()
    every, where = np.unique(np.concatenate([left.comps, right.comps]), return_inverse=True)
    parent = np.arange(len(every))
    lc, rc = where[: len(left.ids)], where[len(left.ids) :]
    root = parent.copy()
    same = left is right
    for i in range(len(left.ids)):
        cand = root[rc] != root[lc[i]]
        if same:
            cand[: i + 1] = False
        if not cand.any():
            continue
        cand &= _lookup(right.post_value, right.post_member, left.posted[i], len(right.ids)) >= MATCHES
        if not cand.any():
            continue
        if exact:
            own = left.value[left.at[i] : left.at[i + 1]]
            both = _lookup(right.set_value, right.set_member, own, len(right.ids))
            cand &= 100 * both >= PERCENT * (len(own) + right.size - both)
        if any([_unions(parent, int(lc[i]), int(rc[j])) for j in np.flatnonzero(cand)]):
            while (parent[parent] != parent).any():
                parent = parent[parent]
            root = parent.copy()
    joined = np.flatnonzero(root != np.arange(len(every)))
    return list(zip(every[root[joined]].tolist(), every[joined].tolist(), strict=True))


def meet(tasks: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) found by the tasks (grp, x, y): block x of a posting or group against block y.

    members (grp, block, id, comp, sig, and text where links are to be confirmed): each is sent
    to the tasks its block takes part in, and a task holds two blocks.
    """
    exact = "text" in members.columns
    left = tasks.select("grp", F.col("x").alias("block"), "x", "y")
    right = tasks.filter("x <> y").select("grp", F.col("y").alias("block"), "x", "y")
    sent = members.join(left.unionByName(right), ["grp", "block"]).select("grp", "x", "y", "block", "id", "comp", "sig", *(["text"] if exact else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        found: list[tuple[int, int]] = []

        def finish() -> None:
            blocks = {k: Block(*v) for k, v in held.items()}
            if key is not None and key[1] in blocks and key[2] in blocks:
                found.extend(links_between(blocks[key[1]], blocks[key[2]], exact))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        for batch in batches:
            names = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            keys = list(zip(*(names[n].to_pylist() for n in ("grp", "x", "y")), strict=True))
            block, ids, comps = (names[n].to_pylist() for n in ("block", "id", "comp"))
            sig = np.array(names["sig"].flatten(), np.int64).reshape(-1, COORDS)
            chunks = text_chunks(text_column(names["text"])) if exact else [(0, len(keys), None, None)]
            for lo, hi, data, offsets in chunks:
                value, number = shingle_sets(data, offsets) if exact else (np.zeros(0, np.uint64), np.zeros(hi - lo, np.int64))
                upto = np.append(0, np.cumsum(number))
                for k in range(lo, hi):
                    if keys[k] != key:
                        finish()
                        key, held = keys[k], {}
                    lists = held.setdefault(block[k], ([], [], [], []))
                    for part, v in zip(lists, (ids[k], comps[k], sig[k].tobytes(), value[upto[k - lo] : upto[k - lo + 1]].tobytes()), strict=True):
                        part.append(v)
            if found:
                yield told()
                found.clear()
        finish()
        yield told()

    dealt = sent.repartition(partitions(tasks.sparkSession), "grp", "x", "y").sortWithinPartitions("grp", "x", "y", "block", "id")
    return dealt.mapInArrow(run, "a long, b long")


def meet_blocks(members: DataFrame, most: int, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) such that all linked pairs within a grp are in one component of these and the known links.

    members (grp, block, id, comp, sig[, text]) is stored; most: members of a block.
    """
    links = known
    blocks = members.select("grp", "block").distinct()
    itself = blocks.select("grp", F.col("block").alias("x"), F.col("block").alias("y"))
    first = stored(blocks.groupBy("grp").agg(F.min("block").alias("x"), F.count("*").alias("n")).filter("n > 1"))
    with_first = blocks.join(first, "grp").filter("block <> x").select("grp", "x", F.col("block").alias("y"))
    found = stored(meet(itself.unionByName(with_first), members))
    if first.isEmpty():
        return found
    # grps of several blocks: who isn't in the grp's largest component meets all other blocks
    comps = components(found if known is None else links.unionByName(found))
    carried = [c for c in ("sig", "text") if c in members.columns]
    several = members.join(F.broadcast(first.select("grp")) if first.count() <= BROADCAST_GROUPS else first.select("grp"), "grp", "left_semi")
    named = stored(several.select("grp", "block", "id", *carried).join(comps, "id", "left").select("grp", "block", "id", F.coalesce("comp", "id").alias("comp"), *carried))
    main = named.groupBy("grp", "comp").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"))
    main = stored(main.filter(F.col("all") > F.col("most")).select("grp", "main", "all", (F.col("all") - F.col("most")).alias("n")))
    if main.isEmpty():
        return found
    # the members left apart are blocks of their own, numbered below zero
    apart = join_hot(named, main, ["grp"], "all").filter("comp <> main")
    piece = -1 - F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("n") / most))
    lone = stored(apart.select("grp", piece.cast("long").alias("block"), "id", "comp", *carried))
    pairs = lone.select("grp", F.col("block").alias("x")).distinct().join(named.select("grp", F.col("block").alias("y")).distinct(), "grp")
    return found.unionByName(stored(meet(pairs, named.unionByName(lone))))


def link_groups(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, comp) of all representatives with a link."""
    groups = candidate_groups(reps).select(F.col("comp").alias("grp"), "id")
    sized = stored(groups.join(reps.select("id", "doc", "h", "n_shingles", "sig"), "id"))
    sizes = stored(sized.groupBy("grp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("all")))
    many = F.ceil(F.greatest(F.col("n") / BLOCK_MEMBERS, F.col("all") / BLOCK_SHINGLES))
    placed = join_hot(sized, sizes, ["grp"], "n").withColumn("block", F.pmod(F.xxhash64("id", F.lit(4)), many).cast("long"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    # a doc_id may be repeated with other texts: the text is the one that gave the signature; doc and h follow from id
    members = placed.join(texts, ["doc", "h"]).dropDuplicates(["id", "doc", "h"]).select("grp", "block", "id", F.col("id").alias("comp"), "sig", "text")
    return components(meet_blocks(stored(members), BLOCK_MEMBERS))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, h, n_shingles, component_id, kept for every row of docs."""
    sketches = stored(sketch(docs))
    found = sketches.filter("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.min("sig").alias("sig"), F.count("*").alias("n"))
    classes = stored(found.select("d1", "d2", "n_shingles", F.col("r.doc_id").alias("doc"), F.col("r.h").alias("h"), "sig", "n"))
    shared = stored(classes.groupBy("doc").agg(F.count("*").alias("n"), F.min("h").alias("first")).filter("n > 1").select("doc", "first"))
    repeated = not shared.isEmpty()
    if repeated:  # classes whose smallest doc_id is the same: all but one go by a hash of doc_id and text
        classes = stored(classes.join(shared, "doc", "left").withColumn("id", F.when(F.coalesce(F.col("h") != F.col("first"), F.lit(False)), F.xxhash64("doc", "h")).otherwise(F.col("doc"))).drop("first"))
    else:
        classes = classes.withColumn("id", F.col("doc"))
    comps = link_groups(docs, classes)
    named = classes.select("d1", "d2", "n_shingles", "n", "doc", "id").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    if repeated:
        named = stored(named)
        named = named.join(named.groupBy("comp").agg(F.min("doc").alias("low")), "comp").withColumn("comp", F.col("low"))
    # copies of one class may be many: classes with many rows are met by broadcast
    named = stored(named.select("d1", "d2", "n_shingles", "n", "comp"))
    own = sketches.filter("n_shingles > 0 and doc_id is not null")
    alone = sketches.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "h", "n_shingles", F.lit(None).cast("long").alias("comp"))
    out = join_hot(own, named, ["d1", "d2", "n_shingles"], "n").select("doc_id", "h", "n_shingles", "comp").unionByName(alone)
    lowest = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("comp")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "h", "n_shingles", lowest.alias("component_id")).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    return labelled(docs).drop("h")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of docs that represent their component, columns unchanged (rows repeated whole stay)."""
    kept = labelled(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__id"]) & (F.xxhash64(docs["text"].cast("string")) == kept["__h"]), "left_semi")
