"""Conversation structure repair (operator 11): signature deduplication.

A conversation's rows become a compact string, its signature, one letter a row: the role's
initial (s, u, a, or x for any other), capital where the text is truncated, or ``-`` where the
row can't stay (blank or said before). What the cheapest repair is follows from the signature
alone, and most conversations share few of them: each distinct signature is solved once, by
recursion over its suffixes with a memo that all signatures of a task share, the audits
are joined back, and the edits are replayed over the rows.

* Edits: Keep, Rerole to user or assistant, Delete, Insert an empty user or assistant turn. A
  repaired conversation's initials read ``(s?(ua)+)?``, so an audit (the edits' initials in
  order) fixes every new role. The cheapest audit is taken, of equals the first in ASCII.
* Copies of a signature, a third of all conversations or more, meet its audit by broadcast.
* Rows are replayed as a stream sorted by conversation: a task holds one audit (a byte a row) and
  one row at a time, so the length of a conversation is bounded by its signature's only.

Defined results: a null role or text is one space, so a null role has no legal initial and a null
text is blank; null turns come first; rows of equal turn are taken by role, then text; a null
conv_id is a conversation of its own; a conversation without rows has an empty audit;
an empty table gives no row; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, stored

RETYPE, DROP, INSERT, CUT = 3, 4, 3, 3
#: The state behind a turn of the state, and the initial that leads there. A conversation may end in any but s and u.
EXPECTS = {"": "u", "s": "u", "u": "a", "a": "u"}
ENDS = ("", "a")
#: Inserts in a row: after a third the recursion would be where it was after the first.
INSERTS = 2
#: Rows of a batch that a task gives back.
BATCH = 4096

_SPACE = "[\\x20\\x09-\\x0D]"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties
    its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user. Nulls become one space."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    role = F.when(fault == 4, "user").otherwise(told("role"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.filter(fault != 0).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def marked(conversations: DataFrame) -> DataFrame:
    """Rows numbered from 1 within their conversation, with their first fault and their letter of the signature."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text")).repartition("conv_id")
    turn = F.col("turn").asc_nulls_first()
    order = Window.partitionBy("conv_id").orderBy(turn, "role", "text")
    initial = F.substring("role", 1, 1)
    # one shuffle by conversation serves both windows
    rows = rows.select("*", F.row_number().over(order).alias("nth"), F.lag(initial).over(order).alias("led"), F.lag("turn").over(order).alias("turn_before"))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("nth")) > 1)
    fault = F.when(F.regexp_replace("text", _SPACE, "") == "", "blank").when(F.col("again"), "duplicate").when(~F.col("text").rlike(f"[.!?]{_SPACE}*\\z"), "truncated")
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    code = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    rows = rows.withColumn("fault", fault)
    legal = F.concat("led", initial).isin("su", "ua", "au")
    return rows.select(
        "conv_id", "turn", "role", "text", F.col("nth").cast("long").alias("nth"), "fault", code.alias("code"),
        ((F.col("nth") > 1) & ~legal).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """One row a conversation: its signature, counts of faults and gaps between turns."""
    told = lambda name: F.count_if(F.col("fault") == name)
    parts = F.sort_array(F.collect_list(F.when(F.col("nth").isNotNull(), F.struct("nth", "code"))))
    gaps = F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")
    return rows.groupBy("conv_id").agg(
        F.array_join(F.transform(parts, lambda x: x["code"]), "").alias("signature"),
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        *[told(name).cast("long").alias(name) for name in ("blank", "duplicate", "truncated")],
        F.count_if("illegal").cast("long").alias("illegal"),
    )


#: A solved suffix behind one state: cost, first edit, and what follows.
Step = tuple[int, str, "Step | None"]


class Solver:
    """Cheapest audits of signatures; suffixes are solved once, whichever signature they end.

    Of two repairs that cost the same the edits where they part differ in their first letters, at
    most after one insert both share, so an audit is kept as a chain of steps and never copied.
    """

    #: Solved suffixes that are kept, and the letters each may have.
    MOST, LETTERS = 100_000, 64

    def __init__(self):
        self.memo: dict[str, dict[str, Step]] = {}
        self.end = self.inserted({s: (0, "", None) for s in ENDS})

    def solve(self, signature: str) -> tuple[int, str]:
        step = self.suffix(signature)[""]
        cost, letters = step[0], []
        while step and step[1]:
            letters.append(step[1])
            step = step[2]
        return cost, "".join(letters)

    def suffix(self, signature: str) -> dict[str, Step]:
        """The cheapest repair of this suffix behind each state.

        The recursion is over ever shorter suffixes; it goes up from the longest one that is
        known, so a long signature needs no deep stack.
        """
        n = len(signature)
        at = next((k for k in range(max(n - self.LETTERS, 0), n) if signature[k:] in self.memo), n)
        best = self.memo[signature[at:]] if at < n else self.end
        for k in range(at - 1, -1, -1):
            best = self.step(signature[k], best)
            if n - k <= self.LETTERS and len(self.memo) < self.MOST:
                self.memo[signature[k:]] = best
        return best

    def step(self, code: str, rest: dict[str, Step]) -> dict[str, Step]:
        """One letter before a solved suffix."""
        out, letter, cut = {}, code.lower(), CUT * code.isupper()
        for state, role in EXPECTS.items():
            ways = [(DROP + rest[state][0], "D", rest[state])]
            if code != "-":
                ways.append((RETYPE + cut + rest[role][0], "R", rest[role]))
                if letter == role or letter == "s" and not state:
                    ways.append((cut + rest[letter][0], "K", rest[letter]))
            out[state] = min(ways, key=lambda x: x[:2])
        return self.inserted(out)

    @staticmethod
    def inserted(best: dict[str, Step]) -> dict[str, Step]:
        """The same with up to INSERTS inserted turns before the letter."""
        out = {}
        for state in EXPECTS:
            ways, at = [], [state]
            for _ in range(INSERTS):
                at.append(EXPECTS[at[-1]])
            for k, last in enumerate(at):
                if last in best:
                    way = best[last]
                    for _ in range(k):
                        way = (INSERT + way[0], "I", way)
                    ways.append(way)
            out[state] = min(ways, key=lambda x: (x[0], x[1], x[2][1] if x[2] else ""))
        return out


def audits(convs: DataFrame) -> DataFrame:
    """signature, n (its conversations), cost and audit: each distinct signature solved once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver = Solver()
        for batch in batches:
            found = [solver.solve(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], ["signature", "n", "cost", "audit"])

    return convs.groupBy("signature").agg(F.count("*").alias("n")).mapInArrow(run, "signature string, n long, cost long, audit string")


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def replay(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (from 0), edit (K, R or I), role and text.

    A conversation's audit goes ahead of its rows (nth 0) in one sorted stream. Turns come
    out by place, those of a conversation one behind the other in one partition; one whose repair
    is empty has a single row with nulls, so no conversation is lost.
    """
    told = F.lit(None).cast("string")
    heads = solved.select("conv_id", F.lit(0).cast("long").alias("nth"), told.alias("role"), F.col("audit").alias("text"))
    stream = heads.unionByName(rows.select("conv_id", "nth", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        turns: Iterator[tuple] = iter(())
        conv, audit, at, place, shift = None, "", 0, 0, 0

        def put(edit: str | None, role: str | None, text: str | None) -> None:
            nonlocal place
            out.append((conv, place, edit, role, text))
            place += 1

        def role_here() -> str:
            return "assistant" if (place - shift) % 2 else "user"

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", role_here(), "")
                at += 1

        for batch in batches:
            turns = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for conv_id, nth, role, text in turns:
                if nth == 0:
                    conv, audit, at, place, shift = conv_id, text, 0, 0, 0
                    inserts()
                    if not audit.strip("D"):
                        out.append((conv, None, None, None, None))
                else:
                    edit = audit[at]
                    at += 1
                    if edit == "K":
                        shift += place == 0 and role[:1] == "s"
                        put("K", role, text)
                    elif edit == "R":
                        put("R", role_here(), text)
                    inserts()
                if len(out) >= BATCH:
                    yield _turns(out)
                    out = []
        if out:
            yield _turns(out)

    return stream.mapInArrow(run, REPAIRED)


def _turns(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "place", "edit", "role", "text"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id and the hash of its ``role:text`` lines, for turns as replay() gives them: neighbours in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, said, began = None, None, False
        for batch in batches:
            for conv_id, place, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if place is None or place == 0:
                    if began:
                        out.append((conv, said.hexdigest()))
                    conv, said, began = conv_id, hashlib.sha256(), True
                else:
                    said.update(b"\n")
                if place is not None:
                    said.update(f"{role}:{text}".encode())
            if len(out) >= BATCH:
                yield _hashes(out)
                out = []
        if began:
            out.append((conv, said.hexdigest()))
        if out:
            yield _hashes(out)

    return repaired.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _hashes(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One row a conversation with its faults, signature, cost and audit; and the repaired turns.

    ids: conversations (conv_id) to tell of beside those that have rows.
    """
    rows = stored(marked(conversations))
    told = rows if ids is None else rows.unionByName(ids.select(F.col("conv_id").cast("long")).distinct(), allowMissingColumns=True)
    convs = stored(signatures(told))
    solved = join_hot(convs, stored(audits(convs)), ["signature"], "n").drop("n")
    return solved, replay(rows, solved)


def report(solved: DataFrame, turns: DataFrame) -> DataFrame:
    """Gaps, faults, cost, audit and the digest of the repaired turns of every conversation."""
    said = digests(turns).withColumnRenamed("conv_id", "of")
    return solved.join(said, solved["conv_id"].eqNullSafe(said["of"])).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
