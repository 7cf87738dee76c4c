"""Chat formatting (operator 4): event-sourced reconstruction, DataFrame functions only.

A log holds events (conv_id, seq, kind, turn, role, text) of four kinds:

* ``delta``: text streamed to the end of the message of that turn;
* ``edit``: the message's text is replaced;
* ``regenerate``: the message starts anew with this text, and what was logged before for
  later turns of the conversation is void.

Logs are dealt by conversation and sorted by sequence; events made void fall out by window
maxima, the rest is folded into messages, and messages are rendered with a template:
``<|im_start|>role\\ntext<|im_end|>\\n``. In texts and roles ``\\`` becomes ``\\\\`` and
``<|`` becomes ``<\\|`` (in roles a line break becomes ``\\n``), so a control string never
appears inside and unescaping gives the exact text back. The loss mask has one span for
each assistant text.

Defined results: null role or text is empty; a null conv_id is a conversation of its own;
a null seq comes first;
events of equal seq are taken in order of kind, then text (equal ones each count); an event of
unknown or null kind is a delta; a null turn is the first turn; an empty log gives no row; extra
columns are left out.
A conversation is one rendered row (that is the product), never more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def unescape_role(role: Column) -> Column:
    """Doubled backslashes first, from left to right: what is left of a backslash then belongs to a line break or to ``<|``."""
    parts = F.split(role, "\\\\\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\n"), F.lit("\n"))), "\\")


def messages(log: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the final messages.

    Events are numbered within their conversation by seq, kind and text first, so events of
    equal seq have one order and a restart voids all that comes before it there.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    log = log.select("conv_id", F.col("turn").cast("long").alias("turn"), "seq", "kind", F.col("role").cast("string").alias("role"), text.alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("seq").asc_nulls_first(), F.col("kind").asc_nulls_first(), "text", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first())
    log = log.withColumn("nth", F.row_number().over(in_order))
    restart = F.when(F.col("kind").isin("edit", "regenerate"), F.col("nth"))
    again = F.when(F.col("kind") == "regenerate", F.col("nth"))
    by_turn = Window.partitionBy("conv_id", "turn")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    marked = log.withColumn("restart", F.max(restart).over(by_turn)).withColumn("void", F.max(again).over(earlier))
    alive = marked.filter((F.col("restart").isNull() | (F.col("nth") >= F.col("restart"))) & (F.col("void").isNull() | (F.col("nth") > F.col("void"))))
    parts = F.sort_array(F.collect_list(F.struct("nth", "text")))
    role = F.coalesce(F.max_by("role", F.struct(F.col("role").isNotNull(), "nth")), F.lit(""))
    return alive.groupBy("conv_id", "turn").agg(role.alias("role"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: one row a conversation.

    loss: for each assistant text its turn's number (from 0), its place within the turn's
    piece, its place in formatted and its length, in code points.
    """
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(F.col("text"))
    pieces = turns.select("conv_id", "turn", (F.col("role") == "assistant").alias("own"), head.alias("head"), body.alias("body"))
    pieces = pieces.select("conv_id", "turn", "own", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.char_length("head").alias("at"), F.char_length("body").alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    start = F.sum(F.char_length("piece")).over(order) - F.char_length("piece")
    nth = F.row_number().over(order) - 1
    placed = pieces.select("conv_id", nth.alias("nth"), "own", "piece", "at", "n", start.alias("start"))
    listed = F.sort_array(F.collect_list(F.struct("nth", "piece", "own", "at", "n", "start")))
    return placed.groupBy("conv_id").agg(listed.alias("p")).select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["own"]), lambda x: F.struct(x["nth"].cast("int").alias("turn"), x["at"].cast("long").alias("at"), (x["start"] + x["at"]).cast("long").alias("start"), x["n"].cast("long").alias("length"))).alias("loss"),
    )


def format_log(log: DataFrame) -> DataFrame:
    return render(messages(log))


def parse(formatted: DataFrame) -> DataFrame:
    """Read renderings back: conv_id, turns (role, text), loss_texts, formatted."""
    pieces = F.slice(F.split("formatted", "<\\|im_start\\|>"), 2, F.lit(2**31 - 1))
    cut = formatted.select("conv_id", "formatted", "loss", pieces.alias("p"))
    role = lambda x: unescape_role(F.substring_index(x, "\n", 1))
    body = lambda x: F.substring(x, F.char_length(F.substring_index(x, "\n", 1)) + 2, F.char_length(x) - F.char_length(F.substring_index(x, "\n", 1)) - 1 - len(CLOSE))
    # a span is cut out of its own turn's piece: the piece follows OPEN, which the place counts
    masked = F.transform("loss", lambda s: unescape(F.substring(F.element_at("p", s["turn"] + 1), (s["at"] - len(OPEN) + 1).cast("int"), s["length"].cast("int"))))
    return cut.select("conv_id", "formatted", F.transform("p", lambda x: F.struct(role(x).alias("role"), unescape(body(x)).alias("text"))).alias("turns"), masked.alias("loss_texts"))


def digests(parsed: DataFrame) -> DataFrame:
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def log_of(conversations: DataFrame) -> DataFrame:
    """Stored conversations as a log: each row opens its turn with one delta.

    Turns are numbered by turn, role and text, so rows of equal turn stay apart.
    """
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")
    return rows.select("conv_id", nth.alias("turn"), nth.alias("seq"), F.lit("delta").alias("kind"), "role", "text")


def history_of(conversations: DataFrame) -> DataFrame:
    """Stored conversations as a log in which every message has a history that folds to it.

    All turns are drafted first, by a delta each. Then they come again in order: an assistant's
    message is regenerated (which voids the drafts of all later turns), any other is edited, with
    the first half of its text, and a delta streams the rest.
    """
    rows = log_of(conversations).drop("seq", "kind")
    n = F.char_length(F.coalesce("text", F.lit("")))
    half = F.floor(n / 2).cast("int")
    first, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, n)
    again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    event = lambda step, kind, text: F.struct((F.col("turn") * 2 + F.lit(step)).alias("seq"), kind.alias("kind"), text.alias("text"))
    later = 1 << 40  # behind all drafts
    events = F.array(event(0, F.lit("delta"), F.concat(F.lit("draft of "), F.coalesce("text", F.lit("")))), event(later, again, first), event(later + 1, F.lit("delta"), rest))
    return rows.select("conv_id", "turn", "role", F.explode(events).alias("e")).select("conv_id", "turn", "e.seq", "e.kind", "role", "e.text")
