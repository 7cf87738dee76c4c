"""Mixing to target weights (operator 7): hierarchical budgeting, DataFrame functions only.

A tree of domain, language and source carries integer weights at each level. The token
budget is poured down the tree: at each node children get shares by weight, a child that
holds less (its tokens times the allowed epochs) gets what it has, and what it leaves is
poured over its siblings first; a node is never given more than its children hold, so
only a shortage of a whole subtree goes to the siblings of an ancestor. The level at which
the water stands is found exactly by a running sum over siblings in order of capacity by
weight.

A leaf that is given e full epochs and a rest takes each of its rows e times and, from
epoch e, the rows in seeded order (md5 of seed, epoch, id and text) until the rest is
reached; the row that reaches it is taken whole. The order is cut by hash ranges: sums of a
range come first, and only the range in which the rest ends is sorted, so a leaf with a
third of all rows is never sorted in one task.

Defined results: null domain, language or source are nodes of their own; a node without
weight gets nothing; a null text has no token and is taken with the epochs of its leaf; an
empty table gives no row. Repeated rows are taken alike and ordered by their number.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEVELS = ("domain", "lang", "source")
#: Rows that a hash range of a leaf holds on average.
RANGE_ROWS = 256
#: Ranges of a leaf are at most two to this power, so their running sums are short.
MOST_BITS = 16
#: Leaves up to which the plan is broadcast (32 bytes each).
BROADCAST_LEAVES = 50_000


@dataclass
class Recipe:
    """Integer weights by value of each level (``default`` where a value isn't named)."""

    budget_tokens: int | None = None
    budget_percent: int = 60
    max_epochs: int = 2
    seed: int = 17
    domain: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "forums": 20})
    lang: dict[str, int] = field(default_factory=lambda: {"en": 55, "de": 15, "fr": 15, "es": 15})
    source: dict[str, int] = field(default_factory=dict)
    default: int = 10


def domain_of(source: Column) -> Column:
    """The domain of a numbered source: web below 8 or without one, books below 14, forums from there."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("int")
    return F.when(F.coalesce(number, F.lit(0)) < 8, F.lit("web")).when(number < 14, F.lit("books")).otherwise(F.lit("forums"))


def word_tokens(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _weight(recipe: Recipe, level: str) -> Column:
    out = F.lit(recipe.default).cast("long")
    for value, weight in getattr(recipe, level).items():
        out = F.when(F.col(level) == value, F.lit(weight).cast("long")).otherwise(out)
    return out


def pour(children: DataFrame, parents: list[str], tie: str) -> DataFrame:
    """given: the share of ``available`` that each child of a parent gets.

    children: parents' columns, tie, w, cap (longs), available (the parent's amount). Children
    are saturated in order of cap / w; the first that isn't fixes the level for the rest.
    """
    # capacity per weight, exact to 2**-53; a child without weight comes last and gets nothing
    ratio = F.when(F.col("w") > 0, F.col("cap").cast("double") / F.col("w").cast("double"))
    order = Window.partitionBy(*parents).orderBy(F.col("ratio").asc_nulls_last(), F.col(tie).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parents)
    c = F.col
    x = children.withColumn("ratio", ratio)
    x = x.withColumn("full_before", F.coalesce(F.sum("cap").over(before), F.lit(0).cast("long"))).withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0).cast("long")))
    level = F.when(c("w_left") > 0, (c("available") - c("full_before")).cast("double") / c("w_left").cast("double"))
    x = x.withColumn("level", level).withColumn("fills", (c("w") > 0) & (c("ratio") <= c("level")))
    # the level at the first child that doesn't fill up holds for it and all after it
    x = x.withColumn("stands", F.first(F.when(~c("fills"), c("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    given = F.when(c("w") <= 0, F.lit(0)).when(c("fills"), c("cap")).otherwise(F.least(c("cap"), F.floor(c("stands") * c("w").cast("double"))))
    return x.withColumn("given", F.greatest(given, F.lit(0)).cast("long")).drop("ratio", "full_before", "w_left", "level", "fills", "stands")


def leaf_budgets(leaves: DataFrame, recipe: Recipe) -> DataFrame:
    """leaves (domain, lang, source, n_rows, tokens) with ``given`` tokens each."""
    x = leaves.withColumn("cap", F.col("tokens") * recipe.max_epochs)
    sums = [F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))).alias("cap"), F.sum("tokens").alias("tokens")]
    low = x.withColumn("w", _weight(recipe, "source"))
    mid = low.groupBy("domain", "lang").agg(*sums).withColumn("w", _weight(recipe, "lang"))
    top = mid.groupBy("domain").agg(*sums).withColumn("w", _weight(recipe, "domain"))
    whole = F.floor(F.sum("tokens").over(Window.partitionBy("root")) * recipe.budget_percent / 100)  # over the domains: a few rows
    top = top.withColumn("root", F.lit(0)).withColumn("available", whole.cast("long") if recipe.budget_tokens is None else F.lit(recipe.budget_tokens).cast("long"))
    top = pour(top, ["root"], "domain").select(F.col("domain").alias("domain1"), F.col("given").alias("available"))
    mid = mid.join(top, F.col("domain").eqNullSafe(F.col("domain1"))).drop("domain1")
    mid = pour(mid, ["domain"], "lang").select(F.col("domain").alias("domain1"), F.col("lang").alias("lang1"), F.col("given").alias("available"))
    low = low.join(mid, F.col("domain").eqNullSafe(F.col("domain1")) & F.col("lang").eqNullSafe(F.col("lang1"))).drop("domain1", "lang1")
    return pour(low, ["domain", "lang"], "source").drop("cap", "w", "available")


def mix(docs: DataFrame, recipe: Recipe | None = None, tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, epochs (times taken, 0 too) for every row of docs."""
    return _decided(docs, recipe or Recipe(), tokens, domain, False).select("doc_id", *LEVELS, "n_tokens", "epochs")


def take(docs: DataFrame, recipe: Recipe | None = None, tokens: Column | None = None, domain: Column | None = None) -> DataFrame:
    """The rows of docs that are taken at least once, columns unchanged."""
    return _decided(docs, recipe or Recipe(), tokens, domain, True).filter("epochs > 0").select("row.*")


def _decided(docs: DataFrame, recipe: Recipe, tokens: Column | None, domain: Column | None, whole: bool) -> DataFrame:
    """The measures and epochs of each row of docs, whole: with the row itself as ``row``; rows stay where they are."""
    c = F.col
    text, lang, source = c("text").cast("string"), c("lang").cast("string"), c("source").cast("string")
    measured = docs.select(
        F.struct(*[docs[x] for x in docs.columns]).alias("row"), c("doc_id").cast("long").alias("doc_id"), (domain if domain is not None else domain_of(source)).alias("domain"), lang.alias("lang"), source.alias("source"),
        (tokens if tokens is not None else word_tokens(text)).cast("long").alias("n_tokens"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("text_md5"),
    )
    leaf = F.xxhash64(*[F.coalesce(c(x), F.lit("")) for x in LEVELS], *[c(x).isNull() for x in LEVELS])
    measured = measured.withColumn("leaf", leaf)
    # texts are measured once for the sums, which run over the narrow table
    narrow = stored(measured.select("leaf", *LEVELS, "doc_id", "text_md5", "n_tokens"))
    leaves = narrow.groupBy(*LEVELS).agg(F.count("*").alias("n_rows"), F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, recipe)
    width = F.least(F.greatest(F.ceil(F.log2(F.greatest(c("n_rows").cast("double") / RANGE_ROWS, F.lit(1.0)))), F.lit(0)), F.lit(MOST_BITS)).cast("int")
    plan = budgets.select(*LEVELS, F.when(c("tokens") > 0, F.floor(c("given") / c("tokens"))).otherwise(F.lit(0)).cast("long").alias("full"), width.alias("width"), "tokens", "given")
    plan = stored(plan.select(leaf.alias("leaf"), "full", "width", (c("given") - c("full") * c("tokens")).alias("rest")))
    small = plan.count() <= BROADCAST_LEAVES  # beyond that a shuffle join, whose hot leaves AQE splits
    sent = lambda x: F.broadcast(x) if small else x
    drawn = F.md5(F.concat_ws("|", F.lit(recipe.seed), c("full"), F.coalesce(c("doc_id").cast("string"), F.lit("")), "text_md5").cast("binary"))

    # the hash range in which a leaf's rest ends: one row a leaf
    ranged = narrow.join(sent(plan.filter("rest > 0")), "leaf").withColumn("drawn", drawn).withColumn("range", F.expr("shiftright(cast(conv(substring(drawn, 1, 8), 16, 10) AS bigint), 32 - width)"))
    sums = ranged.groupBy("leaf", "range", "rest").agg(F.sum("n_tokens").alias("in_range"))
    upto = Window.partitionBy("leaf").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = sums.withColumn("before", F.coalesce(F.sum("in_range").over(upto), F.lit(0))).filter("before < rest and rest <= before + in_range")
    ends = stored(ends.select("leaf", "range", "before"))
    # only that range is put in order; the last row that begins before the rest is reached is the cut
    entries = ranged.join(sent(ends), ["leaf", "range"]).groupBy("leaf", "before", "rest", "drawn").agg(F.sum("n_tokens").alias("n"))
    inside = Window.partitionBy("leaf").orderBy("drawn").rowsBetween(Window.unboundedPreceding, -1)
    start = c("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    cuts = entries.withColumn("start", start).filter(c("start") < c("rest")).groupBy("leaf").agg(F.max("drawn").alias("cut"))
    cuts = stored(plan.join(cuts, "leaf", "left").select("leaf", "full", "cut"))
    more = F.coalesce((drawn <= c("cut")).cast("long"), F.lit(0))
    return (measured if whole else narrow).join(sent(cuts), "leaf").withColumn("epochs", c("full") + more)
