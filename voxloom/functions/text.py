"""Text fields as columns: trimming, splitting, numbers with junk, delimiter detection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiter sets in the order in which they are tried; the last that fits wins.
DELIMITERS = (";", " \t", ",")


def chomp(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_line(line: Column, delimiters: str) -> Column:
    """Fields between any of the delimiters, trimmed, empty ones dropped."""
    pattern = "[" + "".join(re.escape(c) for c in delimiters) + "]"
    return F.filter(F.transform(F.split(line, pattern), chomp), lambda f: f != "")


def to_number(text: Column) -> Column:
    """The number that the text begins with; 0 where it begins with none."""
    head = F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def to_integer(text: Column) -> Column:
    """An integer in decimal, hexadecimal (0x) or octal (leading 0); null otherwise."""
    t = F.lower(chomp(text))
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    body = F.regexp_replace(t, r"^[+-]", "")
    hexed = F.conv(F.regexp_extract(body, r"^0x([0-9a-f]+)$", 1), 16, 10).try_cast("long")
    octal = F.conv(F.regexp_extract(body, r"^0([0-7]+)$", 1), 8, 10).try_cast("long")
    return sign * F.when(body.rlike(r"^0x[0-9a-f]+$"), hexed).when(body.rlike(r"^0[0-7]+$"), octal).when(body.rlike(r"^[0-9]+$"), body.try_cast("long"))


def is_text(content: Column) -> Column:
    """Whether all bytes are tab, line breaks or printable ASCII."""
    return F.hex(content).rlike("^(?:09|0A|0D|[2-6][0-9A-F]|7[0-9A-E])*$")


def dirname(path: Column) -> Column:
    return F.when(path.rlike("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def is_row(column: str = "value", comment: str = "#") -> Column:
    """Whether a line holds fields: neither blank nor a comment."""
    return ~chomp(F.col(column)).startswith(comment) & (chomp(F.col(column)) != "")


def sniff_delimiter(lines: DataFrame, column: str = "value", comment: str = "#") -> str:
    """The last delimiter set under which all lines have one constant width over 1; one aggregate."""
    kept = lines.filter(is_row(column, comment))
    widths = [F.size(parse_line(F.col(column), d)) for d in DELIMITERS]
    row = kept.agg(*[F.min(w) for w in widths], *[F.max(w) for w in widths]).first()
    n = len(DELIMITERS)
    found = [d for k, d in enumerate(DELIMITERS) if row[k] is not None and row[k] == row[k + n] and row[k] > 1]
    return found[-1] if found else DELIMITERS[-1]


def parse_table(lines: DataFrame, delimiters: str | None = None, column: str = "value", comment: str = "#") -> DataFrame:
    """lines with ``fields``, without comments and blank lines."""
    delimiters = delimiters or sniff_delimiter(lines, column, comment)
    kept = lines.filter(is_row(column, comment))
    return kept.withColumn("fields", parse_line(F.col(column), delimiters))
