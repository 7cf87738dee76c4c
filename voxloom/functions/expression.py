"""Infix arithmetic over named columns, compiled to one Column.

Grammar, loosest first: ``or``, ``and``, comparisons, ``+ -``, ``* /``, unary ``-``,
``^``, calls. Comparisons and logic give 1 or 0, as arithmetic on images expects. Catalyst
folds constants and compiles the result with the rest of the plan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(>=|<=|==|!=|[-+*/^()<>,]))")


def _whole(f, x: Column) -> Column:
    """floor or ceil as a double; values beyond 2**53 are whole already."""
    return F.when(F.abs(x) < 2.0**53, f(x).cast("double")).otherwise(x)


_CALLS = {
    "cos": F.cos, "sin": F.sin, "tan": F.tan, "ceil": lambda x: _whole(F.ceil, x), "floor": lambda x: _whole(F.floor, x),
    "exp": F.exp, "round": lambda x: F.round(x, 0), "log": lambda x: F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))),
    "neg": lambda x: -x, "abs": F.abs, "sqrt": F.sqrt,
}
_BINARY = {"or": 1, "and": 2, ">": 3, ">=": 3, "==": 3, "!=": 3, "<=": 3, "<": 3, "+": 4, "-": 4, "*": 5, "/": 5, "^": 7}


class ExpressionError(ValueError):
    pass


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {text[at:at + 10]!r}")
        kind = ("number", "name", "sign")[next(k for k in range(3) if m[k + 1] is not None)]
        out.append((kind, m[m.lastindex]))
        at = m.end()
    return out


def _truth(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def _divide(a: Column, b: Column) -> Column:
    """Division as on plain doubles: x/0 is infinite or NaN instead of an error."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _apply(sign: str, a: Column, b: Column) -> Column:
    match sign:
        case "or":
            return _truth((a != 0) | (b != 0))
        case "and":
            return _truth((a != 0) & (b != 0))
        case ">":
            return _truth(a > b)
        case ">=":
            return _truth(a >= b)
        case "==":
            return _truth(a == b)
        case "!=":
            return _truth(a != b)
        case "<=":
            return _truth(a <= b)
        case "<":
            return _truth(a < b)
        case "+":
            return a + b
        case "-":
            return a - b
        case "*":
            return a * b
        case "/":
            return _divide(a, b)
        case _:
            return F.pow(a, b)


class _Parser:
    def __init__(self, text: str, names: Mapping[str, Column]):
        self.left, self.names, self.text = _tokens(text)[::-1], names, text

    def peek(self) -> str | None:
        return self.left[-1][1] if self.left else None

    def take(self, expected: str | None = None) -> tuple[str, str]:
        if not self.left or expected and self.left[-1][1] != expected:
            raise ExpressionError(f"{expected or 'a value'} is missing in {self.text!r}")
        return self.left.pop()

    def value(self) -> Column:
        kind, token = self.take()
        if kind == "number":
            return F.lit(float(token))
        if token == "(":
            inner = self.expression(0)
            self.take(")")
            return inner
        if token in "+-":
            inner = self.expression(6)
            return -inner if token == "-" else inner
        if kind == "name" and token in _CALLS and self.peek() == "(":
            self.take("(")
            inner = self.expression(0)
            self.take(")")
            return _CALLS[token](inner)
        if kind == "name" and token in self.names:
            return self.names[token].cast("double")
        raise ExpressionError(f"{token!r} isn't a value in {self.text!r}")

    def expression(self, least: int) -> Column:
        out = self.value()
        while (sign := self.peek()) in _BINARY and _BINARY[sign] >= least:
            self.take()
            out = _apply(sign, out, self.expression(_BINARY[sign] + (sign != "^")))
        return out


def compile_expression(text: str, names: Mapping[str, Column]) -> Column:
    parser = _Parser(text, names)
    out = parser.expression(0)
    if parser.left:
        raise ExpressionError(f"{parser.peek()!r} is left over in {text!r}")
    return out


def evaluate(images: Mapping[str, DataFrame], text: str, keys: tuple[str, ...] = ("x", "y", "z", "t"), value: str = "v") -> DataFrame:
    """The expression over images aligned on their coordinates (equi-joins; the first is the reference)."""
    out = None
    for name, image in images.items():
        own = image.select(*keys, F.col(value).alias(f"_{name}"))
        out = own if out is None else out.join(own, list(keys))
    return out.select(*keys, compile_expression(text, {n: F.col(f"_{n}") for n in images}).alias(value))
