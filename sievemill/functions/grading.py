"""Typed equality of answers: exact rational arithmetic on a limited grammar, yes/no words, sets without order.

Expressions of numbers, decimals, percent signs, thousands separators, fractions, square roots of squares, powers with
whole exponents, products and sums are compared by value; any other pair is equal only if the texts are, spaces aside.
A failed or null comparison is false, never null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions import envelope

_CLEAN = [(re.compile(p), r) for p, r in ((r"\\left|\\right|\\!|\\,|\;|\\ |\$", ""), (r"\\[dt]?frac\s*(\d)\s*(\d)", r"((\1)/(\2))"), (r"\\cdot|\\times", "*"), (r"\\%|%", "/100"), (r"(?<=\d),(?=\d{3}(?!\d))", ""), (r"\\div", "/"))]
_TOKEN = re.compile(r"\s*(\d+\.\d*|\.\d+|\d+|\\[dt]?frac|\\sqrt|[-+*/^(){}])")
MOST_DIGITS = 400


class _Reader:
    def __init__(self, text: str):
        for pattern, by in _CLEAN:
            text = pattern.sub(by, text)
        self.tokens, at = [], 0
        text = text.strip().rstrip(".")
        while at < len(text):
            token = _TOKEN.match(text, at)
            if not token:
                raise ValueError(text[at:])
            self.tokens.append(token[1])
            at = token.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        token = self.peek()
        if not token or (wanted and token not in wanted):
            raise ValueError(token)
        self.at += 1
        return token

    def value(self) -> Fraction:
        out = self.sum()
        if self.peek():
            raise ValueError(self.peek())
        return out

    def sum(self) -> Fraction:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take() == "+" else out - self.product()
        return out

    def product(self) -> Fraction:
        out = self.signed()
        while self.peek() and self.peek() not in "+-)}":
            if self.peek() == "/":
                self.take()
                out /= self.signed()
            else:
                if self.peek() == "*":
                    self.take()
                elif self.peek()[0].isdigit():
                    raise ValueError("two numbers side by side")
                out *= self.signed()
        return out

    def signed(self) -> Fraction:
        if self.peek() in ("+", "-"):
            return self.signed() if self.take() == "+" else -self.signed()
        base = self.atom()
        if self.peek() == "^":
            self.take()
            power = self.group() if self.peek() in ("{", "(") else self.signed()
            if power.denominator != 1 or abs(power) > 64:
                raise ValueError("exponent")
            base **= int(power)
        return base

    def group(self) -> Fraction:
        end = {"{": "}", "(": ")"}[self.take("{", "(")]
        out = self.sum()
        self.take(end)
        return out

    def atom(self) -> Fraction:
        token = self.peek()
        if token in ("{", "("):
            return self.group()
        self.take()
        if token.endswith("frac"):
            over = self.group()
            return over / self.group()
        if token == "\\sqrt":
            x = self.group()
            a, b = math.isqrt(x.numerator) if x >= 0 else -1, math.isqrt(x.denominator)
            if a * a != x.numerator or b * b != x.denominator:
                raise ValueError("no square")
            return Fraction(a, b)
        return Fraction(token if token[0] != "." else "0" + token)


def number(text: str) -> Fraction | None:
    try:
        return _Reader(text).value() if len(text) <= MOST_DIGITS else None
    except (ValueError, ZeroDivisionError, RecursionError, KeyError):
        return None


def equal(a: str, b: str) -> bool:
    x, y = number(a), number(b)
    if x is not None and y is not None:
        return x == y
    return "".join(a.split()) == "".join(b.split())


def grade(answer: str | None, gold: str | None, mode: str | None) -> bool:
    """Whether an answer equals the reference under a verifier's mode; null mode: expression."""
    if answer is None or gold is None or not gold.strip():
        return False
    if (mode or "expression") == "boolean":
        return envelope.boolean_word(gold) is not None and envelope.boolean_word(answer) == envelope.boolean_word(gold)
    if mode == "set":
        left, right = envelope.finite_set(answer), envelope.finite_set(gold)
        if left is None or right is None or len(left) != len(right):
            return False
        for item in left:
            twin = next((x for x in right if equal(item, x)), None)
            if twin is None:
                return False
            right.remove(twin)
        return True
    return mode in (None, "expression") and equal(answer, gold)


def equivalent(a: str, b: str, mode: str | None) -> bool:
    return a.strip() == b.strip() or (grade(a, b, mode) and grade(b, a, mode))


def graded(answer: Column, gold: Column, mode: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, g, m in batches:
            yield pd.Series([grade(*(x if isinstance(x, str) else None for x in row)) for row in zip(a, g, m, strict=True)], dtype=bool)

    return run(answer, gold, mode)
