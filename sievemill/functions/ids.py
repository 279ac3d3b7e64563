"""Canonical text, content ids and derived seeds as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode knows it, and the four separators that Java's class leaves out.
SPACE = r"(?U)[\s\x1c-\x1f]+"
ID_DIGITS = 20


def canonical(text: Column) -> Column:
    """Runs of white space become one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def normalized(text: Column) -> Column:
    return F.lower(canonical(text))


def quoted(text: Column) -> Column:
    """A string as JSON text."""
    inner = F.to_json(F.array(text))
    return F.substring(inner, F.lit(2), F.length(inner) - 2)


def bare(number: Column) -> Column:
    """An integer as JSON text."""
    return number.cast("long").cast("string")


def json_list(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first digits of the SHA-256 of the parts, given as JSON texts (quoted, bare)."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(json_list(*parts), 256), 1, ID_DIGITS))


def problem_id(question: Column) -> Column:
    return stable_id("problem", quoted(normalized(question)))


def derived_seed(master: Column, namespace: str, iteration: Column, index: Column) -> Column:
    """31 bits of the SHA-256 of [master, namespace, iteration, index]."""
    digest = F.sha2(json_list(bare(master), quoted(F.lit(namespace)), bare(iteration), bare(index)), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long").bitwiseAND(0x7FFFFFFF)


def content_hash(value: Column) -> Column:
    """SHA-256 of a value's JSON; for structs, name the fields in ascending order."""
    return F.sha2(F.to_json(value), 256)


def candidate_id(question: Column, answer: Column) -> Column:
    return stable_id("cand", quoted(normalized(question)), quoted(F.regexp_replace(answer, r"(?U)^\s+|\s+$", "")))
