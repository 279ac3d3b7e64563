"""Reading generated responses: the question envelope, boxed answers, finite sets, yes/no answers.

Brackets nest, which regular expressions of the JVM cannot follow; the recursive patterns of the regex library can, in
Arrow-batched UDFs. Everything else about a response is decided by the place and order of its markers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.vocab import DOMAINS, SET_ITEMS

#: Markers of the envelope.
THINK = re.compile(r"\A\s*<think>.*?</think>\s*", re.DOTALL)
MARKER = re.compile(r"</?(?:question|domain)>|\\boxed\{")
EMPTY_SETS = (r"\emptyset", r"\varnothing", "∅", "{}", r"\{\}", "[]")
YES, NO = ("yes", "true", "1"), ("no", "false", "0")

_BOX = regex.compile(r"\\boxed\{(?P<c>(?:[^{}]++|\{(?&c)\})*+)\}")
_ENVELOPE = re.compile(r"<question>(?P<q>.*?)</question>(?P<rest>.*)", re.DOTALL)
_TAGGED = re.compile(r"<(?P<d>%s)>\s*(?P<box>\\boxed\{.*)\s*</(?P=d)>" % "|".join(DOMAINS), re.DOTALL)
_DOMAIN = re.compile(r"<domain>(?P<d>.*?)</domain>\s*", re.DOTALL)
_BALANCED = regex.compile(r"(?P<g>(?:[^][{}()]++|\((?&g)\)|\[(?&g)\]|\{(?&g)\})*+)")
_TOP = regex.compile(r"[^][{}(),;]++|(?P<n>\((?:[^][{}()]++|(?&n))*+\)|\[(?:[^][{}()]++|(?&n))*+\]|\{(?:[^][{}()]++|(?&n))*+\})")

_WRAPPED = regex.compile(r"\\\{(?P<inner>.*)\\\}|\{(?P<inner>.*)\}|\[(?P<inner>.*)\]", regex.DOTALL)
_PART = r"(?P<item>(?:[^][{}(),;]++|(?&n))*+)"
_ITEMS = regex.compile(r"(?(DEFINE)(?P<n>\((?:[^][{}()]++|(?&n))*+\)|\[(?:[^][{}()]++|(?&n))*+\]|\{(?:[^][{}()]++|(?&n))*+\}))" + f"{_PART}(?:[,;]{_PART})*")

ENVELOPE_TYPE = "struct<question:string,domain:string,answer:string,reason:string>"


def last_boxed(text: str | None) -> str | None:
    """Content of the box that begins last among those that end; null if it is empty or there is none."""
    found = None
    for found in _BOX.finditer(text or "", overlapped=True):
        pass
    return (found["c"].strip() or None) if found else None


def _domain(text: str) -> tuple[str | None, str]:
    """(reason, "") or (None, domain) of a text that must begin with a domain block."""
    if not text.startswith("<domain>"):
        return "missing_domain_open", ""
    block = _DOMAIN.match(text)
    if not block:
        return "missing_domain_close", ""
    name = block["d"].strip()
    return (None, name) if name in DOMAINS else ("invalid_domain", "")


def read_envelope(response: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """(question, domain, answer, reason); either the first three or the reason is null."""

    def no(reason: str) -> tuple[None, None, None, str]:
        return None, None, None, reason

    if response is None:
        return no("response_not_string")
    text = THINK.sub("", response, count=1).strip()
    if not text.startswith("<question>"):
        return no("missing_question_open")
    parts = _ENVELOPE.fullmatch(text)
    if not parts:
        return no("missing_question_close")
    if text.count("<question>") > 1 or text.count("</question>") > 1:
        return no("multiple_question_blocks")
    rest = parts["rest"].strip()
    if tagged := _TAGGED.fullmatch(rest):
        rest = f"<domain>{tagged['d']}</domain>{tagged['box']}"
    if max(rest.count("<domain>"), rest.count("</domain>")) > 1:
        return no("multiple_domain_blocks")
    domain_first = rest.startswith("<domain>")
    if not domain_first and not rest.startswith(r"\boxed{"):
        return no("missing_domain_open")
    reason, domain = None, ""
    if domain_first:
        reason, domain = _domain(rest)
        if reason:
            return no(reason)
        rest = _DOMAIN.sub("", rest, count=1)
        if not rest.startswith(r"\boxed{"):
            return no("missing_boxed_answer")
    box = _BOX.match(rest)
    if not box:
        return no("unclosed_boxed_answer")
    rest = rest[box.end() :].strip()
    if not domain_first:
        reason, domain = _domain(rest)
        if reason:
            return no(reason)
        rest = _DOMAIN.sub("", rest, count=1)
    if MARKER.search(rest):
        return no("trailing_output")
    question, answer = " ".join(parts["q"].split()), box["c"].strip()
    if not question:
        return no("empty_question")
    return (question, domain, answer, None) if answer else no("empty_answer")


def plain_set(text: str) -> str:
    return text.strip().replace(r"\left", "").replace(r"\right", "")


def finite_set(value: str | None) -> list[str] | None:
    """Elements of a set written out, split at separators outside all brackets; null if it is none or too large."""
    text = plain_set(value or "")
    wrapped = _WRAPPED.fullmatch(text)
    inner = wrapped["inner"].strip() if wrapped else text
    if text in EMPTY_SETS or not inner:
        return []
    found = _ITEMS.fullmatch(inner)
    items = [x.strip() for x in found.captures("item")] if found else [""]
    return items if all(items) and len(items) <= SET_ITEMS else None


def boolean_word(value: str | None) -> str | None:
    text = (value or "").strip().lower()
    if text.startswith(r"\text{") and text.endswith("}") and "\n" not in text:
        text = text[len(r"\text{") : -1]
    text = text.strip("{}[]() .")
    return "Yes" if text in YES else "No" if text in NO else None


def balanced(text: str) -> bool:
    found = _BALANCED.fullmatch(text)
    return found is not None


def _udf(kind: str, f):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(f, na_action=None).astype(object)

    return run


def envelope(response: Column) -> Column:
    """Struct of question, domain, answer and reason."""

    @F.pandas_udf(ENVELOPE_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([read_envelope(x if isinstance(x, str) else None) for x in batch], columns=["question", "domain", "answer", "reason"], dtype=object)

    return run(response)


def boxed(response: Column) -> Column:
    return _udf("string", lambda x: last_boxed(x if isinstance(x, str) else None))(response)


def set_items(value: Column) -> Column:
    return _udf("array<string>", lambda x: finite_set(x if isinstance(x, str) else None))(value)


def boolean(value: Column) -> Column:
    """Yes, No or null, in Catalyst expressions."""
    text = F.lower(F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")))
    text = F.regexp_replace(F.regexp_replace(text, r"^\\text\{(.*)\}$", "$1"), r"^[{}\[\]() .]+|[{}\[\]() .]+$", "")
    return F.when(text.isin(*YES), "Yes").when(text.isin(*NO), "No")
