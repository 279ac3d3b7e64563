"""Prompt templates: text with $name places, and chat messages as arrays of (role, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

PLACE = re.compile(r"\$(\w+)")


def load_template(spark: SparkSession, path: str) -> str:
    text = spark.read.text(path, wholetext=True).first()
    if text is None or not text[0].strip():
        raise ValueError(f"empty template: {path}")
    return text[0].strip()


def render(template: str, **values: Column) -> Column:
    """The template with each place replaced; an unknown place is an error, and values are never read as templates."""
    parts, at = [], 0
    for m in PLACE.finditer(template):
        if m[1] not in values:
            raise KeyError(m[1])
        parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def messages(*turns: tuple[str, Column]) -> Column:
    return F.array(*(F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in turns))
