"""URL filter: host and path rules, then a blocked Bloom filter of listed canonical URLs before an exact join.

Only DataFrame expressions are used. The filter is a table of 256-bit blocks, four 64-bit words each; a URL sets one bit
in every word of one block. Pages whose four bits are set are possible hits; only these go to the exact hash join, which
removes false positives. The block table is broadcast behind a check of its row count, beyond that it is joined by block.
The distinct canonical URLs of the list are written once, for the filter and for the join.

Defined cases: a null url, or one without "://", has empty host and path and no canonical form, so no rule fits and it
is not listed. Null or repeated list entries count once or not at all. Repeated pages are judged each. An empty page
table gives no rows, an empty list blocks nothing. Only the id and url columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import ascii_lower, bounded, scratch

#: Bits of the filter for each listed URL.
BITS_PER_URL = 20
WORDS = 4

#: Query parameters that say where a visitor came from, not what is shown.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host without www. or m., path without its last slash, query without tracking parameters; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"/$", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(_rest(url).isNotNull(), F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null if none does. A rule is (verdict, host/path)."""
    name = verdict = None
    for said, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + rest)
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    null = F.lit(None).cast("string")
    return (null, null) if name is None else (name, verdict)


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _masks(url: Column) -> list[Column]:
    spread = F.xxhash64(url, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * i).bitwiseAND(63).cast("int")) for i in range(WORDS)]


def bloom_table(listed: DataFrame, col: str, blocks: int) -> DataFrame:
    """(_block, _w0.._w3): the blocks that have a bit set."""
    return listed.groupBy(_block(F.col(col), blocks).alias("_block")).agg(*(F.bit_or(m).alias(f"_w{i}") for i, m in enumerate(_masks(F.col(col)))))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", list_col: str = "url") -> DataFrame:
    """Per page: id, host, path, rule, verdict (the rule's; else block if its canonical URL is listed, allow if not), listed."""
    names = scratch(pages.sparkSession, listed.select(canonical(F.col(list_col)).alias("_canon")).where("_canon is not null").distinct(), "listed")
    blocks = max(1, -(-names.count() * BITS_PER_URL // (64 * WORDS)))
    bloom = bounded(bloom_table(names, "_canon", blocks))
    url = F.col(url_col)
    page = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("_canon"))
    bits = [F.col(f"_w{i}").bitwiseAND(m) == m for i, m in enumerate(_masks(F.col("_canon")))]
    maybe = F.coalesce(bits[0] & bits[1] & bits[2] & bits[3], F.lit(False))
    probed = page.withColumn("_block", _block(F.coalesce("_canon", F.lit("")), blocks)).join(bloom, "_block", "left").withColumn("_maybe", maybe & F.col("_canon").isNotNull()).select(id_col, "host", "path", "_canon", "_maybe")
    sure = probed.where("not _maybe").select(id_col, "host", "path", F.lit(False).alias("listed"))
    hit = probed.where("_maybe").join(names.withColumn("_in", F.lit(True)), "_canon", "left").select(id_col, "host", "path", F.coalesce("_in", F.lit(False)).alias("listed"))
    rule, said = rule_columns(F.col("host"), F.col("path"), rules)
    out = sure.unionByName(hit)
    return out.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
