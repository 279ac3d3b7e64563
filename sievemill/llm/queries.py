"""The registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemill.llm import compact_windows, decontaminate, jaccard, license_scan, line_dedup, piece_codec, quality, sharding, url_filter, vector_tree
from sievemill.llm.common import table

SHARDS = 16

#: (verdict, host and path); fixed values of the query's contract.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: The query's list of URLs, kept apart from the pages that it judges: on each site, in each section, every other page up to
#: LISTED_PAGES, in forms that are not canonical.
LISTED_SITES = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org", "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org", "tionsh.example.net", "thther.example.org", "ththed.example.org")
LISTED_SECTIONS = ("en", "fr", "de", "es")
LISTED_PAGES = 1_000
LISTED_FORMS = ("/#top", ".html?utm_source=list", "?page=2&ref=x")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    removed = F.when(F.col("_ld_removed").isNull(), 0).otherwise(F.size("_ld_removed"))
    return out.select("doc_id", F.col("_ld_lines").alias("n_lines"), removed.alias("n_removed"), F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.passages(table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleave(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_tree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    every = lambda values: F.explode(F.array(*map(F.lit, values)))
    listed = spark.range(0, LISTED_PAGES, 2).select("id", every(LISTED_SITES).alias("site")).select("id", "site", every(LISTED_SECTIONS).alias("section")).select("id", "site", "section", every(LISTED_FORMS).alias("form"))
    return url_filter.filter_urls(pages, listed.select(F.format_string("https://www.%s/%s/%d%s", "site", "section", "id", "form").alias("url")), URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pieces": op2_pieces,
    "op3_line_dedup": op3_line_dedup,
    "op4_compact_windows": op4_compact_windows,
    "op5_jaccard": op5_jaccard,
    "op6_sharding": op6_sharding,
    "op7_quality": op7_quality,
    "op8_licenses": op8_licenses,
    "op9_vector_tree": op9_vector_tree,
    "op10_url_filter": op10_url_filter,
}

#: Brute force: words equal on one alignment, counted in every window of that alignment.
OP1_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') w FROM benchmark),
d AS (SELECT doc_id, unnest(w) t, generate_subscripts(w, 1) - 1 p FROM dw),
i AS (SELECT item_id, len(w) n, unnest(w) t, generate_subscripts(w, 1) - 1 q FROM iw),
e AS (SELECT doc_id, item_id, n, p - q o, q FROM d JOIN i USING (t)),
many AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, o) c FROM e),
-- a window is counted from each place up to four before an equal word, so that one that begins with changed words is seen
starts AS (SELECT DISTINCT doc_id, item_id, n, o, q - b AS s FROM many, (SELECT unnest(range(0, 5)) b) WHERE c >= least(n, 7) AND q - b >= 0 AND q - b <= greatest(n - 20, 0)),
sums AS (SELECT s.doc_id, s.item_id, s.n, s.o, s.s, count(*) m FROM starts s JOIN many e ON s.doc_id = e.doc_id AND s.item_id = e.item_id AND s.o = e.o AND e.q >= s.s AND e.q < s.s + 20 GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(m) AS INTEGER) AS matched, CAST(min(greatest(s + o, 0)) AS INTEGER) AS start
FROM sums WHERE m >= CASE WHEN n < 20 THEN n - n // 8 ELSE 16 END GROUP BY doc_id, item_id
"""

OP3_SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
r AS (SELECT doc_id, unnest(ls) x, generate_subscripts(ls, 1) - 1 i FROM l),
f AS (SELECT doc_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') t FROM r),
w AS (SELECT doc_id, i, t, lead(t, 1) OVER d t2, lead(t, 2) OVER d t3, lead(i, 1) OVER d i2, lead(i, 2) OVER d i3 FROM f WHERE t <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT *, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id, i) k FROM w WHERE t3 IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest([i, i2, i3]) i FROM n WHERE k > 1),
k AS (SELECT r.doc_id, string_agg(CASE WHEN g.i IS NULL THEN r.x END, chr(10) ORDER BY r.i) txt, count(g.i) c FROM r LEFT JOIN g USING (doc_id, i) GROUP BY r.doc_id)
SELECT l.doc_id, CAST(len(ls) AS INTEGER) AS n_lines, CAST(c AS INTEGER) AS n_removed,
  md5(CASE WHEN c = 0 THEN text WHEN regexp_replace(coalesce(txt, ''), '\s+', '', 'g') = '' THEN '' ELSE txt END) AS text_md5
FROM l JOIN k USING (doc_id)
"""

OP10_SQL = rf"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END x FROM pages),
p AS (SELECT page_id, x, coalesce(translate(regexp_extract(x, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host, coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') path FROM r),
c AS (SELECT *, array_to_string(list_filter(string_split(regexp_extract(x, '^[^?#]*\?([^#]*)', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$')), '&') q FROM p),
n AS (SELECT *, CASE WHEN x IS NOT NULL THEN regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END canon FROM c),
listed AS (SELECT unnest([{", ".join(f"'{x}'" for x in LISTED_SITES)}]) || '/' || section || '/' || page || form AS canon FROM (SELECT unnest([{", ".join(f"'{x}'" for x in LISTED_SECTIONS)}]) AS section), (SELECT unnest(range(0, {LISTED_PAGES}, 2)) AS page), (SELECT unnest(['', '.html', '?page=2']) AS form)),
j AS (SELECT n.*, listed.canon IS NOT NULL AS listed,
  CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM n LEFT JOIN listed USING (canon))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM j
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op3_line_dedup": OP3_SQL, "op10_url_filter": OP10_SQL}
