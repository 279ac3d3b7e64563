import zlib
from collections import Counter

from sievemill.llm import queries, sharding


def check(rows, shards, total):
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == total and (not total or max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1)
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))


def test_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op6_sharding(spark, "/root/testdata/sf0.01").collect()
    check(rows, 16, len(docs))
    for r in rows:
        raw = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    per = Counter((r["source"], r["shard"]) for r in rows)
    for s in {r["source"] for r in rows}:
        n = sum(v for (x, _), v in per.items() if x == s)
        assert all(abs(per[s, k] - n / 16) <= 2 for k in range(16))


def test_same_for_every_layout_and_range(spark, monkeypatch, docs, prose):
    rows = [(i, prose(3, i)) for i in range(500)]
    one = sorted(map(tuple, sharding.interleave(docs(rows), 7).collect()))
    monkeypatch.setattr(sharding, "RANGE_ROWS", 10)
    assert sorted(map(tuple, sharding.interleave(docs(rows[::-1]).repartition(9), 7).collect())) == one
    assert one != sorted(map(tuple, sharding.interleave(docs(rows), 7, seed=1).collect()))


def test_edges(docs):
    rows = [(1, None), (1, None), (None, "é"), (2, ""), (2, "")]
    got = sharding.interleave(docs(rows, "shard"), 16).collect()
    check(got, 16, 5)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == [(1, 0)] * 4 + [(3, zlib.crc32("é".encode()))]
    assert sharding.interleave(docs([]), 16).count() == 0


def test_order_equals_brute_force(spark):
    """Rows in hash order within their source, by fractional rank, cut into equal runs."""
    from fractions import Fraction

    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.col("source").alias("s")).select("doc_id", "s", F.crc32("t").alias("c")).withColumn("u", F.shiftrightunsigned(F.xxhash64(F.lit(42), "doc_id", "c"), 1)).collect()
    by: dict = {}
    for r in sorted(hashed, key=lambda r: (r["u"], r["doc_id"])):
        by.setdefault(r["s"], []).append(r)
    rows = sorted((Fraction(2 * k + 1, 2 * len(own)), "" if s is None else "+" + s, r["u"], r["doc_id"]) for s, own in by.items() for k, r in enumerate(own))
    n, want, seen = len(rows), {}, Counter()
    for g, r in enumerate(rows):
        shard = g * 16 // n
        want[r[3]] = (shard, seen[shard])
        seen[shard] += 1
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in queries.op6_sharding(spark, "/root/testdata/sf0.01").collect()} == want
