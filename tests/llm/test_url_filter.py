from pyspark.sql import functions as F

from sievemill.llm import queries
from sievemill.llm import url_filter as uf


def test_query_equals_sql(compare):
    compare(queries.op10_url_filter, queries.OP10_SQL)
    compare(queries.op10_url_filter, queries.OP10_SQL, "/root/testdata/sf0.1")


def test_rules_and_forms(spark):
    urls = [None, "no scheme", "http://EXAMPLE.com/en/1", "https://www.Example.com/en/", "http://a.b.example.com?x#y", "ftp://x.net/es/a", "http://net/fr/", "http://internet/fr/", "http://com/", "http://com", "http://xcom/", "://h/p?q", "http://example.com/en"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.filter_urls(pages, pages.limit(0), queries.URL_RULES).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("example.com", "/en/1", "example.com/en/", "block"), 3: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 4: ("a.b.example.com", "", None, "allow"),
        5: ("x.net", "/es/a", "net/es/", "block"), 6: ("net", "/fr/", "net/fr/", "block"), 7: ("internet", "/fr/", None, "allow"), 8: ("com", "/", "com/", "allow"), 9: ("com", "", None, "allow"), 10: ("xcom", "/", None, "allow"), 11: ("h", "/p", None, "allow"), 12: ("example.com", "/en", "com/", "allow"),
    }


def test_list_is_exact(spark, monkeypatch):
    listed = spark.createDataFrame([(f"http://www.site{i}.org/a/{i}/?utm_source=x",) for i in range(300)] * 2 + [(None,), ("bad",)], "url string")
    pages = spark.createDataFrame([(i, f"https://site{i}.org/a/{i}#top") for i in range(600)] + [(1, "https://site1.org/a/1")], "page_id long, url string")
    want = {(i, i < 300) for i in range(600)}
    for bits in (20, 1):  # with one bit a URL the filter passes many that are not listed
        monkeypatch.setattr(uf, "BITS_PER_URL", bits)
        got = uf.filter_urls(pages, listed, ()).collect()
        assert len(got) == 601 and {(r["page_id"], r["verdict"] == "block") for r in got} == want
    monkeypatch.setattr(uf, "bounded", lambda df: df)
    assert {(r["page_id"], r["listed"]) for r in uf.filter_urls(pages, listed, ()).collect()} == want
    assert uf.filter_urls(pages.limit(0), listed, ()).count() == 0


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    rows = spark.range(4000).select(F.concat(F.lit("h.org/"), "id").alias("u"))
    blocks = 4000 * uf.BITS_PER_URL // 256
    table = uf.bloom_table(rows.where("u < 'h.org/5'"), "u", blocks)
    hit = rows.withColumn("_block", uf._block(F.col("u"), blocks)).join(table, "_block", "left")
    for i, m in enumerate(uf._masks(F.col("u"))):
        hit = hit.where(F.col(f"_w{i}").bitwiseAND(m) == m)
    inside = rows.where("u < 'h.org/5'").count()
    assert hit.where("u < 'h.org/5'").count() == inside and hit.count() - inside <= 40


def test_main_path_is_native(spark):
    plan = queries.op10_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct"))
