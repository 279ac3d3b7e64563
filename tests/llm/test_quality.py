import zlib

from sievemill.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op7_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    for label, least in ((1, 0.985), (0, 0.95)):
        own = [r for r in rows if r["quality"] == label]
        assert sum(r["predicted"] == label for r in own) / len(own) >= least
    assert all(0 <= r["score"] <= 1 and (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)


def test_held_out_labels_are_not_learnt(spark, docs, prose):
    rows = [(i, prose(60, i) if i % 2 else " ".join(w.upper() + "!!" for w in prose(60, i).split())) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    turned = spark.createDataFrame([(i, (i + (zlib.crc32(str(i).encode()) % 3 == 1)) % 2) for i, _ in rows], "doc_id long, quality int")
    one, two = quality.train(docs(rows), labels), quality.train(docs(rows), turned)
    assert one.__getstate__() == two.__getstate__()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(rows, "score"), one).collect()}
    assert sum((got[i] >= 0.5) == bool(i % 2) for i, _ in rows) >= 297


def test_edges(spark, docs, prose):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, None), (2, ""), (None, "x"), (3, prose(30000, 1)), (3, "y")]
    scorer = quality.train(docs(rows), labels)
    got = quality.score(docs(rows), scorer).collect()
    assert len(got) == 5 and {r["score"] for r in got} == {0.5} and quality.keep_good(docs(rows), scorer).count() == 5
    assert quality.score(docs([]), scorer).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 5)], "doc_id long, quality int")
    assert quality.train(docs(rows), odd).weights == ()


def test_scores_keep_the_share_when_the_sample_is_cut(spark, docs, prose, monkeypatch):
    """Texts that tell nothing of their label get the share of good labels, of which the sample takes as many as bad ones."""
    monkeypatch.setattr(quality, "FIT_ROWS", 150)
    rows = [(i, prose(60, i)) for i in range(1800)]
    labels = spark.createDataFrame([(i, int(i % 7 != 0)) for i, _ in rows], "doc_id long, quality int")
    got = [r["score"] for r in quality.score(docs(rows), quality.train(docs(rows), labels)).collect()]
    assert 0.78 <= sum(got) / len(got) <= 0.92
