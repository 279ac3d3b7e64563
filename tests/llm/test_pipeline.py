"""The pipeline against its stages done in plain Python, where a stage has a brute-force version."""

import corpus_pipeline as cp
from sievemill.llm import quality
from tests.llm.test_jaccard import brute as near
from tests.llm.test_line_dedup import brute as lines

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if name != cp.STAGES[-1][0]:
            assert docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    before, after = map(text, seen["quality"])
    scorer = quality.train(seen["quality"][0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert after == {i: t for i, t in before.items() if scorer.score(t or "") >= 0.5}
    before, after = map(text, seen["line_dedup"])
    assert after == {i: t for i, t, gone in lines(list(before.items())) if not gone or t}
    before, after = map(text, seen["near_duplicates"])
    assert after == {i: before[i] for i, (_, c) in near(list(before.items())).items() if c == i}
    kept = {r["doc_id"] for r in seen["sentencepiece"][1].collect()}
    assert kept == set(text(seen["decontamination"][1]))
    final = cp.run(spark, SF)
    assert sorted(tuple(r) for r in final.collect()) == sorted(tuple(r) for r in seen["sentencepiece"][1].select(*final.columns).collect())


def test_stages_on_odd_rows(spark, prose):
    """Nulls in any column, empty and very long texts, repeated rows, columns with clashing names, and no rows at all."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, _ld_removed string, ids string, score string, n_shingles long, component_id long"
    leak = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    extra = ("a", "b", "c", 1, 2)
    texts = [(1, prose(200, 1)), (1, prose(200, 1)), (2, None), (3, ""), (4, prose(30000, 2)), (None, prose(80, 3)), (None, None), (5, f"{prose(60, 4)}\n{leak}"), (None, f"{prose(60, 5)}\n{leak}"), (6, "one"), (7, prose(200, 1))]
    rows = spark.createDataFrame([(i, t, None, None, None, *extra) for i, t in texts], schema)
    sf = "/root/testdata/sf0.001"
    none = rows.limit(0)
    for name, stage in cp.STAGES[:-1]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns and stage(spark, none, sf).count() == 0, name
        assert all(tuple(r)[5:] == extra for r in got.collect()), name
    near = [r["doc_id"] for r in cp.near_duplicate_stage(spark, rows, sf).collect()]
    assert 7 not in near and near.count(1) == 2 and near.count(None) == 3
    left = [(r["doc_id"], r["text"]) for r in cp.decontamination_stage(spark, rows, sf).collect()]
    assert len(left) == 9 and not any(leak in (t or "") for _, t in left)
    last = cp.STAGES[-1][1](spark, rows, sf)
    assert last.count() == len(texts) and cp.STAGES[-1][1](spark, none, sf).count() == 0
