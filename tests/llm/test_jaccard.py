import random
import re

import numpy as np
import pytest

from sievemill.llm import jaccard as j
from sievemill.llm import queries, shingles


def shingle_sets(rows):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = shingle_sets(rows)
    low = {i: i for i in sets}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    order = sorted(sets)
    for a in order:
        for b in order:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def check(df, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}
    want = brute(rows)
    assert got == want, [(i, got.get(i), want[i]) for i in want if got.get(i) != want[i]][:5]


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(queries.op5_jaccard(spark, "/root/testdata/sf0.001"), rows)


def test_families_equal_brute_force(docs, prose):
    """Chains, large families, sizes at the edge of the threshold, shared passages, copies and short texts."""
    rng = random.Random(5)
    rows, passage = [], prose(12, 999)
    for family in range(6):
        base = prose(rng.randrange(6, 90), family).split()
        for _ in range(rng.randrange(2, 25)):
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = f"w{rng.randrange(99)}"
            text = text[: len(text) - rng.randrange(3)]
            rows.append(" ".join(text) + (" " + passage if rng.random() < 0.5 else ""))
    chain = prose(60, 50).split()
    rows += [" ".join(chain[k : k + 45]) for k in range(0, 16, 2)]
    rows += [passage, passage.upper(), "one two", "one  two", "One\ttwo", "one", None, "", " \n", "a b c d e", "a b c d e f", "same " * 50, "same " * 9]
    rows = [(100 + 3 * i, t) for i, t in enumerate(rng.sample(rows, len(rows)))]
    check(j.classes(docs(rows, "n_shingles")), rows)


@pytest.mark.parametrize(("tile", "look"), [(256, 1 << 19), (4, 50)])
def test_families_around_the_threshold(docs, prose, monkeypatch, tile, look):
    """Altered copies of a text that is not there, many of them a little under the threshold to each other, of several sizes, in one tile and in many."""
    monkeypatch.setattr(j, "TILE", tile)
    monkeypatch.setattr(j, "LOOK", look)
    rng = random.Random(9)
    rows = []
    for family in range(4):
        base = prose(120, 70 + family).split()
        for _ in range(45):
            text = list(base)
            for _ in range(rng.choice((1, 2, 3, 3))):
                text[rng.randrange(120)] = f"z{rng.randrange(6)}"
            rows.append(" ".join(text[rng.randrange(3) : 120 - rng.choice((0, 0, 9, 14))]))
    rows = list(enumerate(rows, 10))
    assert len({v for _, v in brute(rows).values()}) > 20
    check(j.classes(docs(rows)), rows)


def test_many_rows_in_one_group(docs, prose):
    base = prose(40, 1).split()
    rows = [(i, " ".join(base[:20] + [f"x{i % 7}"] + base[20:] + [f"y{i // 7}"])) for i in range(120)] + [(500 + i, " ".join(base[:12]) + " " + prose(40, 60 + i)) for i in range(40)]
    check(j.classes(docs(rows)), rows)


def test_edges(docs):
    assert j.classes(docs([])).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (2, None), (None, "a b c d e f"), (None, None)]
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.classes(docs(rows)).collect())))
    assert got == sorted(map(str, [(1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 0, 2), (None, 2, 1), (None, 0, None)]))
    kept = j.keep_one(docs([(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (None, "z"), (4, "")]))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "None"] and "pos" in kept.columns


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600, dtype=np.uint64)
    some = [[shingles.distinct(rng.choice(pool, rng.integers(1, 500))) for _ in range(400)] for _ in range(2)]
    n, m = (np.array([len(x) for x in v]) for v in some)
    at, both = np.arange(400), np.concatenate((n, m))
    bits = [j.bitmap(x) for x in some[0] + some[1]]
    most = j.overlap_bounds(both, bits, at, at + 400)
    exact = np.array([len(np.intersect1d(x, y)) for x, y in zip(*some, strict=True)])
    assert (most >= exact).all() and exact.tolist() == [shingles.common(x, y) for x, y in zip(*some, strict=True)]
    same = j.overlap_bounds(both, bits, at, at)
    assert same.tolist() == n.tolist()


def test_batches_do_not_matter(spark, docs, prose):
    """Groups that reach over Arrow batches give the same classes."""
    base = prose(30, 3).split()
    rows = [(i, " ".join(base[:15] + [f"x{i}"] + base[15:])) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        check(j.classes(docs(rows)), rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_groups_are_given_out_whole(spark):
    """Arrow batches of one row, and keys of any size."""
    rows = [(key, 100 * key + i, 50, 0) for key in range(1, 12) for i in range(key)]
    df = spark.createDataFrame(rows, "key long, id long, n long, place int").coalesce(1).sortWithinPartitions("key", "place", "n", "id")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got = {(r["key"], r["a"]) for r in j._candidates(df).where("kind = 1").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k, i) for k, i, _, _ in rows if k >= 4}
