import itertools

from sievemill.llm import decontaminate as d
from sievemill.llm import queries


def test_masks_are_lossless():
    spans = [[sum(1 << (o + s) for o in m) for s in range(d.SPAN - m[-1])] for m in d.MASKS]
    seeds = [x for s in spans for x in s]
    for lost in itertools.combinations(range(d.SPAN), d.SPAN - d.NEED):
        gone = sum(1 << i for i in lost)
        assert any(not x & gone for x in seeds), lost
    for n in range(len(d.SHORT_MASK), d.SPAN):
        for lost in itertools.combinations(range(n), n // 8):
            assert any(not any(s + o in lost for o in d.SHORT_MASK) for s in range(n - 3))


def test_query_equals_sql(compare):
    compare(queries.op1_decontaminate, queries.OP1_SQL)
    compare(queries.op1_decontaminate, queries.OP1_SQL, "/root/testdata/sf0.01")


def test_changed_words_and_edges(spark, docs, prose):
    item = [f"{prose(40, 1)}, end.", prose(10, 2), "too short here", None, ""]
    words = item[0].replace(",", "").replace(".", "").split()
    leak = words[5:35]
    for i in (2, 9, 15, 22):
        leak[i] = "changed"
    clean = prose(300, 3)
    rows = [(1, clean), (2, clean + " " + " ".join(leak).upper() + " " + prose(50, 4)), (2, clean), (3, " ".join(words[:15])), (4, None), (5, ""), (6, prose(30, 5) + " " + item[1]), (7, "too short here"), (8, item[0]), (8, item[0]), (None, item[0])]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(item)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["start"]) for r in d.overlaps(docs(rows, "item_id"), items).collect()}
    assert set(got) == {(2, 0), (6, 1), (7, 2), (8, 0), (None, 0)} and got[7, 2] == (3, 0)
    assert got[8, 0] == (20, 0) and got[2, 0][0] >= 16 and got[6, 1] == (10, 30)
    assert d.overlaps(docs(rows), items.limit(0)).count() == 0 and d.overlaps(docs([]), items).count() == 0
    # beyond the bound of a broadcast the result is the same
    import sievemill.llm.decontaminate as module

    keep = module.bounded
    module.bounded = lambda df, rows=0: df
    try:
        assert {(r["doc_id"], r["item_id"]): (r["matched"], r["start"]) for r in d.overlaps(docs(rows), items).collect()} == got
    finally:
        module.bounded = keep


def test_items_of_few_words_are_matched_whole(spark, docs):
    """Every length from one word to SPAN, against all windows of all documents."""
    import random

    rng = random.Random(3)
    text = lambda n: [rng.choice(("la", "le", "li", "lo", "lu", "ly")) for _ in range(n)]
    rows = [(i, text(rng.randrange(0, 40))) for i in range(60)]
    items = [(n, text(n)) for n in range(1, 10)] + [(100 + n, rows[n + 20][1][:n] or ["none"]) for n in range(1, 21)] + [(900, [])]
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["start"]) for r in d.overlaps(docs([(i, " ".join(w)) for i, w in rows]), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()}
    want = {}
    for i, w in rows:
        for k, x in items:
            n, size = len(x), min(len(x), d.SPAN)
            need = d.NEED if n >= d.SPAN else n - n // 8
            for o in range(-n, len(w)):
                equal = [0 <= o + j < len(w) and w[o + j] == x[j] for j in range(n)]
                for s in range(n - size + 1) if n else ():
                    m = sum(equal[s : s + size])
                    if m >= need:
                        old = want.get((i, k), (0, 999))
                        want[i, k] = (max(old[0], m), min(old[1], max(0, s + o)))
    assert got == want and len(want) > 100


def test_main_path_is_native(spark):
    df = queries.op1_decontaminate(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct"))
