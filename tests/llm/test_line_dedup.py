from pyspark.sql import functions as F

from sievemill.llm import line_dedup as ld
from sievemill.llm import queries


def brute(rows):
    """Windows in (id, line) order; those seen before cover their lines."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        full = [(k, x.strip()) for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for a, b, c in zip(full, full[1:], full[2:]):
            key = (a[1], b[1], c[1])
            if key in seen:
                gone |= {a[0], b[0], c[0]}
            seen.add(key)
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, text if not gone else (left if left.strip() else ""), sorted(gone)))
    return out


def test_query_equals_sql(compare):
    compare(queries.op3_line_dedup, queries.OP3_SQL)
    compare(queries.op3_line_dedup, queries.OP3_SQL, "/root/testdata/sf0.01")


def test_equals_brute_force(docs):
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\na \n b\nc\ny"), (3, "a\nb"), (4, None), (5, ""), (6, "q\nq\nq\nq\nq"), (7, "a\n\nb\n\n\nc"), (8, "b\nc\nd\ne\nf"), (9, "d\ne\nf\ng"), (10, "\n\n\n\n"), (11, "\n".join(f"l{i % 50}" for i in range(2000))), (12, "a\nb\nc\nd"),
    ]
    got = {r["doc_id"]: r for r in ld.dedup_lines(docs(rows, "i")).collect()}
    for i, text, gone in brute(rows):
        assert (got[i]["text"], got[i]["_ld_removed"] or []) == (text, gone), i
        assert got[i]["i"] == 7
    assert got[12]["text"] == "" and got[1]["text"] == "a\nb\nc\nd"


def test_repeated_rows_and_empty_tables(docs):
    rows = [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "k\nl\nm"), (2, "k\nl\nm")]
    got = sorted((str(r["doc_id"]), r["text"]) for r in ld.dedup_lines(docs(rows)).collect())
    assert got == [("1", "a\nb\nc"), ("1", "a\nb\nc"), ("2", ""), ("None", "k\nl\nm")]
    assert ld.dedup_lines(docs([])).count() == 0


def test_columns_named_like_those_within(docs, prose):
    text = "\n".join(prose(6, k) for k in range(4))
    names = ["_ld_rows", "_ld_removed", "_ld_key", "_ld_id", "_ld_lines", "_f"]
    rows = docs([(1, text), (2, text), (None, "x"), (3, None)])
    for n in names:
        rows = rows.withColumn(n, F.lit(n))
    got = {r["doc_id"]: r for r in ld.dedup_lines(rows).collect()}
    assert got[1]["_ld_removed"] is None and got[2]["_ld_removed"] == [0, 1, 2, 3] and got[2]["text"] == "" and got[1]["_ld_lines"] == 4
    assert all(r[n] == n for r in got.values() for n in names if n not in ("_ld_removed", "_ld_lines")) and set(got) == {1, 2, 3, None}
