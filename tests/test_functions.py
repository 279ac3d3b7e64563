"""Scalar functions against plain Python."""

import difflib
import hashlib
import json
import random
import re

from pyspark.sql import functions as F

from sievemill.functions import envelope, grading, ids, text
from sievemill.operators import novelty

ODD = ["a  b", " \t x\u00a0y\u2003z ", 'q"uote \\ back', "caf\u00e9 \u0130 \u03a3", "\x1cfile\x1fsep", "", None, "x23 and 4.5/6, -7", "\u0661\u0662 \u00fc_b"]


def canonical(t):
    return re.sub(r"\s+", " ", t or "").strip()


def test_ids_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i long, t string")
    rows = df.select("i", ids.canonical(F.col("t")).alias("c"), ids.problem_id(F.col("t")).alias("p"), ids.derived_seed(F.lit(5), "ns", F.col("i"), F.lit(2)).alias("s")).collect()
    for r in rows:
        assert r["c"] == canonical(ODD[r["i"]])
        raw = json.dumps([canonical(ODD[r["i"]]).lower()], ensure_ascii=False, separators=(",", ":"))
        assert r["p"] == "problem_" + hashlib.sha256(raw.encode()).hexdigest()[:20]
        digest = hashlib.sha256(json.dumps([5, "ns", r["i"], 2], separators=(",", ":")).encode()).digest()
        assert r["s"] == int.from_bytes(digest[:8], "big") & 0x7FFFFFFF


def words_of(t):
    return re.findall(r"[A-Za-z]+|\d+|[^\w\s]", t)


def shingles_of(t):
    w = words_of(t)
    return {" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else ({" ".join(w)} if w else set())


def test_shingles_and_bands_equal_python(spark):
    texts = [*ODD, "one two three four", "a b c " * 20]
    df = text.with_shingles(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string"), "t")
    template = {i: re.sub(r"(?<![A-Za-z])[-+]?\d+(?:\.\d+)?(?:/\d+)?", "#", canonical(t).lower()) for i, t in enumerate(texts)}
    for r in df.collect():
        assert set(r["shingles"]) == shingles_of(template[r["i"]])
    got = {(r["i"], r["band"]): r["value"] for r in text.band_keys(df, "i").collect()}
    for i, t in template.items():
        weights = [0] * 64
        for s in shingles_of(t):
            v = int.from_bytes(hashlib.sha256(s.encode()).digest()[:8], "big")
            weights = [w + (1 if v >> b & 1 else -1) for b, w in enumerate(weights)]
        whole = sum(1 << b for b, w in enumerate(weights) if w >= 0)
        assert [got[i, b] for b in range(4)] == [whole >> (16 * b) & 0xFFFF for b in range(4)]


def test_explode_does_not_repeat_the_tokeniser(spark):
    df = text.with_shingles(spark.createDataFrame([(1, "a b c d")], "i long, t string"), "t")
    plan = text.band_keys(df, "i")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1


def test_sequence_ratio_keeps_its_sides(spark):
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), ("", ""), ("abcd", "bcde")], "a string, b string")
    for r in df.select("a", "b", novelty.sequence_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        assert r["r"] == difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).ratio()


def test_bracket_reading_equals_a_scan():
    rng = random.Random(4)

    def scan(t):
        for start in sorted((m.start() for m in re.finditer(r"\\boxed\{", t)), reverse=True):
            depth = 0
            for i in range(start + 6, len(t)):
                depth += (t[i] == "{") - (t[i] == "}")
                if depth == 0:
                    return t[start + 7 : i].strip() or None
        return None

    for _ in range(2000):
        t = "".join(rng.choice(["\\boxed{", "{", "}", "a", " ", "\\boxed{}"]) for _ in range(rng.randrange(12)))
        assert envelope.last_boxed(t) == scan(t), t


def test_finite_sets_equal_a_scan():
    rng = random.Random(5)
    pair = {"(": ")", "[": "]", "{": "}"}
    for _ in range(3000):
        t = "".join(rng.choice(list("([{)]},;ab ")) for _ in range(rng.randrange(9)))
        body, want = envelope.plain_set(t), []
        if body not in envelope.EMPTY_SETS:
            for a, b in (("{", "}"), ("[", "]")):
                if body.startswith(a) and body.endswith(b):
                    body = body[1 : max(1, len(body) - 1)].strip()
                    break
            stack, item = [], ""
            for ch in body:
                if ch in pair:
                    stack.append(pair[ch])
                elif ch in pair.values() and (not stack or stack.pop() != ch):
                    want = None
                    break
                if ch in ",;" and not stack:
                    want.append(item.strip())
                    item = ""
                else:
                    item += ch
            if want is not None and body:
                want = None if stack else [*want, item.strip()]
                want = want if want and all(want) else None
        assert envelope.finite_set(t) == want, t


def test_numbers():
    same = [("0.50", "\\dfrac{1}{2}"), ("1{,}000".replace("{,}", ","), "1000"), ("3^2", "9"), ("\\frac{\\sqrt{16}}{2}", "2"), ("-1/2", "-0.5"), ("2\\cdot 3", "6"), ("(1+2)(3)", "9")]
    assert all(grading.equal(a, b) for a, b in same)
    assert grading.number("2 3") is None and grading.number("\\sqrt{2}") is None and grading.number("") is None
