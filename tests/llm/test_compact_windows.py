import random
import re

import numpy as np
import pytest

from sievemill.llm import compact_windows as cw


@pytest.mark.parametrize("most", [3, 50, 10**9])
def test_windows_equal_brute_force(most):
    rng = np.random.default_rng(most)
    for case in range(25):
        n = int(rng.integers(cw.RUN, 350))
        h = rng.integers(1, most, n).astype(np.uint64)
        ends = np.array([n - 1] if case % 2 else [n // 2, n - 1])
        h[ends] = 0
        want = set()
        for i in np.flatnonzero(h):
            a = b = int(i)
            while a > 0 and h[a - 1] >= h[i]:
                a -= 1
            while b + 1 < n and h[b + 1] >= h[i]:
                b += 1
            if b - a + 1 >= cw.RUN:
                want.add((a, b, int(h[i])))
        c, left, right = cw.compact(h, ends)
        assert {(a, b, int(h[k])) for k, a, b in zip(c.tolist(), left.tolist(), right.tolist(), strict=True)} == want


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())


def test_passages_equal_brute_force(docs, prose):
    rng = random.Random(3)
    shared = [prose(n, 100 + n) for n in (50, 60, 120)]
    rows = [(i, prose(rng.randrange(5, 200), i)) for i in range(30)]
    for k, s in enumerate(shared):
        for i in rng.sample(range(30), 2 + 5 * k):
            rows[i] = (i, f"{rows[i][1]} {s.upper() if i % 2 else s} {prose(30, 900 + i + k)}")
    rows += [(40, prose(300, 40)), (41, prose(300, 40)), (42, "same " * 300), (43, "same " * 200), (44, None), (45, ""), (46, "few words"), (47, shared[0] + " . " + prose(20, 1) + " " + shared[0])]
    got = {}
    for r in cw.passages(docs(rows, "start")).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["words"]))
    where = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - cw.PASSAGE + 1):
            where.setdefault(tuple(w[k : k + cw.PASSAGE]), set()).add((i, k))
    hold = {}
    for places in where.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                hold.setdefault(i, set()).update(range(k, k + cw.PASSAGE))
    assert set(hold) == set(got)
    for i in hold:
        assert hold[i] <= got[i], i


def test_near_passages_and_edges(docs, prose):
    base = prose(200, 7).split()
    one, two, far = list(base), list(base), list(base)
    one[100] = "changed"
    two.insert(100, "added")
    for k in range(0, 200, 9):
        far[k] = f"other{k}"
    got = {r["doc_id"]: r["words"] for r in cw.passages(docs([(1, " ".join(base)), (2, " ".join(one)), (3, " ".join(two)), (4, " ".join(far)), (None, " ".join(base))])).collect()}
    assert set(got) == {1, 2, 3} and min(got.values()) >= 190
    assert cw.passages(docs([])).count() == 0 and cw.passages(docs([(1, " ".join(base)), (1, " ".join(base))])).count() == 0


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["start"] + r["words"]))
    return got


def test_exact_repeats_behind_altered_leaders(docs, prose):
    """Smaller ids hold parts of the passage, which are no repeats and lead all its hashes."""
    p = prose(50, 11).split()
    part = lambda i, a, b: " ".join([prose(a, 200 + i), *p[a:b], prose(50 - b, 300 + i)])
    rows = [(k, part(k, a, a + 36)) for k, a in enumerate((0, 14, 4, 10, 7))]
    rows += [(20 + k, f"{prose(40, 40 + k)} {' '.join(p)} {prose(40, 50 + k)}") for k in range(3)]
    got = found(cw.passages(docs(rows).coalesce(1)))
    assert set(got) == {20, 21, 22} and all(set(range(40, 90)) <= got[i] for i in got)


def test_hub_with_the_largest_id(docs, prose):
    """Two altered copies of document 3 that are no repeats of each other."""
    base = prose(400, 21).split()
    one, two = list(base), list(base)
    for k in range(20, 400, 48):
        one[k], two[min(k + 24, 399)] = f"one{k}", f"two{k}"
    got = found(cw.passages(docs([(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(base))]).coalesce(1)))
    assert set(got) == {1, 2, 3} and min(map(len, got.values())) >= 390


@pytest.mark.parametrize("parts", [1, 2])
def test_all_places_in_the_leader(docs, prose, parts):
    """Near copies, so that only links tell: the smallest id holds the passage three times, at unequal steps."""
    p = prose(70, 31).split()
    q = list(p)
    q[35] = "other"
    text = " ".join([*p, prose(60, 32), *p, prose(90, 33), *p])
    got = found(cw.passages(docs([(1, text), (2, " ".join([prose(30, 34), *q]))]).repartitionByRange(parts, "doc_id")))
    assert all(set(range(a, a + 70)) <= got[1] for a in (0, 130, 290)) and set(range(30, 100)) <= got[2]


def test_texts_that_repeat_in_equal_steps(docs, prose):
    p = prose(60, 41)
    rows = [(1, "same " * 300), (2, "same " * 200), (3, " ".join([p] * 20)), (4, f"{prose(30, 42)} {p} {p}"), (5, prose(200, 43))]
    got = found(cw.passages(docs(rows)))
    assert got[1] == set(range(300)) and got[2] == set(range(200)) and got[3] >= set(range(1200)) and got[4] >= set(range(30, 150)) and 5 not in got


def test_runs_of_one_word_are_no_repeats_of_longer_ones(docs, prose):
    """Forty equal words among others share 36 places with any run of that word, however long: fewer than 0.8 of the union. A run of 45 shares 41."""
    around = lambda n, seed: " ".join([prose(30, seed), "left " * 6, "same " * n, "right " * 6, prose(30, seed + 1)])
    got = found(cw.passages(docs([(1, around(40, 61)), (2, prose(40, 63) + " same" * 70), (3, around(40, 64).replace("left", "up").replace("right", "down"))])))
    assert got == {}
    got = found(cw.passages(docs([(1, around(46, 61)), (2, prose(40, 63) + " same" * 70)])))
    assert 1 in got and 2 in got


def test_exact_passages_behind_altered_copies(docs, prose):
    """200 times an earlier document with two words of a passage changed, then two that hold it word for word."""
    rng = random.Random(17)
    rows, where = [], {}
    for k in range(200):
        p = prose(50, 5000 + k).split()
        q = list(p)
        for place in rng.sample(range(50), 2):
            q[place] = f"changed{rng.randrange(9)}"
        for n, text in enumerate((q, p, p)):
            before = rng.randrange(5, 120)
            i = 10 * k + n if k % 2 else 10 * k + (n + 1) % 3  # the altered copy first, or last
            rows.append((i, " ".join([prose(before, 90000 + 10 * k + n), *text, prose(rng.randrange(5, 80), 70000 + 10 * k + n)])))
            if n:
                where[i] = set(range(before, before + 50))
    rng.shuffle(rows)
    got = found(cw.passages(docs(rows).repartition(3)))
    assert [i for i in where if not where[i] <= got.get(i, set())] == []


def test_near_repeats_equal_brute_force(docs, prose):
    """Passages of which 0.8 of the shingles are common, each in two documents among others."""
    rng = random.Random(23)
    rows, pairs = [], []
    for k in range(60):
        p = prose(90, 800 + k).split()
        q = list(p)
        for place in rng.sample(range(12, 78), 2):
            q[place] = "other"
        for n, text in enumerate((p, q)):
            rows.append((10 * k + n, " ".join([prose(40, 3000 + 10 * k + n), *text, prose(30, 4000 + 10 * k + n)])))
        pairs.append((10 * k, 10 * k + 1))
    rows += [(10_000 + k, prose(150, 6000 + k)) for k in range(40)]
    text = {i: words(t) for i, t in rows}

    def shingled(w):
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {}
    for a, b in pairs:
        for at in range(len(text[a]) - 49):
            x = shingled(text[a][at : at + 50])
            y = shingled(text[b][at : at + 50])
            if 100 * len(x & y) >= 80 * len(x | y):
                for i in (a, b):
                    want.setdefault(i, set()).update(range(at, at + 50))
    got = found(cw.passages(docs(rows)))
    assert len(want) >= 110 and set(want) <= set(got) and max(got) < 10_000
    missed = sum(len(want[i] - got[i]) for i in want)
    assert missed <= 0.01 * sum(map(len, want.values()))


def test_every_run_holds_a_seed(prose):
    rng = np.random.default_rng(5)
    for case in range(30):
        sizes = [int(n) for n in rng.integers(0, 200, 4)]
        texts = [rng.integers(1, (2, 3, 50, 2**40)[case % 4], n).astype(np.uint64) for n in sizes]
        if case % 3 == 0:
            texts[1] = texts[0]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        flat = np.concatenate(texts)
        every = np.zeros(len(flat), np.uint64)
        shingle = cw.shingles.places(flat)
        every[: len(shingle)] = shingle
        h, start, first, last = cw.seeds(every, offsets)
        assert len(start) <= 3 + len(flat) // 3
        runs = {}
        for x, y in zip(offsets[:-1], offsets[1:], strict=True):
            for p in range(x, y - cw.PASSAGE + 1):
                own = [k for k in range(len(start)) if p <= start[k] < p + cw.SEED_WINDOW]
                assert own and any(first[k] <= p <= last[k] for k in own)
                runs.setdefault(tuple(flat[p : p + cw.PASSAGE].tolist()), []).append({int(h[k]) for k in own if first[k] <= p <= last[k]})
        for same in runs.values():
            assert set.intersection(*same)


@pytest.mark.parametrize("parts", [1, 3])
def test_near_copies_behind_leaders_that_are_no_repeats(docs, prose, parts):
    """Smaller ids hold parts of a passage and lead its hashes; two larger ones hold it with words changed, nowhere equal over 50 words."""
    rows, want = [], {}
    for k in range(40):
        p = prose(80, 7000 + k).split()
        for n, a in enumerate((0, 22, 44, 10, 33)):
            rows.append((20 * k + n, " ".join([prose(30, 100 + 50 * k + n), *p[a : a + 36], prose(30, 120 + 50 * k + n)])))
        for n, places in enumerate(((), (40,))):
            q = list(p)
            for at in places:
                q[at] = f"other{n}"
            rows.append((20 * k + 10 + n, " ".join([prose(40, 140 + 50 * k + n), *q, prose(40, 145 + 50 * k + n)])))
            want[20 * k + 10 + n] = set(range(42, 118))
    got = found(cw.passages(docs(rows).repartitionByRange(parts, "doc_id")))
    assert set(got) <= set(want)
    assert sum(want[i] <= got.get(i, set()) for i in want) >= 0.95 * len(want)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_every_window_meets_all_leaders(size):
    """Links of rows in batches of any size: all pairs of small hashes, and of large ones each row with every leader before it."""
    import pyarrow as pa

    rng = np.random.default_rng(11)
    rows = []
    for key, n in enumerate((2, 9, 16, 60, 3, 40)):
        ids = np.sort(rng.integers(0, 12 if key == 5 else 10**6, n))
        rows += [(key, int(i), 8 * (100 + 3 * k), 0 << 32 | 10**6, None) for k, i in enumerate(ids)]
    run = {}

    class Rows:
        def mapInArrow(self, f, _):  # noqa: N802
            run["f"] = f

    cw._links(Rows())
    made = lambda r: pa.RecordBatch.from_arrays([pa.array([x[k] for x in r], pa.int64()) for k in range(5)], ["key", "id", "x", "y", "a"])
    got = {(a, b, s) for t in run["f"](made(rows[k : k + size]) for k in range(0, len(rows), size)) for a, b, s in zip(t["a"].to_pylist(), t["b"].to_pylist(), t["shift"].to_pylist(), strict=True)}
    want = set()
    for key in range(6):
        own = [r for r in rows if r[0] == key]
        docs = sorted({r[1] for r in own})
        lead = [k for k, r in enumerate(own) if k < cw.LEADERS or (r[1] in docs[: cw.LEADERS] and own[k - 1][1] != r[1])]
        for j in range(len(own)):
            for i in {i for i in lead if i < j} | {j - 1} - {-1}:
                if own[i][1] != own[j][1]:
                    want.add((own[i][1], own[j][1], (own[j][2] - own[i][2]) // 8))
    assert want <= got and len(got) <= len(want) + 20


def calls(f):
    """Calls that f makes, of Python's and of built-in functions."""
    import sys

    n = [0]
    sys.setprofile(lambda _, event, __: n.__setitem__(0, n[0] + (event in ("call", "c_call"))))
    try:
        f()
    finally:
        sys.setprofile(None)
    return n[0]


def test_verification_takes_no_steps_for_each_pair():
    """Ten times the pairs in a batch take fewer than twice the calls."""
    import pyarrow as pa

    run, rng = {}, np.random.default_rng(8)

    class Rows:
        def join(self, *_):
            return self

        toDF = select = join  # noqa: N815

        def mapInArrow(self, f, _):  # noqa: N802
            run["f"] = f

    cw._verified(Rows(), Rows())

    def made(n):
        w = [rng.integers(1, 2**31, 80).tolist() for _ in range(n)]
        near = [[*t[:40], 5, *t[41:]] for t in w]
        links = [[{"f": f, "shift": 0, "lo": 0, "hi": 75} for f in (0, 1)]] * n
        kind = pa.list_(pa.struct([("f", pa.int32()), ("shift", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n, 2 * n)), pa.array(links, kind), pa.array(w, pa.list_(pa.int32())), pa.array(near, pa.list_(pa.int32()))], ["a", "b", "links", "aw", "bw"])

    few, many = made(50), made(500)
    got = pa.Table.from_batches(run["f"](iter([many]))).to_pylist()
    assert sorted(r["a"] for r in got) == list(range(500)) and {(r["b"] - r["a"], r["a_start"], r["b_start"], r["words"]) for r in got} == {(500, 0, 0, 80)}
    assert calls(lambda: list(run["f"](iter([many])))) < 2 * calls(lambda: list(run["f"](iter([few]))))


def test_windows_take_no_steps_for_each_place():
    """Ten times the places of texts that do not repeat take fewer than twice the calls."""
    h = np.random.default_rng(9).integers(1, 2**63, 20_000).astype(np.uint64)
    h[99::100] = 0
    assert calls(lambda: cw.compact(h, np.arange(99, 20_000, 100))) < 2 * calls(lambda: cw.compact(h[:2000], np.arange(99, 2000, 100)))


def plain_alignments(links):
    """(shift) of one pair's links (f, shift, lo, hi), link by link."""
    out, groups = set(), []
    for link in sorted(links, key=lambda x: x[1]):
        if not groups or link[1] - groups[-1][-1][1] > cw.SHIFT:
            groups.append([])
        groups[-1].append(link)
    for group in groups:
        agree, reach, enough = set(), -1, False
        for f, _, lo, hi in sorted(group, key=lambda x: x[2]):
            if lo > reach - cw.RUN + 1:
                agree.clear()
            agree.add(f)
            reach = max(reach, hi)
            enough |= len(agree) >= cw.ENOUGH
        last = None
        for s in sorted({x[1] for x in group}) if enough else ():
            if last is None or s - last > 1:
                out.add(s)
                last = s
    return out


def plain_repeats(x, y, shift):
    """(start in x, start in y, words) of one pair on one alignment, place by place."""
    low, high = max(shift, 0), min(len(y), len(x) + shift)
    of_y = [any(0 <= p - shift + d < len(x) and x[p - shift + d] == y[p] for d in range(-cw.SHIFT, cw.SHIFT + 1)) for p in range(low, high)]
    of_x = [any(low <= p - d < high and x[p - shift] == y[p - d] for d in range(-cw.SHIFT, cw.SHIFT + 1)) for p in range(low, high)]
    whole = lambda match: {k for k in range(len(match) - cw.RUN + 1) if sum(match[k : k + cw.RUN]) >= cw.EQUAL}
    there, out = whole(of_x), []
    for k in sorted(k for k in whole(of_y) if any(k + d in there for d in range(-cw.SHIFT, cw.SHIFT + 1))):
        if out and k - out[-1][1] <= cw.RUN:
            out[-1][1] = k
        else:
            out.append([k, k])
    return {(a + low - shift, a + low, b - a + cw.RUN - 1 + cw.shingles.WORDS) for a, b in out}


@pytest.mark.parametrize("most", [1, 700, 1 << 18])
def test_verification_equals_plain_loops(most):
    rng, n = np.random.default_rng(most), 0
    for case in range(25):
        xs, ys, links = [], [], []
        for _ in range(1 + case % 5):
            x = rng.integers(2, 2 + (2, 5, 10**6)[int(rng.integers(0, 3))], int(rng.integers(0, 160))).tolist()
            y = list(x)
            for _ in range(int(rng.integers(0, 5))):
                at = int(rng.integers(0, len(y) + 1))
                y[at : at + int(rng.integers(0, 2))] = [10**7] * int(rng.integers(0, 2))
            y = rng.integers(10**8, 10**9, int(rng.integers(0, 40))).tolist() + y[int(rng.integers(0, 30)) :]
            lows = rng.integers(0, 150, int(rng.integers(0, 10))).tolist()
            links.append([(int(rng.integers(0, cw.HASHES)), len(y) - len(x) + int(rng.integers(-9, 10)) * int(rng.integers(0, 2)), lo, lo + cw.RUN + int(rng.integers(0, 50))) for lo in lows])
            xs.append(x)
            ys.append(y)
        pair = np.repeat(np.arange(len(links)), list(map(len, links)))
        cols = np.array([x for own in links for x in own], np.int64).reshape(-1, 4).T
        told = cw.alignments(pair, *cols)
        assert sorted(zip(*(x.tolist() for x in told), strict=True)) == sorted((i, s) for i, own in enumerate(links) for s in plain_alignments(own))
        packed = lambda t: (np.array([v for x in t for v in x], np.uint64), np.cumsum([0, *map(len, t)])[:-1], np.array(list(map(len, t))))
        got = [r for part in cw.repeats(packed(xs), packed(ys), *told, most) for r in zip(*(x.tolist() for x in part), strict=True)]
        want = {(i, *r) for i, own in enumerate(links) for s in plain_alignments(own) for r in plain_repeats(xs[i], ys[i], s)}
        assert len(got) == len(want) and set(got) == want
        n += len(want)
    assert n > 20


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_words_are_those_of_the_expression(spark, most, monkeypatch):
    """Texts hashed in batches have as many words, equal where those of word_hashes are."""
    import pyarrow as pa

    monkeypatch.setattr(cw.shingles, "MOST_BYTES", most)
    texts = [None, "", "  ", "A b\x0b\x0cC", "a\x1cb a\x85b é É x ", "Z" * 3000 + " q", "x\n", "y", " lead", "trail ", "ab ba " * 5, "\x00 a\x00 a", "zz" * 1500 + " Q", "ÀB àb"] * 2
    column = pa.array([*texts, "cut"], pa.string())
    got = cw.shingles.hashed(column).to_pylist()
    assert got[3:9] == cw.shingles.hashed(column.slice(3, 6)).to_pylist() and got[:-1] == cw.shingles.hashed(column.cast(pa.large_string())[: len(texts)]).to_pylist()
    assert cw.shingles.hashed(column[:0]).to_pylist() == []
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [r["w"] for r in df.select("i", cw.shingles.word_hashes(df["t"]).alias("w")).orderBy("i").collect()]
    assert list(map(len, want)) == list(map(len, got[:-1]))
    both = {pair for x, y in zip(want, got, strict=False) for pair in zip(x, y, strict=True)}
    assert len(both) == len({a for a, _ in both}) == len({b for _, b in both})


@pytest.mark.parametrize(("parts", "tile"), [(1, 1 << 14), (3, 4)])
def test_no_link_is_lost_behind_many_holders_of_parts(docs, prose, monkeypatch, parts, tile):
    """Fourteen documents hold parts of a passage; before, between and after them two hold it with a word changed, nowhere equal over 50 words."""
    monkeypatch.setattr(cw, "TILE", tile)
    rows, want = [], {}
    for k in range(30):
        p = prose(80, 17_000 + k).split()
        for n in range(14):
            a = (0, 22, 44, 10, 33)[n % 5]
            rows.append((40 * k + 2 * n, " ".join([prose(30, 20_000 + 40 * k + n), *p[a : a + 36], prose(30, 30_000 + 40 * k + n)])))
        for i, places in ((40 * k + 9, ()), (40 * k + 23, (40,))):
            rows.append((i, " ".join([prose(40, 40_000 + i), *(f"other{i}" if at in places else w for at, w in enumerate(p)), prose(40, 50_000 + i)])))
            want[i] = set(range(42, 118))
    got = found(cw.passages(docs(rows).repartitionByRange(parts, "doc_id")))
    assert set(got) == set(want)
    assert [i for i in want if not want[i] <= got[i]] == []


@pytest.mark.parametrize("most", [3, 1 << 14])
def test_contexts_that_meet_equal_all_pairs(most):
    """Which passages of open rows another document of the cell repeats, against each pair and passage on its own."""
    rng, n = np.random.default_rng(most), 0
    for _ in range(12):
        base, rows = rng.integers(0, 2**31, (3, 99)), []
        for i in range(40):
            t = base[i % 3].copy()
            t[rng.choice(99, int(rng.integers(0, 14)), replace=False)] = rng.integers(0, 2**31)
            t[: int(rng.integers(0, 40))] = rng.integers(0, 2**31, 1)
            rows.append((i % 2, int(rng.integers(0, 15)), t.astype(np.int32)))
        rows.sort(key=lambda r: r[:2])
        cell, ids = (np.array([r[k] for r in rows], np.int64) for k in range(2))
        open_ = rng.integers(0, 1 << cw.RUN, 40) * rng.integers(0, 2, 40)
        whole = lambda v: np.full(40, v, np.int64)
        got = {}
        for a, b, x, y, size in cw.met_in_cells(cell, ids, whole(49), whole(0), whole(cw.SHIFT), open_, whole(-1), np.concatenate([r[2] for r in rows]), np.arange(41) * 99, most):
            for i, j, u, v, w in zip(a.tolist(), b.tolist(), x.tolist(), y.tolist(), size.tolist(), strict=True):
                assert cell[i] == cell[j] and ids[i] != ids[j] and (u, v, w) in plain_repeats(rows[i][2].tolist(), rows[j][2].tolist(), 0)
                got.setdefault(j, set()).update(range(v, v + w - cw.PASSAGE + 1))
        for j in range(40):
            every = {s for i in range(40) if cell[i] == cell[j] and ids[i] != ids[j] for _, v, w in plain_repeats(rows[i][2].tolist(), rows[j][2].tolist(), 0) for s in range(v, v + w - cw.PASSAGE + 1)}
            asked = {cw.SHIFT + k for k in range(cw.RUN) if open_[j] >> k & 1}
            assert asked & every <= got.get(j, set()) <= every
            n += len(asked & every)
    assert n > 500
