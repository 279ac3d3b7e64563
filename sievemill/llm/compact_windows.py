"""Substring dedup by compact windows: passages of PASSAGE words or more that other documents repeat, nearly or exactly.

A text is the sequence of its five-word shingles. Under each of HASHES hash functions the Cartesian tree over the shingles'
hashes splits it into compact windows: all runs within (left, right) that hold the place of the smallest hash share that
minimum, and only windows of at least a passage's length matter, which is about two for each passage's length of text.
Places that are the smallest of some run are found by sliding minima, the tree over them by skipping larger values on both
sides, a batch at a time.

Windows meet by hash. The first LEADERS windows of a hash, and the first of each of its first LEADERS documents, lead it,
and every window is linked to all its leaders and to the one before: a hash of no more windows has all its links. Within a batch
what does not lead is linked at once, and only leaders and the first document's windows go by hash to the tasks that link all batches' leaders. The first document's
further windows are linked to another document's, as each is a place of its own. So a passage that a third of all documents holds sends some LEADERS rows for each batch, and no pairs of all holders are made. An interval join
of a pair's links on one alignment keeps stretches on which ENOUGH hash functions agree and which hold a passage. These
are verified word by word: a passage is a repeat if 0.8 of the shingles of the union are common to both places, each
counted as often as it stands there.
Each document is first verified with the partner that most links name; the partners of links that this leaves uncovered
come next, all of them, where either document is uncovered.

Links go through leaders, which may be altered copies that are no repeats. So the windows of a hash of more than LEADERS rows
are told too, and where a passage around such a window's centre is not covered, all others of its hash are asked: of the
passage's 46 shingles 41 must be theirs, so one of the six that are rarest in the group is, and who holds one of these is
compared with it in place, shingle by shingle, over what both hold around their centres.

Exact repeats have a way of their own that needs no pairs. Seeds are hashes of SEED shingles at places that every run of a passage's length has one of (winnowing),
so equal runs share one. Where a seed that two documents have is not covered by verified passages in one of them, the
runs of equal words around it are hashed in all documents that have it, and documents meet by the hash of the whole run.

Defined cases: null, empty and short texts have no passage; repeats within one document do not count; a text that
repeats itself in equal steps ("ha ha ha") is told by its first places to the verification, and over its whole stretch to the last step; rows of equal ids are one document; null ids take no part; empty tables give no rows. Only id and text are read.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievemill.llm import shingles
from sievemill.llm.common import bounded, scratch
from sievemill.operators.novelty import _whole_cells

PASSAGE = 50
RUN = PASSAGE - shingles.WORDS + 1
HASHES = 5
ENOUGH = 2
NEED = 80
#: Rows of a hash that all others of it are linked to, at least; a hash of no more rows has all its links.
LEADERS = 4
#: Places by which an alignment may shift within a passage, where words were put in or left out.
SHIFT = 4
#: Shingles of a seed; any RUN shingles one after another hold a seed at one of SEED_WINDOW places.
SEED = 16
SEED_WINDOW = RUN - SEED + 1
#: Places from which a value that repeats in equal steps is told again.
THIN = 8
#: Values that minima slide over at once.
BLOCK = 1 << 14
#: Rows of a hash that are compared in one task; larger groups are dealt into cells of two tiles of about that many.
TILE = 1 << 14
#: What x says of a window whose hash has more than LEADERS rows, in place of f.
REST = HASHES + 1
#: Matching places of a run from which two runs share 0.8 of their union.
EQUAL = -(-NEED * 2 * RUN // (100 + NEED))


def _slide(x: np.ndarray, pick: np.ufunc, over: int = RUN) -> np.ndarray:
    """pick over each run of that many values; as long as x, the last ones are over what is left."""
    if len(x) > 2 * BLOCK:  # by blocks that stay in a cache
        return np.concatenate([_slide(x[k : k + BLOCK + over - 1], pick, over)[:BLOCK] for k in range(0, len(x), BLOCK)])
    width, out = 1, x
    while 2 * width <= over:
        out = np.concatenate((pick(out[:-width], out[width:]), out[-width:]))
        width *= 2
    rest = over - width
    return np.concatenate((pick(out[:-rest], out[rest:]), out[-rest:])) if rest and rest < len(out) else out


def _hash_runs(every: np.ndarray, over: int = RUN) -> np.ndarray:
    """Hash of that many shingles from each place on, in their order; the last places have none."""
    join = lambda x, by: shingles.mixed(x[: len(x) - by] * np.uint64(0x9E3779B97F4A7C15) + x[by:])
    width, out = 1, every
    while 2 * width <= over:
        out, width = join(out, width), 2 * width
    return join(out, over - width) if width < over else out


def seeds(every: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, first, last): seeds of a batch's texts, and the starts of the runs of RUN shingles that hold them, as places of the batch.

    A seed is the smallest hash of the starts in some run. Of equal hashes in a row only so many are taken that each run
    still has one.
    """
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(every) < PASSAGE:
        return none  # no text has a passage
    at = np.arange(len(every))
    most = offsets[1:][text] - PASSAGE  # the last start of a run in the place's text
    runs = at <= most
    h = _hash_runs(every, SEED) | np.uint64(1)
    h = np.concatenate((h, np.zeros(len(every) - len(h), np.uint64)))
    low = _slide(h, np.minimum, SEED_WINDOW)
    low[~runs] = 0
    back = np.concatenate((np.zeros(SEED_WINDOW - 1, h.dtype), low))
    top = _slide(back, np.maximum, SEED_WINDOW)[: len(h)]
    # a run does not reach over the end of its text, so neither does a seed of it
    found = np.flatnonzero((h == top) & (h > 0))
    if not len(found):
        return none
    same = (h[found[1:]] == h[found[:-1]]) & (np.diff(found) <= SEED_WINDOW) & (text[found[1:]] == text[found[:-1]])
    if same.any():
        edge = np.flatnonzero(np.concatenate(([True], ~same, [True])))
        keep = np.ones(len(found), bool)
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if y - x > 2:
                places = found[x:y].tolist()
                keep[x:y] = False
                last = 0
                keep[x] = True
                while last < len(places) - 1:
                    reach = last + 1
                    while reach + 1 < len(places) and places[reach + 1] - places[last] <= SEED_WINDOW:
                        reach += 1
                    keep[x + reach], last = True, reach
        found = found[keep]
    first = np.maximum(found - SEED_WINDOW + 1, offsets[:-1][text[found]])
    return h[found], found, first, np.minimum(found, most[found])


def compact(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, left, right) of the compact windows of at least RUN places, a row for each place of its smallest value. h: hashes over 0, and 0 at places that belong to no run, among them all of ends."""
    if len(h) < RUN:
        return (np.zeros(0, np.int64),) * 3
    low = _slide(h, np.minimum)
    low[len(h) - RUN + 1 :] = 0
    back = np.concatenate((np.zeros(RUN - 1, h.dtype), low))[: len(h) + RUN - 1]
    top = _slide(back, np.maximum)[: len(h)]
    at = np.flatnonzero((h == top) & (h > 0))
    at = np.sort(np.concatenate((at, ends)))
    values = h[at]
    before, tied = _smaller(values)
    after = len(at) - 1 - _smaller(values[::-1])[0][::-1]
    told = values > 0
    left = np.where(before < 0, 0, at[before] + 1)
    right = at[np.minimum(after, len(at) - 1)] - 1  # an end comes after each place
    if tied.any():  # an equal value has the same window; of values in equal steps, as in "ha ha ha", only some are told
        last: dict[int, list[int]] = {}  # of a window: last place, distance to the one before, last told
        windows = left * len(h) + right
        own = told & np.isin(windows, windows[tied])
        for i, key, p in zip(np.flatnonzero(own).tolist(), windows[own].tolist(), at[own].tolist(), strict=True):
            of = last.setdefault(key, [p, 0, p])
            if p != of[0]:
                if p - of[0] != of[1] or p - of[2] >= THIN:
                    of[2] = p
                else:
                    told[i] = False
                of[0], of[1] = p, p - of[0]
    return at[told], left[told], right[told]


def _smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the last smaller one before it, or -1, and whether an equal one stands between; not for 0."""
    out = np.arange(-1, len(values) - 1)
    tied = np.zeros(len(values), bool)
    rows = np.flatnonzero(values)
    while len(rows):
        # what stands between a place and its own one so far is no smaller than its value, so it can be skipped
        rows = rows[out[rows] >= 0]
        one, other = values[rows], values[out[rows]]
        rows, one, other = (x[other >= one] for x in (rows, one, other))
        tied[rows] |= other == one
        out[rows] = out[out[rows]]
    return out, tied


def _sequence(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hash at each place, whether it is one, offsets) of a batch's texts, one after another."""
    values, offsets = shingles.flat(column)
    every = np.zeros(len(values), np.uint64)
    found = shingles.places(values)
    every[: len(found)] = found
    good = np.ones(len(values), bool)
    for k in range(1, shingles.WORDS):
        at = offsets[1:] - k
        good[at[at >= offsets[:-1]]] = False
    return every, good, offsets


LINK = ("a", "b", "f", "shift", "lo", "hi")


def _link(a: tuple, b: tuple) -> tuple[np.ndarray, ...]:
    """Of windows (id, centre, left, right) a and b, as arrays: what both allow on the alignment of their centres, in places of b."""
    lo = b[1] - np.minimum(a[1] - a[2], b[1] - b[2])
    hi = b[1] + np.minimum(a[3] - a[1], b[3] - b[1])
    return a[0], b[0], b[1] - a[1], lo, hi


def _ranks(first: np.ndarray, ids: np.ndarray, before: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (key, id), with the place of each one's first row of the key: numbers of the row and of its document in the key. before: those of the first rows, where the first key began before them."""
    at = np.arange(len(first))
    new = np.concatenate(([True], ids[1:] != ids[:-1]))
    new[first == at] = True
    docs = np.cumsum(new)
    row, doc = at - first, docs - docs[first]
    if before is not None:
        n = len(before[0])
        same = (first == 0) & (at >= n)
        row[same] += before[0][-1] - (n - 1)
        doc[same] += before[1][-1] - doc[n - 1]
        row[:n], doc[:n] = before
    return row, doc


def _leaders(first: np.ndarray, ids: np.ndarray, row: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row leads its key: one of the first LEADERS rows, or the first of one of the first LEADERS documents."""
    head = np.concatenate(([True], (ids[1:] != ids[:-1]) | (first[1:] != first[:-1])))
    return (row < LEADERS) | (head & (doc < LEADERS))


def _with_leaders(first: np.ndarray, lead: np.ndarray, rows: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) for each leader i of the key before each of rows j, some `most` at a time."""
    leaders = np.flatnonzero(lead)
    base = np.searchsorted(leaders, first[rows])
    count = np.searchsorted(leaders, rows) - base
    total = np.cumsum(count)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(total, total[start] - count[start] + most, side="right")))
        c = count[start:stop]
        j = np.repeat(rows[start:stop], c)
        yield leaders[np.repeat(base[start:stop] - np.cumsum(c) + c, c) + np.arange(len(j))], j
        start = stop


def _windows(source: DataFrame) -> DataFrame:
    """Rows (key, id, x, y, a). Without a: a leader's window, x of its centre and f, y of left and right; or a seed, whose f is HASHES, x of its start, y of the first and last start of a run that holds it. With a: a link of the batch, id is b, x of shift and f, y of lo and hi; or, with REST as f, any window of a hash that has more than LEADERS rows here, a is its key."""
    names = ["key", "id", "x", "y", "a"]

    def table(f: int, key: np.ndarray, ids: np.ndarray, x: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids), pa.array(x * 8 + f), pa.array(left << 32 | right), pa.nulls(len(key), pa.int64()) if a is None else pa.array(a)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.pieces(shingles.with_words(batches, "t"), "w"):
            every, good, offsets = _sequence(batch.column("w"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            key, start, first, last = seeds(every, offsets)
            doc = np.searchsorted(offsets, start, side="right") - 1
            yield table(HASHES, shingles.mixed(key + np.uint64(HASHES)), ids[doc].astype(np.int64), *(x - offsets[doc] for x in (start, first, last)))
            ends = offsets[1:][offsets[1:] > offsets[:-1]] - 1
            good[ends] = False
            for f in range(HASHES):
                h = shingles.mixed(every ^ np.uint64(0x9E3779B97F4A7C15 * (f + 1) % 2**64)) | np.uint64(1)
                h[~good] = 0
                centre, left, right = compact(h, ends)
                doc = np.searchsorted(offsets, centre, side="right") - 1
                base = offsets[doc]
                cols = [ids[doc].astype(np.int64), centre - base, np.maximum(left, base) - base, right - base]
                key = shingles.mixed(h[centre] + np.uint64(f))
                order = np.lexsort((cols[1], cols[0], key))
                key, cols = key[order], [c[order] for c in cols]
                if not len(key):
                    continue
                head = np.concatenate(([True], key[1:] != key[:-1]))
                first = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
                lead = _leaders(first, cols[0], *_ranks(first, cols[0]))
                own = lead | (cols[0] == cols[0][first])  # leaders, and what the first document has of the same hash
                rest = np.flatnonzero(cols[0] != cols[0][first])
                _, at = np.unique(first[rest], return_index=True)
                other = np.full(len(key), -1)  # at a key's first row: its first window of another document
                other[first[rest][at]] = rest[at]
                other = other[first]
                yield table(f, key[own], *(c[own] for c in cols))
                many = (np.bincount(first, minlength=len(key))[first] > LEADERS) & (other >= 0)
                if many.any():
                    own_id = [c[many] for c in cols]
                    yield table(REST, shingles.mixed(own_id[0].view(np.uint64)), *own_id, key[many].view(np.int64))
                # what does not lead meets the leaders here; the first document's further windows meet another's too, as each is a place of its own
                more = np.flatnonzero(own & ~lead & (other >= 0))
                for i, j in (*_with_leaders(first, lead, np.flatnonzero(~own)), (other[more], more)):
                    some = cols[0][i] != cols[0][j]
                    i, j = i[some], j[some]
                    a, b, shift, lo, hi = (x[ok] for x in [_link(tuple(c[i] for c in cols), tuple(c[j] for c in cols))] for ok in [x[4] - x[3] + 1 >= RUN] for x in x)
                    if len(a):
                        deal = shingles.mixed(b.view(np.uint64))  # anywhere, not with the hash
                        yield table(f, deal, b, shift, lo, hi, a)

    return source.mapInArrow(run, "key long, id long, x long, y long, a long")


def _links(rows: DataFrame, rest: bool = False) -> DataFrame:
    """From rows sorted by (key, id, x): links (a, b, f, shift, lo, hi), lo and hi in places of b, a < b; and of the seeds that two documents have, with null a, the id in b and key, l, r in shift, lo, hi. rest: also, so, the windows of hashes of more than LEADERS rows, some of them twice; key, centre and y in shift, lo, hi, and REST in f."""

    def table(cols: list[np.ndarray], seed: bool) -> pa.RecordBatch:
        order = np.lexsort(cols[::-1])
        cols = [x[order] for x in cols]
        if len(order):
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in cols], axis=0)))
            cols = [x[new] for x in cols]
        out = [pa.array(np.ascontiguousarray(x, dtype=np.int32 if n == "f" else np.int64)) for n, x in zip(LINK, cols, strict=True)]
        return pa.RecordBatch.from_arrays([pa.nulls(len(cols[0]), pa.int64()), *out[1:]] if seed else out, list(LINK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # of the last key: its leaders and its last row, or all while they are of one document
        ranks = None
        for batch in batches:
            if not batch.num_rows:
                continue
            met = batch.column("a").is_valid().to_numpy(zero_copy_only=False)
            key, ids, x, y = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "id", "x", "y"))
            every = [key, x & 7, ids, x >> 3, y >> 32, y & (2**32 - 1)]
            out: list[tuple[np.ndarray, ...]] = []
            told = met & (every[1] == REST)
            if told.any():
                if rest:
                    key_of = batch.column("a").filter(pa.array(told)).to_numpy(zero_copy_only=False).astype(np.int64)
                    yield table([ids[told], ids[told], every[1][told], key_of, x[told] >> 3, y[told]], True)
                batch, met, every, y = batch.filter(pa.array(~told)), met[~told], [r[~told] for r in every], y[~told]
            if met.any():
                out.append((every[1][met], batch.column("a").drop_null().to_numpy(zero_copy_only=False).astype(np.int64), *(x[met] for x in every[2:])))
            rows = [x[~met] for x in every]
            if len(rows[0]):
                old = 0
                if held is not None and held[0][0] == rows[0][0]:
                    old = len(held[0])
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                key, f, ids = rows[:3]
                at = np.arange(len(key))
                head = np.concatenate(([True], key[1:] != key[:-1]))
                first = np.maximum.accumulate(np.where(head, at, 0))
                row, doc = _ranks(first, ids, ranks if old else None)
                lead = _leaders(first, ids, row, doc)
                away = np.flatnonzero(ids != ids[first])
                _, k = np.unique(first[away], return_index=True)
                other = np.full(len(key), -1)
                other[first[away][k]] = away[k]
                other = other[first]
                seed = f == HASHES
                fresh = (other >= 0) & ((at >= old) | (other >= old))
                shared = seed & fresh
                if shared.any():
                    yield table([ids[shared], ids[shared], f[shared], key[shared], rows[4][shared], rows[5][shared]], True)
                if rest:
                    ends = np.concatenate((np.flatnonzero(head)[1:], [len(key)])) - 1
                    many = (row[ends] >= LEADERS)[np.cumsum(head) - 1] & (other >= 0) & ~seed
                    if many.any():
                        yield table([ids[many], ids[many], np.full(int(many.sum()), REST), key[many], rows[3][many], rows[4][many] << 32 | rows[5][many]], True)
                new = np.flatnonzero(~head & ~seed & (at >= old))
                more = np.flatnonzero(~lead & (ids == ids[first]) & fresh & ~seed)  # further windows of the key's first document
                out += [(f[i], *_link(tuple(r[i] for r in rows[2:]), tuple(r[j] for r in rows[2:]))) for i, j in (*_with_leaders(first, lead, new), (new - 1, new), (other[more], more)) for some in [ids[i] != ids[j]] for i, j in [(i[some], j[some])]]
                last = first[-1]
                stay = at[last:] if other[-1] < 0 else np.union1d(last + np.flatnonzero(lead[last:]), at[-1:])
                held, ranks = [r[stay] for r in rows], (row[stay], doc[stay])
            for f_, a_, b_, shift, lo, hi in out:
                ok = hi - lo + 1 >= RUN
                f_, a_, b_, shift, lo, hi = (x[ok] for x in (f_, a_, b_, shift, lo, hi))
                swap = a_ > b_
                lo, hi = np.where(swap, lo - shift, lo), np.where(swap, hi - shift, hi)
                yield table([np.minimum(a_, b_), np.maximum(a_, b_), f_, np.where(swap, -shift, shift), lo, hi], False)

    return rows.mapInArrow(run, "a long, b long, f int, shift long, lo long, hi long")


def alignments(pair: np.ndarray, f: np.ndarray, shift: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval join of the links of a batch's pairs: (pair, shift) of alignments, up to SHIFT apart, on which ENOUGH hash functions agree somewhere; all of such an alignment is looked at, whatever they say of the rest."""
    if not len(pair):
        return pair, shift
    order = np.lexsort((shift, pair))
    group = np.zeros(len(pair), np.int64)
    group[order] = np.cumsum(np.concatenate(([False], (np.diff(pair[order]) != 0) | (np.diff(shift[order]) > SHIFT))))
    order = np.lexsort((lo, group))
    rows = group[order]
    top = (int(hi.max()) + 1).bit_length()
    reach = np.maximum.accumulate(rows << top | hi[order])
    new = np.concatenate(([True], (rows[1:] != rows[:-1]) | (lo[order][1:] > (reach[:-1] & (1 << top) - 1) - RUN + 1)))
    agree = np.bitwise_count(np.bitwise_or.reduceat(np.int64(1) << f[order], np.flatnonzero(new))) >= ENOUGH
    some = np.zeros(rows[-1] + 1, bool)
    some[rows[new][agree]] = True
    order = np.lexsort((shift, group))
    order = order[some[group[order]]]
    if not len(order):
        return pair[:0], shift[:0]
    pair, group, shift = pair[order], group[order], shift[order]
    # a place may match SHIFT places off, so of dense alignments every other will do
    head = np.concatenate(([True], (np.diff(group) != 0) | (np.diff(shift) > 1)))
    start = shift[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
    told = (shift - start) % 2 == 0
    told[1:] &= (np.diff(group) != 0) | (np.diff(shift) != 0)
    return pair[told], shift[told]


def repeats(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], pair: np.ndarray, shift: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """(pair, start in x, start in y, words): passages that are verified on these alignments, some `most` places at a time. x and y: (shingle hashes of all texts, each pair's first place, and how many)."""
    xs, x_at, x_size = x[0], x[1][pair], x[2][pair]
    ys, y_at, y_size = y[0], y[1][pair], y[2][pair]
    low = np.maximum(shift, 0)
    size = np.minimum(y_size, x_size + shift) - low
    rows = np.flatnonzero(size >= RUN)
    total = np.cumsum(size[rows] + 2 * SHIFT)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, side="right")))
        k = rows[start:stop]
        start = stop
        # an alignment has its places of y, and SHIFT on either side that are x's only
        slots = size[k] + 2 * SHIFT
        row = np.repeat(np.arange(len(k)), slots)
        place = np.arange(len(row)) - (np.cumsum(slots) - slots - low[k] + SHIFT)[row]
        inner = (place >= low[k][row]) & (place < (low + size)[k][row])
        of = place - shift[k][row]
        there = (of >= 0) & (of < x_size[k][row])
        a, b = np.zeros((2, len(row)), np.uint64)
        b[:] = 1  # no place, as 0 is in a
        a[there] = xs[(x_at[k][row] + of)[there]]
        b[inner] = ys[(y_at[k][row] + place)[inner]]
        runs = place <= (low + size)[k][row] - RUN
        runs &= inner

        def windows(match: np.ndarray, runs: np.ndarray) -> np.ndarray:
            count = np.concatenate(([0], np.cumsum(match, dtype=np.int32)))
            out = np.zeros(len(match), bool)
            out[: 1 - RUN] = count[RUN:] - count[:-RUN] >= EQUAL
            return out & runs

        enough = windows(a == b, runs)
        left = np.zeros(len(k), bool)
        left[row[runs & ~enough]] = True  # equal texts are done here
        if left.any():
            # a place matches if its shingle stands at most SHIFT places off the alignment, where words were put in or left out;
            # both texts are asked, as one place of a text may match many of another that says the same word over and over
            here = np.flatnonzero(left[row])
            a, b = a[here], b[here]
            of_x, of_y = np.zeros((2, len(here)), bool)
            for d in range(-SHIFT, SHIFT + 1):
                i, j = slice(max(0, d), len(a) + min(0, d)), slice(max(0, -d), len(a) - max(0, d))
                same = a[i] == b[j]
                of_y[j] |= same
                of_x[i] |= same
            whole = windows(of_x & inner[here], runs[here])
            near = whole.copy()  # the passage of x may stand off the alignment too
            for d in range(1, SHIFT + 1):
                near[d:] |= whole[:-d]
                near[:-d] |= whole[d:]
            enough[here] = windows(of_y, runs[here]) & near
        good = np.flatnonzero(enough)
        if len(good):
            cut = np.concatenate(([True], (np.diff(good) > RUN) | (np.diff(row[good]) != 0), [True]))
            first, last = good[cut[:-1]], good[cut[1:]]
            n = k[row[first]]
            yield pair[n], place[first] - shift[n], place[first], place[last] - place[first] + RUN - 1 + shingles.WORDS


def _short(texts: DataFrame) -> DataFrame:
    """(id, w) of texts (id, t): 32 bits of each word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.with_words(batches, "t"):
            w = batch.column("w")
            short = pa.array((w.values.to_numpy() >> 32).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(w.offsets, short)], ["id", "w"])

    return texts.mapInArrow(run, "id long, w array<int>")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b, links), texts (id, w): (a, b, a_start, b_start, words) of verified passages."""
    joined = pairs.join(texts.toDF("a", "aw"), "a").join(texts.toDF("b", "bw"), "b").select("a", "b", "links", "aw", "bw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            text = []
            for name in ("aw", "bw"):
                every, _, offsets = _sequence(batch.column(name))
                text.append((every, offsets[:-1], np.maximum(np.diff(offsets) - shingles.WORDS + 1, 0)))
            links = batch.column("links")
            pair = np.repeat(np.arange(len(links)), links.value_lengths().to_numpy(zero_copy_only=False))
            cols = [links.flatten().field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in LINK[2:]]
            for i, *found in repeats(*text, *alignments(pair, *cols)):
                yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(i)) for n in "ab"), *map(pa.array, found)], ["a", "b", "a_start", "b_start", "words"])

    return joined.mapInArrow(run, "a long, b long, a_start long, b_start long, words long")


def _sides(found: DataFrame) -> DataFrame:
    """(id, s, e, other) of verified passages, for both documents."""
    return found.selectExpr("a id", "a_start s", "a_start + words e", "b other").unionByName(found.selectExpr("b id", "b_start s", "b_start + words e", "a other"))


def _merged(sides: DataFrame) -> DataFrame:
    """(id, s, e, other): the stretches that spans of a document make together, with the smallest other id."""
    spans = sides.groupBy("id", "s", "e").agg(F.min("other").alias("other"))
    order = Window.partitionBy("id").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(reach >= F.col("s"), 0).otherwise(1)).over(order)
    return spans.withColumn("part", part).groupBy("id", "part").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("other").alias("other")).drop("part")


def _contexts(own: DataFrame) -> DataFrame:
    """Of documents (id, m: windows with their key and number of tiles, spans, w): a row for each window and cell of its hash, with what stands around its centre.

    start is the first place of ctx, at the place in it of the first passage that the window holds with its centre, and bit k
    of open says that the passage k places on is not covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.pieces(batches, "w"):
            every, _, offsets = _sequence(batch.column("w"))
            size, total = np.diff(offsets) - shingles.WORDS + 1, len(every)
            m, spans = batch.column("m"), batch.column("spans")
            doc = np.repeat(np.arange(len(m)), m.value_lengths().to_numpy(zero_copy_only=False))
            key, c, left, right, tiles = (m.flatten().field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "c", "l", "r", "tiles"))
            ok = right < size[doc]
            doc, key, c, left, right, tiles = (x[ok] for x in (doc, key, c, left, right, tiles))
            of = np.repeat(np.arange(len(m)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            a, b = (spans.flatten().field(n).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[:-1][of] for n in "se")
            b = b - PASSAGE + 1
            a, b = a[a < b], b[a < b]
            done = np.cumsum(np.bincount(a, minlength=total + 1) - np.bincount(b, minlength=total + 1))[: total + 1] > 0
            first, last = np.maximum(left, c - RUN + 1), np.minimum(right, c + RUN - 1)
            start, stop = np.maximum(first - SHIFT, 0), np.minimum(last + SHIFT + 1, size[doc])
            base, open_ = offsets[:-1][doc], np.zeros(len(doc), np.int64)
            for k in range(RUN):
                here = first + k + RUN - 1 <= last
                open_ |= (here & ~done[np.minimum(base + first + k, total)]).astype(np.int64) << k
            own = (shingles.mixed(batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[doc]) % tiles.astype(np.uint64)).astype(np.int64)
            row = np.repeat(np.arange(len(doc)), tiles)  # a row goes to each cell of its tile
            other = np.arange(len(row)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
            mine = own[row]
            pair = np.minimum(mine, other) << 32 | np.maximum(mine, other)
            cell = shingles.mixed(key[row].view(np.uint64) + shingles.mixed(pair.view(np.uint64))).view(np.int64)
            values, step = (every >> np.uint64(32)).astype(np.uint32).view(np.int32), 1 << 13
            for some in (slice(k, k + step) for k in range(0, len(row), step)):
                r = row[some]
                n = (stop - start)[r]
                at = np.arange(n.sum()) + np.repeat((base + start)[r] - np.cumsum(n) + n, n)
                ctx = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(values[at]))
                tile = np.where(mine[some] == other[some], -1, mine[some])
                cols = [cell[some], c[r], start[r], (first - start)[r], open_[r], tile]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols[:1]), batch.column("id").take(pa.array(doc[r])), *map(pa.array, cols[1:]), ctx], ["cell", "id", "c", "start", "at", "open", "tile", "ctx"])

    return own.mapInArrow(run, "cell long, id long, c long, start long, at long, open long, tile long, ctx array<int>")


def met_in_cells(cell: np.ndarray, ids: np.ndarray, c: np.ndarray, start: np.ndarray, at: np.ndarray, open_: np.ndarray, tile: np.ndarray, values: np.ndarray, offsets: np.ndarray, most: int = 1 << 14) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of a, row of b, start in a, start in b, words): verified passages of rows of contexts sorted by (cell, id), until each open one that has a partner is covered. c: places of the centres."""
    group = np.cumsum(np.concatenate(([0], cell[1:] != cell[:-1])))
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(cell)), size)
    packed = group[row] << 32 | values.view(np.uint32).astype(np.int64)
    order = np.argsort(packed, kind="stable")
    told, holder = packed[order], row[order]
    head = np.concatenate(([True], told[1:] != told[:-1]))
    fresh = head | np.concatenate(([True], ids[holder][1:] != ids[holder][:-1]))
    count = np.zeros(len(packed), np.int32)  # documents of the cell that have the shingle
    count[order] = np.add.reduceat(fresh, np.flatnonzero(head), dtype=np.int32)[np.cumsum(head) - 1]
    alone = np.concatenate(([0], np.cumsum(count == 1)))
    bits = np.flatnonzero(open_)
    k, r = np.nonzero((open_[bits][None, :] >> np.arange(RUN)[:, None]) & 1)
    r = bits[r]
    place = offsets[:-1][r] + at[r] + k
    some = alone[place + RUN] - alone[place] <= RUN - EQUAL  # a passage whose further shingles no other document has is no repeat
    r, place = r[some], place[some]
    asked = [np.zeros((2, 0), np.int64)]
    for s in range(0, len(r), most):
        around = place[s : s + most, None] + np.arange(RUN)
        rare = np.take_along_axis(around, np.argpartition(count[around], RUN - EQUAL, axis=1)[:, : RUN - EQUAL + 1], axis=1)
        who, rare = np.repeat(r[s : s + most], RUN - EQUAL + 1), rare.ravel()
        who, rare = who[count[rare] > 1], rare[count[rare] > 1]
        asked.append(np.unique(np.stack((who, packed[rare])), axis=1))
    who, value = np.unique(np.concatenate(asked, axis=1), axis=1)
    lo, hi = np.searchsorted(told, value), np.searchsorted(told, value, side="right")
    xs, step, covered = values.view(np.uint32).astype(np.uint64) + np.uint64(2), 8, np.zeros(len(values) + 1, bool)
    while len(who):
        n = np.minimum(hi - lo, step)
        total = np.cumsum(n)
        here = 0
        while here < len(who):
            till = max(here + 1, int(np.searchsorted(total, total[here] - n[here] + (most << 4), side="right")))
            part = n[here:till]
            x = holder[np.arange(part.sum()) + np.repeat(lo[here:till] - np.cumsum(part) + part, part)]
            y = np.repeat(who[here:till], part)
            here = till
            y, x = np.divmod(np.unique(y * len(cell) + x), len(cell))
            apart = (ids[x] != ids[y]) & ((tile[y] < 0) | (tile[x] != tile[y]))
            x, y = x[apart], y[apart]
            shift = (c - start)[y] - (c - start)[x]
            for pair, a, b, words in repeats((xs, offsets[:-1][x], size[x]), (xs, offsets[:-1][y], size[y]), np.arange(len(x)), shift):
                yield x[pair], y[pair], start[x[pair]] + a, start[y[pair]] + b, words
                n_of = words - PASSAGE + 1
                covered[np.arange(n_of.sum()) + np.repeat(offsets[:-1][y[pair]] + b - np.cumsum(n_of) + n_of, n_of)] = True
        lo, step = lo + n, min(8 * step, most)
        waits = np.zeros(len(cell), bool)
        waits[r[~covered[place]]] = True
        more = (lo < hi) & waits[who]
        who, lo, hi = who[more], lo[more], hi[more]


def _rest(big: DataFrame, sides: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, a_start, b_start, words) of verified passages between windows of hashes of more than LEADERS rows, where one holds a passage that is not covered. big: (id, key, c, y); sides: merged passages; texts: (id, w)."""
    spark = big.sparkSession
    covered = sides.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    whole = F.coalesce(F.exists("spans", lambda x: (x["s"] <= F.greatest(F.col("l"), F.col("c") - RUN + 1)) & (x["e"] >= F.least(F.col("r"), F.col("c") + RUN - 1) + shingles.WORDS)), F.lit(False))
    rows = big.selectExpr("id", "key", "c", "shiftright(y, 32) l", "y & 4294967295 r").distinct()
    told = scratch(spark, rows.join(covered, "id", "left").select("id", "key", "c", "l", "r", (~whole).alias("open")), "rest")
    keys = told.groupBy("key").agg(F.max("open").alias("some"), F.ceil(F.count("*") / TILE).alias("tiles")).where("some").select("key", "tiles")
    own = told.join(keys, "key").groupBy("id").agg(F.collect_list(F.struct("key", "c", "l", "r", "tiles")).alias("m"), F.max("open").alias("some"))
    own = scratch(spark, own, "marks")
    # of equal texts that are covered one is enough
    same = texts.join(own.where("not some").select("id"), "id", "left_semi").groupBy(F.xxhash64("w"), F.xxhash64(F.lit(1), "w")).agg(F.min("id").alias("id"))
    ids = same.select("id").unionByName(own.where("some").select("id")).distinct()
    source = texts.join(own.join(bounded(ids), "id").select("id", "m"), "id").join(covered, "id", "left").select("id", "m", "spans", "w")
    dealt = _contexts(source).repartition("cell").sortWithinPartitions("cell", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_cells(batches):
            ctx = t.column("ctx").combine_chunks()
            off = ctx.offsets.to_numpy().astype(np.int64)
            cols = [t.column(n).to_numpy() for n in ("cell", "id", "c", "start", "at", "open", "tile")]
            for a, b, *found in met_in_cells(*cols, ctx.values.to_numpy()[off[0] : off[-1]], off - off[0]):
                yield pa.RecordBatch.from_arrays([pa.array(cols[1][a]), pa.array(cols[1][b]), *map(pa.array, found)], ["a", "b", "a_start", "b_start", "words"])

    return dealt.mapInArrow(run, "a long, b long, a_start long, b_start long, words long")


def _equal(marks: DataFrame, found: DataFrame, plain: DataFrame) -> DataFrame:
    """(id, s, e, other): runs of PASSAGE equal words that no verified passage holds, with the smallest other id. marks: shared seeds; found: merged passages.

    Only runs around seeds of groups with an uncovered one are hashed. Groups of equal runs need no pairs.
    """
    spark = plain.sparkSession
    covered = found.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    held = F.coalesce(F.exists("spans", lambda x: (x["s"] <= F.col("l")) & (x["e"] >= F.col("r") + PASSAGE)), F.lit(False))
    told = marks.select(F.col("b").alias("id"), F.col("shift").alias("key"), F.col("lo").alias("l"), F.col("hi").alias("r")).join(covered, "id", "left").select("key", "id", "l", "r", (~held).alias("open"))
    told = scratch(spark, told, "seeds")
    open_ = told.groupBy("key").agg(F.max("open").alias("open")).where("open").select("key")
    own = told.join(open_, "key").groupBy("id").agg(F.collect_set(F.struct("l", "r")).alias("m")).join(covered, "id", "left")
    own = scratch(spark, own, "marks")
    ids = bounded(own.select("id"))
    source = plain.join(ids, "id").join(own, "id").select("id", "m", "spans", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in shingles.pieces(shingles.with_words(batches, "t"), "w"):
            every, _, offsets = _sequence(batch.column("w"))
            if len(every) < RUN:
                continue
            total = len(every)

            def cover(name: str, of: tuple[str, str], less: int) -> np.ndarray:
                """Places within any of the intervals of their text."""
                x = batch.column(name)
                doc = np.repeat(np.arange(len(x)), x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                a, b = (x.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) + offsets[:-1][doc] for k in of)
                b = b - less
                ok = a <= b
                a, b = a[ok], b[ok]
                return np.cumsum(np.bincount(a, minlength=total + 1) - np.bincount(b + 1, minlength=total + 1))[:total] > 0

            at = np.flatnonzero(cover("m", ("l", "r"), 0))
            done = cover("spans", ("s", "e"), PASSAGE)  # still what another document's run may equal
            doc = np.searchsorted(offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(_hash_runs(every)[at].view(np.int64)), batch.column("id").take(pa.array(doc)), pa.array((at - offsets[doc]).astype(np.int64)), pa.array(~done[at])], ["key", "id", "s", "open"])

    runs = scratch(spark, source.mapInArrow(run, "key long, id long, s long, open boolean"), "runs")
    held = runs.groupBy("key").agg(F.min("id").alias("one"), F.max("id").alias("last"), F.max("open").alias("some")).where("one < last and some").select("key", "one")
    runs = scratch(spark, runs.join(held, "key"), "equal")
    two = runs.where("id > one").groupBy("key").agg(F.min("id").alias("two"))
    return runs.where("open").join(two, "key").selectExpr("id", "s", f"s + {PASSAGE} e", "if(id = one, two, one) other")


def _freed(spark: SparkSession) -> None:
    """Has the driver let go of what written tables were made from: Spark removes an exchange's files when the driver's garbage is collected, and there may be no other reason for that for long.

    Python's references go first, and reach the JVM a moment later.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, words, other_id): maximal stretches of words of a document that other documents repeat; the smallest such id."""
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t")).where("id is not null")
    dealt = _windows(plain).repartition("key").sortWithinPartitions("key", "id", "x")
    met = scratch(spark, _links(dealt, rest=True), "links")
    del dealt
    _freed(spark)
    links = met.where("a is not null").groupBy("a", "b").agg(F.collect_set(F.struct("f", "shift", "lo", "hi")).alias("links"))
    pairs = scratch(spark, links.where(F.size(F.array_distinct(F.col("links.f"))) >= ENOUGH), "pairs")
    _freed(spark)
    big = met.where(f"a is null and f = {REST}").selectExpr("b id", "shift key", "lo c", "hi y")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(big.select("id")).distinct()
    # words by 32 bits of their hashes, made once for all pairs of a text; a passage has 50 of them
    texts = scratch(spark, _short(plain.join(bounded(ids), "id").select("id", "t")), "texts")

    best = pairs.groupBy("b").agg(F.max(F.struct(F.size("links").alias("n"), (-F.col("a")).alias("a"))).alias("m")).select("b", (-F.col("m.a")).alias("a"))
    found = scratch(spark, _verified(pairs.join(best, ["a", "b"]), texts), "passages")
    _freed(spark)
    # each document needs its own row: a pair is done only where both sides are covered
    covered = _merged(_sides(found)).groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    inside = lambda spans, lo, hi: F.coalesce(F.exists(spans, lambda s: (s["s"] <= lo) & (s["e"] >= hi)), F.lit(False))
    open_ = F.exists("links", lambda x: ~(inside("spans", x["lo"], x["hi"]) & inside("aspans", x["lo"] - x["shift"], x["hi"] - x["shift"])))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(covered.withColumnRenamed("id", "b"), "b", "left").join(covered.toDF("a", "aspans"), "a", "left").where(open_).select("a", "b", "links")
    found = found.unionByName(scratch(spark, _verified(rest, texts), "passages"))

    _freed(spark)
    sides = scratch(spark, _merged(_sides(found)), "near")
    more = scratch(spark, _rest(big, sides, texts), "passages")
    _freed(spark)
    sides = scratch(spark, _merged(sides.unionByName(_sides(more))), "near")
    out = _merged(sides.unionByName(_equal(met.where(f"a is null and f = {HASHES}"), sides, plain)))
    return out.select(F.col("id").alias(id_col), F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("words"), F.col("other").alias("other_id"))
