"""Exact similarity classes of texts: sets of five-word shingles that share 80 % of their union are linked.

1. One pass over the texts gives each one's set size, a 128-bit signature of the set and a bitmap as wide as its size
   band; texts of equal sets are one class from there on, and a task carries on one text of each set. It also counts
   shingles that several texts of a batch share.
2. Candidates: sets that link share one of the first n - ceil(0.8 n) + 1 shingles in any common order. The order puts
   the shingles counted most last, so common passages select nobody. Rows (shingle, text, size, place) are dealt by
   shingle and sorted by place; a pass of constant memory compares each row with the first, with the first of its size
   band and with the one before it, which is every pair where up to three rows share a shingle. Size and place filters
   apply.
3. Tiles: candidates are compared in tiles of one size band each side, whose bitmaps have one width; counts of bits that
   one side has alone bound the overlap from above, and only pairs within the bound get the exact intersection of sorted
   arrays.
   First each text's most frequent candidate is checked, then the others that the links found leave in different classes.
4. Where four or more rows share a shingle and are still in different classes, all pairs of different classes are
   compared: of up to FEW rows by a join with the filters of size and place; more rows are dealt into tiles of one
   size band and at most about TILE rows, and every two tiles of near bands that may hold a link meet in a cell, where
   counts of bits bound the overlap of all pairs of different classes; only pairs within the bound leave the cell, for
   the exact intersection. So no link that would join two classes is lost. Pairs within a class need no check, as the
   result is the classes: rows of the class that most rows of a shingle have are in tiles of their own, and two such
   tiles do not meet. Shingles of the same family of copies are compared as one, where that is less work.

No key is gathered: groups are streamed, minima are taken map-side and joins can be split by Spark at hot keys. A task
holds one cell at a time, and a cell is dealt anywhere.

Defined cases: null, empty and blank texts have no shingles and link with nothing; a text of one to four words is one
shingle; equal texts (and texts of equal sets) are one class; rows of equal ids are one document; a null id is a class
of its own id, null; empty tables give no rows. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.llm import shingles
from sievemill.llm.common import bounded, scratch
from sievemill.llm.components import components

#: Link where 100 * intersection >= NEED * union.
NEED = 80
#: Most shingles that are put last; the rest are in hash order. Bounds what the driver and the tasks hold.
COMMON = 100_000
#: Texts of a batch that share a shingle, from which it is counted.
SHARED = 4
#: Sets that a task remembers to carry on only one text of each.
SEEN = 500_000
#: Rows of a key up to which its pairs are made by a join.
FEW = 8
#: Rows of a tile, about: tiles are dealt by hash.
TILE = 256
#: Pairs of a cell that are looked at together.
LOOK = 1 << 19
LOOK_BYTES = 1 << 23
#: Bits of a bitmap for each shingle, at least, up to WIDEST in all: the more, the fewer differences fall on the same bit.
SPARSE = 2
WIDEST = 1 << 17


def prefix_size(n: int) -> int:
    return n - (NEED * n + 99) // 100 + 1


def least_common(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Smallest intersection with which sets of these sizes link: 100 c >= NEED (n + m - c)."""
    return -(-NEED * (n + m) // (100 + NEED))


def bitmap(x: np.ndarray) -> bytes:
    """Bits of the set's hashes, as many as the power of two that SPARSE times its size reaches, 64 at least."""
    width = min(WIDEST, max(64, 1 << int(SPARSE * len(x) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(x & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (a row each) brought to a smaller width: a hash's bit there is its bit here modulo the width."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def overlap_bounds(n: np.ndarray, bits: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair (set i, set j) of sets with these sizes and bitmaps a number that their intersection does not exceed.

    Pairs are taken in tiles of one size band each side, whose bitmaps are matrices of one width. A bit set on one side
    alone stands for at least one element that the other lacks.
    """
    out = np.zeros(len(i), np.int64)
    wide = np.fromiter(map(len, bits), np.int64, len(bits))
    row = np.zeros(len(bits), np.int64)  # of a bitmap in the matrix of its width
    matrix = {}
    for w in np.unique(wide).tolist():
        rows = np.flatnonzero(wide == w)
        row[rows] = np.arange(len(rows))
        matrix[w] = np.frombuffer(b"".join([bits[r] for r in rows]), np.uint8).reshape(len(rows), w)
    for p, q in {*zip(wide[i].tolist(), wide[j].tolist(), strict=True)}:
        tile = np.flatnonzero((wide[i] == p) & (wide[j] == q))
        a, b = (np.ascontiguousarray(_folded(matrix[w], min(p, q))).view(np.uint64) for w in (p, q))
        step = max(1, LOOK_BYTES // min(p, q))
        for part in (tile[k : k + step] for k in range(0, len(tile), step)):
            x, y = a[row[i[part]]], b[row[j[part]]]
            both = x & y
            lost, lacking = (np.bitwise_count(v ^ both).sum(1, dtype=np.int64) for v in (x, y))
            out[part] = np.minimum(n[i[part]] - lost, n[j[part]] - lacking)
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), shingles.word_hashes(F.col(text_col)).alias("w"))


def _profile(source: DataFrame) -> DataFrame:
    """kind 0: (id, n, s1, s2, bits, first: whether it is carried on); kind 1: (s1: a shingle, n: texts of a batch that share it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in shingles.pieces(batches, "w"):
            n, s1, s2, bits, first, fresh = [], [], [], [], [], []
            for i, x in zip(batch.column("id").to_pylist(), shingles.sets(batch.column("w")), strict=True):
                one = int(shingles.mixed(x).sum(dtype=np.uint64).astype(np.int64))
                two = int(np.bitwise_xor.reduce(shingles.mixed(x, 0x9FB21C651E98DF25)).astype(np.int64)) if len(x) else 0
                new = i is not None and len(x) > 0 and (one, two) not in seen
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add((one, two))
                    fresh.append(x)
                n.append(len(x)), s1.append(one), s2.append(two), first.append(new), bits.append(bitmap(x))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(n), pa.int32()), batch.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(bits, pa.binary()), pa.array(first, pa.bool_())], names)
            if fresh:
                z = np.sort(np.concatenate(fresh))
                at = np.flatnonzero(np.concatenate(([True], z[1:] != z[:-1])))
                count = np.diff(np.append(at, len(z)))
                many = count >= SHARED
                k = int(many.sum())
                yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(count[many], pa.int64()), pa.array(z[at[many]].view(np.int64)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.bool_())], names)

    names = ["kind", "id", "n", "s1", "s2", "bits", "first"]
    return source.mapInArrow(run, "kind int, id long, n long, s1 long, s2 long, bits binary, first boolean")


def _prefixes(source: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, id, n, place) of each carried text's first shingles. common: shingles to put last, the rarest first."""
    order = np.argsort(common)
    ranked = common[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in shingles.pieces(batches, "w"):
            ids, keys, sizes, places = batch.column("id").to_pylist(), [], [], []
            out_ids = []
            for i, x in zip(ids, shingles.sets(batch.column("w")), strict=True):
                if i is None or not len(x):
                    continue
                sign = (int(shingles.mixed(x).sum(dtype=np.uint64)), len(x))
                if sign in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sign)
                k = prefix_size(len(x))
                if len(ranked):
                    at = np.minimum(np.searchsorted(ranked, x), len(ranked) - 1)
                    hot = ranked[at] == x
                    if hot.any():
                        x = np.concatenate((x[~hot], x[hot][np.argsort(order[at[hot]])]))
                keys.append(x[:k])
                sizes.append(np.full(k, len(x), np.int32))
                places.append(np.arange(k, dtype=np.int32))
                out_ids.append(np.full(k, i, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places))], ["key", "id", "n", "place"])

    return source.mapInArrow(run, "key long, id long, n int, place int")


def _candidates(rows: DataFrame) -> DataFrame:
    """From rows sorted by (key, place, n, id): kind 0: (a, b, n: 1); kind 1: rows of keys with four texts or more (key, a: id, n, place).

    The first row of a key is that of the earliest place: its text has the fewest rarer shingles before, as the original
    of a family of altered copies does, to which all of them are nearer than to each other. So it is the one to meet.
    """
    names = ["kind", "key", "a", "b", "n", "place"]

    def table(kind: int, key: np.ndarray | None, a: np.ndarray, b: np.ndarray | None, n: np.ndarray, place: np.ndarray | None) -> pa.RecordBatch:
        col = lambda v, t: pa.nulls(len(a), t) if v is None else pa.array(v.astype(t.to_pandas_dtype()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), col(key, pa.int64()), col(a, pa.int64()), col(b, pa.int64()), col(n, pa.int64()), col(place, pa.int32())], names)

    def pairs(i: np.ndarray, j: np.ndarray, c: list[np.ndarray]) -> np.ndarray:
        """Of the pairs (row i, row j) those that size and place allow, as ids, smaller first."""
        _, ids, n, place = c
        ok = ids[i] != ids[j]
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok &= 100 * low >= NEED * high
        ok &= np.minimum(n[i] - place[i], n[j] - place[j]) >= least_common(n[i], n[j])
        x, y = ids[i[ok]], ids[j[ok]]
        return np.stack((np.minimum(x, y), np.maximum(x, y)), 1)

    def first_of_band(c: list[np.ndarray], group: np.ndarray) -> np.ndarray:
        """For each row the first row of its key and size band."""
        band = group * 4096 + (np.log(np.maximum(c[2], 1)) / np.log(100 / NEED)).astype(np.int64)
        _, first, back = np.unique(band, return_index=True, return_inverse=True)
        return first[back]

    def work(c: list[np.ndarray], start: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the rows from start on, with rows before them too; and a mask of the rows in large groups."""
        key = c[0]
        head = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.cumsum(head)
        size = np.bincount(group)[group]
        j = np.arange(max(start, 1), len(key))
        j = j[~head[j]]
        hub = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))[j]
        own = first_of_band(c, group)[j]
        return np.unique(np.concatenate((pairs(j - 1, j, c), pairs(hub, j, c), pairs(own, j, c))), axis=0), size >= 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the rows of the last key until the next begins; of a key with many rows only those a later one can meet: the first of all and of each size band, and the last."""
        held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]
        old = large = 0  # rows of held that are done, and whether their key is known to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("key", "id", "n", "place")]
            c = [np.concatenate(x) for x in zip(held, new, strict=True)]
            found, many = work(c, old)
            if large:
                many |= c[0] == c[0][0]
            if len(found):
                yield table(0, None, found[:, 0], found[:, 1], np.ones(len(found), np.int64), None)
            last = c[0] == c[0][-1]
            done = many & ~last
            done[:old] &= not large  # those were given out before
            if done.any():
                yield table(1, c[0][done], c[1][done], None, c[2][done], c[3][done])
            before = old if c[0][0] == c[0][-1] and old else 0
            was_large = large and before
            held = [x[last] for x in c]
            old, large = len(held[0]), 0
            if old >= 4 or was_large:  # of a large key so few rows may be held that one more does not make four
                fresh = slice(before if was_large else 0, None)
                yield table(1, held[0][fresh], held[1][fresh], None, held[2][fresh], held[3][fresh])
                large = 1
                keep = np.unique(np.append(first_of_band(held, np.zeros(old, np.int64)), [0, old - 1]))
                held = [x[keep] for x in held]
                old = len(keep)

    return rows.mapInArrow(run, "kind int, key long, a long, b long, n long, place int")


def _bound_filter(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sizes and bitmaps allow a link."""
    one = marks.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("bits").alias("ab"))
    two = marks.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bb"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("an", "bn"))
            at = np.arange(len(n))
            most = overlap_bounds(np.concatenate((n, m)), batch.column("ab").to_pylist() + batch.column("bb").to_pylist(), at, at + len(n))
            keep = (100 * np.minimum(n, m) >= NEED * np.maximum(n, m)) & (100 * most >= NEED * (n + m - most))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b) those whose sets link: the exact intersection of sorted arrays."""
    one = texts.select(F.col("id").alias("a"), F.col("t").alias("at"))
    two = texts.select(F.col("id").alias("b"), F.col("t").alias("bt"))
    joined = pairs.join(one, "a").join(two, "b").select("a", "b", shingles.word_hashes(F.col("at")).alias("aw"), shingles.word_hashes(F.col("bt")).alias("bw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(shingles.sets(batch.column("aw")), shingles.sets(batch.column("bw")), strict=True):
                c = shingles.common(x, y)
                keep.append(c > 0 and 100 * c >= NEED * (len(x) + len(y) - c))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


FITS = "100 * least(l.n, r.n) >= {0} * greatest(l.n, r.n) and least(l.n - l.place, r.n - r.place) >= ceil({0} * (l.n + r.n) / {1})".format(NEED, 100 + NEED)


def _split(rows: DataFrame) -> DataFrame:
    """Of rows (key, id, n, place, c: class) those of keys with several classes, with k: the rows of the key."""
    # keys with the same texts propose the same pairs; the earliest in the common order has the smallest places for all
    mark = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"m{k}") for k in range(2)]
    by_class = rows.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum("place").alias("p"), *mark)
    by_key = by_class.groupBy("key").agg(F.count("*").alias("classes"), F.sum("k").alias("k"), F.sum("p").alias("p"), *(F.bit_xor(f"m{k}").alias(f"m{k}") for k in range(2)))
    by_key = by_key.where("classes > 1").groupBy("k", "m0", "m1").agg(F.min_by("key", F.struct("p", "key")).alias("key")).select("key", "k")
    return scratch(rows.sparkSession, rows.join(by_key, "key"), "split")


def _undecided(rows: DataFrame) -> DataFrame:
    """(key, id, n, c, k, main): from rows (key, id, n, c: class, k) groups of k texts, mostly of class main, so that any two texts of different classes that a key has are in a group together.

    A group is one key, or all keys of which the largest key that any of their texts has is the same, if to compare all
    texts of these keys once is not more than to compare those of each key: altered copies of one text share many keys.
    """
    spark = rows.sparkSession
    large = rows.groupBy("id").agg(F.max(F.struct("k", "key")).alias("large"))
    owner = scratch(spark, rows.join(large, "id").groupBy("key", "k").agg(F.max("large")["key"].alias("owner")), "owners")
    owned = rows.select("key", "id", "n", "c").join(owner.select("key", "owner"), "key")
    together = owned.select("owner", "id", "n", "c").distinct()
    apart = owner.groupBy("owner").agg(F.sum(F.col("k") * F.col("k")).alias("apart"))
    one = together.groupBy("owner").count().join(apart, "owner").select("owner", (F.col("count") * F.col("count") <= F.col("apart")).alias("one"))
    name = lambda c, k: F.xxhash64(c, F.lit(k)).alias("key")
    groups = together.join(one.where("one"), "owner").select(name("owner", 1), "id", "n", "c").unionByName(owned.join(one.where("not one"), "owner").select(name("key", 2), "id", "n", "c"))
    groups = scratch(spark, groups, "groups")
    sizes = groups.groupBy("key", "c").count().groupBy("key").agg(F.sum("count").alias("k"), F.max(F.struct("count", "c"))["c"].alias("main"))
    return scratch(spark, groups.join(sizes, "key"), "undecided")


def _cells(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """From rows (key, id, n, c, k, main): a row for each cell that it takes part in: (key, t1, t2: the cell's tiles, side: whether it is of t2, id, n, c, bits)."""
    large = F.col("k") > TILE
    band = F.when(large, F.floor(F.log("n") / math.log(100 / NEED))).otherwise(0).cast("long")
    rows = rows.withColumn("band", band).withColumn("own", F.when(large & (F.col("c") == F.col("main")), 1).otherwise(0))
    parts = rows.groupBy("key", "own", "band").agg(F.ceil(F.count("*") / TILE).cast("long").alias("parts"))
    tiles = parts.select("key", "own", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    tile = F.struct("own", "band", "part").alias("t")
    one, two = tiles.select("key", F.col("own").alias("o1"), F.col("band").alias("b1"), tile.alias("t1")), tiles.select("key", F.col("own").alias("o2"), F.col("band").alias("b2"), tile.alias("t2"))
    met = one.join(two, "key").where("t1 <= t2 and o1 + o2 < 2 and abs(b1 - b2) <= 1").select("key", "t1", "t2")
    sides = met.select("key", "t1", "t2", F.col("t1").alias("t"), F.lit(0).alias("side")).unionByName(met.where("t1 != t2").select("key", "t1", "t2", F.col("t2").alias("t"), F.lit(1).alias("side")))
    dealt = rows.join(parts, ["key", "own", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).select("key", "id", "n", "c", tile)
    return dealt.join(marks.select("id", "bits"), "id").join(sides, ["key", "t"]).select("key", "t1", "t2", "side", "id", "n", "c", "bits")


def _in_cells(cells: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes of a cell that sizes and bitmaps allow to link."""

    def pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """Of rows of whole cells, sorted by cell and side."""
        cell, side, ids, n, c = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("cell", "side", "id", "n", "c"))
        bits = batch.column("bits").to_pylist()
        head = np.concatenate(([True], cell[1:] != cell[:-1]))
        start = np.flatnonzero(head)[np.cumsum(head) - 1]
        end = np.append(np.flatnonzero(head)[1:], len(cell))[np.cumsum(head) - 1]
        sides = np.bincount(start, side, len(cell))[start].astype(np.int64)  # rows of side 1 in the cell
        first = np.where(sides > 0, np.where(side > 0, end, end - sides), np.arange(len(cell)) + 1)
        many = end - first
        at = 0
        while at < len(cell):
            to = at + max(1, int(np.searchsorted(np.cumsum(many[at:]), LOOK, side="right")))
            i = np.repeat(np.arange(at, min(to, len(cell))), many[at:to])
            j = np.arange(len(i)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to]) + first[i]
            ok = (c[i] != c[j]) & (100 * np.minimum(n[i], n[j]) >= NEED * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            most = overlap_bounds(n, bits, i, j)
            ok = 100 * most >= NEED * (n[i] + n[j] - most)
            i, j = ids[i[ok]], ids[j[ok]]
            yield np.unique(np.stack((np.minimum(i, j), np.maximum(i, j)), 1), axis=0)
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Holds the rows of the last cell until the next begins."""
        held: pa.Table | None = None

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for found in pairs(rows.combine_chunks().to_batches()[0]):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            same = int(np.argmax(cell[::-1] != cell[-1])) if (cell != cell[-1]).any() else len(cell)
            whole = held.num_rows - same
            if same < len(cell) and whole:
                yield from out(held.slice(0, whole))
                held = held.slice(whole)
            elif held.column("cell")[0].as_py() != cell[-1]:  # the batch is of one cell, and those before it are whole
                yield from out(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield from out(held)

    dealt = cells.withColumn("cell", F.xxhash64("key", "t1", "t2")).repartition("cell").sortWithinPartitions("cell", "side", "id")
    return dealt.select("cell", "side", "id", "n", "c", "bits").mapInArrow(run, "a long, b long").distinct()


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes."""
    one = classes.select(F.col("x").alias("a"), F.col("y").alias("ac"))
    two = classes.select(F.col("x").alias("b"), F.col("y").alias("bc"))
    return pairs.join(one, "a", "left").join(two, "b", "left").where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    source = _source(docs, id_col, text_col)
    profile = scratch(spark, _profile(source), "profile")
    rows = profile.where("kind = 0")
    common = profile.where("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s1").limit(COMMON)
    common = np.array([r["s1"] for r in common.collect()][::-1], np.int64).view(np.uint64)
    sets = rows.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"))
    marks = rows.where("n > 0 and id is not null").select("id", "n", "bits")
    same = rows.where("first").join(sets, ["n", "s1", "s2"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))

    dealt = _prefixes(source, common).repartition("key").sortWithinPartitions("key", "place", "n", "id")
    found = scratch(spark, _candidates(dealt), "candidates")
    pairs = scratch(spark, found.where("kind = 0").groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    large = found.where("kind = 1").select("key", F.col("a").alias("id"), "n", "place")
    ids = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(large.select(F.col("id").alias("a"))).distinct()
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    texts = scratch(spark, plain.join(bounded(ids.withColumnRenamed("a", "id")), "id"), "texts")

    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    edges = scratch(spark, same.unionByName(_links(_bound_filter(best, marks), texts)), "links")
    stars = components(edges)
    more = scratch(spark, _links(_bound_filter(_apart(pairs, stars), marks), texts), "links")
    edges = stars.toDF("a", "b").unionByName(more)
    stars = components(edges)

    named = large.join(stars.select(F.col("x").alias("id"), F.col("y")), "id", "left").withColumn("c", F.coalesce("y", "id")).drop("y")
    split = _split(named.dropDuplicates(["key", "id"]))
    few = split.where(F.col("k") <= FEW)
    few = few.alias("l").join(few.alias("r"), F.expr(f"l.key = r.key and l.c < r.c and {FITS}")).selectExpr("l.id a", "r.id b").distinct()
    across = _bound_filter(few, marks).unionByName(_in_cells(_cells(_undecided(split.where(F.col("k") > FEW)), marks))).distinct()
    last = scratch(spark, _links(across, texts), "links")
    if not last.isEmpty():
        stars = components(stars.toDF("a", "b").unionByName(last))

    # written, so that the join below is between plain exchanges and Spark can split a set that many texts have
    reps = scratch(spark, sets.join(stars, sets["rep"] == stars["x"], "left").select("n", "s1", "s2", F.coalesce("y", "rep").alias("c")), "classes")
    out = rows.join(reps, ["n", "s1", "s2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("c", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their class, or null, with all their columns."""
    found = classes(docs, id_col, text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")
