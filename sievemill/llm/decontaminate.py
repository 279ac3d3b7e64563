"""Benchmark decontamination by spaced seeds, in DataFrame expressions alone.

Words are runs of letters and digits, lower-cased. A document overlaps an item if, somewhere on one alignment without
gaps, at least NEED of SPAN consecutive words are equal (of an item of fewer than SPAN words: all but one in eight). A
mask hashes the words at its offsets and ignores the rest, so changed words at ignored places do not hide a hit. The
three masks were searched so that each of the 4,845 ways to change four of twenty words leaves at least one mask intact
somewhere in the window; the run of four does so for shorter items, and items of up to three words are hashed whole. Hits are thus found without loss, and the words around
each hit are compared on its alignment: the result equals that of comparing all windows.

The items' hashes are broadcast behind a check of their number, their words behind one of rows and words, else they are
joined by a shuffle that Spark may split. What is gathered for a document are the places of its hits, not words.

Defined cases: null and empty texts, of documents and items, have no words and overlap nothing; an item of one to seven
words overlaps where all its words stand together; equal items are each reported; equal ids with different texts are judged apart and reported by their best; empty tables
give no rows. Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.llm.common import bounded

SPAN, NEED = 20, 16
#: Rows and words of items up to which they are broadcast.
ITEM_ROWS, ITEM_WORDS = 20_000, 2_000_000
#: Offsets that a seed looks at. Lossless for four changes in twenty words.
MASKS = ((0, 1, 3, 4, 5, 6), (0, 1, 5, 7, 8, 9), (0, 4, 7, 8, 12, 13))
#: Lossless for one change in eight words and for two in sixteen.
SHORT_MASK = (0, 1, 2, 3)


def words(text: Column) -> Column:
    """64-bit hashes of the words."""
    parts = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(parts, lambda w: F.xxhash64(w))


def _seeds(df: DataFrame, masks: tuple[tuple[int, ...], ...], keep: list[str]) -> DataFrame:
    """A row for each mask and place where it fits: keep, _p (the place), _h (the hash)."""
    size = F.size("_w")
    # texts without room for a mask give null hashes; a filter by length would be pushed below the words and hash texts twice
    placed = df.select(*keep, "_w", F.explode_outer(F.sequence(F.lit(0), size - 1)).alias("_p"))

    def seed(mask: tuple[int, ...]) -> Column:
        at = [F.get(F.col("_w"), F.col("_p") + o) for o in mask]
        return F.when(F.col("_p") + mask[-1] < size, F.xxhash64(F.lit(sum(1 << o for o in mask)), *at))

    hashed = placed.select(*keep, "_p", F.explode_outer(F.array(*map(seed, masks))).alias("_h"))
    return hashed.where("_h is not null")


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")), F.lit(3))


def _matches(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame:
    """(_d: id, _k: key of the text, _i: item id, matched, start), a row for each alignment with a window that has enough equal words."""
    doc = docs.select(F.col(id_col).alias("_d"), _key(F.col(text_col)).alias("_k"), words(F.col(text_col)).alias("_w"))
    item = items.select(F.col(item_col).alias("_i"), _key(F.col(item_text)).alias("_ik"), words(F.col(item_text)).alias("_w")).where(F.size("_w") > 0)
    size = F.size("_w")
    run = len(SHORT_MASK)
    of_long = _seeds(item.where(size >= SPAN), MASKS, ["_i", "_ik"])
    tables, masks = [of_long, _seeds(item.where((size < SPAN) & (size >= run)), (SHORT_MASK,), ["_i", "_ik"])], MASKS
    short = {r["n"] for r in item.where(size < SPAN).select(F.least(size, F.lit(run)).alias("n")).distinct().collect()}  # four at most
    for n in sorted(short):
        masks += (tuple(range(n)),)
        if n < run:
            tables.append(_seeds(item.where(size == n), (tuple(range(n)),), ["_i", "_ik"]))
    hashes = reduce(DataFrame.unionByName, tables).withColumnRenamed("_p", "_q")
    hits = _seeds(doc, masks, ["_d", "_k"]).join(bounded(hashes), "_h").select("_d", "_k", "_i", "_ik", (F.col("_p") - F.col("_q")).alias("_o")).distinct()
    few = item.limit(ITEM_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    item = F.broadcast(item) if few[0] <= ITEM_ROWS and few[1] <= ITEM_WORDS else item
    longs = hits.join(item.select("_i", "_ik", size.alias("_n")), ["_i", "_ik"])
    pairs = longs.groupBy("_d", "_k").agg(F.collect_list(F.struct("_i", "_ik", "_o", "_n")).alias("_c"))
    both = pairs.join(doc, (pairs["_d"].eqNullSafe(doc["_d"])) & (pairs["_k"] == doc["_k"])).select(pairs["_d"], pairs["_k"], "_w", F.explode_outer("_c").alias("_c"))
    from_ = F.greatest(F.lit(0), F.col("_c._o"))
    both = both.select("_d", "_k", "_c._i", "_c._ik", "_c._o", (F.col("_c._o") - from_).alias("_before"), F.slice("_w", from_ + 1, F.col("_c._n")).alias("_dw"))
    both = both.join(item.withColumnRenamed("_w", "_iw"), ["_i", "_ik"])
    flags = F.transform(F.col("_iw"), lambda x, j: F.when(F.get(F.col("_dw"), j + F.col("_before")) == x, 1).otherwise(0))
    both = both.select("_d", "_k", "_i", "_o", flags.alias("_e"))
    size = F.least(F.size("_e"), F.lit(SPAN))
    need = F.when(size < SPAN, size - F.floor(size / 8)).otherwise(NEED).cast("int")
    sums = F.transform(F.sequence(F.lit(0), F.size("_e") - size), lambda s: F.aggregate(F.slice(F.col("_e"), s + 1, size), F.lit(0), lambda a, x: a + x))
    both = both.select("_d", "_k", "_i", "_o", need.alias("_need"), sums.alias("_s"))
    first = F.array_position(F.transform("_s", lambda x: x >= F.col("_need")), True) - 1 + F.col("_o")
    return both.select("_d", "_k", "_i", F.array_max("_s").alias("matched"), F.greatest(F.lit(0), first).cast("int").alias("start"), "_need").where("matched >= _need").drop("_need")


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item id, matched: most equal words of a window, start: where in the document the first window with enough begins)."""
    best = _matches(docs, items, id_col, text_col, item_col, item_text)
    return best.groupBy(F.col("_d").alias(id_col), F.col("_i").alias(item_col)).agg(F.max("matched").alias("matched"), F.min("start").alias("start"))


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that overlap no item, with all their columns. Rows are told apart by id and text, so a row of null id goes too if it overlaps one."""
    gone = _matches(docs, items, id_col, text_col, "item_id", "text").select("_d", "_k").distinct()
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_d"]) & (_key(docs[text_col]) == gone["_k"]), "left_anti")
