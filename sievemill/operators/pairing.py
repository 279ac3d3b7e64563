"""Parent pairs: cells in turn by chance, partners from other cells first, lineages apart if possible."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.ids import bare, quoted, stable_id


def plan_pairs(catalog: list[tuple[str, str, frozenset[str]]], cells: list[str], count: int, seed: int, distinct: bool = True) -> list[tuple[str, str, int]]:
    """(left, right, prompt seed) drawn with the standard generator over a catalog of (id, cell, roots) in stored order.

    For the driver: a run's catalog is some ten thousand rows. Larger catalogs use sample_pairs.
    """
    by_cell = {c: [row[0] for row in catalog if row[1] == c] for c in cells}
    cells = [c for c in cells if by_cell[c]]
    roots = {i: r or frozenset((i,)) for i, _, r in catalog}
    if len(roots) < 2 or not cells:
        raise ValueError("pairs need at least two problems")
    rng, out = random.Random(int(seed)), []
    for _ in range(int(count)):
        home = rng.choice(cells)
        left = rng.choice(by_cell[home])
        tour = [c for c in cells if c != home]
        rng.shuffle(tour)
        right = None
        for c in [*tour, home]:
            drawn = by_cell[c].copy()
            rng.shuffle(drawn)  # drawn for every cell, so that later draws do not depend on where the partner is
            if right is None:
                right = next((i for i in drawn if i != left and not (distinct and roots[i] & roots[left])), None)
        if right is None:
            right = min(i for i in roots if i != left)
        out.append((left, right, rng.randrange(0, 2**31)))
    return out


#: Rows that a cell offers to sample_pairs: what the sample is drawn from, by choice of the operator.
CHOICES = 64


def sample_pairs(problems: DataFrame, key: str, cell: str, roots: str, count: int, seed: int) -> DataFrame:
    """Pairs (pair_id, index, left_id, right_id) for catalogs of any size, ranked by hashes instead of drawn.

    Each index takes the cell and the row of the smallest hash of (seed, index, name); a cell offers its CHOICES rows of
    smallest hash for this seed, as partners too. This differs from plan_pairs in which rows chance picks.
    """
    spark = problems.sparkSession
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(F.xxhash64(F.lit(seed), key), key))
    offered = problems.select(F.col(key).cast("string").alias("id"), F.col(cell).alias("c"), F.col(roots).alias("r"), rank.alias("k")).where(F.col("k") <= CHOICES)
    index = spark.range(count).select(F.col("id").alias("index"))
    # at most CHOICES rows for each cell of a closed vocabulary
    draws = index.join(F.broadcast(offered))
    order = F.struct(F.xxhash64(F.lit(seed), "index", "c"), F.xxhash64(F.lit(seed), "index", "id"), F.col("id"))
    left = draws.groupBy("index").agg(F.min_by(F.struct("id", "c", "r"), order).alias("l"))
    both = left.join(F.broadcast(offered)).where(F.col("id") != F.col("l.id"))
    best = F.struct(F.arrays_overlap("r", "l.r").cast("int"), (F.col("c") == F.col("l.c")).cast("int"), F.xxhash64(F.lit(seed + 1), "index", "id"), F.col("id"))
    out = both.groupBy("index", "l").agg(F.min_by("id", best).alias("right_id")).select("index", F.col("l.id").alias("left_id"), "right_id")
    return out.withColumn("pair_id", stable_id("pair", bare(F.lit(seed)), bare(F.col("index")), quoted(F.col("left_id")), quoted(F.col("right_id"))))
