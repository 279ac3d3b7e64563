"""Balanced selections: ranks and caps within cells, round-robin over cells, all or nothing, lagged evidence."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.functions.vocab import BATCH, PER_CELL, REMEASURE
from sievemill.operators.scoring import in_band


def ranked(rows: DataFrame, cell: str, order: list[Column], per_cell: int = 0) -> DataFrame:
    """rows with their rank in the cell from 1, up to the cap if it is positive."""
    out = rows.withColumn("rn", F.row_number().over(Window.partitionBy(cell).orderBy(*order)))
    return out.where(F.col("rn") <= per_cell) if per_cell > 0 else out


def round_robin(rows: DataFrame, cell: str, cell_order: DataFrame, limit: int, whole: bool) -> DataFrame:
    """The first rows when each cell gives one in turn. rows have rn; cell_order (cell, turn) numbers the cells from 0.

    The cells are a closed vocabulary, so their table is small. A cell gives at most limit rows, so ranks beyond are cut
    before the global order, which is a top-k. With whole, a selection that falls short is empty.
    """
    turns = rows.where(F.col("rn") <= limit).join(F.broadcast(cell_order), cell)
    top = turns.orderBy("rn", "turn").limit(limit)
    seat = F.row_number().over(Window.orderBy("rn", "turn"))
    top = top.withColumn("seat", seat)
    if whole:
        top = top.withColumn("_all", F.count("*").over(Window.partitionBy())).where(F.col("_all") == limit).drop("_all")
    return top


def turns_by_name(rows: DataFrame, cell: str, offset: int = 0) -> DataFrame:
    """(cell, turn): cells in name order, rotated."""
    names = rows.select(cell).distinct()
    numbered = names.withColumn("_ix", F.row_number().over(Window.orderBy(cell)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy()))
    return numbered.select(cell, F.expr(f"pmod(_ix - {int(offset)}, _n)").alias("turn"))


def turns_by_best(rows: DataFrame, cell: str, best: Column) -> DataFrame:
    """(cell, turn): cells by their best row, then by name."""
    top = rows.groupBy(cell).agg(F.max(best).alias("_b"))
    return top.select(cell, (F.row_number().over(Window.orderBy(F.desc("_b"), cell)) - 1).alias("turn"))


def rotation(rows: DataFrame, cell: str, first_seen: str, seed: int) -> int:
    """The seeded offset into the cells. The generator has first shuffled each cell's rows, in the order in which cells were first seen, so the same draws are made on stand-ins of the same lengths; only one row for each cell comes to the driver."""
    sizes = [r["n"] for r in rows.groupBy(cell).agg(F.count("*").alias("n"), F.min(first_seen).alias("_f")).orderBy("_f", cell).collect()]
    rng = random.Random(int(seed))
    for n in sizes:
        rng.shuffle(list(range(n)))
    return rng.randrange(len(sizes)) if sizes else 0


def lagged_frontier(previous: DataFrame, cell: str, problem: str, score: str, s_hat: str, batch: int = BATCH, per_cell: int = PER_CELL, offset: int = 0, whole: bool = True) -> DataFrame:
    """A balanced batch chosen by the previous iteration's scores alone."""
    rows = ranked(previous.where(in_band(F.col(s_hat))), cell, [F.desc(score), F.asc(problem)], per_cell)
    return round_robin(rows, cell, turns_by_name(rows, cell, offset), batch, whole)


def with_current(selected: DataFrame, current: DataFrame, problem: str) -> DataFrame:
    """Selected problems that were measured again: the lagged score chose them, the current one is what they supply."""
    return selected.join(current, problem)


def remeasure(latest: DataFrame, policy: int, cell: str, problem: str, s_hat: str, policy_col: str, created: str, budget: int = REMEASURE) -> DataFrame:
    """Problems that this policy has not scored, balanced over cells: those in the band first, then of the oldest policy, then the oldest."""
    stale = latest.where(~F.col(policy_col).eqNullSafe(F.lit(policy)))
    order = [F.when(F.coalesce(in_band(F.col(s_hat)), F.lit(False)), 0).otherwise(1), F.coalesce(F.col(policy_col), F.lit(-1)), F.col(created), F.col(problem)]
    rows = ranked(stale, cell, order)
    return round_robin(rows, cell, turns_by_name(rows, cell), max(budget, 0), whole=False)


def batch_selection(candidates: DataFrame, cell: str, problem: str, observation: str, score: str, s_hat: str, batch: int = BATCH, per_cell: int = PER_CELL) -> DataFrame:
    """The training batch: cells in the order of their best row, one each in turn, exactly the batch or nothing."""
    rows = ranked(candidates.where(in_band(F.col(s_hat))).dropDuplicates(), cell, [F.desc(score), F.asc(problem), F.asc(observation)], per_cell)
    return round_robin(rows, cell, turns_by_best(rows, cell, F.col(score)), batch, whole=True)


def targets(lagged: DataFrame, again: DataFrame, problem: str) -> DataFrame:
    """Problems to score: the lagged selection, then those to remeasure that are not in it."""
    both = lagged.select(problem, F.lit(0).alias("wave"), F.col("seat")).unionByName(again.select(problem, F.lit(1).alias("wave"), F.col("seat")))
    first = both.withColumn("_rn", F.row_number().over(Window.partitionBy(problem).orderBy("wave", "seat"))).where("_rn = 1")
    return first.select(problem, "wave", "seat")
