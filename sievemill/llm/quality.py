"""Quality score from compression with two dictionaries, one trained on good and one on bad labelled text.

A text is cut into blocks of BLOCK bytes, so that the dictionary tells in every part of a long text, and each block is
compressed with either dictionary. The size difference over the larger size says which kind of text it resembles; the
size over the length says whether it repeats itself, where the difference is small and means little. A logistic curve
over both, fitted on labelled texts that no dictionary has seen, gives the score.

Learning takes a bounded sample: FIT_ROWS labelled rows of each class, in hash order and with their whole texts, half for
the dictionaries and half for the curve. The curve weighs each
class's rows by how many labels one of them stands for, so the share of good texts in it is that of all usable labels at
every size. Scoring takes all rows and whole texts.

Defined cases: null and empty texts get the score of an empty text; without labels of both classes to learn from, all
scores are 0.5; labels other than 0 and 1 are ignored; of repeated rows each is scored; empty tables give no rows. Other
columns are not read, except by keep_good, which returns them unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 4096
FIT_ROWS = 3_000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3
FOLDS = 3
HELD_OUT = 1


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _blocks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "replace")
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] or [b""]


class Scorer:
    """Dictionaries and curve; sent to the tasks, about 130 KB."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", weights: tuple[float, ...] = ()):
        self.good, self.bad, self.weights = good, bad, weights
        self._ready = None

    def __getstate__(self) -> tuple:
        return self.good, self.bad, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def features(self, text: str) -> tuple[float, ...]:
        import zstandard

        if self._ready is None:
            self._ready = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)).compress for d in (self.good, self.bad)]
        good, bad = self._ready
        parts = _blocks(text)
        g, b, n = sum(len(good(p)) for p in parts), sum(len(bad(p)) for p in parts), sum(map(len, parts))
        difference = (g - b) / max(g, b)
        dense = max(-5.0, min(0.0, math.log(min(g, b) / max(n, 1))))
        repeats = max(0.0, -1.4 - dense)
        return 1.0, 10 * difference, dense, repeats, 10 * difference * dense, 10 * difference * repeats

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.5
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _logistic(x: list[tuple[float, ...]], y: list[int], stands: dict[int, float]) -> tuple[float, ...]:
    """Weights of a logistic curve by Newton steps, slightly held to zero. A row counts as the labels of its class that it stands for, so scores keep the share of good texts."""
    import numpy as np

    a, t = np.asarray(x, float), np.asarray(y, float)
    count = np.asarray([stands[v] for v in y])
    count /= count.mean()
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (count * (t - p)) - 0.05 * w
        step = np.linalg.solve((a * (count * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(len(w)), grad)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Scorer:
    """Learns from labelled rows that are not held out."""
    import zstandard

    known = labels.where(~held_out(F.col(id_col)) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_z")).where("_y = _z")
    order = F.xxhash64("_id")
    picked = None
    for value in (0, 1):
        some = known.where(F.col("_y") == value).orderBy(order, "_id").limit(FIT_ROWS)
        picked = some if picked is None else picked.unionByName(some)
    usable = {int(r["_y"]): r["count"] for r in known.where(F.col("_y").isin(0, 1)).groupBy("_y").count().collect()}
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    # at most 2 * FIT_ROWS ids: bounded by the parameter
    rows = texts.join(F.broadcast(picked.select("_id", "_y")), "_id")
    for_curve = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(2)) == 1
    sample = rows.select("_id", "_y", "t", for_curve.alias("c")).collect()
    sample = sorted({(r["_id"], int(r["_y"]), r["t"], r["c"]) for r in sample}, key=lambda r: (str(r[0]), r[2]))
    by = {y: [part for _, label, t, c in sample if label == y and not c and t for part in _blocks(t)] for y in (0, 1)}
    curve = [(t, y) for _, y, t, c in sample if c]
    if min(map(len, by.values())) < 8 or len({y for _, y in curve}) < 2:
        return Scorer()

    def dictionary(texts: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, texts)) // 4)), texts, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little or too uniform to train on: the texts themselves serve
            return b"".join(texts)[-DICTIONARY_BYTES:]

    scorer = Scorer(dictionary(by[1]), dictionary(by[0]))
    scorer.weights = _logistic([scorer.features(t) for t, _ in curve], [y for _, y in curve], {y: n / min(n, FIT_ROWS) for y, n in usable.items()})
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t.as_py() or "") for t in batch.column(1)], pa.float64())], [id_col, "score"])

    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of docs that score 0.5 or more, with all their columns, in one pass and without a shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "") >= 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
