"""SentencePiece encoding and decoding through tables of distinct chunks.

A marker stands for each space, and one more is put in front of the text. No piece of the model has a marker after
another character, and none but the byte pieces has a line feed, so no merge crosses the start of a run of markers or a
line feed: a text's ids are those of its chunks, one after another. Each task keeps a table chunk -> ids, in which a
distinct chunk is segmented once, and joins the ids back by position. The table is emptied when it has TABLE_CHUNKS
chunks, so memory is bounded; nothing is shuffled, and a lost task is just run again. The model is checked for the two
properties first; if it lacks them, or normalises texts, whole texts are encoded.

Defined cases: a null text is the empty text, whose ids are begin and end alone; texts of any length are encoded whole;
repeated rows give repeated results; an empty table gives none. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
TABLE_CHUNKS = 400_000
#: A run of markers with what follows up to the next marker or line feed; or a line feed with what follows.
CHUNK = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Tried once to see whether the model's normaliser leaves texts as they are.
PROBE = "  A ﬁ ＡΩ éß\t\n\r 　x​İ "

_models: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Encodes as the library does, chunk by chunk where the model allows it."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        whole = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        self.mark = self.sp.piece_to_id(MARK)
        self.by_chunk = (
            not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in whole)
            and pieces[self.mark] == MARK
            and self.sp.normalize(PROBE) == MARK + PROBE.replace(" ", MARK)
            and self.sp.encode("\n")[:1] == [self.mark]
        )
        self.table: dict[str, bytes] = {}

    def _segment(self, chunks: list[str]) -> None:
        for chunk, ids in zip(chunks, self.sp.encode([c[1:] if c[0] == MARK else c for c in chunks], num_threads=1), strict=True):
            if chunk == MARK:
                ids = [self.mark]
            elif chunk[0] == "\n":
                ids = ids[1:]  # without the marker put in front
            self.table[chunk] = pack(ids)

    def encode(self, text: str) -> bytes:
        """ids as little-endian unsigned 32-bit integers, without begin and end."""
        if not self.by_chunk:
            return pack(self.sp.encode(text, num_threads=1))
        if not text:
            return b""
        chunks = CHUNK.findall(MARK + text.replace(" ", MARK))
        try:
            return b"".join([self.table[c] for c in chunks])
        except KeyError:
            if len(self.table) > TABLE_CHUNKS:
                self.table.clear()
            self._segment(list({c for c in chunks if c not in self.table}))
            return b"".join([self.table[c] for c in chunks])


def pack(ids: list[int]) -> bytes:
    import numpy as np

    return np.asarray(ids, dtype="<u4").tobytes()


def encoder(model_path: str) -> ChunkEncoder:
    if model_path not in _models:
        _models[model_path] = ChunkEncoder(model_path)
    return _models[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ids (binary, little-endian unsigned 32-bit, with begin and end), n_tokens, decoded."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        enc = encoder(model_path)
        begin, end = pack([enc.sp.bos_id()]), pack([enc.sp.eos_id()])
        for batch in batches:
            ids, sizes, texts = [], [], []
            for text in batch.column("text"):
                packed = begin + enc.encode(text.as_py() or "") + end
                ids.append(packed)
                sizes.append(len(packed) // 4)
                texts.append(enc.sp.decode(np.frombuffer(packed, "<u4").tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(texts, pa.string())], [id_col, "ids", "n_tokens", "decoded"])

    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens long, decoded string")
