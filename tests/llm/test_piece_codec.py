import hashlib
import random

import numpy as np

from sievemill.llm import piece_codec as p
from sievemill.llm import queries


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.model_path())


def test_chunks_equal_the_library():
    sp, enc = library(), p.ChunkEncoder(queries.model_path())
    assert enc.by_chunk
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "the", "Wort", "ﬁ", "é", "é", "▁", "▁▁", "😀", "<s>", "</s>", "<0x0A>", "\x00", "​", "　", "中文", "x" * 30, "0", "1234", ".", "\r"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == sp.encode(text), repr(text)


def test_table_is_emptied(monkeypatch):
    monkeypatch.setattr(p, "TABLE_CHUNKS", 50)
    sp, enc = library(), p.ChunkEncoder(queries.model_path())
    for i in range(40):
        text = " ".join(f"w{i * 7 + k}" for k in range(20))
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == sp.encode(text)
        assert len(enc.table) <= 50 + 21


def test_query_equals_the_library(spark):
    sp = library()
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = queries.op2_pieces(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(rows[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_edges(docs, prose):
    rows = [(1, None), (2, ""), (3, " "), (4, "\n"), (5, prose(20000, 1)), (6, "x" * 50000), (6, "x" * 50000), (None, "a")]
    got = p.encode_decode(docs(rows, "n_tokens"), queries.model_path()).collect()
    sp = library()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        assert np.frombuffer(by[i]["ids"], "<u4").tolist() == ids and by[i]["decoded"] == sp.decode(ids)
    assert p.encode_decode(docs([]), queries.model_path()).count() == 0
