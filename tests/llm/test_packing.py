import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import packing
from docloom.llm.queries import op3_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    tok = Tokenizer.from_file(PATH)
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        ids = np.array(tok.encode(texts[d] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return sum(r.length for r in rows) / (len(windows) * packing.WINDOW)


def test_query_packs_every_id_once(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    assert check(op3_packing(spark, base).collect(), texts) > 0.97


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \n\t", 4: "It's <|endoftext|> o'clock", 5: "naïve é ½ x\xa0y ​ \x1c a\x85b", 6: "word " * 9000, 7: "a" * 30_000, 8: "ΑΣ Σ ſtart İ ﬁ 12,3", 9: "x" * 5}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, start int")
    check(packing.pack_documents(df, PATH).collect(), texts)
    withids = packing.pack_documents(df, PATH, with_ids=True).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in withids)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_equals_plain_search(sizes):
    sizes = sorted(sizes, reverse=True)
    where, offset = packing.best_fit(np.array(sizes, np.int64), 64)
    free = []
    for size, w, o in zip(sizes, where, offset, strict=True):
        fits = [c for c in free if c >= size]
        if fits:
            assert free[w] == min(fits)
        else:
            assert w == len(free)
            free.append(64)
        assert o == 64 - free[w]
        free[w] -= size
