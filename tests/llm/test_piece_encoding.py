import hashlib
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from docloom.llm import piece_encoding
from docloom.llm.queries import op4_piece_encoding

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = SentencePieceProcessor(model_file=PATH)
ENCODER = piece_encoding.ChunkEncoder(PATH)
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_query_equals_library(spark, base):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = op4_piece_encoding(spark, base).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = SP.encode(texts[r.doc_id]) + [2]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(SP.decode(ids)))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab t\nhe▁é\t.🙂語", max_size=80), st.text(" \n", max_size=70), st.text("aehlo", max_size=60)))
def test_texts_equal_library(text):
    ids = ENCODER.encode(text.encode("utf-8", "replace"))
    text = text.encode("utf-8", "replace").decode()
    assert ids == SP.encode(text) + [2]
    assert ENCODER.model.decode(ids) == SP.decode(ids)


def test_long_and_empty(spark):
    texts = {1: None, 2: "", 3: " ", 4: "a" * 50_000, 5: " " * 3000, 6: "the cat\n" * 5000, 7: "\n\n  x", 8: "<s> </s> <0x41> <unk>"}
    df = spark.createDataFrame([(d, t, "x") for d, t in texts.items()], "doc_id long, text string, ids string")
    for r in piece_encoding.encode(df, PATH).collect():
        ids = SP.encode(texts[r.doc_id] or "") + [2]
        assert list(r.ids) == ids and r.decoded == SP.decode(ids)
    assert piece_encoding.digests(df.limit(0), PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(60, 400), st.sampled_from(["a", "ab", "aeinrst", " ", "-=", "0123456789", "ACGTacgt", "aé語 "]), st.randoms())
def test_queued_parts_equal_library(n, letters, rng):
    """Parts longer than PART take the queue of pairs."""
    text = "".join(rng.choice(letters) for _ in range(n))
    assert ENCODER.encode(text.encode()) == SP.encode(text) + [2]


@pytest.mark.parametrize("letters", [" ", "a", "aeinrst", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"])
def test_a_megabyte_without_words_takes_seconds(letters):
    rng = random.Random(2)
    text = "".join(rng.choice(letters) for _ in range(1_000_000))
    began = time.process_time()
    ids = ENCODER.encode(text.encode())
    assert time.process_time() - began < 30 and ids == SP.encode(text) + [2]
