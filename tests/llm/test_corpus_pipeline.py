import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docloom.llm import language_id, secret_scan
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check


def test_stages_act_on_what_is_kept(spark, base, tmp_path):
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, base).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs.collect())
        assert name == "packing" or docs.columns == columns
    raw = {r.doc_id: r for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    identified, unique, distinct, clean, packed = kept
    models = language_id.train(language_id.training_rows(spark.read.parquet(f"{base}/documents.parquet")))
    refused = {r.doc_id for r in language_id.predict(spark.read.parquet(f"{base}/documents.parquet"), models).collect() if r.rejected}
    assert set(identified) == set(raw) - refused and len(identified) > 0.98 * len(raw)
    first = {}
    for d in sorted(identified):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", raw[d].text), d)
    assert set(unique) == set(first.values())
    assert set(distinct) == {c for _, _, c in brute({d: raw[d].text for d in unique})}
    assert set(clean) == set(distinct)
    for d, r in clean.items():
        spans = secret_scan.base_spans(raw[d].text)
        assert (r.text == raw[d].text) == (not spans) and not secret_scan.base_spans(r.text)
        assert r.n_chars == (len(r.text) if spans else raw[d].n_chars)
    check(packed, {d: r.text for d, r in clean.items()})
    assert Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset", "sequence_id"]
    assert out.count() > 100


def test_sequences_carry_their_ids(spark):
    import zlib

    import numpy as np

    rows = corpus_pipeline.sequences(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 100
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
