import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from docloom.llm import language_id
from docloom.llm.queries import op2_language_id


def test_held_out_accuracy(spark, base):
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = op2_language_id(spark, base).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    langs = {v[0] for v in truth.values()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.lang_pred in langs | {"und"}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    bits = language_id.BITS
    key = np.unique(rng.integers(1, 1 << 4 * bits, 3000))
    model = language_id.KneserNey(key, rng.integers(1, 9, len(key)))
    for ctx in [key[0] >> bits, key[50] >> bits, 5, 0]:
        p = model.prob((ctx << bits) + np.arange(1 << bits))
        assert abs(p.sum() - 1) < 1e-9 and (p > 0).all()


def test_matches_plain_cross_entropy():
    folder, bits = language_id.Alphabet(list(map(ord, "abcdefghijklmnopqrstuvwxyzäü日本"))), language_id.BITS
    texts = ["Der Hund läuft", "", "12 34", "the  the\n\ncat", "日本語 テスト"]
    key, bounds = language_id.keys(folder, texts)
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        codes, last = [], 0
        for ch in t.lower():
            c = folder.one(ord(ch))
            if c or last:
                codes.append(c)
            last = c
        padded = [0, 0, 0, *codes]
        want = [(padded[i] << 3 * bits) | (padded[i + 1] << 2 * bits) | (padded[i + 2] << bits) | padded[i + 3] for i in range(len(codes))]
        assert key[a + 1 : b].tolist() == want
    table = pd.DataFrame({"lang": ["x"] * 3 + ["y"] * 2, "key": [1, 65, 4161, 2, 130], "n": [3, 2, 1, 5, 1]})
    models = language_id.LanguageModels(table, folder)
    found, n = models.entropies(key, bounds)
    for k in range(len(texts)):
        own = key[bounds[k] + 1 : bounds[k + 1]].astype(np.int64)
        for j, m in enumerate(models.models):
            assert abs(found[k, j] * max(n[k], 1) + np.log2(m.prob(own[own != 0])).sum()) < 1e-3


def test_edge_cases(spark):
    rows = [(1, "hello there my friend", "en"), (2, "guten tag mein freund", "de"), (3, None, "en"), (4, "", None), (5, "1234 --- ...", "de"), (6, "x" * 100_000, None), (7, "日本", None), (8, "hello there my friend", None)]
    df = spark.createDataFrame([(d, t, g, "c") for d, t, g in rows], "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in language_id.predict(df, language_id.train(df)).collect()}
    assert [out[k].lang_pred for k in (1, 2, 3, 4, 5, 8)] == ["en", "de", "und", "und", "und", "en"]
    assert all(out[k].rejected and out[k].score == 0 for k in (3, 4, 5))
    nothing = language_id.train(df.limit(0))
    assert {r.lang_pred for r in language_id.predict(df, nothing).collect()} == {"und"}
    assert language_id.predict(df.limit(0), nothing).count() == 0


def test_letters_of_other_scripts_stay_apart(spark):
    """Letters outside a-z have their own symbols, so languages of one script are told apart."""
    pools = {"ru": "съешь же ещё этих мягких булок", "uk": "щастям б'ється твоє їжак ґанок", "el": "ξεσκεπάζω την ψυχοφθόρα βδελυγμία", "ja": "いろはにほへと ちりぬるを わかよたれそ"}
    rows = [(k, " ".join(pool.split()[(k + j) % len(pool.split())] for j in range(8)), g) for g, pool in pools.items() for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = language_id.train(df)
    assert len(models.folder.letters) == len({c for _, t, _ in rows for c in t.lower() if c.isalpha()})
    truth = {t: g for _, t, g in rows}
    out = language_id.predict(spark.createDataFrame(list(enumerate(truth)), "doc_id long, text string"), models).collect()
    texts = list(truth)
    assert all(r.lang_pred == truth[texts[r.doc_id]] for r in out)


def test_rejection_is_calibrated(spark, base):
    """Clean held-out texts pass; keyboard noise of the same length does not."""
    import random

    docs = spark.read.parquet(f"{base}/documents.parquet")
    models = language_id.train(language_id.training_rows(docs))
    rng = random.Random(4)
    noise = [(k, "".join(rng.choice("qwxzjkvbpfgh  ") for _ in range(300))) for k in range(50)]
    out = language_id.predict(spark.createDataFrame(noise, "doc_id long, text string"), models).collect()
    assert all(r.rejected for r in out)


def test_models_beyond_the_broadcast_give_the_same_results(spark, base, monkeypatch):
    """A small bound on the broadcast n-grams changes no prediction, score or rejection."""
    docs = spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 300")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "12 34"), (-4, "ыъ qqq zzxj"), (-4, "ыъ qqq zzxj")], "doc_id long, text string")
    asked = docs.select("doc_id", "text").unionByName(odd)

    def results():
        models = language_id.train(language_id.training_rows(docs))
        kept = language_id.keep_identified(docs.withColumn("lang", F.lit(None).cast("string")), models)
        return models, sorted(language_id.predict(asked, models).collect()), sorted((r.doc_id, r.lang) for r in kept.collect())

    whole, want, want_kept = results()
    monkeypatch.setattr(language_id, "ENTRIES", 2000)
    cut, found, found_kept = results()
    assert whole.tables is None and len(cut.grams) < 2000 < len(whole.grams)
    assert np.allclose(cut.entropy, whole.entropy, rtol=1e-6) and np.allclose(cut.slack, whole.slack, atol=1e-4)
    assert len(found) == 305 and found_kept == want_kept
    for a, b in zip(found, want, strict=True):
        assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected) and abs(a.score - b.score) < 1e-5
