import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from docloom.llm import lm_scoring
from docloom.llm.queries import op1_lm_scoring


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def base_scores(texts, held):
    counts = Counter(w for d, t in texts.items() if not held(d) for w in words(t))
    total, distinct = sum(counts.values()), len(counts)
    for d, t in texts.items():
        own = words(t)
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        yield d, len(own), sum(counts[w] > 0 for w in own), total, score


def test_base_equals_brute_force_and_model_beats_it(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    held = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    rows = {r.doc_id: r for r in op1_lm_scoring(spark, base).collect()}
    assert len(rows) == len(texts)
    for d, n, known, total, score in base_scores(texts, held):
        r = rows[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held(d))
        assert r.base_score == pytest.approx(score, rel=1e-9)
    tokens = sum(r.n_tokens for r in rows.values() if r.held_out)
    gain = sum(r.score - r.base_score for r in rows.values() if r.held_out) / tokens
    print("log10 gain a held-out token", gain)
    assert gain > 0.15


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(1, 2**63, 300).astype(np.uint64))
    v = lm_scoring.Vocabulary(np.append(keys, lm_scoring.END), rng.integers(2, 50, len(keys) + 1), 20_000, 1_000)
    model = lm_scoring.Model(v, rng.integers(0, lm_scoring.CLUSTERS, v.size))
    model.weights += rng.normal(size=model.weights.shape).astype(np.float32)
    ids = rng.integers(0, v.size + 1, 20_000)
    counts = np.zeros(2 * lm_scoring.CONTEXTS * (v.size + 1) + lm_scoring.CONTEXTS**2 * lm_scoring.CLASSES, np.int64)
    model.count(ids, np.array([0, 7_000, 20_000]), counts)
    model.climb(counts)
    total = 0.0
    for w in range(v.size + 1):  # the rare class as one outcome
        ids = np.array([5, 9, w])
        total += math.exp(model.log_probs(ids, np.array([0, 3]))[2])
    assert total == pytest.approx(1, abs=1e-4)


def test_climbing_raises_the_likelihood():
    """Words that depend on the word before gain; the fit equals what plain loops over the tokens give."""
    rng = np.random.default_rng(1)
    v = lm_scoring.Vocabulary(np.append(np.arange(1, 40).astype(np.uint64), lm_scoring.END), np.full(40, 100), 4_000, 40)
    label = np.arange(40) % 4
    model = lm_scoring.Model(v, label)
    ids = [0]
    for _ in range(4000):  # the next word of a class follows from the class before
        c = rng.integers(0, 4)
        ids.append(int(c + 4 * ((label[ids[-1]] * 2 + rng.integers(0, 2)) % 10)))
    ids, bounds = np.array(ids), np.array([0, 4001])
    before = model.log_probs(ids, bounds).sum()
    counts = np.zeros(2 * lm_scoring.CONTEXTS * (v.size + 1) + lm_scoring.CONTEXTS**2 * lm_scoring.CLASSES, np.int64)
    model.count(ids, bounds, counts)
    model.climb(counts)
    assert model.log_probs(ids, bounds).sum() > before + 0.5 * len(ids)


def brute_score(v, model, hashes, rare_counts):
    """log10 probability of a token sequence by plain loops over the model's arrays."""
    ids = [int(i) for i in v.ids(hashes)]
    total, bucket, context = 0.0, lambda w: int(model.bucket[w]), lambda w: lm_scoring.CLASSES if w == model.start else int(model.label[w])
    for k, w in enumerate(ids):
        one, two = (ids[k - 1] if k else model.start), (ids[k - 2] if k > 1 else model.start)
        a, b = bucket(one), bucket(two)
        rows = (a, b + lm_scoring.FEATURES[0], (a * 40_503 + b * 30_011 + (a * b >> 3)) % lm_scoring.FEATURES[2] + lm_scoring.FEATURES[0] + lm_scoring.FEATURES[1])
        x = [float(model.bias[c]) + sum(float(model.weights[r, c]) for r in rows) for c in range(lm_scoring.CLASSES)]
        c = int(model.label[w])
        total += x[c] - math.log(sum(math.exp(y) for y in x))
        if w == model.rare:
            total += math.log(rare_counts[k] + 0.1) - math.log(v.rare_total)
        else:
            lean = lambda u: float(model.share[u]) + float(model.lean[0, context(one), u]) + float(model.lean[1, context(two), u])  # noqa: E731,B023
            total += lean(w) - math.log(sum(math.exp(lean(u)) for u in range(v.size) if model.label[u] == c))
    return total / math.log(10)


def test_score_equals_brute_force(spark, base, monkeypatch):
    """The score of each text against loops over tokens, with a vocabulary so small that most words are rare."""
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 300)
    docs = lm_scoring.folds(spark.read.parquet(f"{base}/documents.parquet").where("doc_id < 60"))
    v, model = lm_scoring.train(docs.where("train"))
    assert 50 < v.size <= 300 and np.abs(model.lean).max() > 0.1 and np.abs(model.weights).max() > 0.1
    rows = {r.doc_id: r for r in docs.collect()}
    counts = Counter(w for r in rows.values() if r.train for w in words(r.text))
    for r in lm_scoring.score(docs, v, model).collect()[:12]:
        import pyarrow as pa

        ((_, hashes, _),) = lm_scoring.tokens(pa.array([rows[r.doc_id].text or ""]))
        want = brute_score(v, model, hashes, [counts[w] for w in words(rows[r.doc_id].text)])
        assert r.score == pytest.approx(want, rel=1e-4)


def test_vocabulary_is_exact(spark):
    text = "a b a c"
    df = spark.createDataFrame([(text,), (text,), ("a",)], "text string")
    v = lm_scoring.vocabulary(df)
    assert (v.total, v.distinct, v.size) == (12, 4, 4)
    assert v.ids(np.array([lm_scoring.END], np.uint64))[0] < v.size
    assert sorted(v.ranked().tolist()) == [2, 2, 3, 5]


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "A b a", 4: "b  A\n a", 5: "z" * 100_000, 6: "w " * 60_000, 7: "new words only here", 8: "é É"}
    rows = [(d, t, "c") for d, t in texts.items()] + [(3, "other text", "c")]
    df = lm_scoring.folds(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3))
    got = lm_scoring.score(df, *lm_scoring.train(df.where("train"))).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows)
    assert all(np.isfinite(r.score) and np.isfinite(r.base_score) and r.score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id == 3} == {4, 3}
    nothing = lm_scoring.train(df.where("false"))
    alone = lm_scoring.score(df, *nothing).collect()
    assert {r.n_known for r in alone} == {0} and {r.train_tokens for r in alone} == {0} or len(alone) == len(rows)
    assert lm_scoring.score(df.where("false"), *nothing).collect() == []
