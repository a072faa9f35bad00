import random
import re

import numpy as np

from docloom.llm import minhash_dedup, ngram_join
from docloom.llm.queries import op11_minhash_dedup
from tests.llm.test_ngram_join import near_copies


def brute(texts):
    """All pairs that share a shingle, by an inverted index; union-find over the links."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = set(zip(w, w[1:])) if len(w) >= 2 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for d in sorted(sets):
        counts = {}
        for s in sets[d]:
            for e in index.get(s, ()):
                counts[e] = counts.get(e, 0) + 1
            index.setdefault(s, []).append(d)
        for e, c in counts.items():
            if 100 * c >= 80 * (len(sets[d]) + len(sets[e]) - c) and (a := root(d)) != (b := root(e)):
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(sets[d]), root(d), root(d) == d) for d in sets)


def test_query_equals_brute_force(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    assert sorted(map(tuple, op11_minhash_dedup(spark, base).collect())) == brute(texts)


def test_hot_groups_and_edges(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", 64)
    monkeypatch.setattr(ngram_join, "SIEVED", 200)
    texts = dict(enumerate([None, "", " ", "one", "One", "a b", "A\tb", "a b c d e", "a b c d e f", "z " * 50, "z " * 60]))
    for t in [*near_copies(420, 120, 1, 9), *near_copies(60, 30, 2, 3), *["same text here and there"] * 200, *near_copies(5, 30_000, 3, 900)]:
        texts[len(texts) + 100] = t
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n int").repartition(5)
    assert sorted(map(tuple, minhash_dedup.classes(df).collect())) == brute(texts)


def test_estimate_is_unbiased_with_less_variance_than_minima():
    """Over many random pairs of one similarity: right on average, and both ends beat twice as many minima."""
    rng, both, minima = np.random.default_rng(3), [], []
    for _ in range(150):
        common, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2) for k in (30, 10, 10))
        one, other = (minhash_dedup.signatures([np.unique(np.concatenate([common, x]))]) for x in (a, b))
        both.append(float(minhash_dedup.similarity(one, other)[0]))
        minima.append(float((one[0] == other[0]).mean()))
    assert abs(np.mean(both) - 0.6) < 0.01
    # independent values would halve the variance of the minima; opposite ends do better than that
    assert np.var(both) < 0.6 * np.var(minima)


def test_bands_find_pairs_at_the_threshold():
    rng, missed = np.random.default_rng(5), 0
    for _ in range(300):
        common, a, b = (rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2) for k in (80, 10, 10))
        keys = minhash_dedup.band_keys(*minhash_dedup.signatures([np.unique(np.concatenate([common, x])) for x in (a, b)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed == 0
