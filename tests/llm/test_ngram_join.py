import random
import re

import numpy as np
import pytest

from docloom.llm import ngram_join
from docloom.llm.queries import op6_ngram_join


def brute(texts):
    """All pairs that share a shingle, by an inverted index; union-find over the links."""
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
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
            if 100 * c >= 85 * (len(sets[d]) + len(sets[e]) - c) and (a := root(d)) != (b := root(e)):
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(sets[d]), root(d)) for d in sets)


def test_query_equals_brute_force(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    assert sorted(map(tuple, op6_ngram_join(spark, base).collect())) == brute(texts)


def near_copies(n, length, seed, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize("tile,shingles,hot", [(ngram_join.TILE, ngram_join.SHINGLES, ngram_join.HOT), (64, 2000, 100)])
def test_hot_groups_and_edges(spark, monkeypatch, tile, shingles, hot):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "SIEVED", min(ngram_join.SIEVED, 2 * hot))
    monkeypatch.setattr(ngram_join, "SHINGLES", shingles)
    texts = dict(enumerate([None, "", " ", "one", "One", "a b", "a b c", "A b\tc", "a b c d", "a b c d e", "z " * 50, "z " * 60]))
    for t in [*near_copies(420, 120, 1, 9), *near_copies(60, 30, 2, 3), *["same text here and there"] * 200, *near_copies(5, 30_000, 3, 900)]:
        texts[len(texts) + 100] = t
    rng = random.Random(5)
    shared_passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(150):
        texts[len(texts) + 100] = shared_passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 80)))
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n int").repartition(5)
    assert sorted(map(tuple, ngram_join.classes(df).collect())) == brute(texts)
    kept = ngram_join.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute(texts)})


def test_repeated_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.classes(df).collect())) == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert ngram_join.classes(df.limit(0)).collect() == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(500, 400), (7, 7)], "a long, b long")
    got = dict(map(tuple, ngram_join.components(edges).collect()))
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400}


def test_overlap_product():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40_000, k).astype(np.uint64)) for k in (5, 9000, 20_000, 20_000, 1)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = ngram_join.overlaps(sets)
    assert all(got[i][j] == want[i][j] for i in range(5) for j in range(5) if i != j)


def test_sieve_never_parts_linked_sets():
    rng = np.random.default_rng(4)
    sets, base_sets = [], [np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (10, 200, 5000, 20_000)]
    for b in base_sets:
        for share in (0.0, 0.05, 0.08, 0.2):
            keep = b[rng.random(len(b)) >= share]
            sets.append(np.unique(np.append(keep, rng.integers(0, 2**63, int(len(b) * share * 0.5)).astype(np.uint64))))
    n, bits = np.array([len(s) for s in sets]), [ngram_join.parity(s) for s in sets]
    label = ngram_join._split_group(n, bits)
    c = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for i in range(len(sets)):
        for j in range(i):
            if 100 * c[i][j] >= 85 * (n[i] + n[j] - c[i][j]):
                assert label[i] == label[j] >= 0
    assert len(set(label)) >= 4
