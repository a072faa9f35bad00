import hashlib
import re

import numpy as np

from docloom.llm import exact_dedup, golomb


def test_code_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5, 999, 50_000):
        for high in (2**20, 2**63):
            v = np.unique(rng.integers(0, high, n, dtype=np.uint64))
            assert (golomb.decode(golomb.encode(v)) == v).all()
    ends = np.array([0, 2**64 - 1], np.uint64)
    assert (golomb.decode(golomb.encode(ends)) == ends).all()


def brute(rows):
    groups = {}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    return sorted((d, min(g := groups[norm(t)]), len(g), min(g) == d, hashlib.sha256(norm(t).encode()).hexdigest()) for d, t in rows)


def test_cases_equal_brute_force(spark):
    rows = [(1, "a b"), (2, "a\t\nb"), (3, None), (4, ""), (5, "a  b "), (6, "A b"), (7, "é\xa0x"), (8, "é x"), (9, "y" * 200_000), (10, "y" * 200_000)]
    rows += [(100 + i, "hot  text" if i % 3 else "hot text") for i in range(300)]
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, keep_id string").repartition(7)
    assert sorted(map(tuple, exact_dedup.classes(df).collect())) == brute(rows)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(rows) if r[3])


def test_empty_table(spark):
    assert exact_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
