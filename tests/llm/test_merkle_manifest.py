import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from docloom.llm import merkle_manifest as merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        a = i // 8 * 8
        yield level[a:i], level[i + 1 : a + 8]
        i //= 8


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root of the text in lower case where crc32 says so)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([leaf for *_, leaf, _ in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    upper = levels([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for i, (*_, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*siblings(trees[g], i), *siblings(upper, k)]
            own = leaf
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                own = leaf_of((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                own = sha(*left, own, *right)
            yield r[0], leaf, trees[g][-1][0], upper[-1][0], sha(*(x for left, right in path for x in left + right)), own


def run(df):
    proofs = merkle.prove(df, {"changed": merkle.changed_leaf((F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0))})
    return merkle.verify(proofs, F.coalesce("changed", "leaf")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("languages,most", [(1, 70), (3, 9), (11, 20), (1, 1)])
def test_manifest_equals_brute_force(spark, languages, most):
    rng = random.Random(languages)
    names = [None, "", "é", "z", *(f"l{i}" for i in range(20))][:languages]
    rows = [
        (rng.choice([None, rng.randrange(10_000), 7]), rng.choice([None, "web", ""]), g, rng.choice([None, rng.randrange(99)]), rng.choice([None, "", f"Äx AB {i}퟿😀", "Same"]), "clash", 1)
        for g in names for i in range(rng.randrange(1, most + 1))
    ]
    rows += rows[:3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got, want = [tuple(r) for r in run(df).collect()], list(brute(rows))
    key = lambda x: tuple(map(str, x))
    assert sorted((g[:6] for g in got), key=key) == sorted(want, key=key)
    assert all(g[6] == (g[5] == g[3]) for g in got)


def test_one_third_of_equal_rows(spark):
    rows = [(5, "s", "en", 4, "Copy", None, None)] * 300 + [(i, "s", "de", 1, "x", None, None) for i in range(100)]
    got = run(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted(brute(rows))


def test_any_change_breaks_the_proof(spark, base):
    """Every document whose text has an upper-case letter fails to verify after the change, and no other."""
    docs = spark.read.parquet(f"{base}/documents.parquet")
    out = run(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in out:
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None and any("A" <= c <= "Z" for c in r.text)
        assert r.verified != changed
    assert len({r.root for r in out}) == 1 and any(not r.verified for r in out)


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []
