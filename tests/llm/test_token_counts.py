import math
from functools import cache

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import token_counts
from docloom.llm.queries import op8_token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCORES = token_counts.unigram_scores(PATH)


def brute(word, scores):
    """Best (score, fewest pieces) over all cuts, from the end of the word."""
    text, low = "▁" + word, min(scores.values()) - 10

    @cache
    def best(at):
        if at == len(text):
            return 0.0, 0
        options = []
        for end in range(at + 1, min(len(text), at + 20) + 1):
            if (s := scores.get(text[at:end])) is not None:
                rest = best(end)
                options.append((s + rest[0], -1 + rest[1]))
            elif end == at + 1:
                n = len(text[at].encode())
                rest = best(end)
                options.append((low * n + rest[0], -n + rest[1]))
        return max(options)

    s, n = best(0)
    return s, -n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abcde🙂é.", min_size=1, max_size=12), min_size=1, max_size=8))
def test_words_equal_brute_force(words):
    trie = token_counts.ForwardTrie(SCORES)
    n, tokens, score = trie.count([" ".join(words).encode(), b""])
    want = [brute(w, SCORES) for w in words]
    assert (n.tolist(), tokens.tolist()) == ([len(words), 0], [sum(t for _, t in want), 0])
    assert score[0] == pytest.approx(sum(s for s, _ in want))


def test_query_equals_brute_force(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    found = {r.doc_id: r for r in op8_token_counts(spark, base).collect()}
    assert sorted(found) == sorted(texts)
    scores = token_counts.fitted_scores(spark.read.parquet(f"{base}/documents.parquet"), PATH)
    known = {}
    for d in sorted(texts)[::25]:
        own = (texts[d] or "").encode().split()
        for w in own:
            if w not in known:
                known[w] = brute(w.decode(), scores)
        assert found[d].n_tokens == sum(known[w][1] for w in own) and found[d].n_words == len(own)
        assert found[d].score == pytest.approx(math.fsum(known[w][0] for w in own))


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "a" * 3000, 5: "語\x00", 6: "same word " * 20_000}
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_counts.token_counts(df, PATH, scores=SCORES).collect()}
    assert [got[k].n_tokens for k in (1, 2, 3)] == [0, 0, 0]
    assert got[6].n_tokens == 20_000 * sum(brute(w, SCORES)[1] for w in ("same", "word"))
    assert got[4].n_words == 1 and got[5].n_tokens > 1
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_fit_equals_brute_force(spark):
    """Two rounds by plain loops: cut each word by its best score, take smoothed shares."""
    texts = ["the cat sat on the mat", "the cats sat", None, "on and on and on", "Katze 語🙂"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want = SCORES
    for _ in range(token_counts.ROUNDS):
        trie, counts = token_counts.ForwardTrie(want), {}
        for w in " ".join(filter(None, texts)).split():
            pieces = trie.cuts(w)
            assert "".join(pieces) == "▁" + w
            assert sum(1 if p in want else len(p.encode()) for p in pieces) == brute(w, want)[1]
            for p in pieces:
                if p in want:
                    counts[p] = counts.get(p, 0) + 1
        total = math.log(sum(counts.values()) + token_counts.ADD * len(want))
        want = {p: math.log(counts.get(p, 0) + token_counts.ADD) - total for p in want}
    got = token_counts.fitted_scores(df, PATH)
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p]) for p in want)


def test_words_together_equal_words_one_by_one():
    import random

    import numpy as np

    rng = random.Random(6)
    words = list({"".join(rng.choice("abcdeß🙂 ▁thing.") for _ in range(rng.randrange(1, 63))) for _ in range(2000)})
    trie = token_counts.ForwardTrie(SCORES)
    grown, total = token_counts.Forest(words, trie.vocabulary), np.zeros(len(SCORES), np.int64)
    grown.add(total, np.arange(len(words)))
    want = np.zeros(len(SCORES), np.int64)
    place = {p: k for k, p in enumerate(trie.vocabulary.names)}
    for k, w in enumerate(words):
        node = trie._walk(token_counts.MARK + w)[-1]
        assert (grown.best[grown.ends[k]], grown.count[grown.ends[k]]) == (trie.best[node], trie.pieces[node])
        for p in trie.cuts(w):
            if p in place:
                want[place[p]] += k
    assert (total == want).all()
    long = trie.count([("x" * 300 + " " + "y" * 10).encode()])
    assert long[1][0] == sum(len(trie.cuts(w)) for w in ("x" * 300, "y" * 10))
