import hashlib
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from docloom.llm import token_alignment
from docloom.llm.queries import op12_token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=B)
    # the byte of each character of byte-level BPE, learned from single bytes that decode by themselves
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(x): x for x in plain}
    code.update({chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)})

    def run(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
        parts_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        return ids_a, parts_a, ids_b, parts_b

    return run


def brute(texts, sides):
    """By whole texts: all pairs of tokens whose byte ranges overlap, groups between common ends."""
    found, count = [], {}
    for text in texts:
        if not text:
            found.append(None)
            continue
        ids_a, parts_a, ids_b, parts_b = sides(text)
        whole = (" " + text).encode()
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            found.append(None)
            continue
        spans = []
        for ids, parts in ((ids_a, parts_a), (ids_b, parts_b)):
            at, own = 0, []
            for i, p in zip(ids, parts):
                own.append((at, at + len(p), i))
                at += len(p)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, t, i in side if low <= s and t <= e) for side in spans) if len(whole) < 3000 else None)
            low = e
        owner = [[] for _ in whole]
        for s, e, i in spans[1]:
            for x in range(s, e):
                owner[x] = (s, i)
        links = [(i, j) for s, e, i in spans[0] for _, j in sorted({owner[x] for x in range(s, e)})]
        for x in set(links):
            count[x] = count.get(x, 0) + 1
        found.append((len(ids_a), len(ids_b), len(ends), links, None if None in groups else hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = {}
    for (i, _), n in count.items():
        top[i] = max(top.get(i, 0), n)
    for f in found:
        yield (0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(count[x] == top[x[0]] for x in f[3]), sum(count[x] for x in f[3]), f[4])


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same(rows, want):
    assert len(rows) == len(want)
    for r, w in zip(rows, want):
        assert tuple(r[c] for c in COLUMNS[:6]) == w[:6], r
        assert w[6] is None or r["groups_sha256"] == w[6]


def test_query_equals_brute_force(spark, base, sides):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    got = sorted(op12_token_alignment(spark, base).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == sorted(docs)
    same(got, list(brute([docs[r.doc_id] for r in got], sides)))


def test_strange_texts_equal_brute_force(spark, sides, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", " ", "  ", "\n", "a ", " a", "\na", "a\n", "a \n b", "▁", "a▁b", "x<|endoftext|>y </s> <unk>", "<0x41>", "\x00", "a\x00b", "   x", "é é été　 x", "ﬁ ½", "don't  we'll\t\tgo", "日本 語\n\n語"]
    alphabet = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "é", "Ö", "日", "😀", " ", " ", "1234", ",", "'s", "'", "-", "<s>", "_", "́"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    texts += ["z" * 5000, "same text " * 400] + ["the same line"] * 50
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, block string").repartition(5)
    got = sorted(token_alignment.align(df, A, B).collect(), key=lambda r: r.doc_id)
    same(got, list(brute(texts, sides)))


def test_small_blocks_and_stripes_give_the_same(spark, sides):
    texts = ["one two three four", "two three", "one  two", None, "deux trois été", "two three"] * 20
    rows = [(k, *token_alignment.pair_of(A, B).align([(t or "").encode()])) for k, t in enumerate(texts)]
    want = list(brute(texts, sides))
    for (_, counts, digests, codes, _), w in zip(rows, want):
        assert (*counts[0].tolist(), len(codes)) == w[:4] and digests[0] == w[6]
    codes = [r[3] for r in rows]
    links = token_alignment.link_rows(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7), A, B)
    pairs = {(r.a, r.b): (r.documents, r.best) for r in token_alignment.pair_counts(token_alignment.cells(links, 3)).collect()}
    count = {}
    for c in codes:
        for x in set(c.tolist()):
            count[divmod(x, token_alignment.WIDTH)] = count.get(divmod(x, token_alignment.WIDTH), 0) + 1
    assert {k: v[0] for k, v in pairs.items()} == count
    for (a, _), (n, best) in pairs.items():
        assert best == (n == max(m for (x, _), m in count.items() if x == a))
