"""Every operator on rows with null ids, null columns, repeated rows and clashing columns."""

import public_tokenizers
import pytest

from docloom.llm import exact_dedup, html_extract, language_id, lm_scoring, merkle_manifest, minhash_dedup, ngram_join, packing, piece_encoding, quality_rules, secret_scan, token_alignment, token_counts

ROWS = [
    (None, None, None, None, "x"),
    (None, "a b c d e f", "en", "s", "x"),
    (1, "a b c d e f", "en", "s", "x"),
    (1, "a b c d e f", "en", "s", "x"),
    (2, "token = abcdef123456 hallo welt", None, None, None),
    (3, "", "de", "s", "x"),
]
FIELDS = ("doc_id", "source", "lang", "kept", "text")
SCHEMA = "doc_id long, text string, lang string, source string, kept string"
WORDS, PIECES, BYTES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.json"))

OPERATORS = {
    "lm_scoring": lambda d: lm_scoring.score(lm_scoring.folds(d), *lm_scoring.train(lm_scoring.folds(d).where("train"))),
    "language_id": lambda d: language_id.predict(d, language_id.train(d)),
    "keep_identified": lambda d: language_id.keep_identified(d.union(d), language_id.train(d)),
    "packing": lambda d: packing.pack_documents(d, WORDS),
    "piece_encoding": lambda d: piece_encoding.digests(d, PIECES),
    "exact_dedup": exact_dedup.classes,
    "ngram_join": ngram_join.classes,
    "secret_scan": lambda d: secret_scan.scan(d, secret_scan.train(d)),
    "redact_documents": lambda d: secret_scan.redact_documents(d, secret_scan.train(d)),
    "token_counts": lambda d: token_counts.token_counts(d, PIECES),
    "quality_rules": quality_rules.apply_rules,
    "minhash_dedup": minhash_dedup.classes,
    "token_alignment": lambda d: token_alignment.align(d, BYTES, PIECES),
    "merkle_manifest": lambda d: merkle_manifest.prove(d, fields=FIELDS),
    "html_extract": lambda d: html_extract.main_text(d, "doc_id", "lang", "text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_and_repeats(spark, name):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = OPERATORS[name](df).collect()
    if name == "keep_identified":
        # rows without letters go, and so does the text unlike any training text
        assert [r.text for r in rows] == ["a b c d e f"] * 6
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


ROWS_OF_IDS = [
    (3, "A b c d e f", "x"), (5, "A b c d e f", "y"), (5, "B c d e f g h", "z"), (7, "C", "q"), (7, "C", "q"), (None, "A b c d e f", "n"),
    (None, "only without id", "o"), (None, "only without id", "p"), (9, None, "w"), (10, "", "v"),
]


@pytest.mark.parametrize("operator,empties", [(exact_dedup.deduplicate, 1), (ngram_join.representatives, 2)])
def test_rows_not_ids_decide(spark, operator, empties):
    """Repeated and null ids: one row of each text stays, with its columns, and no other text is lost."""
    df = spark.createDataFrame(ROWS_OF_IDS, "doc_id long, text string, row string").repartition(3)
    got = [tuple(r) for r in operator(df).collect()]
    texts = [t for _, t, _ in got if t]
    assert sorted(texts) == ["A b c d e f", "B c d e f g h", "C", "only without id"]
    assert (3, "A b c d e f", "x") in got and (5, "B c d e f g h", "z") in got and len(got) - len(texts) == empties
