"""The registered queries of the corpus operators; each digests its operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import documents


def tokenizer(name: str) -> str:
    """Path of a public tokenizer file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import lm_scoring
    from docloom.llm.common import remainder

    rows = lm_scoring.folds(documents(spark, base))
    out = lm_scoring.score(rows, *lm_scoring.train(rows.where("train")))
    held_out = (remainder("doc_id", 10) == 0).alias("held_out")
    return out.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_language_id(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import language_id
    from docloom.llm.common import remainder

    docs = documents(spark, base)
    models = language_id.train(language_id.training_rows(docs))
    out = language_id.predict(docs, models)
    return out.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op3_packing(spark: SparkSession, base: str, path: str | None = None) -> DataFrame:
    from docloom.llm import packing

    return packing.pack_documents(documents(spark, base), path or tokenizer("word_bpe_49k.json"))


def op4_piece_encoding(spark: SparkSession, base: str, path: str | None = None) -> DataFrame:
    from docloom.llm import piece_encoding

    return piece_encoding.digests(documents(spark, base), path or tokenizer("piece_bpe_32k.model"))


def op5_exact_dedup(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import exact_dedup

    return exact_dedup.classes(documents(spark, base))


def op6_ngram_join(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import ngram_join

    return ngram_join.classes(documents(spark, base))


def op7_secret_scan(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import secret_scan

    docs = documents(spark, base)
    return secret_scan.scan(docs, secret_scan.train(docs))


def op8_token_counts(spark: SparkSession, base: str, path: str | None = None) -> DataFrame:
    from docloom.llm import token_counts

    return token_counts.token_counts(documents(spark, base), path or tokenizer("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import quality_rules

    out = quality_rules.apply_rules(documents(spark, base).select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_html_extraction(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import html_extract

    return html_extract.main_text(spark.read.parquet(f"{base.rstrip('/')}/pages.parquet"))


def op11_minhash_dedup(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import minhash_dedup

    return minhash_dedup.classes(documents(spark, base))


def op12_token_alignment(spark: SparkSession, base: str, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    from docloom.llm import token_alignment

    return token_alignment.align(documents(spark, base), a_path or tokenizer("byte_bpe_50k.json"), b_path or tokenizer("piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, base: str) -> DataFrame:
    from docloom.llm import merkle_manifest as merkle
    from docloom.llm.common import remainder

    changed = (remainder("doc_id", 3) == 0) & F.col("doc_id").isNotNull()
    proofs = merkle.prove(documents(spark, base), {"changed": merkle.changed_leaf(changed)})
    out = merkle.verify(proofs, F.coalesce("changed", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_piece_encoding": op4_piece_encoding,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_ngram_join": op6_ngram_join,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_html_extraction": op10_html_extraction,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

def _quality_oracle() -> str:
    from docloom.llm.quality_rules import RULES, STOP_WORDS

    tests = [f"{name} {op} {bound}" for name, low, high in RULES for op, bound in ((">=", low), ("<=", high)) if bound is not None]
    return rf"""
        WITH w AS (
          SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 1)) AS i)),
        twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
        rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) r(j) GROUP BY 1),
        lines AS (SELECT doc_id, x FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
        by_line AS (SELECT doc_id, count(*) AS n, count(DISTINCT x) AS d, count(*) FILTER (regexp_matches(x, '(\.\.\.|…)\s*$')) AS e, count(*) FILTER (regexp_matches(x, '^\s*[-•*]')) AS b FROM lines GROUP BY 1),
        m AS (
          SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, coalesce(l.e, 0) AS e, coalesce(l.b, 0) AS b,
            len(list_intersect(list_transform(ws, lambda x: lower(x)), {list(dict.fromkeys(STOP_WORDS))!r})) AS stop_words, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_alpha
          FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN by_line l USING (doc_id)),
        r AS (
          SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
            coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(e / nullif(n_lines, 0), 0) AS ellipsis_line_ratio, coalesce(b / nullif(n_lines, 0), 0) AS bullet_line_ratio,
            coalesce(n_alpha / nullif(n_words, 0), 0) AS alpha_word_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio FROM m)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
          CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM r"""


def _crc32(value: str) -> str:
    """DuckDB: unsigned crc32 of a text of ASCII characters, by its polynomial."""
    step = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    rounds = "list_reduce(list_prepend(xor(a, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda c, k: " + step.format("c") + ")"
    codes = f"[CAST(ascii(x) AS BIGINT) FOR x IN string_split({value}, '')]"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda a, b: {rounds}), 4294967295)"


def _merkle_oracle(levels: int = 8, upper: int = 4) -> str:
    """The manifest level by level, for up to 8**levels rows of a language and 8**upper languages."""
    leaf = lambda text: "sha256(concat(" + ", ".join(f"coalesce(concat(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR), ':', CAST({c} AS VARCHAR)), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""t AS MATERIALIZED (
        SELECT coalesce(':' || lang, '-') AS g, doc_id, {leaf('text')} AS leaf,
          CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS claimed FROM documents)""",
        "a0 AS MATERIALIZED (SELECT g, leaf AS h, doc_id, claimed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM t)"]
    grown = lambda name, k: f"""{name}{k + 1} AS MATERIALIZED (
        SELECT g, i // 8 AS i, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (n + 7) // 8 AS n FROM {name}{k} GROUP BY g, i // 8, n)"""  # noqa: E731
    side = lambda name, k, op, own: f"coalesce((SELECT string_agg(s.h, '' ORDER BY s.i) FROM {name}{k} s WHERE s.g = {own}.g AND s.i // 8 = {own}.i // 8 AND s.i {op} {own}.i), '')"
    parts += [grown("a", k) for k in range(levels)]
    parts.append(f"u0 AS MATERIALIZED (SELECT '' AS g, g AS tree, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM a{levels})")
    parts += [grown("u", k) for k in range(upper)]

    def folded(name: str, count: int, first: str, keep: str) -> list[str]:
        out = [first]
        for k in range(count):
            l, r, more = side(name, k, "<", "x"), side(name, k, ">", "x"), f"(SELECT max(n) FROM {name}{k} s WHERE s.g = x.g) > 1"
            out.append(f"""{name}f{k + 1} AS MATERIALIZED (
                SELECT {keep}, g, i // 8 AS i, CASE WHEN m THEN proof || l || r ELSE proof END AS proof, CASE WHEN m THEN sha256(l || f || r) ELSE f END AS f
                FROM (SELECT x.*, {l} AS l, {r} AS r, {more} AS m FROM {name}f{k} x) y)""")
        return out

    parts += folded("a", levels, "af0 AS MATERIALIZED (SELECT doc_id, h AS leaf, g, i, '' AS proof, claimed AS f FROM a0)", "doc_id, leaf")
    parts += folded("u", upper, f"uf0 AS MATERIALIZED (SELECT b.doc_id, b.leaf, u0.h AS subroot, u0.g, u0.i, b.proof, b.f FROM af{levels} b JOIN u0 ON u0.tree = b.g)", "doc_id, leaf, subroot")
    return f"""WITH {", ".join(parts)}
        SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM uf{upper}, u{upper} r"""


ORACLES = {
    "op13_merkle_manifest": _merkle_oracle(),
    "op9_quality_rules": _quality_oracle(),
    "op5_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
}
