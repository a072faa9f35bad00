import re

import pytest

from docloom.llm import quality_rules
from docloom.llm.queries import op9_quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


def test_query_equals_brute_force(spark, base):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = op9_quality_rules(spark, base).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


CASES = [None, "", " \t\n", "a", "a b", "a b c a b c", "a a a a a", "x\n\nx\nx", "é ü\xa0ñ ó", "# * | <a> & %", "w " * 3000, "🙂 🙂\r\n🙂"]


def test_edge_cases(spark):
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(CASES)], "doc_id long, text string, n_words string")
    rows = {r.doc_id: r for r in quality_rules.apply_rules(df).collect()}
    for i, t in enumerate(CASES):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t


def test_extra_columns_stay(spark):
    """Columns of any name are kept, but for those named as a measure."""
    df = spark.createDataFrame([(1, "a b", 7, 8, 9, 10)], "doc_id long, text string, _words int, __n int, _l int, _w int")
    r = quality_rules.apply_rules(df).first()
    assert (r["_words"], r["__n"], r["_l"], r["_w"]) == (7, 8, 9, 10) and r.n_words == 2
    assert set(df.columns) <= set(quality_rules.apply_rules(df).columns)


def test_long_texts(spark):
    """150,000 words, some windows repeated far apart, and one word over and over."""
    import random

    rng = random.Random(3)
    words = [f"w{rng.randint(0, 60_000)}" for _ in range(150_000)]
    words[140_000:140_040] = words[20:60]
    texts = {1: " ".join(words), 2: "again " * 20_000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality_rules.apply_rules(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])


@pytest.mark.parametrize("text", ["", None])
def test_empty_table(spark, text):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.apply_rules(df).count() == 0


def test_main_path_has_no_python(spark, base):
    plan = op9_quality_rules(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
