import hashlib
import re

import pytest

from docloom.llm import secret_scan
from docloom.llm.queries import op7_secret_scan


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    out.sort()
    label = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in out)
    return *(sum(k == j for _, k, _ in out) for j in range(3)), hashlib.sha256(label.encode()).hexdigest(), label


def same(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        *want, label = brute(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want, texts[r.doc_id]
        assert set(filter(None, label.split(","))) <= set(r.spans.split(","))
        assert all(s.startswith("format:") for s in set(filter(None, r.spans.split(","))) - set(label.split(",")))


def test_query_equals_brute_force(spark, base):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{base}/documents.parquet").collect()}
    rows = op7_secret_scan(spark, base).collect()
    same(rows, texts)
    assert any(r.spans for r in rows)


CASES = [
    None, "", "é token = \"0123456789abcdef0123456789abcdef\" é", "password=abc", "PASSWORD: 'hunter22'", "api_key=api_key=abcdef", "secret: token: abcdefgh",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16 + "x", "AKIAAKIA" + "B" * 12, "f" * 23, "f" * 24, "f" * 24 + "g" + "0" * 30, "ſecret=abcdefg", "toKen=abcdefg", "a" * 200_000 + " token=zzzzzzz",
    "use ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5 now", "Donaudampfschifffahrtsgesellschaft internationalization2",
]


def test_edge_cases(spark):
    texts = dict(enumerate(CASES))
    df = spark.createDataFrame([(d, t, 1) for d, t in texts.items()], "doc_id long, text string, spans int").coalesce(1)
    rows = secret_scan.scan(df, secret_scan.train(df), redacted=True).collect()
    same(rows, texts)
    by = {r.doc_id: r for r in rows}
    assert by[16].spans == "format:4:44" and by[16].redacted == "use [SECRET] now"
    assert by[17].spans == "" and by[17].redacted == CASES[17] and by[0].redacted is None
    assert secret_scan.scan(df.limit(0), secret_scan.train(df.limit(0))).count() == 0


def test_merging_generalises():
    values = secret_scan.public_formats(200)["access"]
    machine = secret_scan.Automaton(values[:150])
    assert machine.states < 60
    scores = [machine.score(v) for v in values[150:]]
    assert sum(s > float("-inf") for s in scores) > 40
    assert machine.score("internationalization") == float("-inf")


@pytest.mark.parametrize("text,found,want", [("abcdef", [(1, 0, 3), (2, 2, 5)], "a#f"), ("abc", [], "abc"), ("abab", [(0, 0, 1), (2, 0, 3)], "#b#b")])
def test_redact(text, found, want):
    assert secret_scan.redact(text, found, "#") == want


def test_a_batch_of_long_texts_takes_little_memory():
    """10,000 rows of 4 KB: the scan may not hold more than a few texts beyond the batch."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["word and more " * 300 + ("token = abcdef123456" if k % 100 == 0 else "") for k in range(10_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), texts], ["doc_id", "text"])
    held = type("Held", (), {"value": secret_scan.fit(secret_scan.public_formats())})
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    (out,) = secret_scan._scan(held, False)([batch])
    assert tracemalloc.get_traced_memory()[1] < 10 << 20 and pa.total_allocated_bytes() - before < 10 << 20
    tracemalloc.stop()
    assert sum(out.column("n_assign").to_pylist()) == 100


@pytest.mark.parametrize("line", ["token=aB3dE5fG7hI9jK1l 0123456789abcdef01234567\n", "0123456789abcdef01234567\n", "ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5 "])
def test_megabytes_of_secrets_take_seconds(line):
    """Base spans and candidates are merged by one pass over both."""
    import time

    formats = secret_scan.Formats(secret_scan.fit(secret_scan.public_formats()))
    text = line * (4_000_000 // len(line))
    began = time.perf_counter()
    base, every = secret_scan.spans(text, formats)
    assert time.perf_counter() - began < 20 and len(every) >= text.count(line.strip()) and set(base) <= set(every)


def test_candidates_in_base_spans_equal_plain_loops():
    import random

    rng, formats = random.Random(4), secret_scan.Formats(secret_scan.fit(secret_scan.public_formats()))
    parts = ["token=", "f" * 30, "ghp_aB3dE5fG7hI9jK1lM3nO5pQ7rS9tU1vW3xY5", " ", "secret: ", "AKIA" + "A1B2C3D4E5F6G7H8", "word", ",", "-"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 20)))
        base, every = secret_scan.spans(text, formats)
        plain = [(m.start(), 3, m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{6,}", text) if not any(s <= m.start() and m.end() <= e for s, _, e in base) and secret_scan.likely(formats.automata, m.group())]
        assert every == sorted(base + plain)


def test_short_values_are_learned_and_scored():
    """A format of ten characters, seen as labelled values, is found without its key; words and numbers are not."""
    import random

    rng = random.Random(1)
    value = lambda: "Q7" + "".join(rng.choice("0123456789XYZ") for _ in range(8))
    formats = secret_scan.Formats(secret_scan.fit({"corpus_assign": [value() for _ in range(300)]}))
    found = [secret_scan.spans(f"see {value()} here", formats)[1] for _ in range(100)]
    assert sum(f == [(4, 3, 14)] for f in found) > 95
    assert secret_scan.spans("Quality internationalization 20240105 2024-01-05 Question ABCDEFGHIJ 1234567890", formats)[1] == []
