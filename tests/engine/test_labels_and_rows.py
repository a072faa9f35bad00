"""Label substitution, stitched table rows and merged ranges against plain loops."""

import random
import re
import time

import pytest

from docloom.functions.labels import LabelTrie, substituted
from docloom.operators import matrix as M
from docloom.operators import review
from docloom.sources import artifacts as R
from pyspark.sql import functions as F


def plain(text, labels):
    """At each place the longest id that starts there between word bounds."""
    out, at = [], 0
    keys = sorted((k for k, v in labels.items() if k and v.strip()), key=len, reverse=True)
    while at < len(text):
        for k in keys:
            if re.compile(rf"\b{re.escape(k)}\b").match(text, at):
                out.append(labels[k].strip())
                at += len(k)
                break
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_labels_equal_plain_loops(seed):
    rng = random.Random(seed)
    part = lambda n: "".join(rng.choice(["a", "b", "a1", "_", " ", "-", "(", "$5", "é", "\\b"]) for _ in range(rng.randrange(1, n)))
    for _ in range(60):
        labels = {part(5): part(4) for _ in range(rng.randrange(6))} | {"": "never", "a": " "}
        text = part(60)
        assert LabelTrie(labels).replace(text) == plain(text, labels), (text, labels)


def test_signs_in_labels_are_literal(spark):
    labels = {"id_1": "costs $5", "id_12": r"\b and \1", "(x": "(", "id": "$0"}
    df = spark.createDataFrame([("id_1, id_12 and (x(id) not id_123", labels), (None, labels), ("id", None)], "t string, m map<string,string>")
    assert [r.y for r in df.select(substituted(F.col("t"), F.col("m")).alias("y")).collect()] == [r"costs $5, \b and \1 and (x($0) not id_123", None, "id"]
    chunks = spark.createDataFrame([("d", "id_1 here\ninternal note", "id_12", None)], "doc string, content string, heading string, primary_source string")
    out = review.sanitised(chunks, spark.createDataFrame([("d", labels)], "doc string, labels map<string,string>"), "doc", "internal").first()
    assert out.content == "costs $5 here" and out.heading == r"\b and \1"


def test_thousands_of_labels_take_one_pass():
    labels = {f"cause_{k}": f"Cause {k}" for k in range(20_000)}
    text = " ".join(f"cause_{k % 30_000}" for k in range(100_000))
    began = time.perf_counter()
    done = LabelTrie(labels).replace(text)
    assert time.perf_counter() - began < 10 and done.startswith("Cause 0 Cause 1") and "cause_25000" in done


def stitched(markdown):
    """The rows of one document, line after line."""
    rows, start, text = [], None, ""

    def add(at, joined):
        x = joined.strip()
        if x.startswith("|") and x.endswith("|") and len(x) > 1:
            cells = [c.strip() for c in x.split("|")[1:-1]]
            if not (cells and all(re.fullmatch(r"[:\-\s]+", c) for c in cells)):
                rows.append((at, cells))

    for k, line in enumerate(markdown.split("\n"), 1):
        x = line.strip()
        if start is not None:
            text = f"{text} {x}".strip()
            if x.endswith("|"):
                add(start, text)
                start = None
        elif x.startswith("|") and x.count("|") >= 2 and not x.endswith("|"):
            start, text = k, x
        else:
            add(k, x)
    return rows


def test_stitched_rows_equal_plain_loops(spark):
    rng = random.Random(3)
    lines = ["| a | b |", "| c | d", "e | f |", "", "  ", "text", "|---|:-:|", "| open | x", "|", "| one", "end |", " | g | h | "]
    docs = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 25))) for _ in range(200)]
    got = {}
    for r in M.stitched_rows(spark.createDataFrame(list(enumerate(docs)), "id long, md string"), "id", "md").collect():
        got.setdefault(r.id, []).append((r.line_no, list(r.cells)))
    assert all(sorted(got.get(k, [])) == stitched(d) for k, d in enumerate(docs))


def test_merged_ranges(spark):
    schema = "doc long, n int, status string, processing_time double, n_pages int, markdown string, elements array<struct<page: int, text: string>>, errors array<string>"
    rows = [
        (1, 2, "Success", 1.0, 4, " two ", [(1, "c"), (4, "d")], ["e"]), (1, 1, "success", None, 3, "one", [(1, "a"), (3, "b")], None), (1, 3, "success", 2.0, 1, "three", None, []),
        (2, 1, "success", 1.0, 2, "x", [(1, "y")], []), (2, 2, "failure", 1.0, 2, "z", [(1, "w")], ["lost"]), (3, 1, "success", 1.0, 1, " ", [], []),
    ]
    parts, elements, summary = R.merged_ranges(spark.createDataFrame(rows, schema), "doc", "n")
    assert sorted(tuple(r) for r in parts.collect()) == [(1, 1, 1, 3, 0, "one"), (1, 2, 4, 7, 5, "two"), (1, 3, 8, 8, 10, "three")]
    assert sorted(tuple(r) for r in elements.collect()) == [(1, 1, 1, "a"), (1, 2, 3, "b"), (1, 3, 4, "c"), (1, 4, 7, "d")]
    assert sorted((r.doc, r.status, r.processing_time, r.n_errors, r.n_pages, r.n_chars) for r in summary.collect()) == [(1, "success", 3.0, 1, 8, 15), (2, "failed", 2.0, 1, 4, 4), (3, "failed", 1.0, 0, 1, 0)]
    whole = "\n\n".join(["one", "two", "three"])
    assert all(whole[r.offset : r.offset + len(r.text)] == r.text for r in parts.collect())
