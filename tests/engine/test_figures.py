"""Descriptions put into markdown, figures, fields and times against plain loops."""

import random

from pyspark.sql import functions as F

from docloom.operators import answers as N
from docloom.operators import figures as G
from docloom.operators.numbering import numbered_rows


def inserted(md, pages):
    for n in sorted(pages):
        section = "\n\n### Visual Elements\n\n" + "".join(f"**{t or f'Figure on page {n}'}**\n\n{d or ''}\n\n" for t, d in pages[n])
        own, after = f"<!-- Page {n} -->", f"<!-- Page {n + 1} -->"
        if after in md:
            md = md.replace(after, f"{section}\n{after}", 1)
        elif own in md:
            a, b = md.split(own, 1)
            md = a + own + section + b
        else:
            md += f"\n\n## Additional Visual Elements (Page {n})\n{section}"
    return md


def test_descriptions_equal_plain_loops(spark):
    rng = random.Random(4)
    docs, told = [], {}
    for k in range(60):
        docs.append((k, "".join(rng.choice(["<!-- Page 1 -->", "<!-- Page 2 -->", "<!-- Page 3 -->", "text $1\n", "\\"]) for _ in range(rng.randrange(6)))))
        told[k] = {n: [(rng.choice([None, "T$0"]), rng.choice([None, "d\\1"])) for _ in range(rng.randrange(1, 3))] for n in rng.sample([1, 2, 3, 11], rng.randrange(4))}
    rows = [(k, n, p, *d) for k, pages in told.items() for n, ds in pages.items() for p, d in enumerate(ds)]
    out = G.with_descriptions(spark.createDataFrame(docs, "doc int, md string"), spark.createDataFrame(rows, "doc int, page int, place int, title string, description string"), "doc", "md")
    assert {r.doc: r.md for r in out.collect()} == {k: inserted(md, told[k]) for k, md in docs}


def test_times(spark):
    cases = {"2024-05-01T10:00:00": 1714557600, "2024-05-01 10:00:00": 1714557600, "2024-05-01T12:00:00+02:00": 1714557600, "2024-05-01T10:00:00.500Z": 1714557600, "2024-05-01": 1714521600, "soon": None, "": None, "2024-13-01": None}
    df = spark.createDataFrame([(x,) for x in [*cases, None]], "x string").select("x", F.unix_timestamp(G.iso_time(F.col("x"))).alias("t"))
    assert {r.x: r.t for r in df.collect()} == cases | {None: None}


def test_answer_events(spark):
    schema = "id int, tokens array<string>, whole string, citations array<string>, error string"
    rows = [(1, ["a", "b"], "no", ["c1"], None), (2, [" "], "all", ["c1", "c2"], None), (3, ["x"], None, [], None), (4, ["x"], None, ["c"], "lost"), (5, None, None, None, None), (6, [], None, ["c"], None)]
    got = {}
    for r in sorted(N.answer_events(spark.createDataFrame(rows, schema), ["id"], "none").collect()):
        got.setdefault(r.id, []).append((r.event, r.payload))
    end = ("complete", None)
    assert got == {
        1: [("token", "a"), ("token", "b"), ("citation", "c1"), end], 2: [("token", " "), ("token", "all"), ("citation", "c1"), ("citation", "c2"), end], 3: [("token", "none"), end],
        4: [("token", "x"), ("error", "lost")], 5: [("token", "none"), end], 6: [("citation", "c"), end],
    }


def test_numbered_rows(spark):
    rows = random.Random(1).sample([(a, b) for a in [None, "x", "y"] for b in range(100)], 300)
    out = numbered_rows(spark.createDataFrame(rows, "a string, b int").repartition(7), ["a", "b"], "n", 5)
    assert sorted((r.n, r.a, r.b) for r in out.collect()) == [(k, *x) for k, x in enumerate(sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1])), 5)]
    assert numbered_rows(spark.createDataFrame([], "a string, b int"), ["a", "b"], "n").count() == 0
