"""Sections, gates, matrices, alignment, JSON, sinks and streams on small fixtures."""

import random
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import json_repair as J
from docloom.functions import text as T
from docloom.functions.ids import uuid5
from docloom.operators import alignment as A
from docloom.operators import feedback as FB
from docloom.operators import matrix as M
from docloom.operators import sections as S
from docloom.sources import artifacts as R
from docloom.streaming import jobs


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_uuid5(spark):
    names = ["a:1", "é:2", "", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", uuid5(F.col("n")).alias("u"))
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, r.n)) for r in df.collect())


@pytest.mark.parametrize("x,want", [("3rd-unit of x", "3Rd-Unit Of X"), ("ab", "Ab")])
def test_title_case(spark, x, want):
    assert one(spark, T.title_case, x) == want == x.title()


@pytest.mark.parametrize("x,want", [(" osbl ", "OSBL (Outside Battery Limits)"), ("north  YARD", "North Yard"), ("  ", None), (None, None)])
def test_workspace_name(spark, x, want):
    assert one(spark, T.workspace_name, x) == want


def test_strip_takes_all_white_space(spark):
    assert one(spark, T.strip, "\t\xa0 a b\n") == "a b"


def test_sections(spark):
    md = "# T\nintro\n## A one\nx\n### sub\ny\n## B\nz"
    rows = S.sections(spark.createDataFrame([(1, md)], "id int, markdown string")).collect()
    assert [(r.section_no, r.heading, r.content, r.start_line, r.end_line) for r in rows] == [(1, "A one", "x\n### sub\ny", 3, 6), (2, "B", "z", 7, 8)]
    plain = spark.createDataFrame([(1, "t", "no heading"), (2, "t", " "), (3, "t", None)], "id int, title string, markdown string")
    assert [(r.id, r.content) for r in S.single_section_fallback(plain).collect()] == [(1, "no heading")]


def metrics(spark, rows):
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, heading string, content string, has_tables boolean, table_facts array<string>")
    return S.qa_metrics(df, "doc").first()


def test_table_ratio(spark):
    table = "| a | b |\n|---|---|"
    assert metrics(spark, [("Data", table, True, ["fact"])]).table_facts_ratio == 100.0
    assert metrics(spark, [("CONTENTS", table, True, None), ("LIST OF FIGURES", table, True, None), ("Data", table, True, ["f"])]).table_facts_ratio == 100.0
    assert metrics(spark, [("Data", "- fact\n" + table, False, None)]).table_facts_ratio == 100.0
    assert metrics(spark, [("Data", table, False, [" "])]).table_facts_ratio == 0.0


def test_question_words_match_inside_words(spark):
    assert metrics(spark, [("Show totals", "x", False, None)]).question_headings == 100.0
    assert metrics(spark, [("Totals", "x", False, None)]).question_headings == 0.0


def test_confidence_penalty_and_gate(spark):
    df = spark.createDataFrame([(100.0, 100.0, 100.0, 100.0, 0.5)], "citation_coverage double, question_headings double, table_facts_ratio double, figure_coverage double, hallucination_risk double")
    m = df.withColumn("confidence", S.confidence())
    assert m.first().confidence == 95.0
    assert S.gate(m).first().decision == "approved"
    assert S.gate(m.withColumn("citation_coverage", F.lit(1.0)).withColumn("critical_issues", F.lit(1))).first().decision == "rejected"


def test_greedy_segments_of_large_groups(spark):
    rng = random.Random(3)
    rows = [(k, i, rng.randrange(0, 9000), rng.random() < 0.3) for k, n in (("a", 900), ("b", 3), ("c", 1), ("d", 250)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i long, s int, h boolean")
    got = {(r.k, r.i): r.segment for r in S.greedy_segments(df, "k", "i", "s", "h").collect()}
    for key in "abcd":
        run, n, chars = 0, 0, 0
        for _, i, size, head in (r for r in rows if r[0] == key):
            size = max(size, 1)
            if n == 0 or n >= 4 or chars + size > 18_000 or (head and chars >= 6_000):
                run, n, chars = run + 1, 0, 0
            n, chars = n + 1, chars + size
            assert got.pop((key, i)) == run
    assert not got


def test_segments_run_past_id_200(spark, base):
    from docloom.plans import registry

    rows = registry.queries()["win4_greedy_segments"](spark, base).collect()
    docs = spark.read.parquet(f"{base}/documents.parquet").select("source", "lang").distinct().count()
    assert len({r.bundle for r in rows}) == docs and len(rows) == spark.read.parquet(f"{base}/documents.parquet").count()


def test_outline_gives_rows(spark):
    from docloom.operators import chunks as C

    df = spark.createDataFrame([("a", i, "h" * 80, "x  " * 400) for i in range(5)], "source string, page_number long, heading string, markdown string")
    out = C.outline(df, "source")
    assert out.columns == ["source", "page_number", "heading", "preview"] and out.count() == 5
    assert {(len(r.heading), len(r.preview)) for r in out.collect()} == {(60, 500)}
    assert "Collect" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_every_line_has_its_section(spark, base):
    import re

    from docloom.plans import registry
    from docloom.plans.text_plans import markdown

    got = {(r.doc_id, r.line_no): r.heading for r in registry.queries()["jn8_range_join_sheets"](spark, base).collect()}
    n = 0
    for d in markdown(spark, base).collect():
        lines = d.markdown.split("\n")
        n += len(lines)
        heads = [re.match(r"##[ \t]+[^ \t\r\n]", x) is not None for x in lines]
        for i in range(len(lines)):
            at = max((k for k in range(i + 1) if heads[k]), default=next((k for k, h in enumerate(heads) if h), None))
            assert got[d.doc_id, i + 1] == (None if at is None else lines[at].lstrip("#").strip())
    assert n == len(got)


def test_resume_skips_only_what_is_done(spark, base):
    from docloom.plans import registry

    ids = lambda name: {r.doc_id for r in spark.read.parquet(f"{base}/{name}.parquet").select("doc_id").collect()}
    got = {r.doc_id for r in registry.queries()["flt24_resume_skip"](spark, base).collect()}
    assert got == ids("documents") - ids("labels") and max(got) >= 900


def test_matrix_with_legend_row(spark):
    head = ["", "", "", "", "", "", "ACTION", "Close valve 1", "Open valve 2", "7", "", ""]
    data = ["1", "T1", "High level", "", "", "", "", "X", "p", "X", "", ""]
    legend = ["X", "ACTION", "", "", "", "", "", "X", "", "", "", ""]
    md = "\n".join("| " + " | ".join(c) + " |" for c in (head, ["---"] * 12, legend, data, data))
    rows = M.table_rows(spark.createDataFrame([("d", md)], "k string, md string"), "k", "md")
    found = M.relations(rows, "k").orderBy("relation_id").collect()
    assert [(r.relation_id, r.cause_id, r.effect_label, r.marker) for r in found] == [
        ("rel_0001", "cause_001", "Close valve 1", "X"), ("rel_0002", "cause_001", "Open valve 2", "P"), ("rel_0003", "cause_001", "Close valve 1", "X"), ("rel_0004", "cause_001", "Open valve 2", "P"),
    ]


def test_page_spans_move_forward(spark):
    lines = [f"this is line number {i} of the text" for i in range(90)]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, markdown string")
    ev = spark.createDataFrame([(1, p, lines[(p - 1) * 30]) for p in (1, 2, 3)], "doc_id long, page_number int, text_preview string")
    got = [(r.page_number, r.start_line, r.end_line) for r in A.page_spans(docs, ev).orderBy("page_number").collect()]
    assert got == [(1, 0, 30), (2, 30, 60), (3, 60, 90)]


def test_joined_headings(spark):
    df = spark.createDataFrame([("## A\n## B\ntext\n## C\n\n## D\nend\n### E",), (None,)], "m string")
    assert [r.m for r in A.with_joined_headings(df, "m").collect()] == ["## A / B\ntext\n\n## C / D\nend\n### E", None]


@pytest.mark.parametrize(
    "raw,want",
    [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('say {"a": [1, 2', '{"a": [1, 2]}'), ("{'a': 1,}", '{"a": 1}'), ('{"a": "cut', '{"a": "cut"}'), ("[1]", None), ("", None), (None, None)],
)
def test_json_recovery(raw, want):
    assert J.recovered(raw) == want


def test_streaks(spark):
    rows = [(1, "a", "up", "2024-01-01"), (2, "a", "down", "2024-01-02"), (3, "a", "down", "2024-01-03"), (4, "a", "down", "2024-01-03"), *[(10 + i, "b", "down", f"2024-01-0{i}") for i in range(1, 6)], (20, "b", "up", "2024-02-01")]
    df = spark.createDataFrame(rows, "id int, answer_id string, sentiment string, created_at string")
    got = {r.answer_id: r for r in FB.snapshots(df).collect()}
    assert (got["a"].negative_streak, got["a"].is_flagged, got["a"].quality_score) == (3, True, -0.5)
    assert (got["b"].negative_streak, got["b"].is_flagged) == (0, True)


def test_sinks(spark, tmp_path):
    folder = str(tmp_path / "chunks")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    R.publish(spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "c")], "document_id string, text string"), folder)
    R.publish(spark.createDataFrame([("d1", "z")], "document_id string, text string"), folder)
    assert sorted((r.document_id, r.text) for r in spark.read.parquet(folder).collect()) == [("d1", "z"), ("d2", "c")]
    R.append(spark.createDataFrame([(1,)], "x int"), str(tmp_path / "log"))
    R.append(spark.createDataFrame([(2,)], "x int"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_artifact_scan(spark, tmp_path):
    for sub, body in (("a", '{"markdown": "m", "chunks": []}'), ("b", '{"markdown": "other"}'), ("c", "broken")):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / ("x_opt.json" if sub != "c" else "y_opt.json")).write_text(body)
    found = R.scan(spark, str(tmp_path), "*_opt.json", "markdown string, chunks array<struct<content: string>>")
    rows = found.select("name", "markdown", R.usable("chunks", "markdown").alias("ok")).orderBy("name").collect()
    assert [(r.name, r.markdown, r.ok) for r in rows] == [("x_opt.json", "m", True), ("y_opt.json", None, False)]


def test_late_rows_are_dropped(spark, tmp_path):
    """Append mode with a short watermark: the last day never closes and late files lose rows."""
    for i, day in enumerate(("2024-01-01", "2024-01-10", "2024-01-02", "2024-01-20")):
        spark.createDataFrame([(f"{day} 12:00:00", "k")], "ts string, kind string").select(F.col("ts").cast("timestamp_ntz").alias("ts"), "kind").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read(spark, str(tmp_path / "in"), "ts timestamp_ntz, kind string")
    out = jobs.run_to_end(jobs.windowed_counts(stream, "ts", "kind", late="1 hour"), "late_rows", "append")
    assert 1 <= out.count() < 4


def test_snapshots_in_batches(spark, tmp_path):
    """A streak that starts in one batch goes on in the next."""
    rows = [(1, 1, "down", "2024-01-01"), (2, 1, "down", "2024-01-02"), (3, 2, "up", "2024-01-03"), (4, 1, "up", "2024-01-04"), (5, 1, "down", "2024-01-05")]
    schema = "id long, answer_id long, sentiment string, created_at string"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.parquet(str(tmp_path / f"src/b={k}"))
    out = jobs.run_to_end(jobs.feedback_snapshots(jobs.read(spark, str(tmp_path / "src/b=*"), schema)), "snapshots_in_batches", "update")
    newest = out.groupBy("answer_id").agg(F.max_by("negative_streak", "feedback_count").alias("s"), F.max("feedback_count").alias("n")).collect()
    want = {str(r.answer_id): (r.feedback_count, r.negative_streak) for r in FB.snapshots(spark.createDataFrame(rows, schema)).collect()}
    assert {str(r.answer_id): (r.n, r.s) for r in newest} == want == {"1": (4, 1), "2": (1, 0)}


def test_joined_headings_take_one_text_at_a_time(spark):
    """An Arrow batch is read text by text; nulls and many rows come back in place."""
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('## A', id, '\n\n## B\nx') END AS m")
    out = A.with_joined_headings(df, "m")
    assert A.headings_arrow(pa.array(["## A\n## B", None, ""])).to_pylist() == ["## A / B", None, ""]
    assert {r.id: r.m for r in out.collect()} == {k: None if k % 7 == 0 else f"\n## A{k} / B\nx" for k in range(300)}


def test_section_texts_stay_out_of_the_joins(spark, base):
    """The exchanges of the section summaries carry the inputs of a text, not the text."""
    from docloom.plans import registry

    plan = registry.queries()["prj2_jn2_section_summaries"](spark, base)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins, texts = ([k for k, line in enumerate(plan) if word in line] for word in ("Join", "repeat(x"))
    assert len(joins) == 2 and texts and max(texts) < min(joins)
