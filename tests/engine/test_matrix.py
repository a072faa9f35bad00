"""Matrices: every step from one pass over the rows, whatever the sheets look like."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import matrix as M
from docloom.plans import registry
from docloom.plans.matrix_plans import matrix_rows

BLANK = [""] * 12


def row(**cells):
    out = list(BLANK)
    for k, v in cells.items():
        out[int(k[1:])] = v
    return out


def sheets(spark):
    a = [row(c6="Close valve 1", c7="short", c8="Open valve 2"), row(c0="1", c1="T1", c6=" x ", c7="X"), row(c0="2", c8="p "), row(c0="1", c1="T1", c8="P")]
    b = [row(c6="ACTION", c7="A1", c8="7"), row(c0="P", c7="X"), row(c0="9", c7="X", c8="X"), row(c6="PERMISSIVE", c7="later", c8="B2")]
    rows = [(s, n, x) for s, given in (("a", a), ("b", b), ("c", [row(c6="No data at all")])) for n, x in enumerate(given)]
    return spark.createDataFrame(rows, "k string, line_no int, cells array<string>").repartition(3)


def test_sheets_with_headers_legends_and_nothing(spark):
    rows = sheets(spark)
    got = sorted(tuple(r) for r in M.relations(rows, "k").select("k", "relation_id", "cause_id", "effect_id", "effect_label", "marker", "row_line", "column").collect())
    assert got == [
        ("a", "rel_0001", "cause_001", "effect_001", "Close valve 1", "X", 1, 6), ("a", "rel_0002", "cause_002", "effect_002", "Open valve 2", "P", 2, 8), ("a", "rel_0003", "cause_001", "effect_002", "Open valve 2", "P", 3, 8),
        ("b", "rel_0001", "cause_001", "effect_001", "A1", "X", 2, 7), ("b", "rel_0002", "cause_001", "effect_002", "B2", "X", 2, 8),
    ]
    assert sorted(tuple(r) for r in M.summary(rows, "k").collect()) == [("a", 2, 2, 3), ("b", 2, 1, 2), ("c", 1, 0, 0)]
    assert {(r.k, r.cause_id): r.markdown for r in M.bullets(rows, "k").collect()} == {("a", "cause_001"): "- X: Close valve 1\n- P: Open valve 2", ("a", "cause_002"): "- P: Open valve 2", ("b", "cause_001"): "- X: A1\n- X: B2"}


def test_a_cause_without_relations_has_its_chunks(spark):
    rows = spark.createDataFrame([("a", 0, row(c6="Close valve 1")), ("a", 1, row(c0="1", c6="X")), ("a", 2, row(c0="2", c9="X")), ("b", 1, row(c0="3", c7="P"))], "k string, line_no int, cells array<string>")
    got = [(r.k, r.chunk_no, r.chunk_id) for r in M.relation_chunks(rows, "k").orderBy("chunk_no").collect()]
    assert got == [("a", 1, "question_heading_0001"), ("a", 2, "row_fact_0002"), ("a", 3, "relation_edge_rel_0001"), ("a", 4, "question_heading_0004"), ("a", 5, "row_fact_0005"), ("b", 6, "question_heading_0006"), ("b", 7, "row_fact_0007")]


@pytest.mark.parametrize("name", ["dom1_matrix_relations", "top10_stable_order", "flt20_jn10_segment_entries", "dom4_jn7_review_bullets", "agg21_matrix_summary"])
def test_rows_are_read_once_and_not_written(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("] parquet") == 1 and "LogicalRDD" not in plan


def test_input_rows_have_a_header_each(spark):
    rows = matrix_rows(spark, "/root/testdata/sf0.001")
    assert rows.where("line_no = 2").count() == rows.select("sheet").distinct().count() and rows.agg(F.min("line_no")).first()[0] == 2
