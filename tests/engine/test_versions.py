"""Versioned tables: atomic publishing, rollback as a new version, notes, publishers that meet."""

import threading

import pytest

from docloom.sources.versions import VersionedTable


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/versions", "doc")


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "doc long, text string")


def state(table, version=None):
    return sorted((r.doc, r.text) for r in table.read(version).collect())


def test_versions_and_rollback(spark, table):
    assert table.head() == 0
    assert table.publish(rows(spark, [(1, "a"), (1, "a2"), (2, "b")]), remark="first") == 1
    assert table.publish(rows(spark, [(2, "B"), (3, "c")])) == 2
    assert table.remove(rows(spark, [(1, "")]).select("doc"), "doc long, text string") == 3
    assert table.rollback(1, "as it was") == 4
    assert table.publish(rows(spark, [(4, "d")])) == 5
    assert table.restore(rows(spark, [(2, ""), (4, "")]), 3) == 6
    assert state(table, 1) == state(table, 4) == [(1, "a"), (1, "a2"), (2, "b")]
    assert state(table, 2) == [(1, "a"), (1, "a2"), (2, "B"), (3, "c")]
    assert state(table, 3) == [(2, "B"), (3, "c")]
    assert state(table, 5) == [(1, "a"), (1, "a2"), (2, "b"), (4, "d")]
    assert state(table) == [(1, "a"), (1, "a2"), (2, "B")]
    assert [tuple(r) for r in table.history().orderBy("version").collect()][3] == (4, "rollback", 1, "as it was")
    with pytest.raises(ValueError):
        table.rollback(7)


def test_a_publish_that_fails_is_not_seen(spark, table):
    table.publish(rows(spark, [(1, "a")]))
    with pytest.raises(Exception, match="broken"):
        table.publish(spark.range(4).selectExpr("id AS doc", "if(id = 3, raise_error('broken'), 'x') AS text"))
    assert table.head() == 1 and state(table) == [(1, "a")]


def test_publishers_that_meet_all_get_through(spark, table):
    """Six at a time: each gets a number of its own, none is lost, each reads what it wrote."""
    found, errors = [], []

    def run(k):
        try:
            found.append(VersionedTable(spark, table.folder, "doc").publish(rows(spark, [(k, f"t{k}")])))
        except Exception as e:  # pragma: no cover
            errors.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(found) == [1, 2, 3, 4, 5, 6]
    assert state(table) == [(k, f"t{k}") for k in range(6)]


def test_a_taken_number_is_refused(spark, table):
    table.publish(rows(spark, [(1, "a")]))
    first = table.entries()[0]
    assert not table._claim(first._replace(remark="again")) and table.entries() == [first]


def test_review_notes(spark, table):
    table.publish(rows(spark, [(1, "a")]))
    schema = "doc long, reviewer string, section_id string, issue_type string, original string, corrected string, rationale string, ambiguity_flags array<string>"
    assert table.note(spark.createDataFrame([(1, "r", "s1", "typo", "x" * 500, "y", "why", None)], schema)) == 2
    assert table.note(spark.createDataFrame([(1, "q", "s2", "gap", "o", "c", "w", ["f"])], schema)) == 3
    got = sorted((r.version, r.reviewer, len(r.original), r.ambiguity_flags) for r in table.notes().collect())
    assert got == [(2, "r", 200, []), (3, "q", 1, ["f"])] and state(table) == [(1, "a")]
