"""Workflow tables derived from the star schema, in Spark and - as CTEs - in SQL.

orders stand for documents under review, lineitem for their sections, customers for
users, conversations for chats, events for feedback on answers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators.lifecycle import STATUSES
from docloom.sources.tables import table

NOW = "2000-06-01 00:00:00"
_NAMES = [s for s, _, _ in STATUSES]


def _pick(names, index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def users(spark, base):
    return table(spark, base, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.concat("c_mktsegment", F.lit(" "), "c_custkey").alias("full_name"))


def workflow_documents(spark, base):
    k, o = F.col("o_orderkey"), table(spark, base, "orders")
    uploaded = F.col("o_orderdate")
    hours = lambda n: F.make_dt_interval(hours=n)
    return o.select(
        k.alias("id"),
        F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("Order "), k)).alias("title"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.lit("2.0")).alias("version"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("o_orderpriority")).alias("system"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("XLSX")).alias("document_type"),
        _pick(_NAMES, k % 16).alias("status"),
        F.col("o_custkey").alias("uploaded_by"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") + 1).alias("approved_by"),
        (k % 12).cast("int").alias("total_sections"),
        (k % 8).cast("int").alias("review_progress"),
        F.when(k % 3 > 0, F.round(F.pmod(F.col("o_totalprice"), F.lit(100.0)), 2)).alias("qa_score"),
        uploaded.alias("uploaded_at"),
        uploaded.alias("created_at"),
        F.when(k % 10 > 0, uploaded + hours((k % 10).cast("int"))).alias("updated_at"),
        F.when(k % 4 == 0, uploaded + hours(F.lit(1))).alias("optimization_started_at"),
        F.when(k % 6 == 0, uploaded + hours(F.lit(2))).alias("optimization_completed_at"),
        F.when(k % 9 == 0, F.lit("model error")).when(k % 9 == 1, F.lit("")).alias("optimization_error"),
        F.when(k % 10 == 5, F.lit("published")).alias("publication_status"),
        F.concat(F.lit("note "), k).alias("notes"),
    )


DOCS = f"""docs AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Order ' || o_orderkey END AS title,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE '2.0' END AS version, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS system,
    CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'XLSX' END AS document_type, list_extract({_NAMES!r}, o_orderkey % 16 + 1) AS status,
    o_custkey AS uploaded_by, CASE WHEN o_orderstatus = 'F' THEN o_custkey + 1 END AS approved_by,
    CAST(o_orderkey % 12 AS INTEGER) AS total_sections, CAST(o_orderkey % 8 AS INTEGER) AS review_progress,
    CASE WHEN o_orderkey % 3 > 0 THEN round(o_totalprice % 100.0, 2) END AS qa_score, o_orderdate AS uploaded_at, o_orderdate AS created_at,
    CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate + to_hours(o_orderkey % 10) END AS updated_at,
    CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + to_hours(1) END AS optimization_started_at,
    CASE WHEN o_orderkey % 6 = 0 THEN o_orderdate + to_hours(2) END AS optimization_completed_at,
    CASE WHEN o_orderkey % 9 = 0 THEN 'model error' WHEN o_orderkey % 9 = 1 THEN '' END AS optimization_error,
    CASE WHEN o_orderkey % 10 = 5 THEN 'published' END AS publication_status, 'note ' || o_orderkey AS notes
  FROM orders)"""
USERS = "users AS (SELECT c_custkey AS id, c_name AS username, c_mktsegment || ' ' || c_custkey AS full_name FROM customer)"


def section_text():
    """A section's text from the columns of its line."""
    return F.concat_ws(" ", F.lit("Part"), "l_partkey", "l_returnflag", F.repeat(F.lit("x"), (F.col("l_quantity") * 8).cast("int")))


def sections(spark, base, text=True):
    """Sections with their text, or with the columns that ``section_text`` makes it from."""
    li = table(spark, base, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("section_number"),
        F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")).alias("reviewed_by"),
        F.when(F.col("l_linestatus") == "O", "pending").when(F.col("l_returnflag") == "R", "approved").otherwise("in-review").alias("status"),
        *([section_text().alias("content")] if text else ["l_partkey", "l_returnflag", "l_quantity"]),
    )


SECTIONS = """sections AS (
  SELECT l_orderkey AS document_id, l_linenumber AS section_number, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS reviewed_by,
    CASE WHEN l_linestatus = 'O' THEN 'pending' WHEN l_returnflag = 'R' THEN 'approved' ELSE 'in-review' END AS status,
    'Part ' || l_partkey || ' ' || l_returnflag || ' ' || repeat('x', CAST(floor(l_quantity * 8) AS INTEGER)) AS content FROM lineitem)"""


def messages(spark, base):
    """Chat messages; a turn stands for its time."""
    return table(spark, base, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("conversation_id"), "role", F.col("text").alias("content"), F.col("turn").alias("timestamp")
    )


def chats(spark, base):
    """Conversations 0 to one past the greatest id: the last has no message."""
    ids = table(spark, base, "conversations").select("conv_id").distinct()
    last = ids.agg((F.max("conv_id") + 1).alias("conv_id"))
    return ids.union(last).select(F.col("conv_id").alias("id"), (F.col("conv_id") % 100).alias("user_id"), F.concat(F.lit("Chat "), "conv_id").alias("title"), (F.col("conv_id") % 5 == 0).alias("is_pinned"))


CHATS = """messages AS (SELECT conv_id || '-' || turn AS id, conv_id AS conversation_id, role, text AS content, turn AS timestamp FROM conversations),
chats AS (SELECT conv_id AS id, conv_id % 100 AS user_id, 'Chat ' || conv_id AS title, conv_id % 5 = 0 AS is_pinned
  FROM (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT max(conv_id) + 1 FROM conversations))"""


def feedback(spark, base):
    e = table(spark, base, "events")
    sentiment = F.when(F.col("event_type").isin("error", "click"), "down").when(F.col("event_type") == "view", "neutral").otherwise("up")
    return e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("answer_id"), sentiment.alias("sentiment"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("code-"), F.col("event_id") % 7)).when(F.col("event_type") == "click", F.lit("")).alias("reason_code"),
        F.when(F.col("event_id") % 3 == 0, F.lit("Power Block")).when(F.col("event_id") % 3 == 1, F.lit("osbl")).alias("system_scope"),
        F.lit(None).cast("string").alias("area_scope"), F.col("ts").alias("created_at"),
    )


FEEDBACK = """feedback AS (
  SELECT event_id AS id, user_id AS answer_id, CASE WHEN event_type IN ('error', 'click') THEN 'down' WHEN event_type = 'view' THEN 'neutral' ELSE 'up' END AS sentiment,
    CASE WHEN event_type = 'error' THEN 'code-' || (event_id % 7) WHEN event_type = 'click' THEN '' END AS reason_code,
    CASE WHEN event_id % 3 = 0 THEN 'Power Block' WHEN event_id % 3 = 1 THEN 'osbl' END AS system_scope, ts AS created_at FROM events)"""
