"""Views, filters, joins, aggregates, windows and lifecycle queries on the workflow tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators import feedback as FB
from docloom.operators import lifecycle as L
from docloom.operators import views as V
from docloom.plans.registry import register
from docloom.plans.workflow import CHATS, DOCS, FEEDBACK, NOW, SECTIONS, USERS, chats, feedback, messages, section_text, sections, users, workflow_documents
from docloom.sources.tables import table


EVENTS_NOW = "2024-01-31 00:00:00"


def now():
    """The fixed present of the workflow tables."""
    return F.to_timestamp_ntz(F.lit(NOW))


def events_now():
    return F.to_timestamp_ntz(F.lit(EVENTS_NOW))




@register("src1_document_listing", f"WITH {DOCS} SELECT id, title, status, uploaded_at FROM docs")
def src1_document_listing(spark, base):
    return workflow_documents(spark, base).select("id", "title", "status", "uploaded_at").orderBy(F.desc("uploaded_at"), "id")


@register("prj1_jn1_document_summaries", f"""WITH {DOCS}, {USERS}
  SELECT d.id, u.username AS uploaded_by_username, a.full_name AS approved_by_name,
    CASE WHEN total_sections > 0 THEN CAST(round(CAST(review_progress AS DECIMAL(18,6)) / total_sections * 100, 2) AS DOUBLE) ELSE 0.0 END AS review_progress_percent
  FROM docs d LEFT JOIN users u ON uploaded_by = u.id LEFT JOIN users a ON approved_by = a.id""")
def prj1_jn1_document_summaries(spark, base):
    return V.document_summaries(workflow_documents(spark, base), users(spark, base)).select("id", "uploaded_by_username", "approved_by_name", "review_progress_percent")


@register("prj2_jn2_section_summaries", f"""WITH {DOCS}, {USERS}, {SECTIONS}
  SELECT document_id, section_number, title AS document_title, d.status AS document_status, u.username AS reviewed_by_username, left(content, 200) AS content_preview, length(content) AS content_length
  FROM sections s JOIN docs d ON document_id = d.id LEFT JOIN users u ON reviewed_by = u.id""")
def prj2_jn2_section_summaries(spark, base):
    out = V.section_summaries(sections(spark, base, text=False), workflow_documents(spark, base), users(spark, base), section_text())
    return out.select("document_id", "section_number", "document_title", "document_status", "reviewed_by_username", "content_preview", "content_length")


@register("jn3_jn6_agg6_conversation_summaries", f"""WITH {CHATS}, {USERS}
  SELECT c.id, u.username, (SELECT count(*) FROM messages m WHERE m.conversation_id = c.id) AS message_count,
    coalesce((SELECT max(timestamp) FROM messages m WHERE m.conversation_id = c.id), -1) AS last_message_at,
    (SELECT left(content, 200) FROM messages m WHERE m.conversation_id = c.id ORDER BY timestamp DESC LIMIT 1) AS last_message_preview
  FROM chats c JOIN users u ON c.user_id = u.id""")
def jn3_jn6_agg6_conversation_summaries(spark, base):
    out = V.conversation_summaries(chats(spark, base), users(spark, base), messages(spark, base))
    return out.select("id", "username", "message_count", F.coalesce("last_message_at", F.lit(-1)).alias("last_message_at"), "last_message_preview")


@register("jn4_bookmark_details", f"""WITH {CHATS}, {USERS}
  SELECT m.id AS message_id, u.username, c.title AS conversation_title, m.role AS message_role
  FROM messages m JOIN chats c ON m.conversation_id = c.id JOIN users u ON u.id = m.conversation_id * 7 % 1000 WHERE m.timestamp % 3 = 0""")
def jn4_bookmark_details(spark, base):
    m = messages(spark, base)
    marks = m.where("timestamp % 3 = 0").select(F.col("id").alias("message_id"), "conversation_id", (F.col("conversation_id") * 7 % 1000).alias("user_id"))
    return V.bookmark_details(marks, users(spark, base), chats(spark, base), m).select("message_id", "username", "conversation_title", "message_role")


@register("prj3_display_rows", f"""WITH {DOCS}
  SELECT id, coalesce(nullif(title, ''), 'Document ' || left(CAST(id AS VARCHAR), 8) || '…') AS title, coalesce(version, '1.0') AS version,
    coalesce(system, '—') AS system, coalesce(nullif(document_type, ''), 'PDF') AS document_type FROM docs""")
def prj3_display_rows(spark, base):
    return V.listing(workflow_documents(spark, base)).select("id", "title", "version", "system", "document_type")


_STATUS_VALUES = ", ".join(f"('{s}', {p}, {'NULL' if g is None else repr(g)})" for s, p, g in L.STATUSES)


@register("prj4_prj5_prj6_status_view", f"""WITH {DOCS}, dim(s, progress, stage) AS (VALUES {_STATUS_VALUES})
  SELECT id, progress, stage, coalesce(publication_status, CASE WHEN status = 'final-approved' THEN 'pending' END) AS publication_status,
    CASE WHEN status IN ('approved-for-optimization', 'optimizing', 'optimization-complete', 'failed') THEN coalesce(optimization_started_at, created_at) ELSE created_at END AS started_at,
    CASE WHEN status IN ('optimization-complete', 'failed') AND optimization_completed_at IS NOT NULL THEN optimization_completed_at
         WHEN progress = 100 OR status = 'failed' THEN updated_at END AS completed_at,
    coalesce(nullif(optimization_error, ''), CASE WHEN status = 'failed' THEN notes END) AS error
  FROM docs JOIN dim ON status = s""")
def prj4_prj5_prj6_status_view(spark, base):
    return L.status_view(workflow_documents(spark, base)).select("id", "progress", "stage", "publication_status", "started_at", "completed_at", "error")


@register("prj7_number_coercion", """
  SELECT p_partkey, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS DOUBLE), 0.0) AS brand_no, coalesce(TRY_CAST(p_name AS DOUBLE), 0.0) AS name_no FROM part""")
def prj7_number_coercion(spark, base):
    p = table(spark, base, "part")
    return p.select("p_partkey", V.number_or_zero(F.split_part("p_brand", F.lit("#"), F.lit(2))).alias("brand_no"), V.number_or_zero(F.col("p_name")).alias("name_no"))


@register("flt1_rest_filters", """
  SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND NOT p_type = 'ECONOMY' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND (p_name LIKE '%ring' OR p_name ILIKE 'BLUE%')""")
def flt1_rest_filters(spark, base):
    p = table(spark, base, "part").where("p_size >= 10")
    out = V.rest_filter(p, {"p_size": "lt.40", "p_type": "not.eq.ECONOMY", "p_brand": "in.(Brand#1,Brand#2,Brand#3)"}, [("p_name", "like.*ring"), ("p_name", "ilike.BLUE*")])
    return out.select("p_partkey")


@register("flt2_select_order_range", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def flt2_select_order_range(spark, base):
    return V.page(table(spark, base, "orders").select("o_orderkey", "o_totalprice"), 3, 50, F.desc("o_totalprice"), F.col("o_orderkey"))


@register("flt10_document_search", f"""WITH {DOCS}
  SELECT id, CASE WHEN lower(title) LIKE '%r 1_5%' THEN 1.0 ELSE 0.5 END AS relevance FROM docs
  WHERE lower(title) LIKE '%r 1_5%' OR lower(system) LIKE '%r 1_5%' OR lower(document_type) LIKE '%r 1_5%'""")
def flt10_document_search(spark, base):
    return V.search_documents(workflow_documents(spark, base), "R 1_5").select("id", "relevance")


@register("flt11_queues", f"""WITH {DOCS}
  SELECT status, status IN ('approved', 'final-approved', 'rejected') AS finalized, status IN ('optimization-complete', 'qa-review') AS editable, count(*) AS n FROM docs GROUP BY ALL""")
def flt11_queues(spark, base):
    d = workflow_documents(spark, base)
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("n")).withColumns({"finalized": F.col("status").isin(*L.FINALIZED), "editable": F.col("status").isin(*L.EDITABLE)})


@register("flt12_conversation_discovery", f"""WITH {CHATS}
  SELECT c.id FROM chats c LEFT JOIN (SELECT conversation_id, max_by(left(content, 200), timestamp) AS preview FROM messages GROUP BY 1) p ON c.id = conversation_id
  WHERE is_pinned AND (contains(lower(title), '5') OR contains(lower(preview), 'the'))""")
def flt12_conversation_discovery(spark, base):
    s = V.conversation_summaries(chats(spark, base), users(spark, base), messages(spark, base))
    match = F.lower("title").contains("5") | F.coalesce(F.lower("last_message_preview").contains("the"), F.lit(False))
    return s.where(F.col("is_pinned") & match).select("id")


@register("flt13_tag_exists", "SELECT EXISTS (SELECT 1 FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')) AS found, (SELECT count(*) FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')) AS n")
def flt13_tag_exists(spark, base):
    tagged = table(spark, base, "part").where(F.array_contains(F.split("p_name", " "), "ring"))
    return tagged.agg((F.count(F.lit(1)) > 0).alias("found"), F.count(F.lit(1)).alias("n"))


@register("flt14_jn12_directory_page", """
  SELECT c_custkey, c_name AS username, s_name AS local_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey WHERE contains(lower(c_name), '00') ORDER BY c_custkey LIMIT 100 OFFSET 100""")
def flt14_jn12_directory_page(spark, base):
    entries = table(spark, base, "customer").select("c_custkey", F.col("c_name").alias("username"), F.col("c_mktsegment").alias("full_name"))
    local = table(spark, base, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("local_name"))
    out = V.directory(entries, local, "c_custkey", "00").select("c_custkey", "username", "local_name")
    return V.page(out, 2, 100, F.col("c_custkey"))


@register("flt15_ownership_lookup", f"WITH {CHATS} SELECT id, title FROM chats WHERE id = 15 AND user_id = 15")
def flt15_ownership_lookup(spark, base):
    return chats(spark, base).where("id = 15 and user_id = 15").select("id", "title")


def liveness(spark, base):
    k = F.col("o_orderkey")
    return table(spark, base, "orders").where("o_orderkey % 3 = 0").select(k.alias("document_id"), (k % 2 == 0).alias("has_live_process"), (k % 4 == 1).alias("optimization_active"))


def artifacts(spark, base):
    k = F.col("o_orderkey")
    return table(spark, base, "orders").where("o_orderkey % 2 = 0").select(k.alias("document_id"), (F.col("o_orderdate") + F.make_dt_interval(hours=F.lit(6))).alias("artifact_completed_at"))


_LIVE = """live AS (SELECT o_orderkey AS document_id, o_orderkey % 2 = 0 AS has_live_process, o_orderkey % 4 = 1 AS optimization_active FROM orders WHERE o_orderkey % 3 = 0),
arts AS (SELECT o_orderkey AS document_id, o_orderdate + INTERVAL 6 HOUR AS artifact_completed_at FROM orders WHERE o_orderkey % 2 = 0)"""
_IN, _OPT = str(L.INGESTING), str(L.OPTIMIZING)
_GRACE = 86_400 * 365
_AGE = f"epoch(TIMESTAMP '{NOW}') - epoch(updated_at)"


@register("flt16_stale_detection", f"""WITH {DOCS}, {_LIVE}
  SELECT id, coalesce(status IN {_IN} AND NOT coalesce(has_live_process, false) AND {_AGE} >= {_GRACE}, false) AS stale, coalesce({_AGE} < {_GRACE}, true) AS recent
  FROM docs LEFT JOIN live ON id = document_id""")
def flt16_stale_detection(spark, base):
    d = workflow_documents(spark, base).join(liveness(spark, base), F.col("id") == F.col("document_id"), "left")
    return d.select("id", L.is_stale(now(), _GRACE).alias("stale"), L.recently_updated(now(), _GRACE).alias("recent"))


@register("flt17_delete_guard", f"""WITH {DOCS}, {_LIVE}
  SELECT id, CASE WHEN status IN {_IN} THEN coalesce(has_live_process, false) OR coalesce({_AGE} < {_GRACE}, true)
    WHEN status IN {_OPT} THEN coalesce(optimization_active, false) OR coalesce({_AGE} < {_GRACE}, true) ELSE false END AS blocked
  FROM docs LEFT JOIN live ON id = document_id""")
def flt17_delete_guard(spark, base):
    d = workflow_documents(spark, base).join(liveness(spark, base), F.col("id") == F.col("document_id"), "left")
    return d.select("id", L.delete_blocked(now(), _GRACE).alias("blocked"))


_ACTIONS = " UNION ALL ".join(f"SELECT id, '{a}' AS action, status IN ({', '.join(map(repr, s))}) AS allowed FROM docs" for a, s in L.ALLOWED.items())


@register("flt18_transition_guards", f"WITH {DOCS} SELECT id, action, allowed, CASE WHEN allowed THEN 200 ELSE 409 END AS code FROM ({_ACTIONS})")
def flt18_transition_guards(spark, base):
    return L.transitions(workflow_documents(spark, base)).select("id", "action", "allowed", "code")


@register("flt27_role_counts_guards", """
  SELECT c_mktsegment AS role, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS active, count(*) FILTER (c_custkey % 10 = 0) AS self_updates FROM customer GROUP BY 1""")
def flt27_role_counts_guards(spark, base):
    c = table(spark, base, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("role")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count_if(F.col("c_custkey") % 10 == 0).alias("self_updates")
    )


@register("flt28_qa_decisions", f"""WITH {DOCS}, reports AS (SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'rejected' END AS decision FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT id, CASE WHEN decision IS NULL THEN 404 WHEN decision = 'rejected' THEN 422 ELSE 200 END AS accept_code, CASE WHEN status = 'qa-passed' THEN 200 ELSE 409 END AS approve_code,
    CASE WHEN status = 'final-approved' AND NOT coalesce(publication_status IN ('publishing', 'published'), false) THEN 200 ELSE 409 END AS publish_code
  FROM docs LEFT JOIN reports ON id = document_id""")
def flt28_qa_decisions(spark, base):
    decision = F.when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    reports = table(spark, base, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("document_id"), decision.alias("decision"))
    return L.decide(workflow_documents(spark, base), reports).select("id", "accept_code", "approve_code", "publish_code")


@register("flt29_src10_upload_admission", """
  SELECT page_id, CASE WHEN lower(url) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(url), '\\.xlsx?$') THEN 'xlsx' WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'xlsx' END AS source_type FROM pages""")
def flt29_src10_upload_admission(spark, base):
    p = table(spark, base, "pages")
    mime = F.when(F.col("page_id") % 3 == 0, "application/pdf").when(F.col("page_id") % 3 == 1, "application/vnd.ms-excel").otherwise("text/html")
    return p.select("page_id", L.upload_type(F.col("url"), mime).alias("source_type"))


@register("dom13_reconciliation", f"""WITH {DOCS}, {_LIVE}, j AS (
    SELECT d.*, has_live_process, optimization_active, artifact_completed_at FROM docs d LEFT JOIN live l ON d.id = l.document_id LEFT JOIN arts a ON d.id = a.document_id), acted AS (
    SELECT id, CASE WHEN coalesce(status IN {_IN} AND NOT coalesce(has_live_process, false) AND {_AGE} >= {_GRACE}, false) THEN 'stale_ingestion'
      WHEN status IN {_OPT} AND NOT coalesce(optimization_active, false) AND artifact_completed_at IS NOT NULL AND coalesce(artifact_completed_at >= updated_at, true) THEN 'reconciled'
      WHEN status IN {_OPT} AND NOT coalesce(optimization_active, false) AND NOT coalesce({_AGE} < {_GRACE}, true) THEN 'stale_optimization' END AS action FROM j)
  SELECT id, action, CASE action WHEN 'reconciled' THEN 'optimization-complete' ELSE 'failed' END AS new_status FROM acted WHERE action IS NOT NULL""")
def dom13_reconciliation(spark, base):
    return L.reconcile(workflow_documents(spark, base), liveness(spark, base), artifacts(spark, base), now(), _GRACE).select("id", "action", "new_status")


@register("snk9_sparse_update", f"""WITH {DOCS}
  SELECT id, CASE WHEN id % 4 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN id % 6 = 0 THEN NULL ELSE notes END AS notes FROM docs""")
def snk9_sparse_update(spark, base):
    d = workflow_documents(spark, base).select("id", "status", "notes")
    patch = d.where("id % 2 = 0").select("id", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("notes"), (F.col("id") % 4 == 0).alias("set_status"), (F.col("id") % 6 == 0).alias("set_notes"))
    return L.patched(d, patch, "id", ["status", "notes"])


@register("snk10_jn13_null_fill", f"WITH {DOCS} SELECT id, coalesce(qa_score, CASE WHEN id % 2 = 0 THEN 50.0 END) AS qa_score, coalesce(version, '9') AS version FROM docs")
def snk10_jn13_null_fill(spark, base):
    d = workflow_documents(spark, base).select("id", "qa_score", "version")
    found = d.select("id", F.when(F.col("id") % 2 == 0, 50.0).alias("qa_score"), F.lit("9").alias("version"))
    return L.null_filled(d, found, "id", ["qa_score", "version"])


@register("snk6_snapshot_upsert", """
  WITH old AS (SELECT user_id AS answer_id, count(*) AS n, 'old' AS scope FROM events WHERE user_id < 100 GROUP BY 1),
       new AS (SELECT user_id AS answer_id, count(*) * 2 AS n, CASE WHEN user_id % 2 = 0 THEN 'new' END AS scope FROM events WHERE user_id >= 50 GROUP BY 1)
  SELECT answer_id, coalesce(new.n, old.n) AS n, coalesce(new.scope, old.scope) AS scope FROM old FULL JOIN new USING (answer_id)""")
def snk6_snapshot_upsert(spark, base):
    e = table(spark, base, "events").groupBy(F.col("user_id").alias("answer_id")).agg(F.count(F.lit(1)).alias("n"))
    old = e.where("answer_id < 100").withColumn("scope", F.lit("old"))
    new = e.where("answer_id >= 50").select("answer_id", (F.col("n") * 2).alias("n"), F.when(F.col("answer_id") % 2 == 0, "new").alias("scope"))
    return FB.merged_snapshots(old, new, "answer_id", ["scope"], ["n"])


@register("snk12_jn17_provisioning", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def snk12_jn17_provisioning(spark, base):
    entries = table(spark, base, "customer").select(F.col("c_custkey").alias("id"))
    return V.missing_accounts(entries, table(spark, base, "supplier").select(F.col("s_suppkey").alias("id")), "id")


@register("snk13_conversation_upsert", f"""WITH {CHATS}
  SELECT coalesce(c.id, n.id) AS id, coalesce(c.title, 'New Conversation') AS title FROM chats c FULL JOIN (SELECT range AS id FROM range(0, 200)) n ON c.id = n.id""")
def snk13_conversation_upsert(spark, base):
    """Get or create: asked ids that do not exist get the default title."""
    asked = spark.range(0, 200)
    have = chats(spark, base).select("id", "title")
    return have.unionByName(asked.join(have, "id", "left_anti").withColumn("title", F.lit("New Conversation")))


# --- feedback -----------------------------------------------------------------------

_WINDOW = f"created_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 14 DAY"


@register("agg1_dt1_stm7_window_totals", f"""WITH {FEEDBACK}
  SELECT count(*) AS total, count(*) FILTER (sentiment = 'up') AS positive, count(*) FILTER (sentiment = 'down') AS negative
  FROM feedback WHERE {_WINDOW} AND lower(system_scope) = 'power block'""")
def agg1_dt1_stm7_window_totals(spark, base):
    return FB.totals(feedback(spark, base), FB.in_window(events_now(), 14, system="POWER block"))


@register("agg3_reason_histogram", f"""WITH {FEEDBACK}
  SELECT reason_code, count(*) AS n FROM feedback WHERE {_WINDOW} AND reason_code IS NOT NULL AND reason_code <> '' GROUP BY 1 ORDER BY n DESC, reason_code""")
def agg3_reason_histogram(spark, base):
    return FB.reasons(feedback(spark, base), FB.in_window(events_now(), 14))


_SNAP = f"""{FEEDBACK}, ranked AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY created_at DESC, id DESC) AS rn FROM feedback),
stops AS (SELECT answer_id, min(rn) AS stop FROM ranked WHERE sentiment <> 'down' GROUP BY 1),
streaks AS (SELECT r.answer_id, count(*) AS s FROM ranked r LEFT JOIN stops USING (answer_id) WHERE sentiment = 'down' AND rn < coalesce(stop, 2147483647) GROUP BY 1),
snaps AS (SELECT answer_id, count(*) AS feedback_count, count(*) FILTER (sentiment = 'up') AS positive_count, count(*) FILTER (sentiment = 'down') AS negative_count,
    max(created_at) AS last_feedback_at, coalesce(any_value(s), 0) AS negative_streak FROM feedback LEFT JOIN streaks USING (answer_id) GROUP BY 1)"""


@register("agg4_agg5_win1_snapshots", f"""WITH {_SNAP}
  SELECT *, round((positive_count - negative_count) / feedback_count, 6) AS quality_score, negative_streak >= 3 OR negative_count >= 5 AS is_flagged FROM snaps""")
def agg4_agg5_win1_snapshots(spark, base):
    return FB.snapshots(feedback(spark, base)).withColumn("quality_score", F.round("quality_score", 6))


@register("agg2_flagged_answers", f"""WITH {_SNAP}
  SELECT count(*) AS flagged FROM snaps WHERE (negative_streak >= 3 OR negative_count >= 5) AND last_feedback_at >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 DAY""")
def agg2_flagged_answers(spark, base):
    s = FB.snapshots(feedback(spark, base)).where((F.col("negative_streak") >= 3) | (F.col("negative_count") >= 5))
    return s.where(FB.in_window(events_now(), 1, time="last_feedback_at")).agg(F.count(F.lit(1)).alias("flagged"))


@register("flt26_jn14_feedback_validation", f"""WITH {CHATS}, req AS (
    SELECT conv_id || '-' || (turn + CASE WHEN turn % 9 = 8 THEN 1000 ELSE 0 END) AS message_id, CASE WHEN turn % 7 = 3 THEN conv_id + 1 ELSE conv_id END AS conversation_id,
      CASE WHEN turn % 5 = 0 THEN (conv_id + 1) % 100 ELSE conv_id % 100 END AS user_id, CASE WHEN conv_id % 10 = 0 THEN 'admin' ELSE 'user' END AS role, conv_id, turn FROM conversations)
  SELECT req.conv_id, req.turn, CASE WHEN m.role IS NULL THEN 'not_found' WHEN m.role <> 'assistant' THEN 'not_an_answer' WHEN m.conversation_id <> req.conversation_id THEN 'wrong_conversation'
    WHEN req.role NOT IN ('admin', 'reviewer') AND NOT coalesce(c.user_id = req.user_id, false) THEN 'forbidden' END AS error_code
  FROM req LEFT JOIN messages m ON message_id = m.id LEFT JOIN chats c ON m.conversation_id = c.id""")
def flt26_jn14_feedback_validation(spark, base):
    t, c = F.col("turn"), F.col("conv_id")
    req = table(spark, base, "conversations").select(
        F.concat_ws("-", c, t + F.when(t % 9 == 8, 1000).otherwise(0)).alias("message_id"), F.when(t % 7 == 3, c + 1).otherwise(c).alias("conversation_id"),
        F.when(t % 5 == 0, (c + 1) % 100).otherwise(c % 100).alias("user_id"), F.when(c % 10 == 0, "admin").otherwise("user").alias("role"), c, t,
    )
    return FB.validated(req, messages(spark, base), chats(spark, base)).select("conv_id", "turn", "error_code")


@register("agg7_user_stats", f"""WITH {DOCS}, {USERS}, {CHATS}
  SELECT u.id, coalesce(total_documents, 0) AS total_documents, coalesce(documents_in_review, 0) AS documents_in_review, coalesce(documents_approved, 0) AS documents_approved, coalesce(total_conversations, 0) AS total_conversations
  FROM users u LEFT JOIN (SELECT uploaded_by, count(*) AS total_documents, count(*) FILTER (status = 'in-review') AS documents_in_review, count(*) FILTER (status = 'approved') AS documents_approved FROM docs GROUP BY 1) ON u.id = uploaded_by
  LEFT JOIN (SELECT user_id, count(*) AS total_conversations FROM chats GROUP BY 1) c ON u.id = c.user_id""")
def agg7_user_stats(spark, base):
    return V.user_stats(users(spark, base), workflow_documents(spark, base), chats(spark, base))


@register("agg26_dashboard", f"""WITH {DOCS}
  SELECT count(*) FILTER (status IN ('uploading', 'extracting')) AS in_pipeline, count(*) FILTER (status = 'in-review') AS in_review,
    count(*) FILTER (status IN ('approved', 'final-approved')) AS approved, CAST(floor(avg(qa_score) + 0.5) AS BIGINT) AS mean_qa_score FROM docs""")
def agg26_dashboard(spark, base):
    return V.dashboard(workflow_documents(spark, base), ["uploading", "extracting"], ["in-review"], ["approved", "final-approved"])


@register("agg16_review_progress", f"""WITH {SECTIONS}
  SELECT document_id, count(*) AS n, count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'pending') AS pending, round(count(*) FILTER (status = 'approved') * 100.0 / count(*), 4) AS completion FROM sections GROUP BY 1""")
def agg16_review_progress(spark, base):
    s = sections(spark, base).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "pending").alias("pending"))
    return s.withColumn("completion", F.round(F.col("approved") * 100.0 / F.col("n"), 4))


@register("agg17_checklist_status", """
  SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'N') THEN 'reviewed' WHEN bool_or(l_returnflag = 'N') THEN 'in-review' ELSE 'pending' END AS status FROM lineitem GROUP BY 1""")
def agg17_checklist_status(spark, base):
    checked = F.col("l_returnflag") == "N"
    state = F.when(F.bool_and(checked), "reviewed").when(F.bool_or(checked), "in-review").otherwise("pending")
    return table(spark, base, "lineitem").groupBy("l_orderkey").agg(state.alias("status"))


@register("agg32_latency_stats", """
  WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events)
  SELECT event_type, any_value(n) AS n, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, max(value) FILTER (rank = greatest(1, round_even(0.95 * n, 0))) AS p95 FROM r GROUP BY 1""")
def agg32_latency_stats(spark, base):
    return FB.latency(table(spark, base, "events"), "event_type", "value").withColumn("mean", F.round("mean", 6))


@register("agg33_moving_mean", """
  SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS moving_mean FROM events""")
def agg33_moving_mean(spark, base):
    return FB.moving_mean(table(spark, base, "events"), "user_id", "event_id", "value").select("event_id", F.round("moving_mean", 6).alias("moving_mean"))


@register("top6_pin_first", f"""WITH {CHATS} SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY is_pinned DESC, id DESC) AS position FROM chats""")
def top6_pin_first(spark, base):
    c = chats(spark, base).withColumn("updated", F.col("id"))
    return V.pinned_first(c, "is_pinned", "updated", "id").select("id", "position")


@register("top7_pagination", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 200 OFFSET 400")
def top7_pagination(spark, base):
    return V.page(table(spark, base, "customer").select("c_custkey"), 3, 500, F.col("c_custkey"))


@register("top8_slice", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 25 OFFSET 75")
def top8_slice(spark, base):
    return table(spark, base, "part").select("p_partkey").orderBy("p_partkey").offset(75).limit(25)


@register("top11_latest_config", "SELECT n_regionkey, max_by(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1")
def top11_latest_config(spark, base):
    return table(spark, base, "nation").groupBy("n_regionkey").agg(F.max_by("n_name", "n_nationkey").alias("n_name"))


@register("top12_ordered_children", """
  SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1""")
def top12_ordered_children(spark, base):
    c = table(spark, base, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return c.select("conv_id", F.array_join("x.role", ",").alias("roles"))


@register("win10_version_retention", """
  SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) <= 2""")
def win10_version_retention(spark, base):
    w = W.partitionBy("l_partkey").orderBy(F.desc("l_orderkey"), F.desc("l_linenumber"))
    li = table(spark, base, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return li.withColumn("rn", F.row_number().over(w)).where("rn <= 2").drop("rn")


@register("win11_event_history", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20")
def win11_event_history(spark, base):
    w = W.partitionBy("user_id").orderBy(F.desc("event_id"))
    return table(spark, base, "events").select("user_id", "event_id").withColumn("rn", F.row_number().over(w)).where("rn <= 20").drop("rn")


@register("stm8_job_outcomes", """
  SELECT user_id AS job_id, CASE WHEN t = 'view' THEN 'timeout' WHEN t = 'error' THEN 'monitor_error' WHEN t = 'purchase' THEN 'complete' WHEN t = 'signup' THEN 'failed' ELSE 'running' END AS outcome
  FROM (SELECT user_id, max_by(event_type, event_id) AS t FROM events GROUP BY 1)""")
def stm8_job_outcomes(spark, base):
    t = F.col("event_type")
    event = F.when(t == "view", "timeout").when(t == "error", "error").when(t.isin("purchase", "signup"), "exit").otherwise("progress")
    e = table(spark, base, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), event.alias("event"), F.when(t == "purchase", 0).otherwise(1).alias("exit_code"), t.alias("message"))
    return L.job_outcome(e).select("job_id", "outcome")


@register("check_unique_sections", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique_sections(spark, base):
    return V.duplicates(table(spark, base, "lineitem"), "l_orderkey", "l_linenumber")
