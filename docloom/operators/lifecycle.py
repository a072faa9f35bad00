"""Document status machine: maps, guards, stale detection, reconciliation, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Statuses with progress in percent and stage.
STATUSES = (
    ("pending", 0, None),
    ("uploading", 10, "upload"),
    ("extracting", 30, "extraction"),
    ("vlm-validating", 60, "validation"),
    ("validation-complete", 100, "validation"),
    ("in-review", 100, "review"),
    ("review-complete", 100, "review"),
    ("approved-for-optimization", 0, "optimization"),
    ("optimizing", 0, "optimization"),
    ("optimization-complete", 100, "optimization"),
    ("qa-review", 100, "qa"),
    ("qa-passed", 100, "qa"),
    ("final-approved", 100, "approved"),
    ("approved", 100, "approved"),
    ("rejected", 100, "rejected"),
    ("failed", 0, "failed"),
)
INGESTING = ("uploading", "extracting", "vlm-validating")
OPTIMIZING = ("approved-for-optimization", "optimizing")
DELETE_BLOCKED = INGESTING + OPTIMIZING
FINALIZED = ("approved", "final-approved", "rejected")
OPTIMIZED = ("optimization-complete", "qa-review", "qa-passed", "final-approved")
EDITABLE = ("optimization-complete", "qa-review")
APPROVABLE = ("validation-complete", "in-review", "review-complete", "failed")
RESCORABLE = ("optimization-complete", "qa-review", "qa-passed")


def status_view(docs: DataFrame) -> DataFrame:
    """Progress, stage, start, completion, error and publication status by status."""
    dim = docs.sparkSession.createDataFrame(STATUSES, "status string, progress int, stage string")
    out = docs.join(F.broadcast(dim), "status", "left").fillna(0, ["progress"])
    s = F.col("status")
    started = F.when(s.isin(*OPTIMIZING, "optimization-complete", "failed"), F.coalesce("optimization_started_at", "created_at")).otherwise(F.col("created_at"))
    completed = (
        F.when(s.isin("optimization-complete", "failed") & F.col("optimization_completed_at").isNotNull(), F.col("optimization_completed_at"))
        .when((F.col("progress") == 100) | (s == "failed"), F.col("updated_at"))
    )
    error = F.coalesce(F.nullif("optimization_error", F.lit("")), F.when(s == "failed", F.col("notes")))
    published = F.coalesce("publication_status", F.when(s == "final-approved", F.lit("pending")))
    return out.withColumns({"started_at": started, "completed_at": completed, "error": error, "publication_status": published})


def is_stale(now: Column, grace_seconds: int) -> Column:
    """Ingestion without a live process whose last update is at least the grace interval ago; unknown times are not stale."""
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return F.coalesce(F.col("status").isin(*INGESTING) & ~F.coalesce("has_live_process", F.lit(False)) & (age >= grace_seconds), F.lit(False))


def recently_updated(now: Column, grace_seconds: int) -> Column:
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("updated_at") < grace_seconds, F.lit(True))


def delete_blocked(now: Column, grace_seconds: int) -> Column:
    live, active = F.coalesce("has_live_process", F.lit(False)), F.coalesce("optimization_active", F.lit(False))
    recent = recently_updated(now, grace_seconds)
    return (
        F.when(F.col("status").isin(*INGESTING), live | recent)
        .when(F.col("status").isin(*OPTIMIZING), active | recent)
        .otherwise(F.lit(False))
    )


def reconcile(docs: DataFrame, liveness: DataFrame, artifacts: DataFrame, now: Column, grace_seconds: int) -> DataFrame:
    """Documents whose status must change, with ``action`` and the new status."""
    out = docs.join(liveness, docs["id"] == liveness["document_id"], "left").drop("document_id")
    out = out.join(artifacts, out["id"] == artifacts["document_id"], "left").drop("document_id")
    idle = F.col("status").isin(*OPTIMIZING) & ~F.coalesce("optimization_active", F.lit(False))
    newer = F.col("artifact_completed_at").isNotNull() & F.coalesce(F.col("artifact_completed_at") >= F.col("updated_at"), F.lit(True))
    action = (
        F.when(is_stale(now, grace_seconds), F.lit("stale_ingestion"))
        .when(idle & newer, F.lit("reconciled"))
        .when(idle & ~recently_updated(now, grace_seconds), F.lit("stale_optimization"))
    )
    new = F.when(F.col("action") == "reconciled", F.lit("optimization-complete")).otherwise(F.lit("failed"))
    return out.withColumn("action", action).where("action is not null").withColumn("new_status", new)


#: action -> statuses from which it may be taken
ALLOWED = {"approve_for_optimization": APPROVABLE, "edit_chunks": EDITABLE, "rescore": RESCORABLE, "publish": ("final-approved",), "final_approve": ("qa-passed",)}


def transitions(docs: DataFrame) -> DataFrame:
    """Each document with each action: allowed, or 409."""
    rules = docs.sparkSession.createDataFrame([(a, list(s)) for a, s in ALLOWED.items()], "action string, allowed_from array<string>")
    rules = rules.agg(F.collect_list(F.struct("action", "allowed_from")).alias("rules"))
    out = docs.crossJoin(F.broadcast(rules)).select(docs["*"], F.explode("rules").alias("r"))
    ok = F.array_contains("r.allowed_from", F.col("status"))
    return out.select(docs["*"], F.col("r.action").alias("action"), ok.alias("allowed"), F.when(ok, 200).otherwise(409).alias("code"))


def decide(docs: DataFrame, reports: DataFrame) -> DataFrame:
    """QA acceptance, final approval and publication with their codes."""
    out = docs.join(reports, docs["id"] == reports["document_id"], "left").drop("document_id")
    accept = F.when(F.col("decision").isNull(), 404).when(F.col("decision") == "rejected", 422).otherwise(200)
    approve = F.when(F.col("status") == "qa-passed", 200).otherwise(409)
    publish = F.when((F.col("status") == "final-approved") & ~F.coalesce(F.col("publication_status").isin("publishing", "published"), F.lit(False)), 200).otherwise(409)
    return out.withColumns({"accept_code": accept, "approve_code": approve, "publish_code": publish})


def patched(current: DataFrame, patch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sparse update: a patch row has ``set_<column>`` flags; a set null clears."""
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"set_{c}") for c in columns])
    out = current.join(p, key, "left")
    new = {c: F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}
    return out.withColumns(new).select(current.columns)


def null_filled(current: DataFrame, found: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Only nulls are filled."""
    f = found.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    out = current.join(f, key, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).select(current.columns)


def upload_type(name: Column, mime: Column) -> Column:
    """Source type by suffix, else by MIME type, else null."""
    n = F.lower(name)
    return (
        F.when(n.endswith(".pdf"), "pdf").when(n.rlike(r"\.xlsx?$"), "xlsx").when(mime == "application/pdf", "pdf").when(mime.contains("spreadsheet") | mime.contains("excel"), "xlsx")
    )


def job_outcome(events: DataFrame) -> DataFrame:
    """The terminal event of each job: from its last event by sequence."""
    last = events.groupBy("job_id").agg(F.max_by(F.struct("event", "exit_code", "message"), "seq").alias("e"))
    state = (
        F.when(F.col("e.event") == "timeout", "timeout").when(F.col("e.event") == "error", "monitor_error")
        .when((F.col("e.event") == "exit") & (F.col("e.exit_code") == 0), "complete").when(F.col("e.event") == "exit", "failed").otherwise("running")
    )
    return last.select("job_id", state.alias("outcome"), F.col("e.message").alias("message"))
