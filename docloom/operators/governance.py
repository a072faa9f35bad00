"""Scope policies, row-level security and audit rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

SHARED_TOKENS = ("shared", "global", "cross-functional")


def policy_sets(policies: DataFrame) -> DataFrame:
    """Per user the active systems and areas, in normal form, and their union."""
    active = policies.where("is_active")
    out = active.groupBy("user_id").agg(
        F.array_sort(F.collect_set(T.scope_token(F.col("system_scope")))).alias("systems"),
        F.array_sort(F.collect_set(T.scope_token(F.col("area_scope")))).alias("areas"),
    )
    allowed = F.array_sort(F.array_union("systems", "areas"))
    shared = F.arrays_overlap(allowed, F.array(*[F.lit(s) for s in SHARED_TOKENS]))
    return out.withColumns({"allowed": allowed, "allows_shared": F.coalesce(shared, F.lit(False))})


def enforce(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """Requests with ``reason_code`` (null: admitted), denied systems and the effective filters.

    Admins pass. Others need a policy, a workspace inside it and systems inside it.
    """
    joined = requests.join(policy_sets(policies), "user_id", "left")
    asked = F.filter(F.transform(F.coalesce("system_filters", F.array().cast("array<string>")), T.scope_token), lambda x: x.isNotNull())
    denied = F.filter(asked, lambda s: ~F.array_contains(F.coalesce("systems", F.array().cast("array<string>")), s))
    admin = F.col("role") == "admin"
    workspace = T.scope_token(F.col("workspace"))
    reason = (
        F.when(admin, F.lit(None).cast("string"))
        .when(F.coalesce(F.size("allowed"), F.lit(0)) <= 0, F.lit("policy_missing"))
        .when(workspace.isNotNull() & ~F.array_contains("allowed", workspace), F.lit("workspace_denied"))
        .when(F.size(denied) > 0, F.lit("system_denied"))
    )
    filters = F.when(F.size(asked) > 0, asked).when(~admin, F.col("systems"))
    return joined.withColumns({"reason_code": reason, "denied_systems": denied, "effective_filters": filters})


def denials(enforced: DataFrame, endpoint: str) -> DataFrame:
    """Audit rows of denied requests."""
    return enforced.where("reason_code is not null").select("query_id", "user_id", F.lit("query").alias("action"), F.lit(endpoint).alias("endpoint"), "reason_code", "workspace", "denied_systems")


def in_scope(contexts: DataFrame, policies: DataFrame) -> DataFrame:
    """Contexts that their user's policy admits; users without a policy row bypass the filter."""
    joined = contexts.join(policy_sets(policies).select("user_id", "allowed", "allows_shared"), "user_id", "left")
    own = F.array_contains("allowed", T.scope_token(F.col("system"))) | F.array_contains("allowed", T.scope_token(F.col("workspace")))
    shared = F.col("allows_shared") & F.coalesce("is_shared", F.lit(False))
    return joined.where(F.col("allowed").isNull() | (F.size("allowed") == 0) | F.coalesce(own, F.lit(False)) | shared)


def rls(df: DataFrame, role: str, uid: Column, policies: dict[str, Column]) -> DataFrame:
    """Rows that any of the role's policies shows; no policy shows nothing. Policies are OR-ed."""
    shown = [c for r, c in policies.items() if r in (role, "*")]
    return df.where(reduce(lambda a, b: a | b, shown) if shown else F.lit(False))


def owned_through(child: DataFrame, parent: DataFrame, key: str, owner: Column) -> DataFrame:
    """Child rows whose parent belongs to the owner (IN-subquery as a semi-join)."""
    return child.join(parent.where(owner).select(F.col(key)), key, "left_semi")


def write_violations(proposed: DataFrame, current: DataFrame, key: str, column: str, barred: str) -> DataFrame:
    """Proposed rows that set a barred value."""
    return proposed.join(current.select(key, F.col(column).alias("was")), key).where((F.col(column) == barred) & (F.col("was") != barred))


def claims(df: DataFrame, column: str = "claims") -> DataFrame:
    """User id and role from JSON claims, with the nil id and ``anon`` as defaults."""
    nil = "00000000-0000-0000-0000-000000000000"
    return df.withColumns(
        {
            "uid": F.coalesce(F.nullif(F.get_json_object(column, "$.sub"), F.lit("")), F.lit(nil)),
            "role": F.coalesce(F.nullif(F.get_json_object(column, "$.role"), F.lit("")), F.lit("anon")),
        }
    )
