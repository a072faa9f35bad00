"""Read models over workflow tables: summaries, listings, searches, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T


def _people(users: DataFrame, prefix: str) -> DataFrame:
    return users.select(F.col("id").alias(f"_{prefix}"), F.col("username").alias(f"{prefix}_by_username"), F.col("full_name").alias(f"{prefix}_by_name"))


def document_summaries(docs: DataFrame, users: DataFrame) -> DataFrame:
    """Documents with uploader, approver and review progress in percent."""
    out = docs
    for prefix in ("uploaded", "approved"):
        out = out.join(_people(users, prefix), F.col(f"{prefix}_by") == F.col(f"_{prefix}"), "left").drop(f"_{prefix}")
    share = F.col("review_progress").cast("decimal(20,0)") / F.col("total_sections").cast("decimal(20,0)") * 100
    return out.withColumn("review_progress_percent", F.when(F.col("total_sections") > 0, F.round(share, 2)).otherwise(F.lit(0)).cast("double"))


def section_summaries(sections: DataFrame, docs: DataFrame, users: DataFrame, content: Column | None = None) -> DataFrame:
    """Sections with their document, reviewer and a preview of 200 characters.

    ``content`` is the text as an expression of the columns of ``sections``, by default
    the column of that name. An expression is evaluated after the joins, so these move and sort its inputs, not texts.
    """
    content = F.col("content") if content is None else content
    d = docs.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("status").alias("document_status"))
    out = sections.join(d, "document_id").join(_people(users, "reviewed"), F.col("reviewed_by") == F.col("_reviewed"), "left").drop("_reviewed")
    return out.withColumns({"content_preview": F.substring(content, 1, 200), "content_length": F.length(content)})


def conversation_summaries(conversations: DataFrame, users: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with message count, last time and the latest message's first 200 characters.

    Without messages the count is 0. Ties in time go to the greatest message id.
    """
    stats = messages.groupBy("conversation_id").agg(
        F.count("id").alias("message_count"),
        F.max("timestamp").alias("last_message_at"),
        F.max_by(F.substring("content", 1, 200), F.struct("timestamp", "id")).alias("last_message_preview"),
    )
    out = conversations.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    out = out.join(stats, F.col("id") == F.col("conversation_id"), "left").drop("conversation_id")
    return out.fillna(0, ["message_count"])


def bookmark_details(bookmarks: DataFrame, users: DataFrame, conversations: DataFrame, messages: DataFrame) -> DataFrame:
    out = bookmarks.join(users.select(F.col("id").alias("user_id"), "username"), "user_id")
    out = out.join(conversations.select(F.col("id").alias("conversation_id"), F.col("title").alias("conversation_title")), "conversation_id")
    return out.join(messages.select(F.col("id").alias("message_id"), F.col("role").alias("message_role"), F.col("content").alias("message_content")), "message_id")


def search_documents(docs: DataFrame, term: str) -> DataFrame:
    """Case-insensitive LIKE on title, system and type; wildcards of the term work as such."""
    pattern = f"%{term.lower()}%"
    like = lambda c: F.coalesce(F.lower(c).like(pattern), F.lit(False))
    hits = docs.where(like(F.col("title")) | like(F.col("system")) | like(F.col("document_type")))
    return hits.withColumn("relevance", F.when(like(F.col("title")), 1.0).otherwise(0.5))


def user_stats(users: DataFrame, docs: DataFrame, conversations: DataFrame) -> DataFrame:
    """Counts of each user's documents by state and conversations; users without any have zeros."""
    d = docs.groupBy(F.col("uploaded_by").alias("id")).agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count_if(F.col("status") == "in-review").alias("documents_in_review"),
        F.count_if(F.col("status") == "approved").alias("documents_approved"),
    )
    c = conversations.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("total_conversations"))
    out = users.select("id").join(d, "id", "left").join(c, "id", "left")
    return out.fillna(0)


def listing(docs: DataFrame) -> DataFrame:
    """Rows for display: defaults where a value is missing or empty."""
    some = lambda c, default: F.coalesce(F.nullif(F.col(c), F.lit("")), default)
    return docs.withColumns(
        {
            "title": some("title", F.concat(F.lit("Document "), F.substring(F.col("id").cast("string"), 1, 8), F.lit("…"))),
            "version": some("version", F.lit("1.0")),
            "system": some("system", F.lit("—")),
            "document_type": some("document_type", F.lit("PDF")),
        }
    )


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page ``number`` (from 1) of at most 200 rows in a total order."""
    size = max(1, min(200, size))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


_COMPARE = {
    "eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
    "like": lambda c, v: c.like(v.replace("*", "%")), "ilike": lambda c, v: c.ilike(v.replace("*", "%")),
    "in": lambda c, v: c.isin(*[x.strip() for x in v.strip("()").split(",")]), "is": lambda c, v: c.isNull() if v == "null" else c == (v == "true"),
    "cs": lambda c, v: reduce(lambda a, b: a & b, [F.array_contains(c, x.strip()) for x in v.strip("{}").split(",")]),
}


def condition(column: str, spec: str) -> Column:
    """A column filter written as ``operator.value`` or ``not.operator.value``."""
    name, _, value = spec.partition(".")
    if name == "not":
        return ~condition(column, value)
    return _COMPARE[name](F.col(column), value)


def rest_filter(df: DataFrame, filters: dict[str, str], any_of: list[tuple[str, str]] = ()) -> DataFrame:
    """All filters, and one of ``any_of`` if given."""
    tests = [condition(c, s) for c, s in filters.items()]
    if any_of:
        tests.append(reduce(lambda a, b: a | b, [condition(c, s) for c, s in any_of]))
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def directory(entries: DataFrame, local: DataFrame, key: str, search: str | None = None) -> DataFrame:
    """Directory entries with their local account, if they have one."""
    found = entries
    if search:
        s = search.lower()
        found = entries.where(F.lower("username").contains(s) | F.lower("full_name").contains(s))
    return found.join(local, key, "left")


def missing_accounts(entries: DataFrame, local: DataFrame, key: str) -> DataFrame:
    return entries.join(local, key, "left_anti")


def pinned_first(df: DataFrame, pinned: str, time: str, tie: str) -> DataFrame:
    """Rank with pinned rows first, then the newest."""
    return df.withColumn("position", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc(pinned), F.desc(time), F.col(tie))))


def dashboard(docs: DataFrame, in_pipeline: list[str], in_review: list[str], approved: list[str]) -> DataFrame:
    mean = F.floor(F.avg("qa_score") + 0.5)
    return docs.agg(
        F.count_if(F.col("status").isin(*in_pipeline)).alias("in_pipeline"), F.count_if(F.col("status").isin(*in_review)).alias("in_review"),
        F.count_if(F.col("status").isin(*approved)).alias("approved"), mean.cast("long").alias("mean_qa_score"),
    )


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that break a uniqueness rule."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def number_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def title_or_default(x: Column) -> Column:
    return T.conversation_title(x)
