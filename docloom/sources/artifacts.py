"""JSON and markdown artifacts, and keyed sinks on partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T


def scan(spark: SparkSession, folder: str, pattern: str, schema: str) -> DataFrame:
    """All JSON files below ``folder`` by name; of equal names the first path wins. Corrupt files give nulls."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("multiLine", "true").schema(schema).json(folder)
    found = raw.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("modified"))
    return found.withColumn("rn", F.row_number().over(W.partitionBy("name").orderBy("path"))).where("rn = 1").drop("rn")


def usable(chunks_column: str, markdown_column: str):
    """A chunk with content, or markdown that is not blank."""
    chunk = F.exists(F.coalesce(chunks_column, F.array().cast("array<struct<content:string>>")), lambda c: F.trim(F.coalesce(c["content"], F.lit(""))) != "")
    return chunk | (F.trim(F.coalesce(markdown_column, F.lit(""))) != "")


def first_by_priority(candidates: DataFrame, key: str, order: list[str], kind: str = "kind") -> DataFrame:
    """Per key the candidate whose kind comes first."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(kind))
    return candidates.where(rank > 0).withColumn("rn", F.row_number().over(W.partitionBy(key).orderBy(rank, "path"))).where("rn = 1").drop("rn")


def merged_ranges(payloads: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The results of a document's page ranges as one result: (parts, elements, summary).

    ``payloads`` has key, order, status, processing_time, n_pages, markdown, elements (array of
    page in the range and text) and errors. Page and element numbers and text offsets
    are prefix sums over the ranges' counts, which alone pass the windows, so no row holds a
    whole document: a part has its ``offset`` in the text whose parts are joined by a blank line.
    A document with a failed range, or one without any text, fails as a whole and has only a summary.
    """
    text = F.coalesce(T.strip(F.col("markdown")), F.lit(""))
    rows = payloads.withColumn("_text", text)
    size = F.when(F.length("_text") > 0, F.length("_text") + 2).otherwise(0)
    good = F.coalesce(F.lower("status") == "success", F.lit(False)) & (F.length("_text") > 0)
    narrow = rows.select(
        key, order, good.alias("good"), F.coalesce("processing_time", F.lit(0.0)).alias("time"), F.coalesce(F.size("errors"), F.lit(0)).alias("errors"),
        F.coalesce("n_pages", F.lit(0)).alias("pages"), F.coalesce(F.size("elements"), F.lit(0)).alias("items"), size.alias("chars"),
    )
    summary = narrow.groupBy(key).agg(
        F.when(F.bool_and("good"), "success").otherwise("failed").alias("status"), F.sum("time").alias("processing_time"), F.sum("errors").alias("n_errors"),
        F.sum("pages").alias("n_pages"), F.sum("items").alias("n_elements"), F.greatest(F.lit(0), F.sum("chars") - 2).alias("n_chars"),
    )
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("pages", "_pages"), ("items", "_items"), ("chars", "offset"))]
    placed = narrow.select(key, order, "pages", *sums).join(summary.where("status = 'success'").select(key), key, "left_semi")
    own = rows.join(placed, [key, order])
    parts = own.select(key, order, (F.col("_pages") + 1).alias("first_page"), (F.col("_pages") + F.col("pages")).alias("last_page"), "offset", F.col("_text").alias("text"))
    items = own.select(key, "_pages", "_items", F.posexplode("elements").alias("pos", "e"))
    elements = items.select(key, (F.col("_items") + F.col("pos") + 1).alias("element"), (F.col("_pages") + F.col("e.page")).alias("page"), F.col("e.text").alias("text"))
    return parts, elements, summary


def page_ranges(documents: DataFrame, pages: str, size: int = 4) -> DataFrame:
    """Conversion ranges of at most ``size`` pages."""
    first = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(pages)), F.lit(size)))
    return documents.withColumn("first_page", first).withColumn("last_page", F.least(F.col("first_page") + size - 1, F.col(pages)))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    return old.join(new, key, "left_anti").unionByName(new)


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys, key, "left_anti")


def publish(chunks: DataFrame, folder: str, partition: str = "document_id") -> None:
    """Replace the partitions of the given documents and no others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)


def append(rows: DataFrame, folder: str) -> None:
    rows.write.mode("append").parquet(folder)


def write_json(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").json(folder)


def messages(rows: DataFrame) -> DataFrame:
    """Messages with their citations as JSON text; none is an empty list."""
    return rows.withColumn("citations", F.coalesce(F.to_json("citations"), F.lit("[]")))


def page_evidence(pages: DataFrame, html: str, limit: int = 500) -> DataFrame:
    """``text_preview``, ``table_count`` and ``image_count`` of pages that come as html."""
    text = T.strip(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]*>", " "))
    count = lambda mark: F.coalesce(F.size(F.split(html, mark)) - 1, F.lit(0)).cast("long")
    preview = F.when(text == "", "[No text extracted]").otherwise(F.substring(text, 1, limit))
    return pages.withColumns({"text_preview": preview, "table_count": count("<table"), "image_count": count("<img")})
