"""Review of optimized chunks: read model, edits, generation segments, visual blocks, sanitised output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import tables as B
from docloom.functions import text as T
from docloom.functions.labels import substituted
from docloom.operators.chunks import ensure_citation

# Statuses in which optimized output can be read, and be edited.
AVAILABLE = ("optimization-complete", "qa-review", "qa-passed", "final-approved", "approved")
EDITABLE = ("optimization-complete", "qa-review")
PREVIEW = 120


def source_type(path: Column, declared: Column) -> Column:
    """``xlsx`` by the source's suffix or as declared, else ``pdf``."""
    sheet = F.lower(T.strip(F.coalesce(path, F.lit("")))).rlike(r"\.xlsx?$") | (F.lower(T.strip(F.coalesce(declared, F.lit("")))) == "xlsx")
    return F.when(sheet, "xlsx").otherwise("pdf")


def read_model(chunks: DataFrame, documents: DataFrame, key: str, order: str) -> DataFrame:
    """Chunks of the documents whose output is available, numbered, with previews and empty lists for nulls.

    ``documents`` has key, status, path and declared_type; the numbering window holds one document's chunks.
    """
    from pyspark.sql import Window as W

    open_ = documents.where(F.col("status").isin(*AVAILABLE)).select(key, source_type(F.col("path"), F.col("declared_type")).alias("source_type"))
    number = F.row_number().over(W.partitionBy(key).orderBy(order))
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    out = chunks.join(open_, key).withColumn("chunk_number", number)
    return out.select(key, "chunk_id", "chunk_number", "source_type", "heading", "markdown", T.truncate(T.collapse_spaces(F.col("markdown")), PREVIEW, "…").alias("text_preview"), empty("table_facts"))


def document_markdown(chunks: DataFrame, key: str, order: str, name: Column) -> DataFrame:
    """Each document's markdown: its name as title, then the contents that are not blank, in order."""
    own = chunks.where(T.strip(F.coalesce("markdown", F.lit(""))) != "").select(key, name.alias("name"), F.struct(order, "markdown").alias("c"))
    g = own.groupBy(key).agg(F.first("name").alias("name"), F.array_sort(F.collect_list("c")).alias("c"))
    return g.select(key, F.concat(F.lit("# "), "name", F.lit("\n\n"), F.array_join("c.markdown", "\n\n"), F.lit("\n")).alias("document_markdown"))


def edited(chunks: DataFrame, edits: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    """``chunks`` with the edits of documents that may still be edited: stripped fields, pages read anew.

    ``edits`` has key, chunk_id, heading, markdown and table_facts; ``touched`` marks patched rows.
    """
    new = edits.join(statuses.where(F.col("status").isin(*EDITABLE)).select(key), key, "left_semi")
    facts = F.filter(F.transform("table_facts", T.strip), lambda f: f != "")
    new = new.select(key, "chunk_id", T.strip(F.col("heading")).alias("_h"), T.strip(F.col("markdown")).alias("_m"), facts.alias("_f"), F.lit(True).alias("_new"))
    out = chunks.join(new, [key, "chunk_id"], "left")
    pick = lambda a, b: F.when(F.col("_new"), a).otherwise(F.col(b)).alias(b)
    patched = {"heading": F.col("_h"), "markdown": F.col("_m"), "table_facts": F.col("_f"), "source_pages": T.page_numbers(F.col("_m"))}
    return out.select(*[pick(patched[c], c) if c in patched else F.col(c) for c in chunks.columns], F.coalesce("_new", F.lit(False)).alias("touched"))


def stale(reports: DataFrame, chunks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Quality reports that stay valid, and those that go because a chunk of their document was edited."""
    touched = chunks.where("touched").select(key).distinct()
    return reports.join(touched, key, "left_anti"), reports.join(touched, key, "left_semi")


def generation_segments(documents: DataFrame, segments: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """(key, segment_id, title, page_numbers, markdown) by the first source a document has:
    prepared segments, else one of all its pages, else one of the pages that its markdown names."""
    prepared = segments.select(key, "segment_id", "title", "page_numbers", "markdown")
    left = documents.join(segments.select(key).distinct(), key, "left_anti")
    own = pages.groupBy(key).agg(F.array_sort(F.collect_set("page_number")).alias("page_numbers"))
    whole = left.join(own, key, "left").select(
        key, F.lit("segment_001").alias("segment_id"), F.lit("Full Document").alias("title"), F.coalesce("page_numbers", T.page_numbers(F.col("markdown"))).alias("page_numbers"), "markdown"
    )
    return prepared.unionByName(whole)


def synthesized(documents: DataFrame, pages: DataFrame, key: str, name: Column) -> DataFrame:
    """Chunks made of pages - authoritative markdown, else the preview - or of the document where no page has text."""
    body = F.coalesce(T.blank_to_null(T.without_comments(F.col("authoritative"))), T.blank_to_null(F.col("preview")))
    own = pages.withColumn("_body", body).where("_body is not null")
    by_page = own.select(
        key, F.col("page_number").alias("chunk_no"), T.heading_question(F.coalesce("heading", F.lit("")), F.col("page_number")).alias("heading"),
        ensure_citation(F.col("_body"), name, F.array("page_number")).alias("content"),
    )
    rest = documents.join(own.select(key).distinct(), key, "left_anti")
    fallback = rest.select(
        key, F.lit(0).alias("chunk_no"), T.heading_question(name, F.lit(0)).alias("heading"), ensure_citation(T.strip(T.without_comments(F.col("markdown"))), name, T.page_numbers(F.col("markdown"))).alias("content")
    )
    return by_page.unionByName(fallback)


def merged_payloads(payloads: DataFrame, key: str, order: str, chunks: str) -> DataFrame:
    """(key, chunks, segmented): the chunks of a document's segments joined in segment order."""
    g = payloads.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(chunks, F.array().cast("array<string>")).alias("c")))).alias("p"))
    return g.select(key, F.flatten("p.c").alias("chunks"), (F.size("p") > 1).alias("segmented"))


def with_visual_blocks(documents: DataFrame, pages: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Documents without their appended visual blocks, and pages with the blocks meant for them."""
    parts = documents.withColumn("_v", B.visual_parts(F.col("markdown")))
    blocks = parts.select(key, F.posexplode("_v.blocks").alias("pos", "b")).groupBy(key, F.col("b.page").alias("page_number"))
    joined = blocks.agg(F.array_sort(F.collect_list(F.struct("pos", T.strip(F.col("b.text")).alias("t")))).alias("x")).select(key, "page_number", F.array_join("x.t", "\n\n").alias("_block"))
    content = F.concat_ws("\n\n", T.blank_to_null(T.rstrip(F.col("content"))), "_block")
    out = pages.join(joined, [key, "page_number"], "left").withColumn("content", F.when(F.col("_block").isNull(), F.col("content")).otherwise(content)).drop("_block")
    return parts.withColumn("markdown", F.col("_v.clean")).drop("_v"), out


def sanitised(chunks: DataFrame, labels: DataFrame, key: str, internal: str) -> DataFrame:
    """Chunks without internal lines, with ids replaced by labels, and with the output contract's defaults.

    ``labels`` has key and a map of ids to labels, see ``substituted``.
    """
    kept = F.array_join(F.filter(F.split("content", "\n"), lambda x: ~F.lower(x).rlike(internal)), "\n")
    named = lambda x: substituted(x, F.col("labels"))
    out = chunks.join(labels.select(key, "labels"), key, "left")
    contract = F.struct(F.coalesce("primary_source", F.lit("optimization_prep")).alias("primary_source"), F.lit(True).alias("json_first"))
    return out.withColumns({"content": named(kept), "heading": named(F.coalesce("heading", F.lit(""))), "source_type": F.lit("xlsx"), "contract": contract}).drop("labels", "primary_source")
