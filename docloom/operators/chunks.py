"""Chunks for review and publication: prep records, fallbacks, read models, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T


def page_records(pages: DataFrame, validation: DataFrame, tables: DataFrame, figures: DataFrame, key: list[str]) -> DataFrame:
    """Review pages with their validation, and their tables and figures as ordered lists."""
    listed = lambda df, name: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias(name)).withColumn(name, F.col(f"{name}.item"))
    out = pages.join(validation, key, "left").join(listed(tables, "tables"), key, "left").join(listed(figures, "figures"), key, "left")
    empty = F.array().cast("array<string>")
    return out.withColumns({"tables": F.coalesce("tables", empty), "figures": F.coalesce("figures", empty)})


def ambiguity_flags(checklist: Column, issues: Column) -> Column:
    """Unchecked items and issue types, in order and once each."""
    open_items = F.transform(F.filter(checklist, lambda c: ~c["checked"]), lambda c: F.concat(F.lit("unchecked:"), c["name"]))
    return F.array_distinct(F.concat(open_items, F.transform(issues, lambda i: F.concat(F.lit("issue:"), i))))


def ordered_distinct(values: Column) -> Column:
    """Trimmed values without blanks, first occurrences kept."""
    return F.array_distinct(F.filter(F.transform(values, T.strip), lambda v: v.isNotNull() & (v != "")))


def ensure_citation(content: Column, document: Column, pages: Column) -> Column:
    """``content`` with a source line for each page, unless it has one."""
    lines = F.transform(pages, lambda p: F.concat(F.lit("[Source: "), document, F.lit(", Page "), p.cast("string"), F.lit("]")))
    return F.when(content.contains("[Source:") | (F.size(pages) <= 0), content).otherwise(F.concat(F.regexp_replace(content, r"(?U)\s+$", ""), F.lit("\n\n"), F.array_join(lines, "\n")))


def first_heading(markdown: Column, page: Column) -> Column:
    """The page's first heading without marks, else ``Page n``."""
    head = F.get(F.filter(F.split(markdown, "\n"), lambda x: T.strip(x).startswith("#")), F.lit(0))
    return F.coalesce(F.nullif(T.strip(F.regexp_replace(T.strip(head), "^#+", "")), F.lit("")), F.concat(F.lit("Page "), page.cast("string")))


def publishable(chunks: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Documents' chunks; documents without any usable chunk give their sections instead."""
    usable = chunks.where(T.strip(F.coalesce("content", F.lit(""))) != "")
    rest = sections.join(usable.select(key).distinct(), key, "left_anti")
    columns = [key, "chunk_no", "heading", "content"]
    return usable.select(*columns, F.lit("chunks").alias("origin")).unionByName(rest.select(*columns, F.lit("markdown").alias("origin")))


def versions(manifest: DataFrame, key: str, keep: int = 2) -> DataFrame:
    """The newest versions of each document, with the number that a rollback would restore."""
    w = W.partitionBy(key).orderBy(F.desc("version"))
    out = manifest.withColumns({"age": F.row_number().over(w), "previous": F.lead("version").over(w)})
    return out.where(F.col("age") <= keep)


def audit_text(manifest: DataFrame, key: str) -> DataFrame:
    line = F.concat(F.lit("v"), F.col("version").cast("string"), F.lit(": "), F.col("note"))
    g = manifest.select(key, "version", line.alias("line")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("version", "line"))).alias("x"))
    return g.select(key, F.array_join("x.line", "\n").alias("report"))


def padded(found: DataFrame, key: str, expected: str, items: str) -> DataFrame:
    """Lists shorter than expected are filled with numbered placeholders."""
    have = F.size(items)
    missing = F.when(F.col(expected) > have, F.sequence(have + 1, F.col(expected))).otherwise(F.array().cast("array<int>"))
    return found.withColumn(items, F.concat(items, F.transform(missing, lambda n: F.concat(F.lit("Image "), n.cast("string"), F.lit(" (no description)")))))


def merged_distinct(first: DataFrame, second: DataFrame, key: list[str]) -> DataFrame:
    """Both tables' rows, of equal keys the first table's."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return both.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy("_o"))).where("_r = 1").drop("_o", "_r")


def sheet_lookup(sections: DataFrame, headings: DataFrame) -> DataFrame:
    """Sheets by lower-case name from two sources: first-seen values win, lists are united."""
    a = sections.select(F.lower("sheet").alias("k"), F.col("page").alias("a_page"), F.col("heads").alias("a_heads"))
    b = headings.select(F.lower("sheet").alias("k"), F.col("page").alias("b_page"), F.col("heads").alias("b_heads"))
    none = F.array().cast("array<string>")
    return a.join(b, "k", "full").select("k", F.coalesce("a_page", "b_page").alias("page"), F.array_distinct(F.concat(F.coalesce("a_heads", none), F.coalesce("b_heads", none))).alias("heads"))


def zipped(chunks: DataFrame, vectors: DataFrame, key: list[str]) -> DataFrame:
    """Chunks with their vectors by position; a chunk or a vector alone is an error."""
    both = chunks.withColumn("_c", F.lit(1)).join(vectors.withColumn("_v", F.lit(1)), key, "full")
    strict = F.when(F.col("_c").isNull() | F.col("_v").isNull(), F.raise_error(F.lit("chunks and vectors differ in number"))).otherwise(F.lit(True))
    return both.where(strict).drop("_c", "_v")


def outline(pages: DataFrame, key: str, limit: int = 500) -> DataFrame:
    """Prompt context of segments: a row for each page (key, page_number, heading, preview), previews bounded."""
    preview = T.truncate(T.collapse_spaces(F.col("markdown")), limit, "…").alias("preview")
    return pages.select(key, "page_number", F.substring("heading", 1, 60).alias("heading"), preview)


def sse_frames(x: Column) -> Column:
    """Events of a server-sent stream: (event, data) of each block that has data."""
    blocks = F.filter(F.split(x, r"\n\n"), lambda b: b.rlike(r"(?m)^data:"))
    data = lambda b: F.array_join(F.transform(F.filter(F.split(b, "\n"), lambda y: y.startswith("data:")), lambda y: F.ltrim(F.substring(y, 6, 1_000_000))), "\n")
    event = lambda b: F.coalesce(F.nullif(F.regexp_extract(b, r"(?m)^event:[ ]*(.*)$", 1), F.lit("")), F.lit("message"))
    return F.transform(blocks, lambda b: F.struct(event(b).alias("event"), data(b).alias("data")))


def preview_rows(rows: DataFrame, key: str, order: str, cells: str, limit: int = 8) -> DataFrame:
    """A sheet as one page: non-empty rows, and the first eight tab-joined in at most 500 characters."""
    line = F.array_join(cells, "\t")
    filled = rows.withColumn("_line", line).where(T.strip(F.regexp_replace("_line", "\t", "")) != "")
    ranked = filled.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(order)))
    agg = ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_list(F.when(F.col("_rn") <= limit, F.struct("_rn", "_line")))).alias("x"))
    return agg.select(key, "n_rows", T.truncate(F.array_join("x._line", "\n"), 500).alias("text_preview"), (F.col("n_rows") > 0).cast("int").alias("table_count"))
