"""Figures of markdown and their descriptions; review fields and times of artifacts with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.tables import VISUAL_HEADING

_IMAGE = r"!\[([^\]]*)\]\(([^)]*)\)"
_TOLD = r"\*\*\s*\[?\s*[Ff]igure\s+([0-9]+)\s*:\s*([^*\]]*)\]?\s*\*\*"


def figures(docs: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, figure_id, kind, caption, description, path): linked images first, then figures that are only described.

    Numbers go on from one kind to the other. A described figure is ``**[Figure n: text]**``.
    """
    all_of = lambda pattern, k: F.regexp_extract_all(markdown, F.lit(pattern), F.lit(k))
    linked = F.transform(
        F.arrays_zip(all_of(_IMAGE, 1).alias("alt"), all_of(_IMAGE, 2).alias("path")),
        lambda x: F.struct(F.lit("linked").alias("kind"), F.lit(None).cast("string").alias("caption"), x["alt"].alias("description"), x["path"].alias("path")),
    )
    told = F.transform(
        F.arrays_zip(all_of(_TOLD, 1).alias("n"), all_of(_TOLD, 2).alias("text")),
        lambda x: F.struct(F.lit("described").alias("kind"), F.concat(F.lit("Figure "), x["n"]).alias("caption"), T.collapse_spaces(x["text"]).alias("description"), F.lit(None).cast("string").alias("path")),
    )
    rows = docs.where(F.col(markdown).isNotNull()).select(key, F.posexplode(F.concat(linked, told)).alias("pos", "f"))
    return rows.select(key, F.format_string("figure_%03d", F.col("pos") + 1).alias("figure_id"), "f.*")


def _marker(page: Column) -> Column:
    return F.concat(F.lit("<!-- Page "), page.cast("string"), F.lit(" -->"))


def with_descriptions(docs: DataFrame, descriptions: DataFrame, key: str, markdown: str) -> DataFrame:
    """``docs`` with their images' descriptions put in, pages in order.

    ``descriptions`` has key, page, place (order in the page), title and description. A page's go before the first marker of
    the next page, else behind its own, else to the end under a heading of their own. All is taken literally.
    """
    title = F.coalesce("title", F.concat(F.lit("Figure on page "), F.col("page").cast("string")))
    line = F.concat(F.lit("**"), title, F.lit("**\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n"))
    pages = descriptions.select(key, "page", F.struct("place", line.alias("line")).alias("d")).groupBy(key, "page").agg(F.array_sort(F.collect_list("d")).alias("d"))
    text = F.concat(F.lit("\n\n### Visual Elements\n\n"), F.array_join("d.line", ""))
    by_key = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", text.alias("text")))).alias("_pages"))

    def put(md: Column, p: Column) -> Column:
        own, after = _marker(p["page"]), _marker(p["page"] + 1)
        place, behind = F.instr(md, after), F.instr(md, own)
        cut = lambda at, new: F.concat(F.substr(md, F.lit(1), at - 1), new, F.substr(md, at))
        end = F.concat(md, F.lit(f"\n\n## {VISUAL_HEADING} (Page "), p["page"].cast("string"), F.lit(")\n"), p["text"])
        return F.when(place > 0, cut(place, F.concat(p["text"], F.lit("\n")))).when(behind > 0, cut(behind + F.length(own), p["text"])).otherwise(end)

    out = docs.join(by_key, key, "left")
    return out.withColumn(markdown, F.when(F.col("_pages").isNull(), F.col(markdown)).otherwise(F.aggregate("_pages", F.col(markdown), put))).drop("_pages")


def review_field(payload: Column, required: list[str], other: list[str]) -> Column:
    """The first field of a JSON object that is not blank: those of ``required_fields`` by ``required``, then its own by ``other``; else the empty text."""
    get = lambda path: T.blank_to_null(F.get_json_object(payload, path))
    paths = [f"$.required_fields.{k}" for k in required] + [f"$.{k}" for k in other]
    return F.coalesce(*[T.strip(get(p)) for p in paths], F.lit(""))


def iso_time(x: Column) -> Column:
    """An ISO date or time as a timestamp; without an offset it is UTC, null where it does not parse."""
    t = F.regexp_replace(T.strip(x), r"^(\d{4}-\d{2}-\d{2}) (?=\d)", "$1T")
    zoned = t.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z"))).when(zoned, t).otherwise(F.concat(t, F.lit("Z")))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}.*)?$"), full.try_cast("timestamp"))


def of_current_run(completed: Column, started: Column) -> Column:
    """Whether an artifact belongs to the run: any does if no start is known, none without a time of its own, else those not older than the start."""
    return F.when(started.isNull(), True).otherwise(F.coalesce(completed >= started, F.lit(False)))
