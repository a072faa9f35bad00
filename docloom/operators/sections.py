"""Markdown: sections, headings, pages, packing. Texts stay in their row; only greedy_segments shuffles, and no texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from docloom.functions import text as T
from docloom.sources.shared import shared, shares

HEADING = r"^##\s+\S"
# Section headings that announce no data table.
LISTING_MARKERS = ("contents", "list of figures", "list of tables")
QUESTION_WORDS = ("what", "why", "how", "when", "where", "which", "who")
MAX_PAGES, TARGET_CHARS, LEAST_CHARS = 4, 18_000, 6_000


def lines(x: Column) -> Column:
    return F.split(x, "\n")


def sections(docs: DataFrame, markdown: str = "markdown") -> DataFrame:
    """One row per ``##`` section: number, heading, content, first and last line; text before the first is dropped."""
    d = docs.withColumn("_l", lines(F.col(markdown)))
    n = F.size("_l")
    heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("_l", i).rlike(HEADING))
    d = d.withColumn("_h", heads)

    def one(h: Column, k: Column) -> Column:
        end = F.coalesce(F.get("_h", k + 1), n)
        return F.struct(
            (k + 1).alias("section_no"),
            T.strip(F.regexp_replace(F.get("_l", h), "^##+", "")).alias("heading"),
            T.strip(F.array_join(F.slice("_l", h + 2, end - h - 1), "\n")).alias("content"),
            (h + 1).alias("start_line"),
            end.alias("end_line"),
        )

    out = d.withColumn("_s", F.explode(F.transform("_h", one)))
    return out.select(*docs.columns, "_s.*").withColumn("section_id", F.concat(F.lit("section_"), F.lpad(F.col("section_no").cast("string"), 3, "0")))


def single_section_fallback(docs: DataFrame, markdown: str = "markdown", title: str = "title") -> DataFrame:
    """Sections, or the whole text as one where a document has no heading."""
    with_heads = F.exists(lines(F.col(markdown)), lambda x: x.rlike(HEADING))
    whole = docs.where(~with_heads & (T.strip(F.col(markdown)) != "")).select(
        *docs.columns, F.lit(1).alias("section_no"), F.col(title).alias("heading"), T.strip(F.col(markdown)).alias("content"),
        F.lit(1).alias("start_line"), F.size(lines(F.col(markdown))).alias("end_line"), F.lit("section_001").alias("section_id"),
    )
    return sections(docs, markdown).unionByName(whole)


def cited(content: Column) -> Column:
    return content.contains("[Source:") | content.contains("(Page ") | F.lower(content).contains("[p.")


def is_question(heading: Column) -> Column:
    """Ends with a question mark or has a question word anywhere, also inside a word."""
    h = F.lower(heading)
    return h.endswith("?") | h.rlike("|".join(QUESTION_WORDS))


def has_table(content: Column) -> Column:
    return content.contains("|") & content.contains("---")


def lists_tables(heading: Column, content: Column) -> Column:
    first = F.array_join(F.slice(lines(F.lower(T.strip(content))), 1, 5), "\n")
    pattern = "|".join(LISTING_MARKERS)
    return F.lower(heading).rlike(pattern) | first.rlike(pattern)


def bullets_near_table(content: Column) -> Column:
    """A bullet from five lines before a table line to nine after it."""
    own = lines(content)

    def near(x: Column, i: Column) -> Column:
        low = F.greatest(F.lit(0), i - 5)
        around = F.array_join(F.slice(own, low + 1, i + 10 - low), "\n")
        return F.when(x.contains("|") & (around.contains("- ") | around.contains("* ")), True).otherwise(False)

    return F.exists(F.transform(own, near), lambda x: x)


def figures(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"!\[(.*?)\]\(.*?\)"), F.lit(1))


def described(alt: Column) -> Column:
    return (F.length(alt) > 10) & (F.lower(alt) != "image")


def qa_metrics(sections: DataFrame, key: str, mismatches: DataFrame | None = None) -> DataFrame:
    """Per document the shares that the acceptance gate reads, and the weighted confidence.

    ``mismatches`` has (key, semantic_mismatches). Sums only, so partial aggregation
    carries a document of any size.
    """
    content, heading = F.coalesce("content", F.lit("")), F.coalesce("heading", F.lit(""))
    table = (F.coalesce("has_tables", F.lit(False)) | has_table(content)) & ~lists_tables(heading, content)
    facts = F.exists(F.coalesce("table_facts", F.array().cast("array<string>")), lambda f: T.strip(f) != "") | bullets_near_table(content)
    flags = sections.select(
        key, cited(content).cast("long").alias("c"), is_question(heading).cast("long").alias("q"), table.cast("long").alias("t"), (table & facts).cast("long").alias("f"),
        F.size(figures(content)).cast("long").alias("g"), F.size(F.filter(figures(content), described)).cast("long").alias("d"),
    )
    s = flags.groupBy(key).agg(F.count(F.lit(1)).alias("n_sections"), *[F.sum(x).alias(x) for x in "cqtfgd"])
    s = s.join(mismatches, key, "left") if mismatches is not None else s.withColumn("semantic_mismatches", F.lit(0))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(100.0)
    out = s.withColumns(
        {
            "citation_coverage": F.col("c") / F.col("n_sections") * 100, "question_headings": F.col("q") / F.col("n_sections") * 100,
            "table_facts_ratio": share("f", "t"), "figure_coverage": share("d", "g"),
            "hallucination_risk": F.least(F.lit(1.0), F.coalesce("semantic_mismatches", F.lit(0)) / F.col("n_sections")),
        }
    )
    return out.withColumn("confidence", confidence()).drop(*"cqtfgd", "semantic_mismatches")


def confidence() -> Column:
    parts = (("citation_coverage", 0.30), ("question_headings", 0.15), ("table_facts_ratio", 0.25), ("figure_coverage", 0.30))
    total = sum((F.col(c) * w for c, w in parts), F.lit(0.0))
    penalty = F.greatest(F.lit(0.0), F.least(F.lit(10.0), F.col("hallucination_risk") * 10))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total - penalty))


# Label, metric, least value of the acceptance gate.
CRITERIA = (
    ("Citation coverage", "citation_coverage", 90.0),
    ("Question headings", "question_headings", 85.0),
    ("Table facts extraction", "table_facts_ratio", 95.0),
    ("Confidence score", "confidence", 80.0),
)


def gate(metrics: DataFrame) -> DataFrame:
    """Failed criteria and the decision; ``critical_issues`` defaults to 0."""
    critical = F.coalesce(F.col("critical_issues"), F.lit(0)) if "critical_issues" in metrics.columns else F.lit(0)
    failed = [F.when(F.col(m) < least, F.lit(label)) for label, m, least in CRITERIA]
    failed += [F.when(critical > 0, F.lit("Critical issues")), F.when(F.col("figure_coverage") < 100, F.lit("Figure descriptions"))]
    out = metrics.withColumn("failed", F.array_compact(F.array(*failed)))
    n = F.size("failed")
    return out.withColumn("decision", F.when(n == 0, "approved").when((n <= 2) & (critical == 0), "conditional_approval").otherwise("rejected"))


# Issue type and the metric that settles it.
SETTLED_BY = {"image_loss": "figure_coverage", "table_fidelity": "table_facts_ratio", "missing_content": "citation_coverage", "formatting": "question_headings"}


def unresolved(issues: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Issues whose type the current metrics do not settle."""
    kind = F.lower(T.strip(F.coalesce("issue_type", F.lit(""))))
    done = F.when(kind == "semantic_mismatch", F.col("hallucination_risk") <= 0)
    for name, metric in SETTLED_BY.items():
        done = done.when(kind == name, F.col(metric) >= 100)
    return issues.join(metrics.select(key, *SETTLED_BY.values(), "hallucination_risk"), key, "left").where(~F.coalesce(done, F.lit(False))).select(issues.columns)


def greedy_segments(rows: DataFrame, key: str, order: str, size: str, head: str, max_items: int = MAX_PAGES, target: int = TARGET_CHARS, least: int = LEAST_CHARS) -> DataFrame:
    """Greedy runs over groups of any size: ``key``, ``order`` and the number of the row's ``segment``, from 1.

    A new run starts when the current one has ``max_items``, would pass ``target``, or is at
    least ``least`` and a heading comes. Rows are range-partitioned by key and order, so a large group spans many tasks. A run
    has at most ``max_items`` rows, so one of a part's first rows starts a run; each task
    folds its part once for each such start, the driver carries the state from part to
    part - a few numbers each - and a second fold numbers the rows.
    """
    def step(state, size, head):
        run, n, chars = state
        size = max(size or 0, 1)
        if n == 0 or n >= max_items or chars + size > target or (head and chars >= least):
            return run + 1, 1, size
        return run, n + 1, chars + size

    def parts(batches):
        part = first = last = None
        opening, states, at = [], {}, 0
        for b in batches:
            for p, k, s, h in zip(*(b.column(c).to_pylist() for c in ("_part", "_key", "_size", "_head")), strict=True):
                if part is None:
                    part, first, last = p, k, k
                if k != last:
                    last, states, at = k, {-1: (0, 0, 0)}, max_items
                elif at < max_items:
                    opening.append((s, bool(h)))
                    states[at] = (0, 0, 0)
                    at += 1
                states = {e: step(x, s, h) for e, x in states.items()}
        if part is not None:
            ends = [(e, *x) for e, x in states.items()]
            yield pa.RecordBatch.from_pylist([{"part": part, "first": first, "last": last, "opening": opening, "ends": ends}], ends_schema)

    pair = pa.struct([("size", pa.int64()), ("head", pa.bool_())])
    end = pa.struct([(c, pa.int64()) for c in ("e", "run", "n", "chars")])
    ends_schema = pa.schema([("part", pa.int32()), ("first", pa.string()), ("last", pa.string()), ("opening", pa.list_(pair)), ("ends", pa.list_(end))])
    narrow = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.col(size).cast("long").alias("_size"), F.col(head).alias("_head"))
    dealt = narrow.repartitionByRange(shares(rows), "_key", "_order").sortWithinPartitions("_key", "_order")
    dealt = shared(dealt.withColumn("_part", F.spark_partition_id()))
    found = dealt.mapInArrow(parts, "part int, first string, last string, opening array<struct<size: long, head: boolean>>, ends array<struct<e: long, run: long, n: long, chars: long>>")
    entries, key_now, state = {}, None, (0, 0, 0)
    for p in sorted(found.collect(), key=lambda r: r.part):
        state = state if p.first == key_now else (0, 0, 0)
        entries[p.part] = state
        ends = {x.e: (x.run, x.n, x.chars) for x in p.ends}
        if -1 in ends:
            state = ends[-1]
        else:
            for e, x in enumerate(p.opening):
                run, state = state[0], step(state, x.size, x.head)
                if state[0] > run:
                    state = (run + ends[e][0], *ends[e][1:])
                    break
        key_now = p.last

    def number(batches):
        last, state = None, None
        for b in batches:
            segments = []
            for p, k, s, h in zip(*(b.column(c).to_pylist() for c in ("_part", "_key", "_size", "_head")), strict=True):
                if state is None:
                    last, state = k, entries[p]
                elif k != last:
                    last, state = k, (0, 0, 0)
                state = step(state, s, h)
                segments.append(state[0])
            yield pa.RecordBatch.from_arrays([b.column("_key"), b.column("_order"), pa.array(segments, pa.int32())], [key, order, "segment"])

    kind = rows.schema[order].dataType
    return dealt.mapInArrow(number, t.StructType([t.StructField(key, t.StringType()), t.StructField(order, kind), t.StructField("segment", t.IntegerType())]))


def page_issues(evidence: DataFrame) -> DataFrame:
    """Page checks: fewer table lines than two a table, or images without a figure marker."""
    table_lines = F.size(F.filter(lines(F.col("markdown")), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 2))
    marks = (F.length("markdown") - F.length(F.replace(F.col("markdown"), F.lit("![")))) / 2
    issue = lambda kind, severity: F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"))
    found = F.array_compact(
        F.array(
            F.when((F.col("table_count") > 0) & (table_lines < 2 * F.col("table_count")), issue("table_fidelity", "major")),
            F.when((F.col("image_count") > 0) & (marks < F.col("image_count")), issue("image_loss", "critical")),
        )
    )
    out = evidence.withColumn("issues", found)
    return out.withColumn("confidence_score", F.greatest(F.lit(0.0), 1 - 0.15 * F.size("issues")))


#: Tokens that the order of ``sharing`` knows as frequent, 16 bytes each.
FREQUENT = 1 << 16


def _ordered(held):
    """Rows (key, hashes): the hashes by frequency, then by value."""

    def run(batches):
        often, count = held.value
        for b in batches:
            lists = b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            df = np.zeros(len(flat), np.int64)
            if len(often) and len(flat):
                at = np.minimum(np.searchsorted(often, flat), len(often) - 1)
                df = np.where(often[at] == flat, count[at], 0)
            flat = flat[np.lexsort((flat, df, np.repeat(np.arange(len(sizes)), sizes)))]
            offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], b.schema.names)

    return run


def sharing(a: DataFrame, b: DataFrame, key_a: str, key_b: str, tokens: str, least: int) -> DataFrame:
    """(key_a, key_b, shared) of the pairs with at least ``least`` common tokens; ``tokens`` are distinct.

    Tokens are 64-bit hashes, put in order of their frequency in ``b`` - the FREQUENT most frequent are
    broadcast, any common order serves. Two lists that share that many
    share one of the first n - least + 1 of each. Only those meet in the equi-join, so frequent
    tokens make no pairs; candidates are then counted on their whole lists.
    """
    # written before they are filtered and counted, so that texts are cut in tokens once
    hashed = lambda rows, key: shared(rows.select(key, F.transform(tokens, lambda x: F.xxhash64(x)).alias("h"))).where(F.size("h") >= least)
    own, other = hashed(a, key_a), hashed(b, key_b)
    counts = other.select(F.explode("h").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    often = sorted(counts.orderBy(F.desc("n"), "t").limit(FREQUENT).collect())
    held = a.sparkSession.sparkContext.broadcast((np.array([r.t for r in often], np.int64), np.array([r.n for r in often], np.int64)))
    own, other = (shared(x.mapInArrow(_ordered(held), x.schema)) for x in (own, other))
    heads = lambda x: x.select(x.columns[0], F.explode(F.slice("h", F.lit(1), F.size("h") - least + 1)).alias("t"))
    pairs = heads(own).join(heads(other), "t").select(key_a, key_b).distinct()
    both = pairs.join(own.withColumnRenamed("h", "_a"), key_a).join(other.withColumnRenamed("h", "_b"), key_b)
    return both.select(key_a, key_b, F.size(F.array_intersect("_a", "_b")).cast("long").alias("shared")).where(F.col("shared") >= least)
