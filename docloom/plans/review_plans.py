"""Review, table-text and artifact queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions import tables as B
from docloom.operators import review as V
from docloom.plans.registry import register
from docloom.plans.text_plans import _LINES, markdown
from docloom.sources import artifacts as R
from docloom.sources.shared import shared_folder
from docloom.sources.tables import table
from docloom.sources.versions import VersionedTable, content_digest

_S = r"[\s\p{Z}]"


@register("str16_table_cells", rf"""
  WITH l AS (SELECT doc_id, i, CASE WHEN i % 2 = 1 THEN '|  C 1  H 4 | ' || x || '  |' ELSE x END AS x FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  c AS (SELECT doc_id, i, CASE WHEN contains(x, '|') THEN array_to_string(list_transform(string_split(x, '|'), lambda y: regexp_replace(regexp_replace(regexp_replace(regexp_replace(y, '^{_S}+|{_S}+$', '', 'g'), '{_S}{{2,}}', ' ', 'g'),
    '([A-Z]){_S}+(\d)', '\1\2', 'g'), '(\d){_S}+([A-Z])', '\1\2', 'g')), '|') ELSE x END AS x FROM l)
  SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS markdown FROM c GROUP BY 1""")
def str16_table_cells(spark, base):
    """Cells of table rows trimmed, spaces collapsed, formulas joined."""
    row = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 2 == 0, F.concat(F.lit("|  C 1  H 4 | "), x, F.lit("  |"))).otherwise(x))
    return table(spark, base, "documents").select("doc_id", B.normal_tables(F.array_join(row, "\n")).alias("markdown"))


_HEADERS = ("Device & Equip.", "P&ID no.", "the tag", "Notes:", "control-device", "Page (number)", "Interlock no", "Colour")
_HEADER_SQL = "[" + ", ".join(f"'{h}'" for h in _HEADERS) + "]"
_FIELDS = ("device", "description", "pid_or_page", "interlock_no", "notes"), ("interacting_device", "control_device", "device_or_equip", "interlock_no", "notes")


def _field_sql(fields: tuple[str, ...]) -> str:
    test = lambda f: " OR ".join(f"contains(' ' || n || ' ', ' {a} ')" for a in B.FIELD_ALIASES[f])
    return "CASE " + " ".join(f"WHEN {test(f)} THEN '{f}'" for f in fields) + " END"


@register("str19_header_fields", rf"""
  WITH h AS (SELECT p_partkey, {_HEADER_SQL}[p_partkey % {len(_HEADERS)} + 1] || ' ' || p_size AS header FROM part),
  m AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(upper(header), '&+', ' AND ', 'g'), '[^A-Z0-9]+', ' ', 'g')) AS n FROM h)
  SELECT p_partkey, n AS label, {_field_sql(_FIELDS[0])} AS cause_field, {_field_sql(_FIELDS[1])} AS effect_field FROM m""")
def str19_header_fields(spark, base):
    """Header labels in normal form and the logical field that they name."""
    headers = F.array(*[F.lit(h) for h in _HEADERS])
    header = F.concat(F.element_at(headers, (F.col("p_partkey") % len(_HEADERS) + 1).cast("int")), F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, base, "part").select("p_partkey", B.header_label(header).alias("label"), B.header_field(header, _FIELDS[0]).alias("cause_field"), B.header_field(header, _FIELDS[1]).alias("effect_field"))


@register("str23_sheet_facts", rf"""WITH {_LINES}, t AS (SELECT doc_id, i, regexp_replace(line, '^{_S}+|{_S}+$', '', 'g') AS x FROM lines WHERE regexp_matches(line, '^{_S}*\|')),
  r AS (SELECT *, regexp_replace(x, '[|\-: ]', '', 'g') = '' AS rule FROM t),
  h AS (SELECT doc_id, min(i) FILTER (rule) AS cut, min_by(x, i) FILTER (length(x) - length(replace(x, '|', '')) >= 2) AS header FROM r GROUP BY 1),
  n AS (SELECT doc_id, header, count(*) FILTER (NOT rule AND i > cut) AS n FROM h JOIN r USING (doc_id) GROUP BY 1, 2),
  f AS (SELECT doc_id, 'Columns: ' || array_to_string(list_filter(list_transform(string_split(header, '|'), lambda c: trim(c)), lambda c: c <> ''), ', ') AS c, n, header FROM n)
  SELECT d.doc_id, CASE WHEN header IS NULL THEN 'Sheet: S' || d.doc_id ELSE c || CASE WHEN n > 0 THEN ';Contains ' || n || ' data rows' ELSE '' END END AS facts FROM documents d LEFT JOIN f USING (doc_id)""")
def str23_sheet_facts(spark, base):
    facts = B.sheet_facts(F.col("markdown"), F.concat(F.lit("S"), "doc_id"))
    return markdown(spark, base).select("doc_id", F.array_join(facts, ";").alias("facts"))


@register("str24_bounded_content", rf"""
  WITH b AS (SELECT doc_id, '[Source: D, Page ' || doc_id || ']' AS cite, regexp_replace('## Doc ' || doc_id || chr(10) || chr(10) || coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '{_S}', '', 'g') <> ''), chr(10)), ''), '^{_S}+|{_S}+$', '', 'g') AS body FROM documents)
  SELECT doc_id, CASE WHEN length(body) > 900 - length(cite) - 2 THEN regexp_replace(substring(body, 1, 900 - length(cite) - 3), '{_S}+$', '') || '…' ELSE body END || chr(10) || chr(10) || cite AS content FROM b""")
def str24_bounded_content(spark, base):
    key = F.col("doc_id").cast("string")
    content = B.bounded_content(F.concat(F.lit("Doc "), key), F.split("text", "\n"), F.concat(F.lit("[Source: D, Page "), key, F.lit("]")))
    return table(spark, base, "documents").select("doc_id", content.alias("content"))


@register("str25_figure_issues", """
  WITH f AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'A long description ' || p_name WHEN 2 THEN 'This figure SHOWS ' || p_name WHEN 3 THEN NULL ELSE 'It depicts ' || p_name END AS d, CASE WHEN p_partkey % 3 = 0 THEN 'Unknown' ELSE 'Page 1' END AS l FROM part)
  SELECT p_partkey, array_to_string(list_filter([CASE WHEN d IS NULL OR length(d) < 10 THEN 'Description too short or missing' END,
    CASE WHEN length(d) >= 10 AND NOT regexp_matches(lower(d), 'shows|displays|illustrates|depicts') THEN 'Description should explain what the figure shows' END, CASE WHEN l = 'Unknown' THEN 'Source page number missing' END], lambda x: x IS NOT NULL), ';') AS issues FROM f""")
def str25_figure_issues(spark, base):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, "image").when(k == 1, F.concat(F.lit("A long description "), "p_name")).when(k == 2, F.concat(F.lit("This figure SHOWS "), "p_name")).when(k == 4, F.concat(F.lit("It depicts "), "p_name"))
    where = F.when(F.col("p_partkey") % 3 == 0, "Unknown").otherwise("Page 1")
    return table(spark, base, "part").select("p_partkey", F.array_join(B.description_issues(text, where), ";").alias("issues"))


@register("str26_captions", r"""
  WITH m AS (SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Figure ' || (doc_id % 9) || ': Caption of ' || doc_id || chr(10) END || '![' AS md, length(text) AS n FROM documents),
  c AS (SELECT doc_id, substring(md, greatest(1, length(md) - 1 - 200), least(200, length(md) - 2)) AS context FROM m)
  SELECT doc_id, length(context) AS n, CASE WHEN regexp_matches(context, '[Ff]igure\s+\d+') THEN trim(regexp_extract(context, '[Ff]igure\s+\d+[:.]?\s*([^\n]*)', 1)) END AS caption FROM c""")
def str26_captions(spark, base):
    """The caption of the figure that ends each text, looked for in the 200 characters before it."""
    k = F.col("doc_id")
    caption = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("Figure "), (k % 9).cast("string"), F.lit(": Caption of "), k.cast("string"), F.lit("\n")))
    md = table(spark, base, "documents").select("doc_id", F.concat("text", F.lit("\n"), caption, F.lit("![")).alias("md"))
    context = md.select("doc_id", B.preceding(F.col("md"), F.length("md") - 1).alias("context"))
    return context.select("doc_id", F.length("context").alias("n"), B.caption(F.col("context")).alias("caption"))


@register("str29_visual_blocks", r"""
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN regexp_replace(text, '[\s\p{Z}]+$', '') || chr(10) || chr(10) || '## Additional Visual Elements (Page ' || turn || ')' || chr(10) || 'role ' || role
      || CASE WHEN turn % 4 = 0 THEN chr(10) || chr(10) || '## Additional Visual Elements (Page ' || turn || ')' || chr(10) || 'again' ELSE '' END ELSE text END AS content FROM conversations""")
def str29_visual_blocks(spark, base):
    """Blocks appended to a document go to the pages that they name."""
    c = table(spark, base, "conversations")
    head = F.concat(F.lit("## Additional Visual Elements (Page "), F.col("turn").cast("string"), F.lit(")\n"))
    own = F.when(F.col("turn") % 2 == 0, F.concat(head, F.lit("role "), "role", F.lit("\n"), F.when(F.col("turn") % 4 == 0, F.concat(head, F.lit("again\n"))).otherwise("")))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(own.isNotNull(), F.struct("turn", own.alias("b"))))).alias("x"))
    docs = g.select("conv_id", F.concat(F.lit("intro\n"), F.array_join("x.b", "")).alias("markdown"))
    pages = c.select("conv_id", F.col("turn").alias("page_number"), F.col("text").alias("content"))
    return V.with_visual_blocks(docs, pages, "conv_id")[1].select("conv_id", F.col("page_number").alias("turn"), "content")


_STATUS_SQL = "['optimization-complete', 'qa-review', 'qa-passed', 'optimizing'][conv_id % 4 + 1]"


def _review(spark, base):
    """Chunks and documents: a conversation is a document, a turn a chunk."""
    names = F.array(*[F.lit(s) for s in ("optimization-complete", "qa-review", "qa-passed", "optimizing")])
    c = table(spark, base, "conversations")
    chunks = c.select("conv_id", F.concat(F.lit("c"), F.col("turn").cast("string")).alias("chunk_id"), "turn", F.col("role").alias("heading"), F.col("text").alias("markdown"),
                      F.when(F.col("turn") % 2 == 0, F.array(F.lit(" fact "), F.lit(" "))).alias("table_facts"), F.array(F.col("turn").cast("int")).alias("source_pages"))
    status = F.element_at(names, (F.col("conv_id") % 4 + 1).cast("int"))
    path = F.when(F.col("conv_id") % 3 == 0, "a/b.XLSX").otherwise("a.pdf")
    docs = c.select("conv_id").distinct().select("conv_id", status.alias("status"), path.alias("path"), F.when(F.col("conv_id") % 5 == 0, " XLSX ").alias("declared_type"))
    return chunks, docs


@register("dom15_review_chunks", rf"""
  WITH c AS (SELECT *, regexp_replace(regexp_replace(text, '{_S}+', ' ', 'g'), '^ | $', '', 'g') AS p FROM conversations WHERE conv_id % 4 <> 3)
  SELECT conv_id, 'c' || turn AS chunk_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS chunk_number, CASE WHEN conv_id % 3 = 0 OR conv_id % 5 = 0 THEN 'xlsx' ELSE 'pdf' END AS source_type, role AS heading,
    CASE WHEN length(p) > 120 THEN substring(p, 1, 119) || '…' ELSE p END AS text_preview, CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS facts FROM c""")
def dom15_review_chunks(spark, base):
    """The editable chunks of documents whose output is available."""
    chunks, docs = _review(spark, base)
    return V.read_model(chunks, docs, "conv_id", "turn").select("conv_id", "chunk_id", "chunk_number", "source_type", "heading", "text_preview", F.size("table_facts").alias("facts"))


def _edited(spark, base):
    chunks, docs = _review(spark, base)
    edits = chunks.where("turn = 0").select("conv_id", "chunk_id", F.concat(F.lit(" New "), "heading").alias("heading"), F.concat(F.lit(" see page 7 and Page 9: "), "markdown").alias("markdown"), F.array(F.lit(" x "), F.lit("")).alias("table_facts"))
    return V.edited(chunks, edits, docs, "conv_id")


_EDITED = rf"""e AS (
  SELECT conv_id, turn, conv_id % 4 < 2 AND turn = 0 AS touched, CASE WHEN conv_id % 4 < 2 AND turn = 0 THEN regexp_replace('see page 7 and Page 9: ' || text, '{_S}+$', '') ELSE text END AS md, text FROM conversations)"""


@register("snk15_edited_chunks", rf"""WITH {_EDITED}
  SELECT conv_id, string_agg(md, chr(10) || chr(10) ORDER BY turn) FILTER (regexp_replace(md, '{_S}', '', 'g') <> '') AS body, bool_or(touched) AS touched FROM e GROUP BY 1""")
def snk15_edited_chunks(spark, base):
    """Edits applied where the status allows, and each document's markdown built anew."""
    new = _edited(spark, base)
    md = V.document_markdown(new, "conv_id", "turn", F.lit("D"))
    body = F.substring("document_markdown", F.lit(6), F.length("document_markdown") - 6)
    return new.groupBy("conv_id").agg(F.bool_or("touched").alias("touched")).join(md, "conv_id", "left").select("conv_id", body.alias("body"), "touched")


@register("snk15_stale_reports", """
  WITH t AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 4 < 2 AND turn = 0)
  SELECT DISTINCT conv_id, conv_id IN (SELECT conv_id FROM t) AS gone FROM conversations""")
def snk15_stale_reports(spark, base):
    """An edit takes away the quality report of its document and no other."""
    reports = table(spark, base, "conversations").select("conv_id").distinct()
    valid, gone = V.stale(reports, _edited(spark, base), "conv_id")
    return valid.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)))


_PAGES_SQL = "list_filter(list_transform(regexp_extract_all(text, '(?i)page\\s+(\\d{1,9})', 1), lambda s: CAST(s AS INTEGER)), lambda x: true)"


@register("dom9_generation_segments", rf"""
  WITH d AS (SELECT doc_id, 'on page 4 and Page 2, page 4. ' || text AS text FROM documents), p AS (SELECT DISTINCT doc_id, 1 AS page_number FROM d WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 3 FROM d WHERE doc_id % 3 = 1),
  s AS (SELECT doc_id, 'seg_' || n AS segment_id, '1' AS pages FROM d, range(1, 3) t(n) WHERE doc_id % 3 = 0),
  w AS (SELECT doc_id, {_PAGES_SQL} AS v FROM d)
  SELECT doc_id, segment_id, pages FROM s UNION ALL SELECT doc_id, 'segment_001', '1,3' FROM d WHERE doc_id % 3 = 1
  UNION ALL SELECT doc_id, 'segment_001', array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') FROM w WHERE doc_id % 3 = 2""")
def dom9_generation_segments(spark, base):
    """Prepared segments, else one of all pages, else one of the pages that the text names."""
    d = table(spark, base, "documents").select("doc_id", F.concat(F.lit("on page 4 and Page 2, page 4. "), "text").alias("markdown"))
    segments = d.where("doc_id % 3 = 0").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("n"), "markdown")
    segments = segments.select("doc_id", F.concat(F.lit("seg_"), F.col("n").cast("string")).alias("segment_id"), F.lit("t").alias("title"), F.array(F.lit(1)).alias("page_numbers"), "markdown")
    pages = d.where("doc_id % 3 = 1").select("doc_id", F.explode(F.array(F.lit(3), F.lit(1))).alias("page_number"))
    out = V.generation_segments(d, segments, pages, "doc_id")
    return out.select("doc_id", "segment_id", F.array_join(F.col("page_numbers").cast("array<string>"), ",").alias("pages"))


@register("dom9_synthesized_chunks", rf"""
  WITH p AS (SELECT conv_id, turn, coalesce(nullif(regexp_replace(CASE WHEN turn % 2 = 0 THEN text END, '^{_S}+|{_S}+$', '', 'g'), ''), 'preview ' || turn) AS body FROM conversations WHERE conv_id % 5 <> 0)
  SELECT conv_id, turn AS chunk_no, CASE WHEN turn > 0 THEN 'What is covered on page ' || turn || '?' ELSE 'What should you know from this section?' END AS heading,
    CASE WHEN contains(body, '[Source:') THEN body ELSE regexp_replace(body, '{_S}+$', '') || chr(10) || chr(10) || '[Source: D, Page ' || turn || ']' END AS content FROM p
  UNION ALL SELECT DISTINCT conv_id, 0, 'What does this section explain about D?', 'see page 6' || chr(10) || chr(10) || '[Source: D, Page 6]' FROM conversations WHERE conv_id % 5 = 0""")
def dom9_synthesized_chunks(spark, base):
    """Chunks made of pages with text, or of the document where it has none."""
    c = table(spark, base, "conversations")
    docs = c.select("conv_id", F.lit("<!-- x -->see page 6").alias("markdown")).distinct()
    text = F.when((F.col("conv_id") % 5 != 0) & (F.col("turn") % 2 == 0), F.col("text"))
    preview = F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("preview "), F.col("turn").cast("string")))
    pages = c.select("conv_id", F.col("turn").cast("int").alias("page_number"), F.lit("").alias("heading"), text.alias("authoritative"), preview.alias("preview"))
    return V.synthesized(docs, pages, "conv_id", F.lit("D"))


@register("set5_merged_payloads", """
  SELECT conv_id, array_to_string(flatten(list([role, 't' || turn] ORDER BY turn) FILTER (turn % 3 <> 2)), ',') AS chunks, count(*) > 1 AS segmented FROM conversations GROUP BY 1""")
def set5_merged_payloads(spark, base):
    """The chunks of all segments of a document, in segment order."""
    payloads = table(spark, base, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 2, F.array("role", F.concat(F.lit("t"), F.col("turn").cast("string")))).alias("chunks"))
    out = V.merged_payloads(payloads, "conv_id", "turn", "chunks")
    return out.select("conv_id", F.array_join("chunks", ",").alias("chunks"), "segmented")


@register("dom17_sanitised_output", """
  WITH l AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split('cause_1 of cause_12' || chr(10) || text, chr(10))) AS x, generate_subscripts(string_split('cause_1 of cause_12' || chr(10) || text, chr(10)), 1) AS i FROM documents) WHERE NOT contains(lower(x), 'ation'))
  SELECT doc_id, string_agg(CASE WHEN doc_id % 2 = 0 AND i = 1 THEN 'Valve of Line ' || doc_id ELSE x END, chr(10) ORDER BY i) AS content, CASE WHEN doc_id % 2 = 0 THEN 'Valve' ELSE 'cause_1' END AS heading, 'xlsx' AS source_type FROM l GROUP BY doc_id""")
def dom17_sanitised_output(spark, base):
    """Internal lines go, ids become labels, the output contract gets its defaults."""
    d = table(spark, base, "documents")
    chunks = d.select("doc_id", F.concat(F.lit("cause_1 of cause_12\n"), "text").alias("content"), F.lit("cause_1").alias("heading"), F.lit(None).cast("string").alias("primary_source"))
    labels = d.where("doc_id % 2 = 0").select("doc_id", F.create_map(F.lit("cause_1"), F.lit("Valve"), F.lit("cause_12"), F.concat(F.lit("Line "), F.col("doc_id").cast("string"))).alias("labels"))
    return V.sanitised(chunks, labels, "doc_id", "ation").select("doc_id", "content", "heading", "source_type")


@register("src2_page_evidence", rf"""
  WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '^{_S}+|{_S}+$', '', 'g') AS x, html FROM pages)
  SELECT page_id, CASE WHEN x = '' THEN '[No text extracted]' ELSE substring(x, 1, 500) END AS text_preview, len(regexp_extract_all(html, '<table')) AS table_count, len(regexp_extract_all(html, '<img')) AS image_count FROM t""")
def src2_page_evidence(spark, base):
    """Text preview and counts of a page's elements; the page scan itself is an input table."""
    return R.page_evidence(table(spark, base, "pages"), "html").select("page_id", "text_preview", "table_count", "image_count")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}"


@register("snk3_publish", """
  SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer""")
def snk3_publish(spark, base):
    """Publishing a document again replaces its partition and no other."""
    folder, c = _folder(spark), table(spark, base, "customer").select("c_custkey", "c_mktsegment")
    R.publish(c.withColumn("version", F.lit(1)), folder, "c_mktsegment")
    R.publish(c.where("c_mktsegment = 'BUILDING'").withColumn("version", F.lit(2)), folder, "c_mktsegment")
    return spark.read.parquet(folder).select("c_custkey", "c_mktsegment", "version")


@register("snk7_append_events", "SELECT event_id, event_type FROM events")
def snk7_append_events(spark, base):
    """Insert-only appends in two batches."""
    folder, e = _folder(spark), table(spark, base, "events").select("event_id", "event_type")
    R.append(e.where("event_id % 2 = 0"), folder)
    R.append(e.where("event_id % 2 <> 0"), folder)
    return spark.read.parquet(folder)


@register("snk8_messages", """
  SELECT conv_id, turn, text AS content, CASE WHEN role = 'assistant' THEN '[{"id":"cite-1","page":' || turn || '}]' ELSE '[]' END AS citations FROM conversations""")
def snk8_messages(spark, base):
    """Messages appended with their citations as JSON text."""
    cite = F.when(F.col("role") == "assistant", F.array(F.struct(F.lit("cite-1").alias("id"), F.col("turn").alias("page"))))
    folder = _folder(spark)
    R.append(R.messages(table(spark, base, "conversations").select("conv_id", "turn", F.col("text").alias("content"), cite.alias("citations"))), folder)
    return spark.read.parquet(folder)


@register("snk5_artifacts", """
  SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, '# ' || conv_id || chr(10) || string_agg(role, chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY 1""")
def snk5_artifacts(spark, base):
    """Reports as JSON artifacts, their markdown beside the fields, read back."""
    g = table(spark, base, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    md = F.concat(F.lit("# "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join("x.role", "\n"))
    folder = _folder(spark)
    R.write_json(g.select("conv_id", F.array_join("x.role", ",").alias("roles"), md.alias("markdown")), folder)
    return spark.read.schema("conv_id long, roles string, markdown string").json(folder)


@register("src6_src8_artifact_scan", """
  SELECT r_regionkey AS id, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1 UNION ALL SELECT -1, 0""")
def src6_src8_artifact_scan(spark, base):
    """Artifacts below a folder by name; a broken one gives defaults."""
    folder = _folder(spark)
    own = table(spark, base, "nation").groupBy(F.col("n_regionkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    own.write.option("maxRecordsPerFile", 1).json(f"{folder}/good/deep")
    spark.createDataFrame([("{broken",)], "value string").write.text(f"{folder}/bad")
    found = R.scan(spark, folder, "part-*", "id long, n long")
    return found.select(F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("n", F.lit(0)).alias("n"))


@register("dom12_snk3_versions", """
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  v1 AS (SELECT doc_id, t FROM d WHERE doc_id % 2 = 0),
  v2 AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN t || ' edited' ELSE t END AS t FROM d WHERE doc_id % 2 = 0 OR doc_id % 3 = 0),
  v3 AS (SELECT * FROM v2 WHERE doc_id % 4 <> 0),
  v5 AS (SELECT * FROM v1 UNION ALL SELECT doc_id, t FROM d WHERE doc_id % 7 = 0 AND doc_id % 2 = 1),
  v6 AS (SELECT * FROM v5 WHERE doc_id % 5 <> 0 UNION ALL SELECT * FROM v3 WHERE doc_id % 5 = 0)
  SELECT 1 AS version, doc_id, sha256(t) AS text_sha256 FROM v1 UNION ALL SELECT 2, doc_id, sha256(t) FROM v2 UNION ALL SELECT 3, doc_id, sha256(t) FROM v3
  UNION ALL SELECT 4, doc_id, sha256(t) FROM v1 UNION ALL SELECT 5, doc_id, sha256(t) FROM v5 UNION ALL SELECT 6, doc_id, sha256(t) FROM v6""")
def dom12_snk3_versions(spark, base):
    """Six versions of a table: published, edited and added to, reduced, rolled back to the first, added to, and some documents restored as they were in the third."""
    d = table(spark, base, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = VersionedTable(spark, f"{shared_folder(spark)}/versions_{uuid.uuid4().hex}", "doc_id")
    t.publish(d.where("doc_id % 2 = 0"), remark="first")
    edited = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    t.publish(d.where("doc_id % 10 = 0 or (doc_id % 3 = 0 and doc_id % 2 = 1)").select("doc_id", edited.alias("text")))
    t.remove(d.where("doc_id % 4 = 0").select("doc_id"), d.schema)
    t.rollback(1)
    t.publish(d.where("doc_id % 7 = 0 and doc_id % 2 = 1"))
    t.restore(d.where("doc_id % 5 = 0").select("doc_id"), 3)
    of = lambda v: t.read(v).select(F.lit(v).alias("version"), "doc_id", content_digest("text").alias("text_sha256"))
    out = of(1)
    for v in range(2, 7):
        out = out.unionByName(of(v))
    return out
