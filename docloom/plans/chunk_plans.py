"""Chunk, page and lineage queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.rewrites import LOG_RULES, log_line
from docloom.operators import chunks as C
from docloom.operators import lifecycle as L
from docloom.operators import matrix as M
from docloom.operators import retrieval as R
from docloom.operators import sections as S
from docloom.plans.registry import register
from docloom.plans.retrieval_plans import K, THRESHOLD, _with, chunks, query_set
from docloom.plans.text_plans import _LINES, markdown
from docloom.sources.tables import table


@register("ret4_win2_win3_fusion", _with("SELECT query_id, chunk_id, rank_final, round(score_fused, 8) AS score_fused, round(best_norm, 6) AS best_norm FROM final"))
def ret4_win2_win3_fusion(spark, base):
    c, q = chunks(spark, base), query_set(spark, base)
    out = R.fuse(R.both_branches(c, q, K, THRESHOLD), K)
    return out.select("query_id", "chunk_id", "rank_final", F.round("score_fused", 8).alias("score_fused"), F.round("best_norm", 6).alias("best_norm"))


@register("ret6_diagnostics", _with(f"""
  SELECT query_id, {K} AS requested_top_k, count(*) FILTER (branch = 'lexical') AS lexical_hits, count(*) FILTER (branch = 'dense') AS dense_hits FROM parts GROUP BY 1"""))
def ret6_diagnostics(spark, base):
    c, q = chunks(spark, base), query_set(spark, base)
    lexical, dense = R.both_branches(c, q, K, THRESHOLD)
    both = lexical.unionByName(dense)
    count = lambda b: F.count_if(F.col("branch") == b).alias(f"{b}_hits")
    return both.groupBy("query_id").agg(F.lit(K).alias("requested_top_k"), count("lexical"), count("dense"))


@register("flt3_payload_filter", """
  SELECT doc_id FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang IN ('en', 'de') AND lower(source) IN ('src1', 'src2', 'src3') AND (lower(source) = 'src2' OR doc_id % 7 = 0)""")
def flt3_payload_filter(spark, base):
    c = chunks(spark, base).where(F.col("document_type").isin("en", "de"))
    c = c.withColumns({"q_systems": F.array(F.lit("src1"), F.lit("SRC2"), F.lit("src3")), "q_workspace": F.lit("src2"), "q_shared": F.lit(True)})
    return c.where(R.scope_condition()).select(F.col("chunk_id").cast("long").alias("doc_id"))


@register("jn16_positional_zip", "SELECT doc_id, len(embedding) AS dims FROM documents JOIN embeddings ON doc_id = vec_id")
def jn16_positional_zip(spark, base):
    v = table(spark, base, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dims"))
    c = table(spark, base, "documents").select("doc_id").join(v.select("doc_id"), "doc_id", "left_semi")
    inner = v.join(c, "doc_id", "left_semi")
    return C.zipped(c, inner, ["doc_id"])


@register("jn9_dom8_page_records", f"""WITH {_LINES}, t AS (SELECT doc_id, string_agg(line, ';' ORDER BY i) AS tables FROM lines WHERE starts_with(line, '|') GROUP BY 1), f AS (SELECT doc_id, count(*) AS figures FROM lines WHERE starts_with(line, '![') GROUP BY 1)
  SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(t.tables, '') AS tables, coalesce(f.figures, 0) AS figures FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN f USING (doc_id)""")
def jn9_dom8_page_records(spark, base):
    m = markdown(spark, base)
    lines = m.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "item"))
    v = table(spark, base, "labels").select("doc_id", "quality")
    out = C.page_records(m.select("doc_id"), v, lines.where(F.col("item").startswith("|")), lines.where(F.col("item").startswith("![")), ["doc_id"])
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.array_join("tables", ";").alias("tables"), F.size("figures").cast("long").alias("figures"))


@register("agg24_ordered_distinct", """
  WITH g AS (SELECT user_id, list(event_type ORDER BY event_id) AS v FROM events GROUP BY 1)
  SELECT user_id, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS kinds FROM g""")
def agg24_ordered_distinct(spark, base):
    g = table(spark, base, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("x"))
    return g.select("user_id", F.array_join(C.ordered_distinct(F.col("x.event_type")), ",").alias("kinds"))


@register("agg23_group_by_sheet", "SELECT lower(trim(o_orderpriority)) AS sheet, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY 1")
def agg23_group_by_sheet(spark, base):
    key = T.scope_token(F.concat(F.lit("  "), "o_orderpriority"))
    return table(spark, base, "orders").groupBy(key.alias("sheet")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first")).where("sheet is not null")


@register("agg30_image_loss_pages", "SELECT doc_id % 50 AS page, max(toxic) AS images FROM labels WHERE quality = 0 GROUP BY 1")
def agg30_image_loss_pages(spark, base):
    rows = table(spark, base, "labels").withColumn("issues", F.when(F.col("quality") == 0, F.array(F.lit("image_loss"), F.lit("formatting"))).otherwise(F.array(F.lit("formatting"))))
    lost = rows.select((F.col("doc_id") % 50).alias("page"), "toxic", F.explode("issues").alias("issue")).where("issue = 'image_loss'")
    return lost.groupBy("page").agg(F.max("toxic").alias("images"))


@register("agg22_figure_summary", f"""WITH {_LINES}
  SELECT count(*) FILTER (starts_with(line, '![')) AS figures, count(*) FILTER (starts_with(line, '![') AND length(line) - 12 > 10) AS described FROM lines""")
def agg22_figure_summary(spark, base):
    alts = markdown(spark, base).select(F.explode(S.figures(F.col("markdown"))).alias("alt"))
    return alts.agg(F.count(F.lit(1)).alias("figures"), F.count_if(F.length("alt") > 10).alias("described"))


@register("str11_ensure_citation", """
  SELECT doc_id, CASE WHEN contains(text, '[Source:') THEN text ELSE regexp_replace(text, '[\\s\\p{Z}]+$', '') || chr(10) || chr(10) || '[Source: D' || doc_id || ', Page 1]' || chr(10) || '[Source: D' || doc_id || ', Page 2]' END AS content FROM documents""")
def str11_ensure_citation(spark, base):
    pages = F.array(F.lit(1), F.lit(2))
    return table(spark, base, "documents").select("doc_id", C.ensure_citation(F.col("text"), F.concat(F.lit("D"), "doc_id"), pages).alias("content"))


@register("str12_first_heading", f"""WITH {_LINES}, h AS (SELECT doc_id, min_by(line, i) AS line FROM lines WHERE starts_with(ltrim(line), '#') GROUP BY 1)
  SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(line, '^#+', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), ''), 'Page ' || doc_id) AS heading FROM documents LEFT JOIN h USING (doc_id)""")
def str12_first_heading(spark, base):
    return markdown(spark, base).select("doc_id", C.first_heading(F.col("markdown"), F.col("doc_id")).alias("heading"))


@register("str4_scope_normal_form", "SELECT DISTINCT c_mktsegment, lower(c_mktsegment) AS scope FROM customer")
def str4_scope_normal_form(spark, base):
    x = F.concat(F.lit(" \t"), "c_mktsegment", F.lit(" "))
    return table(spark, base, "customer").select("c_mktsegment", T.scope_token(x).alias("scope")).distinct()


def _log_samples(value: str) -> list[str]:
    """A line for each rule of the log, ``value`` in its open part."""
    return [re.sub(r"\\(.)", r"\1", re.sub(r"\(\.\+\)|\.\*", "{0}", p.strip("^$"))).format(value) for p, _ in LOG_RULES]


def _log_case() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    branch = lambda p, r: f"WHEN regexp_matches(t, {quote(p)}) THEN " + ("NULL" if r is None else f"regexp_replace(t, {quote(p)}, {quote(r)})")
    return "CASE " + " ".join(branch(p, r) for p, r in LOG_RULES) + " ELSE t END"


_LOG_VALUES = ", ".join("'" + x.replace("'", "''") + "'" for x in _log_samples("<v>"))


@register("str30_log_messages", rf"""
  WITH s AS (SELECT event_id, CASE WHEN event_id % 35 < {len(LOG_RULES)} THEN replace([{_LOG_VALUES}][event_id % 35 + 1], '<v>', CAST(user_id AS VARCHAR) || ' of ' || event_type) WHEN event_id % 35 = 30 THEN '=====' WHEN event_id % 35 = 31 THEN '  ' ELSE event_type || ' Load Model' END AS line FROM events),
  r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '🚀 * ' || line WHEN 1 THEN '  ' || replace(line, ' ', '   ') ELSE line END AS raw FROM s),
  c AS (SELECT event_id, CASE WHEN trim(raw) <> '' THEN trim(regexp_replace(regexp_replace(trim(raw), '^(?:[^\p{{L}}\p{{N}}_\s]+\s*)+', ''), '\s+', ' ', 'g')) END AS t FROM r)
  SELECT event_id, {_log_case()} AS message FROM c""")
def str30_log_messages(spark, base):
    """A line of each rule of the log, with leading signs and wide gaps, and lines of no rule."""
    k, value = (F.col("event_id") % 35).cast("int"), F.concat(F.col("user_id").cast("string"), F.lit(" of "), "event_type")
    sample = F.replace(F.get(F.array(*[F.lit(x) for x in _log_samples("<v>")]), k), F.lit("<v>"), value)
    line = F.when(k < len(LOG_RULES), sample).when(k == 30, "=====").when(k == 31, "  ").otherwise(F.concat("event_type", F.lit(" Load Model")))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("🚀 * "), line)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("  "), F.replace(line, F.lit(" "), F.lit("   ")))).otherwise(line)
    return table(spark, base, "events").select("event_id", log_line(raw).alias("message"))


@register("stm5_sse_frames", """
  SELECT event_id, event_type AS event, props AS data FROM events UNION ALL SELECT event_id, 'message', 'x' FROM events""")
def stm5_sse_frames(spark, base):
    raw = F.concat(F.lit("event: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n: ping\n\ndata: x"))
    return table(spark, base, "events").select("event_id", F.explode(C.sse_frames(raw)).alias("f")).select("event_id", "f.event", "f.data")


@register("src3_sheet_preview", """
  WITH r AS (SELECT l_suppkey AS sheet, l_partkey || chr(9) || l_returnflag || chr(9) || l_linestatus AS line, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem)
  SELECT sheet, count(*) AS n_rows, string_agg(line, chr(10) ORDER BY rn) FILTER (rn <= 8) AS text_preview, 1 AS table_count FROM r GROUP BY 1""")
def src3_sheet_preview(spark, base):
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey")
    rows = table(spark, base, "lineitem").select(F.col("l_suppkey").alias("sheet"), order.alias("o"), F.array(F.col("l_partkey").cast("string"), "l_returnflag", "l_linestatus").alias("cells"))
    return C.preview_rows(rows, "sheet", "o", "cells")


@register("src4_src5_cells_to_markdown", """
  SELECT p_brand, '| Col1 | Size |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || p_name || ' | ' || p_size || ' |', chr(10) ORDER BY p_partkey) AS markdown FROM part GROUP BY 1""")
def src4_src5_cells_to_markdown(spark, base):
    """Rows as a pipe table: the first row is the header, a blank header becomes Col{i}."""
    header = F.transform(F.array(F.lit(""), F.lit("Size")), lambda h, i: F.when(h == "", F.concat(F.lit("Col"), (i + 1).cast("string"))).otherwise(h))
    pipe = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    p = table(spark, base, "part").select("p_brand", "p_partkey", pipe(F.array("p_name", F.col("p_size").cast("string"))).alias("line"))
    g = p.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("x"))
    return g.select("p_brand", F.concat_ws("\n", pipe(header), F.lit("|---|---|"), F.array_join("x.line", "\n")).alias("markdown"))


@register("jn19_sheet_lookup", """
  WITH a AS (SELECT lower(k) AS k, min(l_orderkey) AS page FROM (SELECT l_returnflag AS k, l_orderkey FROM lineitem UNION ALL SELECT l_linestatus, l_orderkey FROM lineitem) GROUP BY 1),
    b AS (SELECT lower(o_orderstatus) AS k, min(o_orderkey) + 100 AS page FROM orders GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS k, coalesce(a.page, b.page) AS page, CASE WHEN a.k IS NULL THEN 'b' WHEN b.k IS NULL THEN 'a,x' ELSE 'a,x,b' END AS heads FROM a FULL JOIN b ON a.k = b.k""")
def jn19_sheet_lookup(spark, base):
    flags = table(spark, base, "lineitem").select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("sheet"), "l_orderkey")
    a = flags.groupBy("sheet").agg(F.min("l_orderkey").alias("page"), F.array(F.lit("a"), F.lit("x")).alias("heads"))
    b = table(spark, base, "orders").groupBy(F.lower("o_orderstatus").alias("sheet")).agg((F.min("o_orderkey") + 100).alias("page"), F.array(F.lit("b")).alias("heads"))
    return C.sheet_lookup(a, b).select("k", "page", F.array_join("heads", ",").alias("heads"))


@register("jn20_anchor_containment", """
  WITH l AS (SELECT doc_id, i, lower(x) AS x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))
  SELECT doc_id, i, CAST(contains(x, 'the th') OR contains('the th', x) AS INTEGER) + CAST(contains(x, 'of the') OR contains('of the', x) AS INTEGER) AS score FROM l WHERE x <> ''""")
def jn20_anchor_containment(spark, base):
    """How many anchors a line contains or is contained in."""
    anchors = F.array(F.lit("the th"), F.lit("of the"))
    l = table(spark, base, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x")).withColumn("x", F.lower("x")).where("x <> ''")  # noqa: E741
    score = F.size(F.filter(anchors, lambda a: F.col("x").contains(a) | F.contains(a, F.col("x"))))
    return l.select("doc_id", (F.col("i") + 1).alias("i"), score.alias("score"))


@register("top9_first_facts", """
  WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS v FROM lineitem GROUP BY 1) SELECT l_orderkey, array_to_string(v[1:3], ',') AS facts FROM g""")
def top9_first_facts(spark, base):
    g = table(spark, base, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    return g.select("l_orderkey", F.array_join(F.slice(F.col("x.l_partkey"), 1, 3).cast("array<string>"), ",").alias("facts"))


@register("set4_figure_union", """
  SELECT doc_id, 'classic' AS kind, doc_id AS fig FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 'described', doc_id + 1000 FROM documents WHERE doc_id % 3 = 0""")
def set4_figure_union(spark, base):
    d = table(spark, base, "documents").select("doc_id")
    part = lambda cond, kind, offset: d.where(cond).select("doc_id", F.lit(kind).alias("kind"), (F.col("doc_id") + offset).alias("fig"))
    return part("doc_id % 2 = 0", "classic", 0).unionByName(part("doc_id % 3 = 0", "described", 1000))


@register("set6_merge_descriptions", """
  SELECT text, min(src) AS src FROM (SELECT DISTINCT text, 0 AS src FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT DISTINCT text, 1 FROM documents WHERE doc_id % 2 = 1) GROUP BY 1""")
def set6_merge_descriptions(spark, base):
    d = table(spark, base, "documents")
    half = lambda k: d.where(f"doc_id % 2 = {k}").select("text").distinct().withColumn("src", F.lit(k))
    return C.merged_distinct(half(0), half(1), ["text"])


@register("flt21_effect_labels", "SELECT p_partkey, NOT (p_size % 2 = 0 OR p_name = '') AS ok FROM part")
def flt21_effect_labels(spark, base):
    label = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_name"))
    return table(spark, base, "part").select("p_partkey", M.is_label(label).alias("ok"))


@register("flt24_resume_skip", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt24_resume_skip(spark, base):
    """Every document that is not done yet: an anti-join with the labels."""
    return table(spark, base, "documents").select("doc_id").join(table(spark, base, "labels").select("doc_id"), "doc_id", "left_anti")


@register("jn18_cleanup_match", "SELECT DISTINCT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') OR p_name IN (SELECT p_name FROM part WHERE p_size = 7)")
def jn18_cleanup_match(spark, base):
    """Manifests that match a document by path or by title: two semi-joins, one row each."""
    p = table(spark, base, "part").select("p_partkey", "p_name", "p_size")
    by_path = p.join(table(spark, base, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi")
    by_title = p.join(p.where("p_size = 7").select("p_name"), "p_name", "left_semi")
    return by_path.select("p_partkey").union(by_title.select("p_partkey")).distinct()


@register("dom10_publishable_chunks", f"""WITH {_LINES}
  SELECT doc_id, 1 AS chunk_no, text AS content, 'chunks' AS origin FROM documents WHERE doc_id % 3 = 0 AND regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g') <> ''
  UNION ALL SELECT doc_id, section_no, content, 'markdown' FROM secs WHERE doc_id % 3 <> 0""")
def dom10_publishable_chunks(spark, base):
    d = table(spark, base, "documents")
    own = d.where("doc_id % 3 <> 1").select("doc_id", F.lit(1).alias("chunk_no"), F.lit("h").alias("heading"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(" ").alias("content"))
    sections = S.sections(markdown(spark, base)).select("doc_id", F.col("section_no").alias("chunk_no"), "heading", "content")
    return C.publishable(own, sections, "doc_id").select("doc_id", "chunk_no", "content", "origin")


@register("dom12_versions", """
  SELECT user_id, event_id AS version, coalesce(lead(event_id) OVER w, -1) AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC) QUALIFY row_number() OVER w <= 2""")
def dom12_versions(spark, base):
    m = table(spark, base, "events").select("user_id", F.col("event_id").alias("version"))
    return C.versions(m, "user_id").select("user_id", "version", F.coalesce("previous", F.lit(-1)).alias("previous"))


@register("dom12_audit_report", "SELECT conv_id, string_agg('v' || turn || ': ' || role, chr(10) ORDER BY turn) AS report FROM conversations GROUP BY 1")
def dom12_audit_report(spark, base):
    m = table(spark, base, "conversations").select("conv_id", F.col("turn").alias("version"), F.col("role").alias("note"))
    return C.audit_text(m, "conv_id")


@register("dom16_placeholders", """
  SELECT doc_id, doc_id % 5 AS expected, array_to_string(list_concat(['d'], list_transform(range(2, CAST(doc_id % 5 AS INTEGER) + 1), lambda n: 'Image ' || n || ' (no description)')), ';') AS items FROM documents""")
def dom16_placeholders(spark, base):
    d = table(spark, base, "documents").select("doc_id", (F.col("doc_id") % 5).cast("int").alias("expected"), F.array(F.lit("d")).alias("items"))
    return C.padded(d, "doc_id", "expected", "items").select("doc_id", "expected", F.array_join("items", ";").alias("items"))


@register("dom18_segment_outline", """
  SELECT source, count(*) AS n, CAST(sum(least(500, length(regexp_replace(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')))) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def dom18_segment_outline(spark, base):
    d = table(spark, base, "documents").select("source", F.col("doc_id").alias("page_number"), F.get(F.split("text", "\n"), F.lit(0)).alias("heading"), F.col("text").alias("markdown"))
    o = C.outline(d, "source")
    return o.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("preview")), F.lit(0)).cast("long").alias("chars"))


@register("dom7_dom11_dom14_review_units", f"""WITH {_LINES}
  SELECT doc_id, count(*) AS units, min(start_line) AS first_line, max(end_line) AS last_line, CASE WHEN doc_id % 4 = 0 THEN 'reviewed' ELSE 'pending' END AS status FROM secs GROUP BY doc_id""")
def dom7_dom11_dom14_review_units(spark, base):
    """Review units of a document with their span and derived status."""
    s = S.sections(markdown(spark, base)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))
    checked = F.array(F.col("doc_id") % 4 == 0, F.col("doc_id") % 4 == 0)
    status = F.when(F.forall(checked, lambda c: c), "reviewed").when(F.exists(checked, lambda c: c), "in-review").otherwise("pending")
    return s.withColumn("status", status)


@register("str32_image_descriptions", """
  SELECT p_partkey, 'start <!-- page --> [Image: ' || p_name || '] end' AS markdown FROM part""")
def str32_image_descriptions(spark, base):
    """Descriptions go in after the page marker, once; replacement text is taken literally."""
    text = F.lit("start <!-- page --> end")
    new = F.concat(F.lit("<!-- page --> [Image: "), "p_name", F.lit("]"))
    return table(spark, base, "part").select("p_partkey", F.replace(text, F.lit("<!-- page -->"), new).alias("markdown"))


@register("jsn5_field_fallbacks", """
  SELECT event_id, coalesce(json_extract_string(props, '$.device'), json_extract_string(props, '$.k'), event_type) AS device FROM events""")
def jsn5_field_fallbacks(spark, base):
    fields = F.from_json("props", "map<string,string>")
    get = lambda k: F.try_element_at(fields, F.lit(k))
    return table(spark, base, "events").select("event_id", F.coalesce(get("device"), get("k"), F.col("event_type")).alias("device"))


@register("dt2_artifact_recency", """
  SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END >= TIMESTAMP '1998-01-01', false) AS newer FROM orders""")
def dt2_artifact_recency(spark, base):
    """ISO texts parsed leniently; what does not parse is not newer."""
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, base, "orders").select("o_orderkey", F.coalesce(F.try_to_timestamp(raw, F.lit("yyyy-MM-dd'T'HH:mm:ss")) >= F.lit("1998-01-01").cast("timestamp"), F.lit(False)).alias("newer"))


@register("win9_sheet_sections", f"WITH {_LINES} SELECT doc_id, heading AS sheet, start_line, end_line, coalesce(lead(start_line) OVER (PARTITION BY doc_id ORDER BY section_no), 0) AS next_start FROM secs")
def win9_sheet_sections(spark, base):
    from pyspark.sql import Window as W

    s = S.sections(markdown(spark, base))
    return s.select("doc_id", F.col("heading").alias("sheet"), "start_line", "end_line", F.coalesce(F.lead("start_line").over(W.partitionBy("doc_id").orderBy("section_no")), F.lit(0)).alias("next_start"))


@register("win5_cause_batches", """
  WITH RECURSIVE r AS (SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i, greatest(1, CAST(trunc(l_quantity * 60) AS BIGINT)) AS size FROM lineitem),
  f AS (
    SELECT l_suppkey, CAST(0 AS BIGINT) AS i, 0 AS run, 0 AS n, CAST(0 AS BIGINT) AS chars FROM r GROUP BY 1
    UNION ALL
    SELECT f.l_suppkey, f.i + 1, CASE WHEN n = 0 OR n >= 6 OR chars + size > 7500 THEN run + 1 ELSE run END, CASE WHEN n = 0 OR n >= 6 OR chars + size > 7500 THEN 1 ELSE n + 1 END,
      CASE WHEN n = 0 OR n >= 6 OR chars + size > 7500 THEN size ELSE chars + size END FROM f JOIN r ON r.l_suppkey = f.l_suppkey AND r.i = f.i + 1)
  SELECT l_suppkey, max(run) AS batches, max(i) AS causes FROM f GROUP BY 1""")
def win5_cause_batches(spark, base):
    """Causes of a supplier in batches of at most six or 7,500 characters; a large supplier spans many tasks."""
    li = table(spark, base, "lineitem").select(F.col("l_suppkey").cast("string").alias("key"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"), (F.col("l_quantity") * 60).cast("int").alias("size"), F.lit(False).alias("head"))
    runs = S.greedy_segments(li, "key", "o", "size", "head", 6, 7_500, 1 << 30)
    return runs.groupBy(F.col("key").cast("long").alias("l_suppkey")).agg(F.max("segment").alias("batches"), F.count(F.lit(1)).alias("causes"))


@register("src11_artifact_times", "SELECT o_custkey, min(o_orderdate) AS started, max(o_orderdate) AS completed FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1")
def src11_artifact_times(spark, base):
    usable = table(spark, base, "orders").where(F.col("o_orderstatus") != "P")
    return usable.groupBy("o_custkey").agg(F.min("o_orderdate").alias("started"), F.max("o_orderdate").alias("completed"))


@register("mth3_relaxed_threshold", "SELECT event_id, round(greatest(0.45, CAST(value AS DOUBLE) / 100 - 0.25), 6) AS relaxed FROM events")
def mth3_relaxed_threshold(spark, base):
    """The relaxed form of a threshold a row."""
    return table(spark, base, "events").select("event_id", F.round(R.relaxed(F.col("value") / 100), 6).alias("relaxed"))


_STATUS = "CASE event_id % {n} {cases} END".format(n=len(L.STATUSES), cases=" ".join(f"WHEN {k} THEN '{{}}'" for k in range(len(L.STATUSES))))


@register("status_dimension", "WITH s(status, progress, stage) AS (VALUES " + ", ".join("({})".format(", ".join("NULL" if x is None else repr(x) for x in r)) for r in L.STATUSES) + "), e AS (SELECT event_id, "
  + _STATUS.format(*[s for s, _, _ in L.STATUSES]) + " AS status FROM events) SELECT event_id, status, progress, stage FROM e JOIN s USING (status)")
def status_dimension(spark, base):
    """Progress and stage of each job's status, from the status table."""
    statuses = spark.createDataFrame(L.STATUSES, "status string, progress int, stage string")
    names = F.array(*[F.lit(s) for s, _, _ in L.STATUSES])
    e = table(spark, base, "events").select("event_id", F.element_at(names, (F.col("event_id") % len(L.STATUSES) + 1).cast("int")).alias("status"))
    return e.join(F.broadcast(statuses), "status").select("event_id", "status", "progress", "stage")
