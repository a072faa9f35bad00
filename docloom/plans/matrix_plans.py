"""Matrix, alignment, JSON and path queries; matrices come from lineitem, a sheet a supplier."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import json_repair as J
from docloom.operators import alignment as A
from docloom.operators import answers as N
from docloom.operators import matrix as M
from docloom.plans.registry import register
from docloom.plans.text_plans import _LINES, markdown
from docloom.sources import artifacts as R
from docloom.sources.tables import table

COLUMNS = 14


def matrix_rows(spark, base):
    """Per supplier a header row and one row a line item: three cells of a cause, three plain ones, eight marker cells."""
    li = table(spark, base, "lineitem")
    n = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    mark = [F.when((F.col("l_partkey") + j) % 5 == 0, "X").when((F.col("l_partkey") + j) % 7 == 0, "p").otherwise("") for j in range(8)]
    cells = F.array(
        F.concat(F.lit("R"), F.col("l_partkey") % 40), F.concat(F.lit("TAG-"), F.col("l_partkey") % 40), F.concat(F.lit("Cause number "), F.col("l_partkey") % 40),
        F.lit("note"), F.lit("12"), F.col("l_linestatus"), *mark,
    )
    own = li.select(F.col("l_suppkey").alias("sheet"), n.alias("n"), "l_partkey", "l_linestatus")
    labels = [F.lit("") for _ in range(6)] + [F.concat(F.lit(f"Effect valve {j} of "), "sheet") if j != 3 else F.lit("short") for j in range(8)]
    row = lambda line, x: F.struct(line.cast("int").alias("line_no"), x.alias("cells"))
    data = row(F.col("n") + 3, cells)
    return own.select("sheet", F.inline(F.when(F.col("n") == 1, F.array(row(F.lit(2), F.array(*labels)), data)).otherwise(F.array(data))))


_M = f"""base AS (
  SELECT l_suppkey AS sheet, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) + 3 AS line_no, l_partkey % 40 AS c, l_partkey FROM lineitem),
marks AS (SELECT sheet, line_no, c, j + 6 AS col, CASE WHEN (l_partkey + j) % 5 = 0 THEN 'X' WHEN (l_partkey + j) % 7 = 0 THEN 'P' END AS marker FROM base, range(8) t(j)),
datarows AS (SELECT DISTINCT sheet, line_no, c FROM marks WHERE marker IS NOT NULL),
bound AS (SELECT sheet, min(col) AS bound FROM marks JOIN (SELECT sheet, line_no FROM datarows QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY line_no) <= 15) USING (sheet, line_no) WHERE marker IS NOT NULL GROUP BY 1),
effects AS (SELECT sheet, col, 'Effect valve ' || (col - 6) || ' of ' || sheet AS effect_label, printf('effect_%03d', row_number() OVER (PARTITION BY sheet ORDER BY col)) AS effect_id
  FROM bound, range({6}, {COLUMNS}) t(col) WHERE col >= bound AND col <> 9),
causes AS (SELECT sheet, c, printf('cause_%03d', row_number() OVER (PARTITION BY sheet ORDER BY min(line_no))) AS cause_id FROM datarows GROUP BY sheet, c),
relations AS (SELECT sheet, printf('rel_%04d', row_number() OVER (PARTITION BY sheet ORDER BY line_no, col)) AS relation_id, cause_id, effect_id, effect_label, marker,
    CASE marker WHEN 'X' THEN 'active_interlock' ELSE 'permissive_condition' END AS marker_semantic, line_no AS row_line, col AS "column"
  FROM marks JOIN effects USING (sheet, col) JOIN causes USING (sheet, c) WHERE marker IS NOT NULL)"""


@register("dom1_matrix_relations", f"WITH {_M} SELECT * FROM relations")
def dom1_matrix_relations(spark, base):
    return M.relations(matrix_rows(spark, base), "sheet")


@register("agg27_agg29_effect_index", f"WITH {_M} SELECT sheet, col AS \"column\", effect_label, effect_id FROM effects")
def agg27_agg29_effect_index(spark, base):
    return M.effects(matrix_rows(spark, base), "sheet").select("sheet", "column", "effect_label", "effect_id")


@register("agg28_effect_bound", f"WITH {_M} SELECT sheet, bound FROM bound")
def agg28_effect_bound(spark, base):
    return M.bounds(matrix_rows(spark, base), "sheet").select("sheet", "bound")


@register("agg21_matrix_summary", f"""WITH {_M}
  SELECT sheet, (SELECT count(*) FROM effects e WHERE e.sheet = b.sheet) AS effects, (SELECT count(*) FROM causes c WHERE c.sheet = b.sheet) AS causes, (SELECT count(*) FROM relations r WHERE r.sheet = b.sheet) AS relations FROM bound b""")
def agg21_matrix_summary(spark, base):
    return M.summary(matrix_rows(spark, base), "sheet")


@register("set3_matrix_entities", f"""WITH {_M} SELECT sheet, cause_id AS entity_id, 'cause' AS type, 'TAG-' || c AS label FROM causes UNION ALL SELECT sheet, effect_id, 'effect', effect_label FROM effects""")
def set3_matrix_entities(spark, base):
    return M.entities(matrix_rows(spark, base), "sheet")


@register("dom4_jn7_review_bullets", f"WITH {_M} SELECT sheet, cause_id, string_agg('- ' || marker || ': ' || effect_label, chr(10) ORDER BY row_line, \"column\") AS markdown FROM relations GROUP BY 1, 2")
def dom4_jn7_review_bullets(spark, base):
    return M.bullets(matrix_rows(spark, base), "sheet")


@register("flt20_jn10_segment_entries", f"""WITH {_M}, e AS (SELECT sheet, relation_id, row_line % 10 AS page_number FROM relations)
  SELECT sheet, relation_id, page_number % 2 AS segment_id FROM e WHERE page_number < 4 UNION SELECT sheet, relation_id, 9 FROM e WHERE sheet % 10 = 0""")
def flt20_jn10_segment_entries(spark, base):
    r = M.relations(matrix_rows(spark, base), "sheet")
    e = r.select(F.col("sheet").alias("k"), F.lit("all").alias("book"), F.col("sheet").cast("string").alias("sheet"), "relation_id", (F.col("row_line") % 10).alias("page_number"), F.concat(F.lit("S"), F.col("sheet") % 10, F.lit(".rows")).alias("path_ref"))
    s = spark.sql("SELECT * FROM VALUES ('all', 0, array(0, 2), array('none')), ('all', 1, array(1, 3), array('none')), ('all', 9, array(-1), array('S0')) AS t(book, segment_id, pages, sheets)")
    return M.in_segment(e, s, "book").select(F.col("k").alias("sheet"), "relation_id", "segment_id")


@register("top10_stable_order", f"WITH {_M} SELECT sheet, relation_id, row_number() OVER (PARTITION BY sheet ORDER BY marker, row_line, \"column\", relation_id) AS position FROM relations")
def top10_stable_order(spark, base):
    w = W.partitionBy("sheet").orderBy("marker", "row_line", "column", "relation_id")
    return M.relations(matrix_rows(spark, base), "sheet").select("sheet", "relation_id", F.row_number().over(w).alias("position"))


@register("str18_table_cells", rf"""WITH {_LINES}, t AS (SELECT doc_id, i + 1 AS line_no, regexp_replace(line, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g') AS x FROM lines WHERE contains(line, '|'))
  SELECT doc_id, line_no, array_to_string(list_transform(string_split(substring(x, 2, length(x) - 2), '|'), lambda c: regexp_replace(c, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), ';') AS cells
  FROM t WHERE starts_with(x, '|') AND suffix(x, '|') AND length(x) > 1 AND NOT regexp_matches(x, '^[|:\-\s]+$')""")
def str18_table_cells(spark, base):
    return M.table_rows(markdown(spark, base), "doc_id", "markdown").select("doc_id", "line_no", F.array_join("cells", ";").alias("cells"))


@register("win13_joined_headings", r"""
  WITH l AS (SELECT doc_id, i - 1 AS i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
  h AS (
    SELECT doc_id, i - i % 4 AS i, string_agg(CASE i % 4 WHEN 0 THEN regexp_replace('## ' || x, '\s+$', '') ELSE regexp_replace(regexp_replace(x, '^[#]+', ''), '^\s+|\s+$', '', 'g') END, ' / ' ORDER BY i) AS line FROM l WHERE i % 4 < 2 GROUP BY 1, 2
    UNION ALL SELECT doc_id, i, CASE i % 4 WHEN 2 THEN '' ELSE x END FROM l WHERE i % 4 >= 2)
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS markdown FROM h GROUP BY 1""")
def win13_joined_headings(spark, base):
    d = table(spark, base, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 4 < 2, F.concat(F.lit("## "), x)).when(i % 4 == 2, "").otherwise(x)), "\n").alias("markdown"))
    return A.with_joined_headings(d, "markdown")


@register("jsn1_path_metadata", """
  SELECT event_id, nullif(regexp_extract('book.s' || user_id || repeat('.x', event_id % 4) || '.' || event_type, '^(.*)\\.[^.]*$', 1), '') AS parent, 3 + event_id % 4 AS depth,
    CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'null' ELSE 'number' END AS value_type FROM events""")
def jsn1_path_metadata(spark, base):
    e = table(spark, base, "events")
    path = F.concat(F.lit("book.s"), F.col("user_id").cast("string"), F.expr("repeat('.x', cast(event_id % 4 as int))"), F.lit("."), "event_type")
    k = F.get_json_object("props", "$.k")
    kind = F.when(k.isNull(), "null").when(k.try_cast("double").isNotNull(), "number").otherwise("string")
    return e.select("event_id", J.parent_path(path).alias("parent"), J.path_depth(path).alias("depth"), kind.alias("value_type"))


@register("jsn2_json_recovery", """
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def jsn2_json_recovery(spark, base):
    """Props wrapped as models write them - fenced, lax, cut off - and recovered."""
    e, m = table(spark, base, "events"), F.col("event_id") % 4
    raw = (
        F.when(m == 0, F.col("props")).when(m == 1, F.concat(F.lit("Here:\n```json\n"), "props", F.lit("\n```")))
        .when(m == 2, F.regexp_replace(F.regexp_replace("props", '"', "'"), r"\}", ",}")).otherwise(F.concat(F.lit("Sure. "), F.regexp_replace("props", r"\}$", "")))
    )
    out = J.with_recovered(e.select("event_id", raw.alias("raw")), "raw", "json")
    return out.select("event_id", F.get_json_object("json", "$.k").cast("long").alias("k"))


@register("jsn3_flt19_chunk_coercion", """
  SELECT conv_id, turn, text AS content, CASE WHEN turn % 2 = 0 THEN role END AS heading, 'chunk_' || lpad(CAST(turn + 1 AS VARCHAR), 3, '0') AS id FROM conversations WHERE trim(text) <> ''""")
def jsn3_flt19_chunk_coercion(spark, base):
    """Chunks under alias keys in JSON; blank contents go, missing ids are numbered."""
    c = table(spark, base, "conversations")
    name = lambda k, *v: F.when(F.col("turn") % 2 == k, F.col(v[0]))
    raw = F.to_json(F.struct(name(0, "text").alias("body"), name(1, "text").alias("markdown"), name(0, "role").alias("title")))
    x = c.withColumn("c", J.coalesced_chunk(raw)).where("c.content is not null")
    return x.select("conv_id", "turn", "c.content", "c.heading", F.coalesce("c.id", F.concat(F.lit("chunk_"), F.lpad((F.col("turn") + 1).cast("string"), 3, "0"))).alias("id"))


@register("jsn4_schema_validation", """
  SELECT event_id, event_id % 5 IN (1, 2) AS complete, CASE event_id % 5 WHEN 0 THEN NULL WHEN 4 THEN NULL ELSE CAST(event_id AS BIGINT) END AS k,
    CASE event_id % 5 WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 4 THEN event_type ELSE 'unknown' END AS kind FROM events""")
def jsn4_schema_validation(spark, base):
    """A typed parse with required fields: what is malformed, missing or of another type falls back to defaults."""
    fields = F.struct(F.col("event_id").alias("k"), F.col("event_type").alias("kind"))
    m = F.col("event_id") % 5
    raw = (
        F.when(m == 0, F.lit("not json")).when(m == 3, F.to_json(F.struct(F.col("event_id").alias("k"))))
        .when(m == 4, F.to_json(F.struct(F.lit("text").alias("k"), F.col("event_type").alias("kind")))).otherwise(F.to_json(fields))
    )
    e = table(spark, base, "events").withColumn("v", F.from_json(raw, "k long, kind string"))
    complete = F.coalesce(F.col("v.k").isNotNull() & F.col("v.kind").isNotNull(), F.lit(False))
    return e.select("event_id", complete.alias("complete"), F.col("v.k").alias("k"), F.coalesce("v.kind", F.lit("unknown")).alias("kind"))


@register("src9_page_ranges", """
  SELECT l_orderkey, l_linenumber, l_partkey, f AS first_page, least(f + 3, CAST(l_quantity AS INTEGER)) AS last_page FROM lineitem, LATERAL (SELECT unnest(range(1, greatest(1, CAST(l_quantity AS INTEGER)) + 1, 4)) AS f)""")
def src9_page_ranges(spark, base):
    li = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.bround("l_quantity").cast("int").alias("n"))
    return R.page_ranges(li, "n", 4).drop("n")


@register("src7_candidate_priority", """
  SELECT o_custkey, min_by(o_orderkey, (CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) * 100000000 + o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def src7_candidate_priority(spark, base):
    c = table(spark, base, "orders").select("o_custkey", F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("path"))
    return R.first_by_priority(c, "o_custkey", ["F", "O", "P"]).select("o_custkey", F.col("path").alias("o_orderkey"))


@register("snk1_upsert", """
  SELECT c_custkey AS p_partkey, c_nationkey + 100 AS p_size FROM customer UNION ALL SELECT p_partkey, p_size FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""")
def snk1_upsert(spark, base):
    p = table(spark, base, "part").select("p_partkey", "p_size")
    new = table(spark, base, "customer").select(F.col("c_custkey").alias("p_partkey"), (F.col("c_nationkey") + 100).alias("p_size"))
    return R.upsert(p, new, "p_partkey")


@register("snk2_snk14_delete", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def snk2_snk14_delete(spark, base):
    gone = table(spark, base, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.delete(table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), gone, "l_orderkey")


@register("win14_overall_progress", """
  WITH e AS (SELECT event_id, user_id, event_id % 6 AS seg, CAST(value AS INTEGER) % 140 AS pct FROM events)
  SELECT event_id, greatest(0, least(100, CAST(round_even(((greatest(1, least(5, seg)) - 1) + greatest(0, least(100, pct)) / 100.0) / 5 * 100, 0) AS INTEGER))) AS percent FROM e""")
def win14_overall_progress(spark, base):
    seg, pct = F.greatest(F.lit(1), F.least(F.lit(5), F.col("event_id") % 6)), F.bround("value").cast("int") % 140
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(100), x))
    overall = ((seg - 1) + clamp(pct) / 100.0) / 5
    return table(spark, base, "events").select("event_id", clamp(F.bround(overall * 100).cast("int")).alias("percent"))


@register("stm4_token_stream", """
  SELECT conv_id, turn, i - 1 AS seq, tok FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS tok, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations WHERE role = 'assistant')
  UNION ALL SELECT conv_id, turn, len(string_split(text, ' ')), '[complete]' FROM conversations WHERE role = 'assistant'""")
def stm4_token_stream(spark, base):
    """Tokens of each answer in order, then the terminal event."""
    c = table(spark, base, "conversations").where("role = 'assistant'")
    return c.select("conv_id", "turn", F.posexplode(F.concat(F.split("text", " "), F.array(F.lit("[complete]")))).alias("seq", "tok"))


@register("map1_sampling", """
  WITH o AS (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS level, CAST('0x' || substring(md5(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS place FROM orders)
  SELECT o_orderkey, level FROM o WHERE place < CASE level WHEN 'medium' THEN 50 WHEN 'low' THEN 15 ELSE 100 END""")
def map1_sampling(spark, base):
    """Sampling by risk: rates by level, decided by a digest of the id, so a rerun takes the same rows."""
    level = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low")
    rate = F.when(level.isin("critical", "high"), 100).when(level == "medium", 50).otherwise(15)
    place = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") % 100
    return table(spark, base, "orders").where(place < rate).select("o_orderkey", level.alias("level"))


@register("dom2_relation_chunks", f"""WITH {_M},
  listed AS (SELECT sheet, cause_id, count(*) AS n, string_agg('  - Effect `' || effect_label || '` [' || marker || ': ' || replace(marker_semantic, '_', ' ') || ']', chr(10) ORDER BY relation_id) FILTER (k <= 3) AS x
    FROM (SELECT *, row_number() OVER (PARTITION BY sheet, cause_id ORDER BY relation_id) AS k FROM relations) GROUP BY 1, 2),
  c AS (SELECT sheet, c, cause_id, coalesce(n, 0) AS n, x FROM causes LEFT JOIN listed USING (sheet, cause_id)),
  chunks AS (
    SELECT sheet, cause_id, 0 AS part, '' AS relation_id, 'question_heading_chunk' AS chunk_type, 'What does cause TAG-' || c || ' indicate on ' || sheet || '?' AS heading,
      '- Cause `' || cause_id || '` has ' || n || ' mapped effect relation(s).' || chr(10) || '- Reference: `R' || c || '`' || chr(10) || '- Description: Cause number ' || c
        || CASE WHEN n > 0 THEN chr(10) || '- Mapped effects:' ELSE '' END || chr(10) || coalesce(x, '') || CASE WHEN n > 3 THEN chr(10) || '  - ... and ' || (n - 3) || ' more effect(s).' ELSE '' END AS content FROM c
    UNION ALL SELECT sheet, cause_id, 1, '', 'row_fact_chunk', 'What fact is recorded for cause TAG-' || c || '?',
      '- Cause ID: `' || cause_id || '`' || chr(10) || '- Cause tag: `TAG-' || c || '`' || chr(10) || '- Cause reference: `R' || c || '`' || chr(10) || '- Description: Cause number ' || c FROM c
    UNION ALL SELECT r.sheet, r.cause_id, 2, relation_id, 'relation_edge_chunk', 'How does TAG-' || c || ' affect ' || effect_label || '?',
      '- Cause `' || r.cause_id || '` triggers effect `' || effect_id || '`.' || chr(10) || '- Marker: `' || marker || '` (' || marker_semantic || ').' FROM relations r JOIN c ON c.sheet = r.sheet AND c.cause_id = r.cause_id),
  k AS (SELECT *, row_number() OVER (ORDER BY sheet, cause_id, part, relation_id) AS chunk_no FROM chunks)
  SELECT sheet, chunk_no, CASE part WHEN 2 THEN 'relation_edge_' || relation_id ELSE CASE part WHEN 0 THEN 'question_heading_' ELSE 'row_fact_' END || lpad(CAST(chunk_no AS VARCHAR), CAST(greatest(4, length(CAST(chunk_no AS VARCHAR))) AS INTEGER), '0') END AS chunk_id,
    chunk_type, heading, content FROM k""")
def dom2_relation_chunks(spark, base):
    """Questions, facts and edges of all sheets, numbered through."""
    return M.relation_chunks(matrix_rows(spark, base), "sheet")


@register("map1_risk_sampling", """
  WITH s AS (
    SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'Safety notes' WHEN 1 THEN 'Overview' WHEN 2 THEN 'Product Specifications' WHEN 3 THEN role WHEN 4 THEN NULL ELSE 'Summary of tables' END AS heading,
      CASE WHEN conv_id % 5 = 0 THEN text || ' see SPECIFICATION' ELSE text END AS content, conv_id % 7 = 0 AS has_tables FROM conversations),
  r AS (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(coalesce(heading, '')), 'safety|warning|critical|specification') THEN 'critical' WHEN has_tables OR contains(lower(coalesce(content, '')), 'specification') THEN 'high'
      WHEN regexp_matches(lower(coalesce(heading, '')), 'introduction|overview|summary') THEN 'low' ELSE 'medium' END AS risk_level, CAST('0x' || substring(md5(conv_id || chr(31) || turn), 1, 8) AS BIGINT) % 100 AS place FROM s)
  SELECT conv_id, turn, risk_level, place < CASE risk_level WHEN 'medium' THEN 50 WHEN 'low' THEN 15 ELSE 100 END AS sampled FROM r""")
def map1_risk_sampling(spark, base):
    """Sections classified by heading, tables and content, and drawn at the rate of their risk."""
    heads = F.array(*[F.lit(x) for x in ("Safety notes", "Overview", "Product Specifications")], F.col("role"), F.lit(None).cast("string"), F.lit("Summary of tables"))
    c = table(spark, base, "conversations").withColumn("heading", F.get(heads, (F.col("turn") % 6).cast("int")))
    content = F.when(F.col("conv_id") % 5 == 0, F.concat("text", F.lit(" see SPECIFICATION"))).otherwise(F.col("text"))
    return N.sampled(c.withColumn("risk_level", N.risk_level(F.col("heading"), content, F.col("conv_id") % 7 == 0)), ["conv_id", "turn"]).select("conv_id", "turn", "risk_level", "sampled")


@register("stm4_answer_events", """
  WITH t AS (
    SELECT conv_id, turn, text, CASE WHEN conv_id % 4 = 0 THEN [] ELSE ['cite-1', 'cite-2'] END AS citations, CASE WHEN (conv_id + turn) % 11 = 0 THEN 'model lost' END AS error,
      CASE WHEN conv_id % 3 = 0 THEN ['', ' '] ELSE string_split(text, ' ') END AS tokens FROM conversations WHERE role = 'assistant'),
  e AS (
    SELECT conv_id, turn, list_concat(list_transform(tokens, lambda x: {'event': 'token', 'payload': x}), [{'event': 'error', 'payload': error}]) AS ev FROM t WHERE error IS NOT NULL
    UNION ALL SELECT conv_id, turn, [{'event': 'token', 'payload': 'Nothing was found.'}, {'event': 'complete', 'payload': CAST(NULL AS VARCHAR)}] FROM t WHERE error IS NULL AND len(citations) = 0
    UNION ALL SELECT conv_id, turn, list_concat(list_transform(tokens, lambda x: {'event': 'token', 'payload': x}), CASE WHEN trim(array_to_string(tokens, '')) = '' AND text <> '' THEN [{'event': 'token', 'payload': text}] ELSE [] END,
      list_transform(citations, lambda x: {'event': 'citation', 'payload': x}), [{'event': 'complete', 'payload': CAST(NULL AS VARCHAR)}]) FROM t WHERE error IS NULL AND len(citations) > 0)
  SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS seq, ev[i].event AS event, coalesce(ev[i].payload, '') AS payload FROM e, LATERAL (SELECT unnest(range(1, len(ev) + 1)) AS i)""")
def stm4_answer_events(spark, base):
    """Answers as a client sees them: tokens, the whole text where a stream was blank, citations, the end; no context; errors."""
    c = table(spark, base, "conversations").where("role = 'assistant'")
    none = F.array().cast("array<string>")
    turns = c.select(
        "conv_id", "turn", F.col("text").alias("whole"), F.when(F.col("conv_id") % 4 == 0, none).otherwise(F.array(F.lit("cite-1"), F.lit("cite-2"))).alias("citations"),
        F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "model lost").alias("error"), F.when(F.col("conv_id") % 3 == 0, F.array(F.lit(""), F.lit(" "))).otherwise(F.split("text", " ")).alias("tokens"),
    )
    return N.answer_events(turns, ["conv_id", "turn"], "Nothing was found.").withColumn("payload", F.coalesce("payload", F.lit("")))
