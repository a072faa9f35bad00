"""Text, section and quality queries on ``documents``, ``pages`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.labels import substituted
from docloom.operators import sections as S
from docloom.plans.registry import register
from docloom.sources.images import placeholders
from docloom.sources.tables import table


def markdown(spark, base):
    """Each document as markdown: its lines become headings, cited text, table rows, bullets and figures in turn."""
    x_of = lambda x, i: (
        F.when(i % 6 == 0, F.concat(F.lit("## "), x, F.when(F.col("doc_id") % 3 == 0, "?").otherwise("")))
        .when(i % 6 == 1, F.concat(x, F.lit(" [Source: D, Page "), i.cast("string"), F.lit("]")))
        .when(i % 6 == 2, F.concat(F.lit("| Tag | "), x, F.lit(" |"))).when(i % 6 == 3, F.concat(F.lit("|---|---| "), x))
        .when(i % 6 == 4, F.concat(F.when(F.col("doc_id") % 2 == 0, "- ").otherwise(""), F.regexp_replace(x, "[-*] ", "")))
        .otherwise(F.concat(F.lit("!["), F.regexp_replace(x, r"[\]\[]", ""), F.lit("](img.png)")))
    )
    d = table(spark, base, "documents")
    return d.select("doc_id", F.concat(F.lit("Doc "), "doc_id").alias("title"), F.array_join(F.transform(F.split("text", "\n"), x_of), "\n").alias("markdown"))


_LINES = r"""lines AS (
  SELECT doc_id, i - 1 AS i, CASE (i - 1) % 6
      WHEN 0 THEN '## ' || x || CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END
      WHEN 1 THEN x || ' [Source: D, Page ' || (i - 1) || ']' WHEN 2 THEN '| Tag | ' || x || ' |' WHEN 3 THEN '|---|---| ' || x
      WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN '- ' ELSE '' END || regexp_replace(x, '[-*] ', '', 'g')
      ELSE '![' || regexp_replace(x, '[\]\[]', '', 'g') || '](img.png)' END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
marked AS (SELECT *, regexp_matches(line, '^##[ \t]+[^ \t\r\n]') AS head FROM lines),
numbered AS (SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS section_no FROM marked),
sections AS (
  SELECT doc_id, section_no, regexp_replace(max(line) FILTER (head), '^##+', '') AS raw_heading, min(i) + 1 AS start_line, max(i) + 1 AS end_line,
    string_agg(line, chr(10) ORDER BY i) FILTER (NOT head) AS raw FROM numbered WHERE section_no > 0 GROUP BY 1, 2),
secs AS (
  SELECT doc_id, section_no, regexp_replace(raw_heading, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS heading, coalesce(regexp_replace(raw, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '') AS content, start_line, end_line FROM sections)"""


@register("win8_str28_sections", f"WITH {_LINES} SELECT doc_id, section_no, heading, content, start_line, end_line, 'section_' || CASE WHEN section_no > 999 THEN CAST(section_no AS VARCHAR) ELSE lpad(CAST(section_no AS VARCHAR), 3, '0') END AS section_id FROM secs")
def win8_str28_sections(spark, base):
    out = S.sections(markdown(spark, base))
    no = F.col("section_no").cast("string")
    wide = F.when(F.length(no) > 3, F.concat(F.lit("section_"), no)).otherwise(F.col("section_id"))
    return out.select("doc_id", "section_no", "heading", "content", "start_line", "end_line", wide.alias("section_id"))


_METRICS = f"""{_LINES}, flags AS (
  SELECT doc_id, contains(content, '[Source:') OR contains(content, '(Page ') OR contains(lower(content), '[p.') AS c,
    suffix(lower(heading), '?') OR regexp_matches(lower(heading), 'what|why|how|when|where|which|who') AS q,
    contains(content, '|') AND contains(content, '---') AND NOT regexp_matches(lower(heading), 'contents|list of figures|list of tables')
      AND NOT regexp_matches(array_to_string(string_split(lower(content), chr(10))[1:5], chr(10)), 'contents|list of figures|list of tables') AS t, content,
    regexp_extract_all(content, '!\\[(.*?)\\]\\(.*?\\)', 1) AS figs, string_split(content, chr(10)) AS ls FROM secs),
sums AS (
  SELECT doc_id, count(*) AS n_sections, count(*) FILTER (c) AS c, count(*) FILTER (q) AS q, count(*) FILTER (t) AS t,
    count(*) FILTER (t AND len(list_filter(list_transform(ls, lambda x, i: contains(x, '|') AND (contains(array_to_string(ls[greatest(1, i - 5):i + 9], chr(10)), '- ') OR contains(array_to_string(ls[greatest(1, i - 5):i + 9], chr(10)), '* '))), lambda b: b)) > 0) AS f,
    sum(len(figs)) AS g, sum(len(list_filter(figs, lambda a: length(a) > 10 AND lower(a) <> 'image'))) AS d FROM flags GROUP BY 1),
mm AS (SELECT doc_id, toxic AS m FROM labels),
pct AS (
  SELECT doc_id, n_sections, c / n_sections * 100 AS citation_coverage, q / n_sections * 100 AS question_headings, CASE WHEN t > 0 THEN f / t * 100 ELSE 100.0 END AS table_facts_ratio,
    CASE WHEN g > 0 THEN d / g * 100 ELSE 100.0 END AS figure_coverage, least(1.0, coalesce(m, 0) / n_sections) AS hallucination_risk FROM sums LEFT JOIN mm USING (doc_id)),
metrics AS (
  SELECT *, greatest(0.0, least(100.0, citation_coverage * 0.30 + question_headings * 0.15 + table_facts_ratio * 0.25 + figure_coverage * 0.30 - least(10.0, hallucination_risk * 10))) AS confidence FROM pct)"""


def _metrics(spark, base):
    s = S.sections(markdown(spark, base)).withColumns({"has_tables": F.lit(False), "table_facts": F.lit(None).cast("array<string>")})
    mismatches = table(spark, base, "labels").groupBy("doc_id").agg(F.max("toxic").alias("semantic_mismatches"))
    return S.qa_metrics(s, "doc_id", mismatches)


_NAMES = ("citation_coverage", "question_headings", "table_facts_ratio", "figure_coverage", "hallucination_risk", "confidence")


@register("agg8_to_agg14_qa_metrics", f"WITH {_METRICS} SELECT doc_id, n_sections, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM metrics")
def agg8_to_agg14_qa_metrics(spark, base):
    return _metrics(spark, base).select("doc_id", "n_sections", *[F.round(n, 6).alias(n) for n in _NAMES])


@register("agg15_qa_gate", f"""WITH {_METRICS}, f AS (
    SELECT doc_id, list_filter([CASE WHEN citation_coverage < 90 THEN 'Citation coverage' END, CASE WHEN question_headings < 85 THEN 'Question headings' END, CASE WHEN table_facts_ratio < 95 THEN 'Table facts extraction' END,
      CASE WHEN confidence < 80 THEN 'Confidence score' END, CASE WHEN figure_coverage < 100 THEN 'Figure descriptions' END], lambda x: x IS NOT NULL) AS failed FROM metrics)
  SELECT doc_id, array_to_string(failed, ';') AS failed, CASE WHEN len(failed) = 0 THEN 'approved' WHEN len(failed) <= 2 THEN 'conditional_approval' ELSE 'rejected' END AS decision FROM f""")
def agg15_qa_gate(spark, base):
    return S.gate(_metrics(spark, base)).select("doc_id", F.array_join("failed", ";").alias("failed"), "decision")


_KINDS = "['image_loss', 'table_fidelity', 'semantic_mismatch', 'missing_content', 'formatting', 'other']"


@register("flt23_unresolved_issues", f"""WITH {_METRICS}, issues AS (SELECT doc_id, list_extract({_KINDS}, doc_id % 6 + 1) AS issue_type FROM documents)
  SELECT doc_id, issue_type FROM issues LEFT JOIN metrics USING (doc_id)
  WHERE NOT coalesce(CASE issue_type WHEN 'image_loss' THEN figure_coverage >= 100 WHEN 'table_fidelity' THEN table_facts_ratio >= 100 WHEN 'semantic_mismatch' THEN hallucination_risk <= 0
    WHEN 'missing_content' THEN citation_coverage >= 100 WHEN 'formatting' THEN question_headings >= 100 END, false)""")
def flt23_unresolved_issues(spark, base):
    kinds = F.array(*[F.lit(k) for k in ("image_loss", "table_fidelity", "semantic_mismatch", "missing_content", "formatting", "other")])
    issues = table(spark, base, "documents").select("doc_id", F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("issue_type"))
    return S.unresolved(issues, _metrics(spark, base), "doc_id")


@register("agg18_section_metadata", f"""WITH {_LINES}
  SELECT doc_id, count(*) AS n_sections, CAST(sum(len(regexp_extract_all(content, '[^ \\t\\n\\r\\f\\v]+'))) AS BIGINT) AS words, count(*) FILTER (contains(content, '|') AND contains(content, '---')) AS tables,
    count(*) FILTER (contains(content, '![')) AS images FROM secs GROUP BY 1""")
def agg18_section_metadata(spark, base):
    s = S.sections(markdown(spark, base))
    words = F.size(F.regexp_extract_all("content", F.lit(r"([^ \t\n\r\f\x0B]+)"), F.lit(1)))
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_sections"), F.sum(words).alias("words"), F.count_if(S.has_table(F.col("content"))).alias("tables"), F.count_if(F.col("content").contains("![")).alias("images")
    )


_GREEDY = """r AS (
    SELECT source || '/' || lang AS bundle, doc_id, text, row_number() OVER (PARTITION BY source || '/' || lang ORDER BY doc_id) AS i, greatest(1, coalesce(length(text), 0)) AS size, doc_id % 5 = 0 AS head FROM documents),
  f AS (
    SELECT bundle, CAST(0 AS BIGINT) AS i, 0 AS run, 0 AS n, CAST(0 AS BIGINT) AS chars FROM r GROUP BY 1
    UNION ALL
    SELECT bundle, i, CASE WHEN cut THEN run + 1 ELSE run END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN size ELSE chars + size END FROM (
      SELECT f.bundle, f.i + 1 AS i, run, n, chars, size, n = 0 OR n >= 4 OR chars + size > 18000 OR (head AND chars >= 6000) AS cut FROM f JOIN r ON r.bundle = f.bundle AND r.i = f.i + 1)),
  segments AS (SELECT r.bundle, r.doc_id, r.text, CAST(run AS INTEGER) AS segment FROM r JOIN f ON f.bundle = r.bundle AND f.i = r.i)"""


@register("win4_greedy_segments", f"WITH RECURSIVE {_GREEDY} SELECT bundle, doc_id, segment FROM segments")
def win4_greedy_segments(spark, base):
    """Pages of a source and language, in id order, packed greedily into segments: a fold over each one's ordered sizes."""
    d = table(spark, base, "documents").select("lang", "source", "doc_id", F.length("text").alias("size"), (F.col("doc_id") % 5 == 0).alias("head"))
    return S.greedy_segments(d.withColumn("bundle", F.concat_ws("/", "source", "lang")), "bundle", "doc_id", "size", "head")


@register("agg25_segment_rollup", f"""WITH RECURSIVE {_GREEDY}
  SELECT bundle, segment, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS pages, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS INTEGER) AS chars, substring(min_by(text, doc_id), 1, 30) AS title FROM segments GROUP BY 1, 2""")
def agg25_segment_rollup(spark, base):
    s = win4_greedy_segments(spark, base).join(table(spark, base, "documents").select("doc_id", "text"), "doc_id")
    g = s.groupBy("bundle", "segment").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("p"))
    return g.select("bundle", "segment", F.array_join(F.col("p.doc_id").cast("array<string>"), ",").alias("pages"), F.length(F.array_join("p.text", "\n\n")).alias("chars"), F.substring(F.get("p.text", F.lit(0)), 1, 30).alias("title"))


@register("str5_conversation_title", r"""
  WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM conversations)
  SELECT conv_id, turn, CASE WHEN t = '' THEN 'New Conversation' WHEN length(t) > 80 THEN regexp_replace(substring(t, 1, 77), ' +$', '') || '...' ELSE t END AS title FROM c""")
def str5_conversation_title(spark, base):
    return table(spark, base, "conversations").select("conv_id", "turn", T.conversation_title(F.col("text")).alias("title"))


@register("str6_str7_excerpts", """
  SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 497) || '...' ELSE text END AS excerpt, CASE WHEN length(text) > 120 THEN substring(text, 1, 119) || '…' ELSE text END AS preview FROM documents""")
def str6_str7_excerpts(spark, base):
    return table(spark, base, "documents").select("doc_id", T.truncate(F.col("text"), 500).alias("excerpt"), T.truncate(F.col("text"), 120, "…").alias("preview"))


@register("str8_strip_comments", "SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') AS html FROM pages")
def str8_strip_comments(spark, base):
    return table(spark, base, "pages").select("page_id", T.without_comments(F.col("html")).alias("html"))


@register("str9_arr1_page_numbers", r"""
  WITH t AS (SELECT doc_id, list_transform(regexp_extract_all('Page ' || (doc_id % 7) || ' page ' || (doc_id % 3) || ' PAGE  ' || (doc_id % 7) || text, '(?i)page\s+(\d{1,9})', 1), lambda s: CAST(s AS INTEGER)) AS p FROM documents)
  SELECT doc_id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS pages, p[1] AS first_page FROM t""")
def str9_arr1_page_numbers(spark, base):
    k = F.col("doc_id")
    t = F.concat(F.lit("Page "), k % 7, F.lit(" page "), k % 3, F.lit(" PAGE  "), k % 7, F.col("text"))
    p = T.page_numbers(t)
    return table(spark, base, "documents").select("doc_id", F.array_join(p.cast("array<string>"), ",").alias("pages"), F.get(p, F.lit(0)).alias("first_page"))


@register("str10_question_headings", r"""
  WITH h AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'Page 12' WHEN 2 THEN '## ' || string_split(text, chr(10))[1] || '?' ELSE string_split(text, chr(10))[1] END AS raw FROM documents),
  c AS (SELECT doc_id, regexp_replace(regexp_replace(raw, '[\s\p{Z}]+', ' ', 'g'), '^[ #:\-\t\n]+|[ #:\-\t\n]+$', '', 'g') AS t FROM h)
  SELECT doc_id, CASE WHEN t = '' AND doc_id > 0 THEN 'What is covered on page ' || doc_id || '?' WHEN t = '' THEN 'What should you know from this section?' WHEN suffix(t, '?') THEN t
    WHEN regexp_matches(t, '^(?i)page[\s]+\d+$') THEN 'What is covered on ' || lower(t) || '?' ELSE 'What does this section explain about ' || t || '?' END AS question FROM c""")
def str10_question_headings(spark, base):
    k, x = F.col("doc_id"), F.get(F.split("text", "\n"), F.lit(0))
    raw = F.when(k % 4 == 0, "").when(k % 4 == 1, "Page 12").when(k % 4 == 2, F.concat(F.lit("## "), x, F.lit("?"))).otherwise(x)
    return table(spark, base, "documents").select("doc_id", T.heading_question(raw, k).alias("question"))


@register("str13_match_form", r"""
  SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(replace(text, '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s\p{Z}|%-]', '', 'g')), '^[\s]+|[\s]+$', '', 'g') AS form FROM documents""")
def str13_match_form(spark, base):
    return table(spark, base, "documents").select("doc_id", T.match_form(F.col("text")).alias("form"))


@register("str14_anchor_candidates", r"""
  WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents),
  n AS (SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(replace(x, '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g'), '[^\p{L}\p{M}\p{N}_\s\p{Z}|%-]', '', 'g')), '^[\s]+|[\s]+$', '', 'g') AS f FROM l)
  SELECT doc_id, count(*) AS n FROM n WHERE length(f) >= 18 OR len(regexp_extract_all(f, '[^ ]+')) >= 3 GROUP BY 1""")
def str14_anchor_candidates(spark, base):
    d = table(spark, base, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("x"))
    f = T.match_form(F.col("x"))
    return d.where((F.length(f) >= 18) | (F.size(F.regexp_extract_all(f, F.lit("([^ ]+)"), F.lit(1))) >= 3)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@register("str15_table_figure_markers", f"""WITH {_LINES}
  SELECT doc_id, count(*) FILTER (length(line) - length(replace(line, '|', '')) >= 2) AS table_lines, count(*) FILTER (contains(line, '![')) AS figure_lines FROM lines GROUP BY 1""")
def str15_table_figure_markers(spark, base):
    m = markdown(spark, base).select("doc_id", F.explode(F.split("markdown", "\n")).alias("x"))
    pipes = F.length("x") - F.length(F.replace(F.col("x"), F.lit("|")))
    return m.groupBy("doc_id").agg(F.count_if(pipes >= 2).alias("table_lines"), F.count_if(F.col("x").contains("![")).alias("figure_lines"))


@register("str17_drop_midnight", """
  SELECT o_orderkey, 'due ' || strftime(o_orderdate, '%Y-%m-%d') || ' or later' AS line FROM orders""")
def str17_drop_midnight(spark, base):
    line = F.concat(F.lit("due "), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit(" or later"))
    return table(spark, base, "orders").select("o_orderkey", F.regexp_replace(line, r"\b(\d{4}-\d{2}-\d{2}) 00:00:00\b", "$1").alias("line"))


@register("str22_row_facts", """
  SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_returnflag <> 'N' THEN 'L' || l_linenumber || ': Flag = ' || l_returnflag END, 'L' || l_linenumber || ': Status = ' || l_linestatus], lambda x: x IS NOT NULL), ' ; ') AS facts FROM lineitem""")
def str22_row_facts(spark, base):
    """first: header = value for every value but -, N/A and blanks."""
    headers = F.array(F.lit("Flag"), F.lit("Status"))
    values = F.array(F.when(F.col("l_returnflag") == "N", "N/A").otherwise(F.col("l_returnflag")), F.col("l_linestatus"))
    first = F.concat(F.lit("L"), "l_linenumber")
    facts = F.zip_with(headers, values, lambda h, v: F.when(~F.upper(T.strip(v)).isin("", "-", "N/A"), F.concat(first, F.lit(": "), h, F.lit(" = "), v)))
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.array_compact(facts), " ; ").alias("facts"))


@register("str21_table_markdown", """
  SELECT l_orderkey, '| Line | Qty |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || l_linenumber || ' | ' || CAST(l_quantity AS INTEGER) || ' |', chr(10) ORDER BY l_linenumber, l_quantity, l_partkey) AS markdown FROM lineitem GROUP BY 1""")
def str21_table_markdown(spark, base):
    row = F.concat(F.lit("| "), F.col("r.l_linenumber"), F.lit(" | "), F.bround("r.l_quantity").cast("int"), F.lit(" |"))
    li = table(spark, base, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_quantity", "l_partkey").alias("r"))
    g = li.select("l_orderkey", "r", row.alias("t")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("r", "t"))).alias("x"))
    return g.select("l_orderkey", F.concat(F.lit("| Line | Qty |\n|---|---|\n"), F.array_join("x.t", "\n")).alias("markdown"))


@register("str27_embedded_images", """
  SELECT page_id, regexp_replace('![pic](data:image/png;base64,' || md5(url) || ') ' || url, '!\\[[^\\]]*\\]\\(data:image/[^)]*\\)', '[IMAGE]', 'g') AS x FROM pages""")
def str27_embedded_images(spark, base):
    x = F.concat(F.lit("![pic](data:image/png;base64,"), F.md5("url"), F.lit(") "), F.col("url"))
    return table(spark, base, "pages").select("page_id", placeholders(x).alias("x"))


@register("str31_query_redaction", r"""
  SELECT page_id, regexp_replace(url, '((?:^|[?&])(?:ref|token)=)[^&#]*', '\1[REDACTED]', 'g') AS url FROM pages""")
def str31_query_redaction(spark, base):
    return table(spark, base, "pages").select("page_id", F.regexp_replace("url", r"((?:^|[?&])(?:ref|token)=)[^&#]*", "$1[REDACTED]").alias("url"))


@register("str33_version_from_name", """
  SELECT p_partkey, CAST(nullif(regexp_extract('doc_v' || p_size || '.md', '_v(\\d+)\\.md$', 1), '') AS INTEGER) AS version, coalesce(CAST(nullif(regexp_extract(p_name, '_v(\\d+)\\.md$', 1), '') AS INTEGER), -1) AS none FROM part""")
def str33_version_from_name(spark, base):
    number = lambda x: F.nullif(F.regexp_extract(x, r"_v(\d+)\.md$", 1), F.lit("")).cast("int")
    return table(spark, base, "part").select("p_partkey", number(F.concat(F.lit("doc_v"), "p_size", F.lit(".md"))).alias("version"), F.coalesce(number(F.col("p_name")), F.lit(-1)).alias("none"))


@register("str20_id_substitution", """
  SELECT l_orderkey, l_linenumber, 'cause Customer and cause_1 of Line ' || l_linenumber AS text FROM lineitem""")
def str20_id_substitution(spark, base):
    """Ids replaced by labels, longest first, at word bounds."""
    labels = F.create_map(F.lit("id_1"), F.lit("Customer"), F.lit("id_12"), F.concat(F.lit("Line "), F.col("l_linenumber")))
    done = substituted(F.lit("cause id_1 and cause_1 of id_12"), labels)
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", done.alias("text"))


@register("mth5_sha256", "SELECT doc_id, sha256(text) AS hash FROM documents")
def mth5_sha256(spark, base):
    return table(spark, base, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@register("mth2_clamp_round", """
  SELECT event_id, CAST(greatest(0, least(100, floor(value))) AS INTEGER) AS percent, CAST(round(CAST(value AS DECIMAL(18,4)), 1) AS DOUBLE) AS half_up FROM events""")
def mth2_clamp_round(spark, base):
    clamp = F.greatest(F.lit(0), F.least(F.lit(100), F.floor("value"))).cast("int")
    return table(spark, base, "events").select("event_id", clamp.alias("percent"), F.round(F.col("value").cast("decimal(18,4)"), 1).cast("double").alias("half_up"))


@register("mth4_window_sizes", f"""WITH {_LINES}, n AS (SELECT doc_id, greatest(1.0, count(*) / greatest(1, doc_id % 5)) AS d FROM lines GROUP BY 1)
  SELECT doc_id, CAST(greatest(15, least(160, trunc(d * 1.5))) AS INTEGER) AS section_window, CAST(greatest(3, least(40, trunc(d * 0.4))) AS INTEGER) AS lookback FROM n""")
def mth4_window_sizes(spark, base):
    d = F.greatest(F.lit(1.0), F.size(F.split("markdown", "\n")) / F.greatest(F.lit(1), F.col("doc_id") % 5))
    clamp = lambda low, high, x: F.greatest(F.lit(low), F.least(F.lit(high), x.cast("int")))
    return markdown(spark, base).select("doc_id", clamp(15, 160, d * 1.5).alias("section_window"), clamp(3, 40, d * 0.4).alias("lookback"))


@register("jn8_range_join_sheets", f"""WITH {_LINES}
  SELECT l.doc_id, l.i + 1 AS line_no, coalesce(s.heading, f.heading) AS heading FROM lines l LEFT JOIN secs s ON l.doc_id = s.doc_id AND l.i + 1 BETWEEN s.start_line AND s.end_line
  LEFT JOIN secs f ON l.doc_id = f.doc_id AND f.section_no = 1""")
def jn8_range_join_sheets(spark, base):
    """Each line's section: the last heading at or before it, else the document's first."""
    m = markdown(spark, base).select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("i", "line"))
    head = F.when(F.col("line").rlike(S.HEADING), T.strip(F.regexp_replace("line", "^##+", "")))
    w = W.partitionBy("doc_id").orderBy("i")
    before = F.last(head, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    first = F.first(head, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return m.withColumn("heading", F.coalesce(before, first)).select("doc_id", (F.col("i") + 1).alias("line_no"), "heading")


@register("win12_adjacent_duplicates", """
  WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag AS v, lag(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS prev, l_partkey FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v = prev AND v NOT IN ('X', 'P', '-') THEN '' ELSE v END AS cell FROM c""")
def win12_adjacent_duplicates(spark, base):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    v = T.strip(F.col("l_returnflag"))
    noise = ~v.isin("X", "P", "-") & ~v.rlike(r"^\d+(\.\d+)?$") & (v != "")
    cell = F.when((v == F.lag(v).over(w)) & noise, "").otherwise(v)
    return table(spark, base, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", cell.alias("cell"))


@register("jn11_set7_token_overlap", """
  WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS t FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS t FROM documents)
  SELECT item_id, doc_id, count(*) AS shared FROM b JOIN d USING (t) GROUP BY 1, 2 HAVING count(*) >= 30""")
def jn11_set7_token_overlap(spark, base):
    """Sections and pages that share at least 30 tokens."""
    own = lambda df, key: df.select(key, F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]{3,})"), F.lit(1))).alias("tokens"))
    return S.sharing(own(table(spark, base, "benchmark"), "item_id"), own(table(spark, base, "documents"), "doc_id"), "item_id", "doc_id", "tokens", 30)


@register("flt25_internal_lines", """
  WITH l AS (SELECT doc_id, i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE NOT contains(lower(x), 'ation'))
  SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS text FROM l GROUP BY 1""")
def flt25_internal_lines(spark, base):
    """Lines that match an internal marker are dropped; documents without a line left go too."""
    kept = F.filter(F.split("text", "\n"), lambda x: ~F.lower(x).contains("ation"))
    return table(spark, base, "documents").where(F.size(kept) > 0).select("doc_id", F.array_join(kept, "\n").alias("text"))


@register("agg19_agg20_dom6_page_validation", f"""WITH {_LINES}, p AS (
    SELECT doc_id, doc_id % 3 AS table_count, doc_id % 4 AS image_count, count(*) FILTER (length(line) - length(replace(line, '|', '')) >= 2) AS t, CAST(sum(length(line) - length(replace(line, '![', ''))) / 2 AS BIGINT) AS g FROM lines GROUP BY 1),
  q AS (SELECT doc_id, CAST(table_count > 0 AND t < 2 * table_count AS INTEGER) + CAST(image_count > 0 AND g < image_count AS INTEGER) AS n, image_count > 0 AND g < image_count AS critical FROM p)
  SELECT doc_id % 10 AS bucket, round(avg(greatest(0.0, 1 - 0.15 * n)), 6) AS confidence, CAST(sum(n) AS BIGINT) AS issues, count(*) FILTER (critical) AS critical FROM q GROUP BY 1""")
def agg19_agg20_dom6_page_validation(spark, base):
    k = F.col("doc_id")
    v = S.page_issues(markdown(spark, base).withColumns({"table_count": k % 3, "image_count": k % 4}))
    critical = F.exists("issues", lambda i: i["severity"] == "critical")
    return v.groupBy((k % 10).alias("bucket")).agg(F.round(F.avg("confidence_score"), 6).alias("confidence"), F.sum(F.size("issues")).alias("issues"), F.count_if(critical).alias("critical"))
