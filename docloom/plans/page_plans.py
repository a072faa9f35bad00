"""Queries on pages of documents: alignment of previews with markdown, parts of a conversion, embedded images, table rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docloom.functions.labels import substituted
from docloom.operators import alignment as A
from docloom.operators import figures as G
from docloom.operators import matrix as M
from docloom.plans.registry import register
from docloom.sources import artifacts as R
from docloom.sources import images as I
from docloom.sources.shared import shared_folder
from docloom.sources.tables import table


def markdown_lines(spark, base):
    return table(spark, base, "documents").select("doc_id", F.col("text").alias("markdown"))


def previews(spark, base):
    """One to four pages a document. A page's preview are two lines of its part cut at 60 characters and both joined;
    every fifth document's pages come in reverse order, so that anchors lie behind the floor."""
    ls, p = F.split("text", "\n"), (1 + F.col("doc_id") % 4).cast("int")
    pages = table(spark, base, "documents").where("text is not null").select("doc_id", ls.alias("ls"), p.alias("p"), F.explode(F.sequence(F.lit(1), p)).alias("page_number"))
    q = F.when(F.col("doc_id") % 5 == 0, F.col("p") - F.col("page_number")).otherwise(F.col("page_number") - 1)
    at = F.floor(q * F.size("ls") / F.col("p")).cast("int")
    line = lambda k: F.coalesce(F.get("ls", at + k), F.lit(""))
    cut = lambda k: F.substring(line(k), 1, 60)
    return pages.select("doc_id", "page_number", F.concat_ws("\n", cut(0), cut(1), F.concat(line(0), F.lit(" "), line(1))).alias("text_preview"))


_FORM = r"regexp_replace(lower(regexp_replace(regexp_replace(replace({0}, '&amp;', '&'), '[\s\p{{Z}}]+', ' ', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}_\s\p{{Z}}|%-]', '', 'g')), '^[\s]+|[\s]+$', '', 'g')"
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_SCORES = f"""src AS (SELECT doc_id, string_split(text, chr(10)) AS ls, CAST(1 + doc_id % 4 AS INTEGER) AS p FROM documents WHERE text IS NOT NULL),
  pages AS (SELECT doc_id, ls, p, k AS page_number, ((CASE WHEN doc_id % 5 = 0 THEN p - k ELSE k - 1 END) * len(ls)) // p AS pos FROM src, range(1, 5) t(k) WHERE k <= p),
  preview AS (SELECT doc_id, page_number, unnest([substring(coalesce(ls[pos + 1], ''), 1, 60), substring(coalesce(ls[pos + 2], ''), 1, 60), coalesce(ls[pos + 1], '') || ' ' || coalesce(ls[pos + 2], '')]) AS x FROM pages),
  anchors AS (SELECT doc_id, page_number, a FROM (SELECT doc_id, page_number, {_FORM.format('x')} AS a FROM preview) WHERE length(a) >= 18 OR len(string_split(a, ' ')) >= 3),
  lines AS (SELECT doc_id, i - 1 AS i, {_FORM.format('ls[i]')} AS x FROM src, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
  scores AS MATERIALIZED (SELECT doc_id, page_number, i, count(*) AS s FROM lines JOIN anchors USING (doc_id) WHERE x <> '' AND (contains(x, a) OR contains(a, x)) GROUP BY 1, 2, 3)"""


@register("jn20_anchor_scores", f"WITH {_SCORES} SELECT doc_id, CAST(page_number AS INTEGER) AS page_number, CAST(i AS INTEGER) AS line, CAST(s AS INTEGER) AS score FROM scores")
def jn20_anchor_scores(spark, base):
    """For every line of a document, how many anchors of each page it holds or is held in."""
    return A.anchor_scores(markdown_lines(spark, base), previews(spark, base))


_PAGES = f"""{_SCORES},
  sized AS (SELECT doc_id, len(ls) AS n, p, greatest(1.0, len(ls) / p) AS per, ls FROM src),
  par AS MATERIALIZED (SELECT *, greatest(8, least(longest, CAST(floor(per * 0.45) AS BIGINT))) AS least_lines FROM (
    SELECT *, greatest(40, least(n, CAST(floor(per * 2.2) AS BIGINT))) AS radius, greatest(3, least(24, CAST(floor(per * 0.25) AS BIGINT))) AS back,
      greatest(20, least(greatest(15, least(160, CAST(floor(per * 1.5) AS BIGINT))), CAST(floor(per * 2.0) AS BIGINT))) AS longest FROM sized)),
  walk AS (
    SELECT doc_id, 0 AS k, CAST(-1 AS BIGINT) AS pos FROM par
    UNION ALL
    SELECT doc_id, k + 1, CASE WHEN k > 0 AND found <= pos THEN least(n - 1, pos + 1) ELSE found END FROM (
      SELECT c.doc_id, c.k, c.pos, c.n, least(greatest(c.low, coalesce(arg_min(s.i, -s.s * 1000000000000 + abs(s.i - c.centre) * 1000000 + s.i), c.centre)), c.n - 1) AS found
      FROM (SELECT *, greatest(low, least(CAST(floor((k + 0.5) * n / p) AS BIGINT), n - 1)) AS centre FROM (
          SELECT w.doc_id, w.k, w.pos, n, p, radius, CASE WHEN w.k = 0 THEN 0 ELSE least(n - 1, w.pos + 1) END AS low FROM walk w JOIN par USING (doc_id) WHERE w.k < p)) c
        LEFT JOIN scores s ON s.doc_id = c.doc_id AND s.page_number = c.k + 1 AND s.i >= greatest(c.low, c.centre - c.radius) AND s.i < least(c.n, greatest(c.low + 1, c.centre + c.radius))
      GROUP BY c.doc_id, c.k, c.pos, c.n, c.low, c.centre)),
  starts AS (SELECT doc_id, k, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY k) AS after FROM walk WHERE k > 0),
  spans AS MATERIALIZED (
    SELECT doc_id, k, pos AS a, CASE WHEN after IS NULL THEN n ELSE least(CASE WHEN after > pos THEN after ELSE least(n, pos + least_lines) END, pos + longest) END AS z, n, p, back, ls
    FROM starts JOIN par USING (doc_id))"""


@register("win6_win7_dom5_page_alignment", f"WITH RECURSIVE {_PAGES} SELECT doc_id, CAST(k AS INTEGER) AS page_number, CAST(a AS INTEGER) AS start_line, CAST(z AS INTEGER) AS end_line FROM spans")
def win6_win7_dom5_page_alignment(spark, base):
    """Each document's text cut in pages by previews: the line that most anchors match, never above the page before."""
    return A.page_spans(markdown_lines(spark, base), previews(spark, base))


_CUT = lambda a, z: _TRIM.format(f"coalesce(array_to_string(ls[{a} + 1:{z}], chr(10)), '')")


@register("dom5_page_sections", f"""WITH RECURSIVE {_PAGES},
  cut AS MATERIALIZED (
    SELECT doc_id, k, {_CUT('a', 'z')} AS own, {_CUT('greatest(0, a - back)', 'z')} AS more, {_CUT('share', 'share + size')} AS share FROM (
      SELECT *, greatest(0, least((k - 1) * size, greatest(0, n - size))) AS share FROM (SELECT *, greatest(40, n // p) AS size FROM spans))),
  picked AS MATERIALIZED (SELECT doc_id, k, CASE WHEN own <> '' THEN own WHEN more <> '' THEN more ELSE share END AS own, share FROM cut),
  fin AS (
    SELECT doc_id, k, own AS section, [own] AS seen FROM picked WHERE k = 1
    UNION ALL
    SELECT doc_id, k, section, list_append(seen, section) FROM (
      SELECT p.doc_id, p.k, f.seen, CASE WHEN list_contains(f.seen, p.own) AND p.share <> '' THEN p.share ELSE p.own END AS section FROM fin f JOIN picked p ON p.doc_id = f.doc_id AND p.k = f.k + 1))
  SELECT doc_id, CAST(k AS INTEGER) AS page_number, sha256(section) AS section_sha256, CAST(length(section) AS INTEGER) AS n_chars FROM fin""")
def dom5_page_sections(spark, base):
    """The markdown of each page, without a section that an earlier page has."""
    out = A.page_sections(markdown_lines(spark, base), previews(spark, base))
    return out.select("doc_id", "page_number", F.sha2("section", 256).alias("section_sha256"), F.length("section").alias("n_chars"))


def _broken_rows(spark, base):
    """Every line of a document as a row of a table, in six ways: whole, cut in two or three lines, never closed, a separator, plain."""
    x_of = lambda x, i: (
        F.when(i % 6 == 0, F.concat(F.lit("| a | "), x, F.lit(" |"))).when(i % 6 == 1, F.concat(F.lit(" | c | "), x))
        .when(i % 6 == 2, F.concat(x, F.lit(" | e |"))).when(i % 6 == 3, F.when(F.col("doc_id") % 3 == 0, F.lit("|---|:-:|")).otherwise(F.concat(F.lit("| open | "), x)))
        .when(i % 6 == 4, F.when(F.col("doc_id") % 2 == 0, F.lit("")).otherwise(x)).otherwise(F.concat(F.lit("end | "), F.lit(" | ")))
    )
    return table(spark, base, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), x_of), "\n").alias("markdown"))


_STRIP = _TRIM.format("line")


@register("str18_stitched_rows", f"""
  WITH l AS (
    SELECT doc_id, i AS line_no, {_STRIP} AS x FROM (
      SELECT doc_id, i, CASE (i - 1) % 6 WHEN 0 THEN '| a | ' || x || ' |' WHEN 1 THEN ' | c | ' || x WHEN 2 THEN x || ' | e |'
          WHEN 3 THEN CASE WHEN doc_id % 3 = 0 THEN '|---|:-:|' ELSE '| open | ' || x END WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE x END ELSE 'end |  | ' END AS line
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))),
  f AS (SELECT *, suffix(x, '|') AS closes, starts_with(x, '|') AND NOT suffix(x, '|') AND length(x) - length(replace(x, '|', '')) >= 2 AS opens FROM l),
  g AS (SELECT *, coalesce(sum(CAST(closes AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM f),
  h AS (SELECT *, min(line_no) FILTER (opens) OVER (PARTITION BY doc_id, seg) AS first FROM g),
  r AS (SELECT doc_id, CASE WHEN line_no >= first THEN first ELSE line_no END AS start, string_agg(x, ' ' ORDER BY line_no) AS row_text, count(*) AS n_lines FROM h WHERE x <> '' GROUP BY 1, 2)
  SELECT doc_id, CAST(start AS INTEGER) AS line_no, n_lines, array_to_string(list_transform(string_split(substring(row_text, 2, length(row_text) - 2), '|'), lambda c: {_TRIM.format('c')}), ';') AS cells
  FROM r WHERE starts_with(row_text, '|') AND suffix(row_text, '|') AND length(row_text) > 1
    AND NOT len(list_filter(string_split(substring(row_text, 2, length(row_text) - 2), '|'), lambda c: NOT regexp_matches({_TRIM.format('c')}, '^[:\\-\\s]+$'))) = 0""")
def str18_stitched_rows(spark, base):
    """Table rows that run over several lines, joined by a two-state scan."""
    return M.stitched_rows(_broken_rows(spark, base), "doc_id", "markdown").select("doc_id", "line_no", "n_lines", F.array_join("cells", ";").alias("cells"))


def _payloads(spark, base):
    """Documents converted in ranges of eight lines, two lines a page; the second range of every 37th document fails."""
    lines = F.split("text", "\n")
    d = table(spark, base, "documents").where("text is not null").select("doc_id", lines.alias("ls"))
    r = d.select("doc_id", "ls", F.explode(F.sequence(F.lit(0), F.floor((F.size("ls") - 1) / 8).cast("int"))).alias("range_no")).select("doc_id", "range_no", F.slice("ls", F.col("range_no") * 8 + 1, F.lit(8)).alias("ls"))
    failed = (F.col("doc_id") % 37 == 0) & (F.col("range_no") == 1)
    errors = F.when(F.col("range_no") % 2 == 1, F.array(F.lit("low contrast"))).otherwise(F.array().cast("array<string>"))
    return r.select(
        "doc_id", "range_no", F.when(failed, "failure").otherwise("success").alias("status"), (F.size("ls") * F.lit(0.5)).alias("processing_time"), F.ceil(F.size("ls") / 2).cast("int").alias("n_pages"),
        F.array_join("ls", "\n").alias("markdown"), F.transform("ls", lambda x, i: F.struct((F.floor(i / 2) + 1).cast("int").alias("page"), x.alias("text"))).alias("elements"), errors.alias("errors"),
    )


_RANGES = f"""r AS (
    SELECT doc_id, range_no, ls[range_no * 8 + 1:range_no * 8 + 8] AS ls FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(0, (len(string_split(text, chr(10))) - 1) // 8 + 1)) AS range_no FROM documents WHERE text IS NOT NULL)),
  p AS (SELECT *, {_TRIM.format('array_to_string(ls, chr(10))')} AS body, (len(ls) + 1) // 2 AS pages FROM r),
  bad AS (SELECT doc_id, bool_or((doc_id % 37 = 0 AND range_no = 1) OR body = '') AS bad FROM p GROUP BY 1),
  o AS (SELECT *, CASE WHEN body = '' THEN 0 ELSE length(body) + 2 END AS chars FROM p),
  w AS (SELECT *, coalesce(sum(pages) OVER b, 0) AS pages_before, coalesce(sum(len(ls)) OVER b, 0) AS items_before, coalesce(sum(chars) OVER b, 0) AS chars_before
    FROM o WINDOW b AS (PARTITION BY doc_id ORDER BY range_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("src9_merged_elements", f"""WITH {_RANGES}
  SELECT doc_id, CAST(items_before + j AS BIGINT) AS element, CAST(pages_before + (j + 1) // 2 AS BIGINT) AS page, sha256(ls[j]) AS text_sha256
  FROM w JOIN bad USING (doc_id), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS j) WHERE NOT bad""")
def src9_merged_elements(spark, base):
    """The items of all ranges of a document, pages and items numbered through."""
    elements = R.merged_ranges(_payloads(spark, base), "doc_id", "range_no")[1]
    return elements.select("doc_id", F.col("element").cast("long").alias("element"), F.col("page").cast("long").alias("page"), F.sha2("text", 256).alias("text_sha256"))


@register("src9_merged_parts", f"""WITH {_RANGES}
  SELECT doc_id, 'success' AS status, CAST(pages_before + 1 AS BIGINT) AS first_page, CAST(pages_before + pages AS BIGINT) AS last_page, CAST(chars_before AS BIGINT) AS at_char, sha256(body) AS text_sha256, CAST(0 AS BIGINT) AS n_errors FROM w JOIN bad USING (doc_id) WHERE NOT bad
  UNION ALL
  SELECT doc_id, CASE WHEN any_value(bad) THEN 'failed' ELSE 'success' END, 1, CAST(sum(pages) AS BIGINT), CAST(greatest(0, sum(chars) - 2) AS BIGINT), '', CAST(count(*) FILTER (range_no % 2 = 1) AS BIGINT) FROM w JOIN bad USING (doc_id) GROUP BY 1""")
def src9_merged_parts(spark, base):
    """The parts of the merged markdown with their offsets, and each document's summary."""
    parts, _, summary = R.merged_ranges(_payloads(spark, base), "doc_id", "range_no")
    long = lambda c, name: F.col(c).cast("long").alias(name)
    a = parts.select("doc_id", F.lit("success").alias("status"), long("first_page", "first_page"), long("last_page", "last_page"), long("offset", "at_char"), F.sha2("text", 256).alias("text_sha256"), F.lit(0).cast("long").alias("n_errors"))
    b = summary.select("doc_id", "status", F.lit(1).cast("long").alias("first_page"), long("n_pages", "last_page"), long("n_chars", "at_char"), F.lit("").alias("text_sha256"), long("n_errors", "n_errors"))
    return a.unionByName(b)


@register("str20_label_substitution", r"""
  WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '^[a-eA-E][\p{L}\p{N}_]{4,}$') THEN '$5 \b(' || x || '\1' ELSE x END), '') AS text FROM w""")
def str20_label_substitution(spark, base):
    """Each document with its own map of hundreds of ids: all its words of five or more letters from a to e; labels full of pattern signs."""
    ids = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike(r"^[a-eA-E][\p{L}\p{N}_]{4,}$")))
    labels = F.map_from_arrays(ids, F.transform(ids, lambda w: F.concat(F.lit("$5 \\b("), w, F.lit("\\1"))))
    return table(spark, base, "documents").where("text is not null").select("doc_id", substituted(F.col("text"), labels).alias("text"))


def _with_images(spark, base):
    """Documents in whose text every third line is followed by an image of its bytes; those of every seventh document are broken."""
    plain = lambda b: F.replace(F.base64(b), F.lit("\r\n"), F.lit(""))  # noqa: E731  (Spark breaks the line after 76 characters, a data URI has none)
    data = lambda x: F.concat(plain(x.cast("binary")), F.when(F.col("doc_id") % 7 == 0, "!").otherwise(""))
    kind = lambda i: F.when(i % 2 == 0, "png").otherwise("jpeg")
    x_of = lambda x, i: F.when(i % 3 == 0, F.concat(x, F.lit("![a "), i.cast("string"), F.lit("](data:image/"), kind(i), F.lit(";base64,"), data(F.substring(x, 1, 45)), F.lit(") end"))).otherwise(x)
    return table(spark, base, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), x_of), "\n").alias("markdown"))


_IMAGES = """l AS (SELECT doc_id, i - 1 AS i, x, base64(encode(substring(x, 1, 45))) AS b, CASE (i - 1) % 2 WHEN 0 THEN 'png' ELSE 'jpeg' END AS kind
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL))"""


@register("str27_extracted_images", f"""WITH {_IMAGES}
  SELECT doc_id, CAST(i // 3 + 1 AS INTEGER) AS image, 'image_' || (i // 3 + 1) || '.' || kind AS name, 'a ' || i AS alt, kind AS format, sha256(encode(substring(x, 1, 45))) AS sha256, CAST(strlen(substring(x, 1, 45)) AS INTEGER) AS n_bytes
  FROM l WHERE i % 3 = 0 AND doc_id % 7 <> 0""")
def str27_extracted_images(spark, base):
    """The images that documents embed, numbered in their text, with the digests under which they are stored."""
    return I.extracted(_with_images(spark, base), "markdown")[1].drop("bytes")


@register("str27_image_links", f"""WITH {_IMAGES}
  SELECT doc_id, sha256(string_agg(CASE WHEN i % 3 <> 0 THEN x WHEN doc_id % 7 = 0 THEN x || '![a ' || i || '](data:image/' || kind || ';base64,' || b || '!) end' ELSE x || '![a ' || i || '](image_' || (i // 3 + 1) || '.' || kind || ') end' END, chr(10) ORDER BY i)) AS text_sha256 FROM l GROUP BY 1""")
def str27_image_links(spark, base):
    """The markdown with links to files; links that cannot be decoded stay."""
    return I.extracted(_with_images(spark, base), "markdown")[0].select("doc_id", F.sha2("markdown", 256).alias("text_sha256"))


@register("str27_stored_images", f"""WITH {_IMAGES}
  SELECT sha256(encode(substring(x, 1, 45))) AS sha256, min(kind) AS format, CAST(strlen(any_value(substring(x, 1, 45))) AS INTEGER) AS n_bytes FROM l WHERE i % 3 = 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 0 GROUP BY 1
  UNION ALL
  SELECT sha256(encode(substring(x, 1, 45))), min(kind), CAST(strlen(any_value(substring(x, 1, 45))) AS INTEGER) FROM l WHERE i % 3 = 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 1
    AND substring(x, 1, 45) NOT IN (SELECT substring(x, 1, 45) FROM l WHERE i % 3 = 0 AND doc_id % 7 <> 0 AND doc_id % 2 = 0) GROUP BY 1""")
def str27_stored_images(spark, base):
    """A content-addressed store after two runs, of documents with even and with odd ids: each image is there once."""
    folder = f"{shared_folder(spark)}/images_{uuid.uuid4().hex}"
    docs = _with_images(spark, base)
    for half in (0, 1):
        I.store(I.extracted(docs.where(F.col("doc_id") % 2 == half), "markdown")[1], folder)
    return I.stored(spark, folder).select("sha256", "format", F.octet_length("bytes").alias("n_bytes"))


def _with_figures(spark, base):
    """Every line of a document in turn a linked image, a described figure with wide gaps, and plain."""
    clean = lambda x: F.regexp_replace(x, r"[\[\]()*]", "")
    x_of = lambda x, i: F.when(i % 3 == 0, F.concat(F.lit("!["), clean(x), F.lit("](f"), i.cast("string"), F.lit(".png)"))).when(i % 3 == 1, F.concat(F.lit("**[Figure "), i.cast("string"), F.lit(":  "), F.replace(clean(x), F.lit(" "), F.lit("  ")), F.lit("]**"))).otherwise(x)
    return table(spark, base, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), x_of), "\n").alias("markdown"))


@register("set4_extracted_figures", r"""
  WITH l AS (SELECT doc_id, i - 1 AS i, regexp_replace(x, '[\[\]()*]', '', 'g') AS c FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
  u AS (SELECT doc_id, i, 0 AS k, 'linked' AS kind, '' AS caption, c AS description, 'f' || i || '.png' AS path FROM l WHERE i % 3 = 0
    UNION ALL SELECT doc_id, i, 1, 'described', 'Figure ' || i, regexp_replace(regexp_replace(c, '[\s\p{Z}]+', ' ', 'g'), '^ | $', '', 'g'), '' FROM l WHERE i % 3 = 1)
  SELECT doc_id, printf('figure_%03d', row_number() OVER (PARTITION BY doc_id ORDER BY k, i)) AS figure_id, kind, caption, description, path FROM u""")
def set4_extracted_figures(spark, base):
    """Linked images and described figures of each document under running numbers."""
    out = G.figures(_with_figures(spark, base), "doc_id", "markdown")
    return out.select("doc_id", "figure_id", "kind", *[F.coalesce(c, F.lit("")).alias(c) for c in ("caption", "description", "path")])


@register("str32_inserted_descriptions", """
  WITH l AS (SELECT doc_id, i - 1 AS i, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)),
  m AS (SELECT doc_id, string_agg(CASE WHEN i % 4 = 0 AND doc_id % 3 <> 0 THEN '<!-- Page ' || (i // 4 + 1) || ' -->' || chr(10) || x ELSE x END, chr(10) ORDER BY i) AS md, max(i) // 4 + 1 AS last, count(*) AS n FROM l GROUP BY 1),
  s AS (SELECT doc_id, x, chr(10) || chr(10) || '### Visual Elements' || chr(10) || chr(10) || '**Figure on page 1**' || chr(10) || chr(10) || '$1 ' || x || chr(10) || chr(10) || '**T**' || chr(10) || chr(10) || chr(10) || chr(10) AS sec FROM l WHERE i = 0)
  SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN md || chr(10) || chr(10) || '## Additional Visual Elements (Page 1)' || chr(10) || sec
    WHEN last > 1 THEN substring(md, 1, instr(md, '<!-- Page 2 -->') - 1) || sec || chr(10) || substring(md, instr(md, '<!-- Page 2 -->'))
    ELSE '<!-- Page 1 -->' || sec || substring(md, 16) END) AS text_sha256 FROM m JOIN s USING (doc_id)""")
def str32_inserted_descriptions(spark, base):
    """Two descriptions of the first page: before the second page's marker, behind the only one, or at the end where there is none."""
    x_of = lambda x, i: F.when((i % 4 == 0) & (F.col("doc_id") % 3 != 0), F.concat(F.lit("<!-- Page "), (F.floor(i / 4) + 1).cast("string"), F.lit(" -->\n"), x)).otherwise(x)
    d = table(spark, base, "documents").where("text is not null")
    docs = d.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), x_of), "\n").alias("markdown"))
    own = F.array(F.struct(F.lit(1).alias("place"), F.lit(None).cast("string").alias("title"), F.concat(F.lit("$1 "), F.get(F.split("text", "\n"), F.lit(0))).alias("description")), F.struct(F.lit(2).alias("place"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("description")))
    told = d.select("doc_id", F.lit(1).alias("page"), F.explode(own).alias("e")).select("doc_id", "page", "e.*")
    return G.with_descriptions(docs, told, "doc_id", "markdown").select("doc_id", F.sha2("markdown", 256).alias("text_sha256"))


@register("jsn5_review_fields", """
  SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 = 1 THEN json_extract_string(props, '$.k') WHEN event_id % 4 = 2 THEN 'u' || user_id ELSE '' END AS device FROM events""")
def jsn5_review_fields(spark, base):
    """A device by the required fields, then by two fields of the payload; blank ones are passed over."""
    e, m = table(spark, base, "events"), F.col("event_id") % 4
    text = lambda x: F.concat(F.lit(' "'), x, F.lit(' "'))
    raw = (
        F.when(m == 0, F.concat(F.lit('{"required_fields": {"device": " ", "tag":'), text(F.col("event_type")), F.lit('}, "device": "no"}')))
        .when(m == 1, F.concat(F.lit('{"required_fields": {"device": null}, "device": '), F.get_json_object("props", "$.k"), F.lit("}")))
        .when(m == 2, F.concat(F.lit('{"required_fields": [], "name":'), text(F.concat(F.lit("u"), "user_id")), F.lit("}"))).otherwise(F.lit('{"x": 1}'))
    )
    return e.select("event_id", G.review_field(raw, ["device", "tag"], ["device", "name"]).alias("device"))


@register("dt2_current_artifacts", """
  WITH t AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS d, CASE o_custkey % 5 WHEN 0 THEN NULL ELSE TIMESTAMP '1995-01-01' + INTERVAL 1 DAY * (o_custkey % 700) END AS started FROM orders),
  c AS (SELECT *, CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN d WHEN 2 THEN d - INTERVAL 2 HOUR WHEN 3 THEN d WHEN 4 THEN d + INTERVAL 90 MINUTE WHEN 5 THEN NULL ELSE d END AS completed FROM t)
  SELECT o_orderkey, started IS NULL OR coalesce(completed >= started, false) AS current FROM c""")
def dt2_current_artifacts(spark, base):
    """Artifacts of the run that is going on, by ISO times with and without offsets, dates, and texts that are none."""
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate").cast("timestamp")
    iso = lambda t, tail="": F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(tail))
    raw = (
        F.when(k == 0, "not a date").when(k == 1, iso(d)).when(k == 2, iso(d, "+02:00")).when(k == 3, F.date_format(d, "yyyy-MM-dd")).when(k == 4, F.replace(iso(d + F.expr("INTERVAL 90 MINUTES"), ".000Z"), F.lit("T"), F.lit(" "))).when(k == 5, "2024-13-45T00:00:00")
        .otherwise(iso(d, "Z"))
    )
    started = F.when(F.col("o_custkey") % 5 != 0, F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval((F.col("o_custkey") % 700).cast("int")))
    return table(spark, base, "orders").select("o_orderkey", G.of_current_run(G.iso_time(raw), started).alias("current"))
