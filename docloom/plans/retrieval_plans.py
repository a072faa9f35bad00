"""Retrieval and governance queries on ``documents`` joined with ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.functions.ids import uuid5
from docloom.functions.vectors import cosine
from docloom.operators import governance as G
from docloom.operators import retrieval as R
from docloom.plans.registry import register
from docloom.sources.tables import table

#: The query set: every vector whose id this divides; some have scopes.
QUERY_STEP = 20
WORDS = "the and of de la der"
K, THRESHOLD = 5, 0.2


def chunks(spark: SparkSession, base: str) -> DataFrame:
    """Chunks: a document with the vector of its id, and a payload derived from its columns."""
    docs, vectors = table(spark, base, "documents"), table(spark, base, "embeddings")
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select(
        F.col("doc_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("doc-"), F.col("doc_id")).alias("document_id"),
        F.concat(F.lit("Title "), F.col("doc_id")).alias("document_title"),
        F.col("text").alias("content"),
        F.col("embedding").alias("vector"),
        F.upper("source").alias("system"),
        F.lower("source").alias("workspace"),
        F.col("lang").alias("document_type"),
        (F.col("doc_id") % 7 == 0).alias("is_shared"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("section_heading"),
        (F.col("doc_id") % 50 + 1).cast("int").alias("page_number"),
    )


def query_set(spark: SparkSession, base: str) -> DataFrame:
    """All queries: the ids that QUERY_STEP divides."""
    vectors = table(spark, base, "embeddings").where(F.col("vec_id") % QUERY_STEP == 0)
    none = F.lit(None).cast("array<string>")
    return vectors.select(
        F.col("vec_id").alias("query_id"),
        F.lit(WORDS).alias("q_text"),
        F.col("embedding").alias("q_vector"),
        F.when(F.col("vec_id") == 100, F.array(F.lit("src0"), F.lit("src1"), F.lit("src2"))).otherwise(none).alias("q_systems"),
        F.when(F.col("vec_id").isin(200, 300, 400), F.concat(F.lit("src"), (F.col("vec_id") / 100).cast("int").cast("string"))).alias("q_workspace"),
        (F.col("vec_id") == 300).alias("q_shared"),
    )


_CTE = f"""
chunks AS (
  SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'doc-' || doc_id AS document_id, 'Title ' || doc_id AS document_title, text AS content,
         embedding AS vector, upper(source) AS system, lower(source) AS workspace, lang AS document_type, doc_id % 7 = 0 AS is_shared,
         string_split(text, chr(10))[1] AS section_heading, doc_id % 50 + 1 AS page_number
  FROM documents JOIN embeddings ON doc_id = vec_id),
queries AS (
  SELECT vec_id AS query_id, embedding AS q_vector,
         CASE WHEN vec_id = 100 THEN ['src0', 'src1', 'src2'] END AS q_systems,
         CASE WHEN vec_id IN (200, 300, 400) THEN 'src' || (vec_id // 100) END AS q_workspace, vec_id = 300 AS q_shared
  FROM embeddings WHERE vec_id % {QUERY_STEP} = 0),
scored AS (
  SELECT c.*, q.query_id, q.q_workspace, q.q_shared,
         list_cosine_similarity(c.vector::DOUBLE[], q.q_vector::DOUBLE[]) AS score,
         q.q_systems IS NULL OR list_contains(q.q_systems, lower(c.system)) AS in_system,
         q.q_workspace IS NULL OR lower(c.workspace) = q.q_workspace AS in_workspace
  FROM chunks c CROSS JOIN queries q),
tiered AS (
  SELECT *, CASE
    WHEN in_system AND (in_workspace OR (q_shared AND is_shared)) AND score >= {THRESHOLD} THEN 1
    WHEN q_workspace IS NOT NULL AND NOT q_shared AND in_system AND (in_workspace OR is_shared) AND score >= {THRESHOLD} THEN 2
    WHEN in_system AND (in_workspace OR (q_shared AND is_shared)) AND score >= {R.relaxed_threshold(THRESHOLD)} THEN 3 END AS tier
  FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT * FROM tiered WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY query_id))),
terms AS (SELECT string_split('{WORDS}', ' ') AS q),
dense AS (
  SELECT *, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS norm
  FROM ranked WHERE rank <= {K} WINDOW w AS (PARTITION BY query_id)),
lexical AS (
  SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, score DESC, chunk_id) AS rank FROM (
    SELECT r.*, len(list_filter(q, lambda t: list_contains(regexp_extract_all(lower(document_title || ' ' || section_heading || ' ' || content), '[a-z0-9]+'), t))) / len(q) AS overlap
    FROM ranked r, terms WHERE rank <= {4 * K}) WHERE overlap > 0
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, score DESC, chunk_id) <= {K}),
lexical_norm AS (
  SELECT *, CASE WHEN max(overlap) OVER w > min(overlap) OVER w THEN (overlap - min(overlap) OVER w) / (max(overlap) OVER w - min(overlap) OVER w) ELSE 1.0 END AS norm
  FROM lexical WINDOW w AS (PARTITION BY query_id)),
parts AS (
  SELECT query_id, chunk_id, 'lexical' AS branch, rank, overlap AS raw, norm, document_id, document_title, content, page_number, section_heading FROM lexical_norm
  UNION ALL
  SELECT query_id, chunk_id, 'dense', rank, score, norm, document_id, document_title, content, page_number, section_heading FROM dense),
fused AS (
  SELECT query_id, chunk_id, any_value(document_id) AS document_id, any_value(document_title) AS document_title, any_value(content) AS content,
         any_value(page_number) AS page_number, any_value(section_heading) AS section_heading, sum(0.5 / (60 + rank)) AS score_fused, max(norm) AS best_norm,
         max(rank) FILTER (branch = 'lexical') AS lexical_rank, max(rank) FILTER (branch = 'dense') AS dense_rank
  FROM parts GROUP BY query_id, chunk_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score_fused DESC, best_norm DESC, chunk_id) <= {K}),
final AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score_fused DESC, best_norm DESC, chunk_id) AS rank_final FROM fused)
"""


def _with(body: str) -> str:
    return f"WITH {_CTE} {body}"


def _fused(spark, base):
    c, q = chunks(spark, base), query_set(spark, base)
    return R.hybrid(c, q, K, THRESHOLD)[0]


def _ranks(fused: DataFrame) -> DataFrame:
    return fused.select("query_id", "rank_final", "chunk_id", "document_id", F.round("score_fused", 8).alias("score_fused"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("lexical_rank", "dense_rank")], "lexical_share")


@register("ret_hybrid_topk", _with("""
  SELECT query_id, rank_final, chunk_id, document_id, round(score_fused, 8) AS score_fused, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(dense_rank, 0) AS dense_rank,
         round(coalesce(0.5 / (60 + lexical_rank) / score_fused, 0.0), 6) AS lexical_share FROM final"""))
def ret_hybrid_topk(spark: SparkSession, base: str) -> DataFrame:
    """The flagship: both branches fused, with ranks and shares."""
    return _ranks(_fused(spark, base))


@register("ret1_dense_branch", _with("SELECT query_id, chunk_id, rank, round(score, 6) AS score_raw, round(norm, 6) AS score_norm, tier FROM dense"))
def ret1_dense_branch(spark, base):
    hits = R.branch_norm(R.resilient(chunks(spark, base), query_set(spark, base), K, THRESHOLD), "score")
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score_raw"), F.round("score_norm", 6).alias("score_norm"), "tier")


@register("ret2_scope_resilience", _with(f"SELECT query_id, tier, chunk_id, rank FROM ranked WHERE rank <= {K}"))
def ret2_scope_resilience(spark, base):
    return R.resilient(chunks(spark, base), query_set(spark, base), K, THRESHOLD).select("query_id", "tier", "chunk_id", "rank")


@register("ret3_lexical_branch", _with("SELECT query_id, chunk_id, rank, round(overlap, 6) AS score_raw, round(norm, 6) AS score_norm FROM lexical_norm"))
def ret3_lexical_branch(spark, base):
    hits = R.lexical_branch(chunks(spark, base), query_set(spark, base), K, THRESHOLD)
    return hits.select("query_id", "chunk_id", "rank", F.round("score_raw", 6).alias("score_raw"), F.round("score_norm", 6).alias("score_norm"))


@register("ret5_dense_only_fallback", _with("SELECT query_id, chunk_id, rank AS rank_final, 'lexical_unavailable' AS reason FROM dense"))
def ret5_dense_only_fallback(spark, base):
    hits, reason = R.hybrid(chunks(spark, base), query_set(spark, base), K, THRESHOLD, available=("dense",))
    return hits.select("query_id", "chunk_id", "rank_final", F.lit(reason).alias("reason"))


@register("ret9_citations", _with("""
  SELECT query_id, 'cite-' || rank_final AS citation_id, document_id, document_title, page_number, section_heading,
         CASE WHEN length(content) > 500 THEN substring(content, 1, 497) || '...' ELSE content END AS excerpt FROM final"""))
def ret9_citations(spark, base):
    return R.citations(_fused(spark, base))


@register("agg31_prompt_packing", _with("""
  SELECT query_id, rank_final, chunk_id, total_chars FROM (
    SELECT *, CAST(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank_final) AS BIGINT) AS total_chars FROM final) WHERE total_chars <= 8000"""))
def agg31_prompt_packing(spark, base):
    return R.packed_contexts(_fused(spark, base)).select("query_id", "rank_final", "chunk_id", "total_chars")


@register("top5_type_boost", _with(f"""
  SELECT query_id, chunk_id, round(boosted, 6) AS boosted, rank_boosted FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS rank_boosted FROM (
      SELECT *, CASE WHEN document_type = 'fr' THEN least(1.0, score + 0.08) ELSE score END AS boosted FROM ranked WHERE rank <= {4 * K})) WHERE rank_boosted <= {K}"""))
def top5_type_boost(spark, base):
    pool = R.resilient(chunks(spark, base), query_set(spark, base), 4 * K, THRESHOLD)
    return R.boosted(pool, ["  FR  "], K).select("query_id", "chunk_id", F.round("boosted", 6).alias("boosted"), "rank_boosted")


@register("flt6_threshold_topk", f"""
  WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % {QUERY_STEP} = 0)
  SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (
    SELECT query_id, vec_id, s, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM (
      SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]) AS s FROM embeddings CROSS JOIN q) WHERE s >= 0.3) WHERE rank <= 10""")
def flt6_threshold_topk(spark, base):
    vectors = table(spark, base, "embeddings")
    queries = vectors.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    hits = R.scored(vectors.select("vec_id", F.col("embedding").alias("vector")), queries, 0.3, 10, "vec_id")
    return R._top(hits, 10, F.desc("score"), F.col("vec_id")).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@register("mth1_cosine", """
  SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def mth1_cosine(spark, base):
    a = table(spark, base, "embeddings")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("next")), 6).alias("similarity"))


@register("str1_str2_overlap", """
  SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens,
         round(len(list_filter(['the', 'the', 'de', 'und'], lambda t: list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), t))) / 4, 6) AS overlap FROM documents""")
def str1_str2_overlap(spark, base):
    terms = F.array(*[F.lit(w) for w in ("the", "the", "de", "und")])
    docs = table(spark, base, "documents")
    return docs.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.round(T.overlap_score(terms, F.col("text")), 6).alias("overlap"))


@register("flt4_workspace_aliases", """
  SELECT DISTINCT source, list_sort(list_distinct([source, lower(source), upper(source), upper(source[1]) || lower(source[2:])])) AS aliases FROM documents""")
def flt4_workspace_aliases(spark, base):
    x = F.col("source")
    aliases = F.array_sort(F.array_distinct(F.array(x, F.lower(x), F.upper(x), T.title_case(x))))
    return table(spark, base, "documents").select("source").distinct().select("source", aliases.alias("aliases"))


@register("snk4_point_rows", _with(r"""
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
    document_id, lower(trim(system)) AS workspace, lower(trim(system)) IN ('shared', 'global', 'cross-functional') OR is_shared AS is_shared, CAST(page_number AS INTEGER) AS page_number
  FROM (SELECT *, sha1('\x6b\xa7\xb8\x11\x9d\xad\x11\xd1\x80\xb4\x00\xc0\x4f\xd4\x30\xc8'::BLOB || encode(document_id || ':' || chunk_id)) AS h FROM chunks)"""))
def snk4_point_rows(spark, base):
    """Point rows for publication: name-based id, normal workspace, shared flag, first page."""
    c = chunks(spark, base)
    return c.select(
        uuid5(F.concat_ws(":", "document_id", "chunk_id")).alias("point_id"), "document_id",
        F.lower(T.strip(F.col("system"))).alias("workspace"),
        (F.lower(T.strip(F.col("system"))).isin(*R.SHARED) | F.col("is_shared")).alias("is_shared"), "page_number",
    )


# --- governance ---------------------------------------------------------------------


def policies(spark, base):
    """One policy row per customer: its segment as system, its nation's region as area."""
    c, n, r = (table(spark, base, t) for t in ("customer", "nation", "region"))
    named = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return named.select(
        (F.col("c_custkey") % 500).alias("user_id"), F.concat(F.lit(" "), F.col("c_mktsegment")).alias("system_scope"),
        F.when(F.col("c_custkey") % 9 == 0, F.lit("Shared")).otherwise(F.col("r_name")).alias("area_scope"), (F.col("c_acctbal") > 0).alias("is_active"),
    )


def requests(spark, base):
    """One request per order."""
    o = table(spark, base, "orders")
    role = F.when(F.col("o_orderkey") % 50 == 0, F.lit("admin")).otherwise(F.lit("user"))
    systems = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("Machinery"), F.lit("BUILDING "))).otherwise(F.lit(None).cast("array<string>"))
    workspace = F.when(F.col("o_orderkey") % 2 == 0, F.lit("Asia")).otherwise(F.lit(None).cast("string"))
    return o.select(F.col("o_orderkey").alias("query_id"), (F.col("o_custkey") % 600).alias("user_id"), role.alias("role"), workspace.alias("workspace"), systems.alias("system_filters"))


_POLICIES = """
policies AS (
  SELECT c_custkey % 500 AS user_id, lower(trim(c_mktsegment)) AS s, lower(CASE WHEN c_custkey % 9 = 0 THEN 'Shared' ELSE r_name END) AS a, c_acctbal > 0 AS is_active
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
sets AS (
  SELECT user_id, list_sort(list(DISTINCT s)) AS systems, list_sort(list(DISTINCT a)) AS areas, list_sort(list_distinct(list_concat(list(s), list(a)))) AS allowed
  FROM policies WHERE is_active GROUP BY user_id),
requests AS (
  SELECT o_orderkey AS query_id, o_custkey % 600 AS user_id, CASE WHEN o_orderkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role,
         CASE WHEN o_orderkey % 2 = 0 THEN 'asia' END AS workspace, CASE WHEN o_orderkey % 3 = 0 THEN ['machinery', 'building'] ELSE [] END AS asked FROM orders),
enforced AS (
  SELECT query_id, user_id, role, list_filter(asked, lambda x: NOT list_contains(coalesce(systems, []), x)) AS denied, CASE
    WHEN role = 'admin' THEN NULL WHEN allowed IS NULL THEN 'policy_missing'
    WHEN workspace IS NOT NULL AND NOT list_contains(allowed, workspace) THEN 'workspace_denied'
    WHEN len(list_filter(asked, lambda x: NOT list_contains(coalesce(systems, []), x))) > 0 THEN 'system_denied' END AS reason_code
  FROM requests LEFT JOIN sets USING (user_id))
"""


@register("set1_policy_union", f"""WITH {_POLICIES}
  SELECT user_id, array_to_string(systems, ',') AS systems, array_to_string(allowed, ',') AS allowed,
         list_has_any(allowed, ['shared', 'global', 'cross-functional']) AS allows_shared FROM sets""")
def set1_policy_union(spark, base):
    p = G.policy_sets(policies(spark, base))
    return p.select("user_id", F.array_join("systems", ",").alias("systems"), F.array_join("allowed", ",").alias("allowed"), "allows_shared")


@register("ret8_scope_enforcement", f"WITH {_POLICIES} SELECT query_id, user_id, role, reason_code FROM enforced")
def ret8_scope_enforcement(spark, base):
    return G.enforce(requests(spark, base), policies(spark, base)).select("query_id", "user_id", "role", "reason_code")


@register("set2_denied_systems", f"WITH {_POLICIES} SELECT query_id, array_to_string(denied, ',') AS denied_systems FROM enforced WHERE role <> 'admin' AND len(denied) > 0")
def set2_denied_systems(spark, base):
    e = G.enforce(requests(spark, base), policies(spark, base)).where((F.col("role") != "admin") & (F.size("denied_systems") > 0))
    return e.select("query_id", F.array_join("denied_systems", ",").alias("denied_systems"))


@register("snk11_denial_audit", f"""WITH {_POLICIES}
  SELECT reason_code, '/chat' AS endpoint, count(*) AS n FROM enforced WHERE reason_code IS NOT NULL GROUP BY reason_code""")
def snk11_denial_audit(spark, base):
    rows = G.denials(G.enforce(requests(spark, base), policies(spark, base)), "/chat")
    return rows.groupBy("reason_code", "endpoint").agg(F.count(F.lit(1)).alias("n"))


@register("flt5_context_scope_filter", f"""WITH {_POLICIES}, contexts AS (
    SELECT l_orderkey, l_linenumber, o_custkey % 600 AS user_id, lower(o_orderpriority) AS workspace, CASE WHEN l_linenumber = 1 THEN 'machinery' ELSE 'household' END AS system, l_returnflag = 'R' AS is_shared
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  SELECT l_orderkey, l_linenumber FROM contexts LEFT JOIN sets USING (user_id)
  WHERE allowed IS NULL OR list_contains(allowed, system) OR list_contains(allowed, workspace) OR (list_has_any(allowed, ['shared', 'global', 'cross-functional']) AND is_shared)""")
def flt5_context_scope_filter(spark, base):
    li, o = table(spark, base, "lineitem"), table(spark, base, "orders")
    system = F.when(F.col("l_linenumber") == 1, F.lit("Machinery ")).otherwise(F.lit("HOUSEHOLD"))
    contexts = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(
        "l_orderkey", "l_linenumber", (F.col("o_custkey") % 600).alias("user_id"), F.col("o_orderpriority").alias("workspace"), system.alias("system"), (F.col("l_returnflag") == "R").alias("is_shared")
    )
    return G.in_scope(contexts, policies(spark, base)).select("l_orderkey", "l_linenumber")


@register("flt7_row_level_security", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 600 = 7 OR o_orderstatus = 'F'")
def flt7_row_level_security(spark, base):
    rules = {"authenticated": F.col("o_custkey") % 600 == 7, "*": F.col("o_orderstatus") == "F", "reviewer": F.lit(True)}
    return G.rls(table(spark, base, "orders"), "authenticated", F.lit(7), rules).select("o_orderkey", "o_orderstatus")


@register("jn5_owned_through_parent", """
  SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey < 50)""")
def jn5_owned_through_parent(spark, base):
    li = table(spark, base, "lineitem").select("l_orderkey", "l_linenumber")
    parent = table(spark, base, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return G.owned_through(li, parent, "l_orderkey", F.col("o_custkey") < 50)


@register("flt8_write_check", """
  SELECT o_orderkey, o_orderstatus AS was FROM orders WHERE o_orderkey % 5 = 0 AND o_orderstatus <> 'F'""")
def flt8_write_check(spark, base):
    o = table(spark, base, "orders")
    proposed = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit("F")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    return G.write_violations(proposed, o, "o_orderkey", "o_orderstatus", "F").select("o_orderkey", "was")


@register("flt9_claims", """
  SELECT event_id, coalesce(nullif(json_extract_string(props, '$.k'), ''), '00000000-0000-0000-0000-000000000000') AS uid, 'anon' AS role FROM events""")
def flt9_claims(spark, base):
    e = table(spark, base, "events").withColumn("claims", F.regexp_replace("props", '"k"', '"sub"'))
    return G.claims(e).select("event_id", "uid", "role")


@register("str3_workspace_name", """
  SELECT DISTINCT o_orderpriority, upper(o_orderpriority[1]) || lower(o_orderpriority[2:5]) || CASE WHEN o_orderpriority LIKE '% %' THEN lower(split_part(o_orderpriority, ' ', 1)[6:]) || ' ' || upper(split_part(o_orderpriority, ' ', 2)[1]) || lower(split_part(o_orderpriority, ' ', 2)[2:]) ELSE lower(o_orderpriority[6:]) END AS workspace FROM orders""")
def str3_workspace_name(spark, base):
    return table(spark, base, "orders").select("o_orderpriority").distinct().select("o_orderpriority", T.workspace_name(F.col("o_orderpriority")).alias("workspace"))


@register("ret7_scope_resolution", """
  SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END, 'all') AS workspace,
         coalesce(CASE WHEN o_orderkey % 4 = 0 THEN false END, true) AS include_shared FROM orders""")
def ret7_scope_resolution(spark, base):
    """The request's scope, else the persisted one, else the default."""
    k = F.col("o_orderkey")
    asked, kept = F.when(k % 2 == 0, F.col("o_orderpriority")), F.when(k % 3 == 0, F.col("o_orderstatus"))
    return table(spark, base, "orders").select(k, F.coalesce(asked, kept, F.lit("all")).alias("workspace"), F.coalesce(F.when(k % 4 == 0, F.lit(False)), F.lit(True)).alias("include_shared"))
