"""Scoped hybrid retrieval: dense and lexical branches, weighted reciprocal-rank fusion.

Every operator takes a table of queries and keeps ``query_id``, so many queries run in
one plan. The query table may be of any size: up to MAX_QUERIES (counted) it is broadcast and
chunks are scored in place; beyond, blocks of about as many queries are dealt as rows and
meet each part of the chunks in a group of its own, in one plan whatever their number. A task of a
top-k search passes on no more than its own k best of each query (``_best``), so what leaves it follows
the queries and not the pairs; the final cut is Spark's. The three-tier search ranks
narrow rows and fetches the payload of the hits by ``chunk_id``, which names one chunk. Hybrid
search writes its narrow pool once for both branches and fetches payloads after the fusion.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.pandas.types import to_arrow_type

from docloom.functions import text as T
from docloom.llm.common import release
from docloom.sources.shared import shared, shares

POOL, RANK_CONSTANT, WEIGHT = 4, 60, 0.5
RELAXED_FLOOR, RELAXED_DELTA = 0.45, 0.25
TYPE_BOOST = 0.08
SHARED = ("shared", "global", "cross-functional")
#: Queries that are broadcast, or on average make a block.
MAX_QUERIES = 1 << 15
#: Cells of a product that a task holds at once, and pairs of them that are scored exactly at once.
CELLS, EXACT = 1 << 21, 1 << 16
#: Rows that a task collects before it keeps the best, and the most of those that it goes on holding.
HELD, MOST_HELD = 1 << 18, 1 << 21
#: Columns of a chunk by which a query's scope may tell it from another.
SCOPE = ("system", "workspace", "is_shared")

PAYLOAD = ("document_id", "document_title", "content", "system", "workspace", "document_type", "is_shared", "section_heading", "page_number")


def relaxed_threshold(threshold: float) -> float:
    return max(RELAXED_FLOOR, threshold - RELAXED_DELTA)


def relaxed(threshold: Column) -> Column:
    """``relaxed_threshold`` of a column."""
    return F.greatest(F.lit(RELAXED_FLOOR), threshold - RELAXED_DELTA)


def scope_condition(strict: bool = False, shared: Column | None = None) -> Column:
    """Filter of a chunk by its query's scope columns ``q_systems`` and ``q_workspace``.

    A chunk must be of one of the systems, if any are asked for, and must be of the
    workspace or shared. ``strict`` compares the systems' case.
    """
    fold = (lambda x: x) if strict else F.lower
    wanted = F.transform("q_systems", fold)
    must = F.coalesce(F.size("q_systems") <= 0, F.lit(True)) | F.array_contains(wanted, fold(F.col("system")))
    aliases = F.array_distinct(F.array(*[f(T.strip(F.col("q_workspace"))) for f in (lambda x: x, F.lower, F.upper, T.title_case)]))
    own = F.array_contains(aliases, F.col("system")) | F.array_contains(aliases, F.col("workspace"))
    shared = F.col("q_shared") if shared is None else shared
    common = shared & (F.coalesce("is_shared", F.lit(False)) | F.col("workspace").isin(*SHARED))
    return must & (F.col("q_workspace").isNull() | F.coalesce(own, F.lit(False)) | common)


class _Asked:
    """Unit vectors of queries and, for a top-k search, which queries take any chunk in scope."""

    def __init__(self, table: pa.Table):
        self.ids, self.free = table.column("query_id").to_numpy(), table.column("_free").to_numpy()
        vectors = table.column("q_vector").combine_chunks()
        self.unit = _units(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(self.ids), -1 if len(self.ids) else 0))


def _products(asked: _Asked, floors: np.ndarray, own: pa.Table | pa.RecordBatch, at: int):
    """Yields tables of the rows of ``own``, but for the vector column, with the place of the query and the score of each pair
    that is not below the query's floor; a slab of rows at a time. Single precision finds the pairs, with a margin of its
    error; double precision scores them."""
    vectors = own.column(at)
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    dims, queries = asked.unit.shape[1], len(asked.ids)
    valid = np.flatnonzero(sizes == dims) if queries else np.zeros(0, np.int64)
    step, margin, single = max(1, CELLS // max(1, queries)), (dims + 4) * 1.2e-7, asked.unit.astype(np.float32)
    rest = [c for c in range(own.num_columns) if c != at]
    for low in range(0, len(valid), step):
        rows = valid[low : low + step]
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        unit = _units(flat.astype(np.float64).reshape(len(rows), -1))
        chunk, query = np.nonzero(unit.astype(np.float32) @ single.T >= (floors - margin).astype(np.float32))
        for k in range(0, len(chunk), EXACT):
            c, q = chunk[k : k + EXACT], query[k : k + EXACT]
            score = np.round(np.einsum("ij,ij->i", unit[c], asked.unit[q]), 12)  # equal vectors tie whatever their place in a product
            c, q, score = (x[score >= floors[q]] for x in (c, q, score))
            if len(c):
                taken = own.take(pa.array(rows[c]))
                yield pa.table([*(taken.column(j) for j in rest), pa.array(q), pa.array(score)], [*(own.schema.names[j] for j in rest), "_query", "score"])


def _best(found: pa.Table, asked: _Asked, floors: np.ndarray, k: int, tie: str) -> pa.Table:
    """The k best rows of a query by score, then ``tie``; of a query with a scope the k best of each kind of chunk.

    Chunks of a kind agree in SCOPE, so a query's scope takes all or none of them and its
    tier only falls as the score rises: no row of a final k best is lost. Floors of
    queries that take any chunk rise to their k-th score.
    """
    query = found.column("_query").to_numpy()
    kind = np.zeros(len(query), np.int64)
    if not asked.free.all():
        for c in SCOPE:
            if c in found.column_names:
                codes = pc.fill_null(pc.cast(found.column(c).combine_chunks().dictionary_encode().indices, pa.int64()), -1).to_numpy() + 1
                kind = np.unique(kind * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
        kind[asked.free[query]] = 0
    table = found.append_column("_kind", pa.array(kind))
    order = pc.sort_indices(table, sort_keys=[("_query", "ascending"), ("_kind", "ascending"), ("score", "descending"), (tie, "ascending")], null_placement="at_start")
    at = order.to_numpy()
    q, g = query[at], kind[at]
    first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (g[1:] != g[:-1]))[: len(q)])
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    last = (rank == k - 1) & asked.free[q]
    floors[q[last]] = np.maximum(floors[q[last]], found.column("score").to_numpy()[at[last]])
    return found.take(pa.array(at[rank < k]))


def _pairs(asked: _Asked, floor: float, parts, at: int, k: int | None, tie: str):
    """Tables of the pairs of all ``parts``; with ``k`` only the k best (``_best``), collected in bounded memory."""
    floors, held, rows = np.full(len(asked.ids), float(floor)), [], 0
    limit = HELD
    for own in parts:
        for found in _products(asked, floors, own, at):
            if not k:
                yield found
                continue
            held.append(found)
            rows += found.num_rows
            if rows > limit:
                best = _best(pa.concat_tables(held), asked, floors, k, tie)
                if best.num_rows > MOST_HELD:
                    yield best
                    best = best.slice(0, 0)
                held, rows = [best], best.num_rows
                limit = max(HELD, 2 * rows)
    if rows:
        yield _best(pa.concat_tables(held), asked, floors, k, tie)


def _named(found: pa.Table, asked: _Asked, schema: pa.Schema) -> pa.Table:
    """The pairs with their query's id for its place."""
    ids = pa.array(asked.ids[found.column("_query").to_numpy()])
    return pa.table([*(found.column(c) for c in schema.names[:-2]), ids, found.column("score")], schema.names).cast(schema)


def _in_place(chunks: DataFrame, asked: DataFrame, floor: float, k: int | None, tie: str, schema: T_.StructType) -> DataFrame:
    """Pairs with a query table that is small enough to be broadcast."""
    held = chunks.sparkSession.sparkContext.broadcast(_Asked(asked.toArrow()))
    at, out = chunks.columns.index("vector"), _arrow(schema)

    def run(batches):
        for found in _pairs(held.value, floor, batches, at, k, tie):
            yield from _named(found, held.value, out).to_batches(max_chunksize=1 << 16)
        release()

    return chunks.mapInArrow(run, schema)


def _arrow(schema: T_.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in schema])


def _dealt(chunks: DataFrame, asked: DataFrame, floor: float, k: int | None, tie: str, schema: T_.StructType, blocks: int) -> DataFrame:
    """Pairs with a query table of any size: a group for each block of queries and part of the chunks."""
    parts = shares(chunks)
    names, at = [c for c in chunks.columns if c != "vector"], len(chunks.columns) - 1
    left = chunks.select(*names, "vector").withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    left = left.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    right = right.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    out = _arrow(schema)

    def run(own: pa.Table, table: pa.Table) -> pa.Table:
        if not own.num_rows or not table.num_rows:
            return out.empty_table()
        asked = _Asked(table)
        found = [_named(x, asked, out) for x in _pairs(asked, floor, [own.select([*names, "vector"])], at, k, tie)]
        return pa.concat_tables(found) if found else out.empty_table()

    return left.groupBy("_part", "_block").cogroup(right.groupBy("_part", "_block")).applyInArrow(run, schema)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows become NaN and so match nothing."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return vectors / np.sqrt(np.square(vectors).sum(1, keepdims=True))


def scored(chunks: DataFrame, queries: DataFrame, floor: float = -1.0, k: int | None = None, tie: str = "chunk_id") -> DataFrame:
    """Chunks with the queries (one row a query_id) to which their similarity is at least ``floor``; only such pairs leave a task.

    With ``k`` a task passes on what can be among the k best of a query by score, then
    ``tie``, within its scope; the final cut is the caller's.
    """
    fields = [chunks.schema[c] for c in chunks.columns if c != "vector"] + [queries.schema["query_id"], T_.StructField("score", T_.DoubleType())]
    blocks = -(-queries.count() // MAX_QUERIES)
    free = F.lit(True)
    if "q_systems" in queries.columns:
        free = F.coalesce(F.size("q_systems") <= 0, F.lit(True)) & F.col("q_workspace").isNull()
    asked = queries.where("q_vector is not null").select("query_id", "q_vector", free.alias("_free"))
    rest = queries.drop("q_vector")
    if blocks <= 1:
        return _in_place(chunks, asked, floor, k, tie, T_.StructType(fields)).join(F.broadcast(rest), "query_id")
    return _dealt(chunks, asked, floor, k, tie, T_.StructType(fields), blocks).join(rest, "query_id")


def _top(df: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    w = W.partitionBy("query_id").orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def dense(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """Top-k by cosine at or above the threshold, in scope."""
    hits = scored(chunks, queries, threshold, k).where(scope_condition(strict) & (F.col("score") >= threshold))
    return _top(hits, k, F.desc("score"), F.col("chunk_id"))


def tiered(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """The k best chunks of each query in three tiers: as asked; with shared documents; with the relaxed threshold.

    All tiers come from one scan: a hit's tier is the first that admits it, and a query
    keeps its least tier with a hit. The last tier uses the asked shared flag again. Rows are narrow:
    chunk_id, the query's columns but for its vector, score, tier and rank.
    """
    base = scored(chunks.select("chunk_id", "vector", "system", "workspace", "is_shared"), queries, min(threshold, relaxed_threshold(threshold)), k)
    asked, wide = scope_condition(strict), scope_condition(strict, F.lit(True))
    widens = F.col("q_workspace").isNotNull() & ~F.col("q_shared")
    tier = (
        F.when(asked & (F.col("score") >= threshold), 1)
        .when(widens & wide & (F.col("score") >= threshold), 2)
        .when(asked & (F.col("score") >= relaxed_threshold(threshold)), 3)
    )
    hits = base.withColumn("tier", tier).where("tier is not null")
    ranked = _top(hits, k, F.col("tier"), F.desc("score"), F.col("chunk_id"))
    least = F.min("tier").over(W.partitionBy("query_id"))
    return ranked.withColumn("least", least).where("tier = least").drop("least", "system", "workspace", "is_shared")


def resilient(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """``tiered`` with the payload of the chunks."""
    return tiered(chunks, queries, k, threshold, strict).join(chunks.drop("vector"), "chunk_id")


def branch_norm(hits: DataFrame, raw: str) -> DataFrame:
    """Min-max form of a branch's scores; 1 where all are equal."""
    w = W.partitionBy("query_id")
    low, high = F.min(raw).over(w), F.max(raw).over(w)
    return hits.withColumn("score_norm", F.when(high > low, (F.col(raw) - low) / (high - low)).otherwise(F.lit(1.0)))


def pool_of(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """The POOL * k best chunks of each query; both branches come from it, so one scan serves both."""
    return resilient(chunks, queries, POOL * k, threshold, strict)


def _payload(hits: DataFrame) -> list[str]:
    """The payload columns that ``hits`` has."""
    return [c for c in PAYLOAD if c in hits.columns]


def dense_of(pool: DataFrame, k: int) -> DataFrame:
    hits = branch_norm(pool.where(F.col("rank") <= k), "score")
    return hits.select("query_id", "chunk_id", *_payload(pool), F.lit("dense").alias("branch"), "rank", F.col("score").alias("score_raw"), "score_norm")


def lexical_of(pool: DataFrame, k: int) -> DataFrame:
    text = F.concat_ws(" ", F.coalesce("document_title", F.lit("")), F.coalesce("section_heading", F.lit("")), F.coalesce("content", F.lit("")))
    hits = pool.drop("rank").withColumn("overlap", T.overlap_score(T.tokens(F.col("q_text")), text))
    # rows without overlap rank last; a filter before the ranking would be evaluated a second time
    hits = branch_norm(_top(hits, k, F.desc("overlap"), F.desc("score"), F.col("chunk_id")).where("overlap > 0"), "overlap")
    return hits.select("query_id", "chunk_id", *_payload(pool), F.lit("lexical").alias("branch"), "rank", F.col("overlap").alias("score_raw"), "score_norm")


def dense_branch(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """The k best chunks by similarity."""
    return dense_of(pool_of(chunks, queries, k, threshold, strict), k)


def lexical_branch(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> DataFrame:
    """Overlap of query terms within the dense pool of POOL * k chunks."""
    return lexical_of(pool_of(chunks, queries, k, threshold, strict), k)


def both_branches(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False) -> list[DataFrame]:
    """The lexical and the dense branch without payload, from one narrow pool that is written once."""
    pool = shared(tiered(chunks, queries, POOL * k, threshold, strict))
    return [_lexical_narrow(pool, chunks, k), dense_of(pool, k)]


def _lexical_narrow(pool: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The lexical branch of a narrow pool, without the texts it is scored by."""
    text = ["document_title", "section_heading", "content"]
    return lexical_of(pool.join(chunks.select("chunk_id", *text), "chunk_id"), k).drop(*text)


def fuse(branches: list[DataFrame], top_n: int, weights: dict[str, float] | None = None, constant: int = RANK_CONSTANT) -> DataFrame:
    """Weighted reciprocal-rank fusion; ties go by best norm, then by chunk id."""
    weights = weights or {"lexical": WEIGHT, "dense": WEIGHT}
    rows = reduce(DataFrame.unionByName, branches)
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("branch") == name, F.lit(float(w))).otherwise(weight)
    rows = rows.withColumn("part", weight / (F.lit(constant) + F.col("rank")))
    of = lambda name, c: F.max(F.when(F.col("branch") == name, F.col(c))).alias(f"{name}_{c}")
    fused = rows.groupBy("query_id", "chunk_id").agg(
        F.sum("part").alias("score_fused"),
        F.max("score_norm").alias("best_norm"),
        of("lexical", "rank"), of("dense", "rank"), of("lexical", "score_raw"), of("dense", "score_raw"), of("lexical", "part"), of("dense", "part"),
        *[F.first(c).alias(c) for c in _payload(rows)],
    )
    fused = _top(fused, top_n, F.desc("score_fused"), F.desc("best_norm"), F.col("chunk_id"), rank="rank_final")
    share = lambda name: F.round(F.coalesce(F.col(f"{name}_part") / F.col("score_fused"), F.lit(0.0)), 6).alias(f"{name}_share")
    return fused.withColumns({"score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score_fused")))}).select("*", share("lexical"), share("dense"))


def single_branch(branch: DataFrame, top_n: int) -> DataFrame:
    """One branch alone, by rank and id, when the other is unavailable."""
    return _top(branch.withColumnRenamed("rank", "branch_rank"), top_n, F.col("branch_rank"), F.col("chunk_id"), rank="rank_final")


def hybrid(chunks: DataFrame, queries: DataFrame, k: int, threshold: float, strict: bool = False, available=("lexical", "dense")) -> tuple[DataFrame | None, str | None]:
    """The fused result, or one branch, or none; with the reason of a fallback."""
    if not available:
        return None, "both_unavailable"
    pool, found = shared(tiered(chunks, queries, POOL * k, threshold, strict)), {}
    if "lexical" in available:
        found["lexical"] = _lexical_narrow(pool, chunks, k)
    if "dense" in available:
        found["dense"] = dense_of(pool, k)
    if len(found) == 2:
        hits, reason = fuse([found["lexical"], found["dense"]], k), None
    else:
        (name, only), = found.items()
        hits, reason = single_branch(only, k), "dense_unavailable" if name == "lexical" else "lexical_unavailable"
    return hits.join(chunks.select("chunk_id", *_payload(chunks)), "chunk_id"), reason


def citations(hits: DataFrame, rank: str = "rank_final") -> DataFrame:
    """cite-1, cite-2 ... with excerpts of at most 500 characters."""
    return hits.select(
        "query_id",
        F.concat(F.lit("cite-"), F.col(rank).cast("string")).alias("citation_id"),
        "document_id",
        "document_title",
        "page_number",
        "section_heading",
        T.truncate(F.col("content"), 500).alias("excerpt"),
    )


def packed_contexts(hits: DataFrame, limit: int = 8000, rank: str = "rank_final") -> DataFrame:
    """Contexts in order while their total length stays within the limit; the first overflow stops."""
    w = W.partitionBy("query_id").orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    return hits.withColumn("total_chars", F.sum(F.length("content")).over(w)).where(F.col("total_chars") <= limit)


def boosted(hits: DataFrame, preferred: list[str], k: int) -> DataFrame:
    """Hits of preferred document types gain TYPE_BOOST, at most 1; order is stable."""
    wanted = [p.strip().lower() for p in preferred if p and p.strip()]
    score = F.when(F.lower(T.strip(F.col("document_type"))).isin(*wanted), F.least(F.lit(1.0), F.col("score") + TYPE_BOOST)).otherwise(F.col("score"))
    return _top(hits.withColumn("boosted", score), k, F.desc("boosted"), F.col("rank"), rank="rank_boosted")
