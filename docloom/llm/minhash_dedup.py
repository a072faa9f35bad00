"""Near-dedup by min-max hashing: both ends of every permutation, banded, confirmed on whole sets.

A document's set are its distinct 2-word shingles; two sets link when
100 * overlap >= 80 * union.

1. Each permutation of the 32-bit shingle hashes is evaluated once and gives two
   values of the signature, its minimum and its maximum. Two sets agree in either with
   the probability of their Jaccard similarity; the two are negatively correlated, so
   an estimate from 120 permutations has less variance than one from 240 minima,
   for half the hash evaluations. Copies of a set are hashed once in a task.
2. A band is ``ROWS`` values of as many different permutations, alternately minima and
   maxima; the complementary band takes the other ends. Two sets of similarity s meet
   in one of the ``BANDS`` bands with probability 1 - (1 - s**6)**40: all but 5 in a
   million at 0.8, 3 in 10,000 at 0.15 or below.
3. Buckets of a band are counted with partial aggregation; those with two or more
   distinct sets remain, each distinct group of sets once. No bucket is gathered in a task: entries stay rows.
4. Groups go through the parity sieve, bounded blocks and overlap products of the
   n-gram join, so each link is confirmed on the whole sets, links form a spanning
   forest, and components come from star contractions.

Defined results: null text and text without words have n_shingles 0 and are their own
component; a text of one word has one shingle; equal sets always link, as they become
one row by a 128-bit hash before any banding; repeated rows count as equal sets;
a component without any id has a null component_id and its rows are kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import ngram_join
from docloom.llm.common import bloom, mix64, shared, split_by, trimmed

WORDS, PERCENT = 2, 80
BANDS, ROWS = 40, 6
#: Shingles that are hashed at a time, and set hashes that a task remembers before it starts anew.
SLAB, SEEN = 1 << 16, 1 << 18
#: Smaller sets can link with equal sets only.
LEAST = 4

_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_FACTORS = (_SEEDS[: BANDS * ROWS // 2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (_SEEDS[BANDS * ROWS // 2 :] >> np.uint64(32)).astype(np.uint32)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of each set (not empty) under each permutation: two arrays, sets x permutations."""
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    start = np.append(0, np.cumsum([len(s) for s in sets])[:-1])
    low, high = (np.empty((len(sets), len(_FACTORS)), np.uint32) for _ in range(2))
    for k, (factor, shift) in enumerate(zip(_FACTORS, _SHIFTS, strict=True)):
        value = flat * factor + shift
        low[:, k] = np.minimum.reduceat(value, start)
        high[:, k] = np.maximum.reduceat(value, start)
    return low, high


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated Jaccard similarity of sets by their signatures: the share of ends that agree."""
    return ((a[0] == b[0]).mean(-1) + (a[1] == b[1]).mean(-1)) / 2


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """64-bit bucket of each set in each band: sets x BANDS."""
    ends = [np.where(np.arange(low.shape[1]) % 2 == side, low, high).astype(np.uint64) for side in (0, 1)]
    values = np.concatenate(ends, 1).reshape(len(low), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(low), BANDS))
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return key


def _signed(batches):
    """doc_id, row, size, set hash, parity cells and, once for each set that a task sees, its buckets."""
    seen: set[tuple[int, int]] = set()
    for b in batches:
        n, s1, s2 = np.zeros((3, b.num_rows), np.int64)
        bits: list[bytes | None] = [None] * b.num_rows
        bands: list[np.ndarray | None] = [None] * b.num_rows
        held, size = [], 0

        def flush(held):
            keys = band_keys(*signatures([own for _, own in held])).view(np.int64)
            for (k, _), own in zip(held, keys, strict=True):
                bands[k] = own  # noqa: B023

        for k, own in ngram_join.shingle_sets(b.column(1), WORDS):
            n[k] = len(own)
            if len(own):
                s1[k], s2[k] = name = ngram_join.set_hash(own)
                bits[k] = ngram_join.parity(own)
                if len(own) >= LEAST and name not in seen:
                    seen.add(name)
                    held.append((k, own))
                    size += len(own)
            if size > SLAB:
                flush(held)
                held, size = [], 0
        if held:
            flush(held)
        if len(seen) > SEEN:
            seen = set()
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array(n), pa.array(s1), pa.array(s2), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "row", "n", "s1", "s2", "bits", "bands"],
        )


def signed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    rows = ngram_join.text_rows(docs, id_col, text).select(F.col("row.id").alias("doc_id"), "text", "row")
    rows = rows.withColumn("doc_id", F.when(~F.col("row.none"), F.col("doc_id")))
    return rows.mapInArrow(trimmed(_signed), f"doc_id long, row {ngram_join._ROW}, n long, s1 long, s2 long, bits binary, bands array<bigint>")


def candidates(signed: DataFrame) -> DataFrame:
    """(block, s1, n): each distinct group of sets that share a bucket, once."""
    entries = signed.where("bands is not null").select(F.explode("bands").alias("block"), "s1", "n")
    met = shared(entries.groupBy("block").agg(F.min("s1").alias("a"), F.max("s1").alias("z")).where("a <> z").select("block"))
    maybe, _ = split_by(entries, F.col("block"), bloom(met))
    groups = shared(maybe.join(met, "block").select("block", "s1", "n").distinct())
    # a group's name: two sets of sets with equal names, counts and ends are equal but for a 64-bit accident
    own = groups.groupBy("block").agg(F.bit_xor(F.xxhash64("s1")).alias("name"), F.count(F.lit(1)).alias("m"), F.min("s1").alias("a"), F.max("s1").alias("z"))
    once = own.groupBy("name", "m", "a", "z").agg(F.min("block").alias("block")).select("block")
    return groups.join(once, "block").select("block", "s1", "n")


def members(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row key, n, and the least doc_id of its component, null where none has an id."""
    signed = shared(signed_rows(docs, id_col, text))
    sets = ngram_join.distinct_sets(signed)
    found = ngram_join.confirmed(ngram_join.text_rows(docs, id_col, text), signed, sets, candidates(signed), WORDS, PERCENT)
    return ngram_join.grouped(signed, sets, found)


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept (the document that names its component)."""
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = members(docs, id_col, text).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
