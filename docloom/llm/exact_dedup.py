"""Exact dedup by an exchange of Golomb-coded fingerprints.

1. Every text is normalised (each run of ASCII white space becomes one space) and
   hashed in the JVM; ids and digests go to the shared folder, texts do not.
2. Each partition sorts its distinct 64-bit fingerprints and sends every owner (a
   range of the fingerprint space) one Golomb-coded block.
3. An owner answers each sender with a bitmap over that sender's block: seen from
   another sender too, or not. Senders add what they hold twice themselves.
4. Only suspects' texts are shuffled: the scan is narrowed by a Bloom filter of the
   suspect fingerprints, of bounded size. Grouping by the whole normalised text compares
   bytes; map-side combining leaves one row per text and task, so a group with a third
   of all rows stays small.
5. Rows find their group by digest in a plain join, which adaptive execution splits
   where one digest is hot.

Defined results: null text counts as empty; ties go to the smallest doc_id, a null id
comes last. ``classes`` has a row for each row, and all rows of a group that bear its
keep_id are ``kept``, as the id names them; ``deduplicate`` leaves exactly one row of
each text, whatever ids repeat or are null, and all its columns. An empty table gives no
rows; extra columns are ignored by ``classes`` and kept by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm import golomb
from docloom.llm.common import SPACE_CLASS, bloom, shared, shares, split_by, trimmed


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE_CLASS}+", " ")


def fingerprints(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text).alias("norm"))
    return norm.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha"), F.spark_partition_id().alias("sender"))


def _blocks(owners: int):
    """Per partition and owner: the coded distinct fingerprints and a bitmap of those held twice here."""

    def run(batches):
        senders, values = [], []
        for b in batches:
            senders.append(b.column(0).to_numpy(zero_copy_only=False))
            values.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        if not values:
            return
        sender, value = np.concatenate(senders), np.concatenate(values)
        for one in np.unique(sender):
            distinct, counts = np.unique(value[sender == one], return_counts=True)
            owner = ((distinct >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            edges = np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))
            rows = [(o, edges[o], edges[o + 1]) for o in range(owners) if edges[o] < edges[o + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([o for o, _, _ in rows], pa.int32()),
                    pa.array([int(one)] * len(rows), pa.int32()),
                    pa.array([golomb.encode(distinct[a:b]) for _, a, b in rows], pa.binary()),
                    pa.array([golomb.bitmap(counts[a:b] > 1) for _, a, b in rows], pa.binary()),
                ],
                ["owner", "sender", "block", "own"],
            )

    return run


def _answers(pdf):
    """An owner's answer: for each sender a bitmap of the fingerprints that another sender has too."""
    blocks = [golomb.decode(b) for b in pdf["block"]]
    values, counts = np.unique(np.concatenate(blocks), return_counts=True)
    twice = values[counts > 1]
    out = pdf[["owner", "sender"]].copy()
    out["twice"] = [golomb.bitmap(np.isin(b, twice, assume_unique=True)) for b in blocks]
    return out


def _decode(batches):
    """A sender reads its answers: the fingerprints flagged there or held twice here."""
    for b in batches:
        found = []
        for block, own, twice in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            values = golomb.decode(block)
            found.append(values[golomb.unbitmap(own, len(values)) | golomb.unbitmap(twice, len(values))])
        flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["fp"])


def suspects(prints: DataFrame) -> DataFrame:
    """Fingerprints that occur more than once, one row each."""
    owners = shares(prints)
    blocks = shared(prints.select("sender", "fp").mapInArrow(trimmed(_blocks(owners)), "owner int, sender int, block binary, own binary"))
    answers = blocks.groupBy("owner").applyInPandas(_answers, "owner int, sender int, twice binary")
    flagged = blocks.join(answers, ["owner", "sender"]).select("block", "own", "twice")
    return flagged.mapInArrow(trimmed(_decode), "fp long").distinct()


def _fingerprint(text: str) -> Column:
    return F.xxhash64(normalised(text))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    prints = shared(fingerprints(docs, id_col, text))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    doubtful, _ = split_by(texts, _fingerprint("_text"), bloom(shared(suspects(prints))))
    groups = (
        doubtful.groupBy(normalised("_text").alias("norm"))
        .agg(F.min("_id").alias("keep"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.sha2("norm", 256).alias("sha"), "keep", "n")
    )
    out = prints.join(groups, "sha", "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("keep").eqNullSafe(F.col("doc_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each text, that of the smallest doc_id.

    Rows whose fingerprint no other row has pass unshuffled; of the others each task
    sends one row a text.
    """
    prints = docs.select(_fingerprint(text).alias("fp"), F.spark_partition_id().alias("sender"))
    doubtful, clear = split_by(docs, _fingerprint(text), bloom(shared(suspects(shared(prints)))))
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(id_col).isNull(), F.col(id_col)))
    picked = doubtful.groupBy(normalised(text).alias("norm")).agg(least.alias("row")).select("row.*")
    return clear.unionByName(picked)
