"""A Merkle manifest of a dataset: leaves by document, subroots by language, one root, a proof for each row.

Every step is a DataFrame level:

1. A row's leaf hashes its fields. Leaves are range-partitioned by (language, id), and
   a leaf's index is its row_number inside the range part plus the sizes of the parts
   before; no task holds a whole language.
2. Level by level, index divided by the fanout names the parent; the sorted array of
   its children is hashed into it. A run's children stand together, so partial
   aggregation leaves one row for a run before the shuffle. Levels shrink by the fanout,
   and each is written to the shared folder.
3. The subroots, in order of language, are the leaves of a tree of the same kind.
4. Proofs are appended level by level by joins on (language, parent), from the root
   down, so that the siblings of an upper level are held once for each node below
   it and not once for each document. The last join has one row for each run of leaves.

Defined results: null fields are hashed as ``-``; null languages come first and are one
language; leaves ascend by id, null ids first, then by leaf, so the order of input rows
does not matter; repeated rows are leaves of their own; a language with one row has that
leaf as subroot; a proof without siblings is the hash of nothing; an empty table gives no rows;
columns beside the fields are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import shared, shares

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def leaf_digest(fields: list[Column]) -> Column:
    """Hash of the fields in order, each as its byte count, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return sha(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def tree_name(key: str) -> Column:
    """A string without null that sorts as the key does, null first."""
    return F.coalesce(F.concat(F.lit(":"), F.col(key).cast("string")), F.lit("-"))


def indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with a column ``tree``) with ``index``, the place in the tree by ``order``, and ``n``, the tree's size."""
    keys = [F.col(c).asc_nulls_first() for c in order]
    cut = shared(rows.repartitionByRange(shares(rows), F.col("tree"), *keys).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("tree")
    before = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = cut.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"))
    sizes = sizes.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("m").over(whole).alias("n"))
    k = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys))
    return cut.withColumn("k", k).join(sizes, ["tree", "part"]).withColumn("index", F.col("before") + F.col("k") - 1).drop("k", "before", "part")


def grow(leaves: DataFrame) -> list[DataFrame]:
    """The runs of each level: tree, up (the parent's index), kids (index, digest and what leaves carry), n (nodes of
    the level), digest (the parent's). ``leaves`` has tree, index, n, digest; other columns stay with the kids of level 0.
    A tree of one leaf has that leaf as top."""
    runs, nodes = [], leaves
    while True:
        kid = F.struct("index", "digest", *(c for c in nodes.columns if c not in ("tree", "index", "n", "digest")))
        run = nodes.groupBy("tree", F.floor(F.col("index") / FANOUT).alias("up")).agg(F.array_sort(F.collect_list(kid)).alias("kids"), F.first("n").alias("n"))
        own = F.when(F.col("n") == 1, F.col("kids")[0]["digest"]).otherwise(F.sha2(F.array_join("kids.digest", ""), 256))
        runs.append(shared(run.withColumn("digest", own)))
        nodes = runs[-1].select("tree", F.col("up").alias("index"), F.ceil(F.col("n") / FANOUT).alias("n"), "digest").where("n > 1")
        if nodes.isEmpty():
            return runs


def tops(runs: list[DataFrame]) -> DataFrame:
    """(tree, level, digest): the root of each tree, and the level that it stands on."""
    each = [r.where(F.col("n") <= FANOUT).select("tree", F.lit(k + 1).alias("level"), "digest") for k, r in enumerate(runs)]
    return reduce(DataFrame.union, each)


def descend(runs: list[DataFrame], heads: DataFrame) -> DataFrame:
    """The kids of level 0, each with its ``path`` - (left, right) siblings from its own level up - and what ``heads`` bears.

    ``heads`` has tree, level and path of each root; joins go from the root's level down.
    """
    at = None
    for k in reversed(range(len(runs))):
        here = heads.where(F.col("level") == k + 1).drop("level").withColumn("up", F.lit(0).cast("long"))
        above = here if at is None else here.unionByName(at)
        met = runs[k].drop("digest").join(above, ["tree", "up"])
        each = met.select("*", F.posexplode("kids").alias("place", "kid"))
        side = lambda first, count: F.array_join(F.slice("kids.digest", first, count), "")
        entry = F.struct(side(F.lit(1), F.col("place")).alias("left"), side(F.col("place") + 2, F.lit(FANOUT)).alias("right"))
        path = F.when(F.col("n") == 1, F.col("path")).otherwise(F.concat(F.array(entry), F.col("path")))
        at = each.select(F.col("kid"), F.col("tree"), path.alias("path"), *(c for c in heads.columns if c not in ("tree", "level", "path")))
        if k:
            at = at.withColumn("up", F.col("kid.index")).drop("kid")
    return at


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings lead to."""
    return F.aggregate(path, leaf, lambda own, e: sha(e["left"], own, e["right"]))


def proof_digest(path: Column) -> Column:
    """Hash of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda e: F.concat(e["left"], e["right"])), ""), 256)


def prove(docs: DataFrame, carried: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root and path, and the columns ``carried`` (of fixed size)."""
    carried = carried or {}
    leaves = docs.select(
        tree_name(tree).alias("tree"), F.col(id_col).alias("doc_id"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
        F.monotonically_increasing_id().alias("row"), *(c.alias(name) for name, c in carried.items()),
    )
    # the row number parts equal rows, so that many of them do not meet in one range
    runs = grow(indexed(shared(leaves), ["doc_id", "digest", "row"]).drop("row"))
    subroots = shared(tops(runs))
    upper = grow(indexed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    root = tops(upper).select("tree", "level", nothing.alias("path"), F.col("digest").alias("root"))
    named = descend(upper, root).select(F.col("kid.name").alias("tree"), F.col("kid.digest").alias("subroot"), "path", "root")
    heads = shared(subroots.select("tree", "level").join(named, "tree"))
    return descend(runs, heads).select("kid.doc_id", F.col("kid.digest").alias("leaf"), "subroot", "root", "path", *(F.col(f"kid.{c}").alias(c) for c in carried))


def changed_leaf(changed: Column, fields: tuple[str, ...] = FIELDS, text: str = "text") -> Column:
    """The leaf with the text in lower case where ``changed`` holds, else null."""
    return F.when(changed, leaf_digest([lowered(F.col(f)) if f == text else F.col(f) for f in fields]))


def verify(proofs: DataFrame, claimed: Column) -> DataFrame:
    """``proofs`` with proof_sha256, folded_root - of ``claimed``, a leaf - and verified, instead of the paths."""
    out = proofs.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", fold(claimed, F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path")
