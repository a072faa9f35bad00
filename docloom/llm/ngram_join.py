"""N-gram Jaccard self-join and its connected components.

A document's set are its distinct 4-word shingles, as 64-bit hashes. Two sets link
when 100 * overlap >= 85 * union. The join never lists the pairs of a group:

1. Each text is reduced to its set's size and a 128-bit set hash; equal sets become
   one row, whatever their number.
2. Exact document frequencies are counted by sending sorted, Golomb-coded shingle
   keys to owners of key ranges. The most frequent ``FREQUENT`` keys - a fixed bound -
   are broadcast and only put the shingles in order, rare ones first.
3. Linked sets share one of their first n - ceil(0.85 n) + 1 shingles in any common
   order (prefix bound). Owners gather these columns of the document by n-gram
   incidence matrix, split a column's rows where sizes rule links out, and keep each
   distinct group of rows once; columns of keys in more than ``HOT`` documents reach no
   owner and stay rows throughout. Groups that share rows are clustered, and a cluster -
   cut in runs of bounded size where it is large - is a block of rows.
   Before that, parities of the shingles in fixed cells part sets of a group that
   cannot link: each differing cell is a shingle that only one of two sets has.
   Groups above ``SIEVED`` sets skip this, so no task ever holds a larger one.
4. Only sets in some block fetch their shingles. A block's overlap counts are a sparse
   matrix product, a slab of columns at a time; a pair is dropped by size, then by the
   exact count, and a spanning forest of the links found is all that leaves the task.
5. Components come from alternating star contractions, each round written to the
   shared folder.

Defined results: null text and text without words have n_shingles 0 and are their own
component; texts of one to three words have one shingle; repeated rows count as equal
sets, rows of one id with different texts as different ones; a component without any id
has a null component_id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import golomb
from docloom.llm.common import bloom, frequent, mix64, shared, shares, split_by, text_buffer, trimmed, word_hashes

WORDS, PERCENT = 4, 85
#: Bits of a shingle key in the frequency count and in the candidate search; cut keys only add candidates.
DF_BITS, KEY_BITS = 40, 48
#: Keys that the order knows as frequent (16 bytes each), and the count from which one may be.
FREQUENT, LEAST_FREQUENT = 1 << 17, 8
#: Sets and shingles that a run of a cut group has; two runs meet in a block.
TILE, SHINGLES = 1024, 1 << 19
SLAB, SLICE, HELD = 2048, 1 << 20, 1 << 20
#: Sets above this size have the finer parity cells; larger groups than SIEVED go on unsieved.
LARGE, SIEVED = 3000, 8192
#: Documents from which a key's column is held as rows; parts in which sets of one size are ranked.
HOT, CELLS = 1 << 14, 64

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_sets(texts: pa.Array, size: int = WORDS):
    """Yields (row, sorted distinct hashes of shingles of ``size`` words) for each text of a batch."""
    data, offs = text_buffer(texts)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1)
        words, first = word_hashes(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        if len(words) >= size:
            m = len(words) - size + 1
            mixed = words[:m] * _MULT[0]
            for j in range(1, size):
                mixed += words[j : j + m] * _MULT[j]
            mixed = mix64(mixed)
        first = first.tolist()
        for k in range(to - at):
            a, b = first[k], first[k + 1]
            if b - a >= size:
                own = np.sort(mixed[a : b - size + 1])
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                yield at + k, own[keep]
            elif b > a:
                short = (words[a:b] * _MULT[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield at + k, mix64(np.array([short], np.uint64))
            else:
                yield at + k, np.zeros(0, np.uint64)
        at = to


def set_hash(own: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        a = mix64(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(own))
        b = mix64(own + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def parity(own: np.ndarray) -> bytes:
    """Parity of the set's shingles in each of 2048 cells, and in 16384 for sets too large for these.

    Each cell that differs between two sets is at least one shingle that only one has.
    """
    cells = lambda bits, shift: np.packbits(np.bincount((own >> np.uint64(shift)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()
    return cells(2048, 9) + (cells(16_384, 21) if len(own) > LARGE else b"")


def _signatures(batches):
    for b in batches:
        n, s1, s2 = np.zeros((3, b.num_rows), np.int64)
        bits: list[bytes | None] = [None] * b.num_rows
        for k, own in shingle_sets(b.column(1)):
            n[k] = len(own)
            if len(own):
                s1[k], s2[k] = set_hash(own)
                bits[k] = parity(own)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(s1), pa.array(s2), pa.array(bits, pa.binary())], ["doc_id", "row", "n", "s1", "s2", "bits"])


def _edges(keys: np.ndarray, bits: int, owners: int) -> np.ndarray:
    """Bounds of each owner's range in sorted keys of so many bits."""
    owner = (keys >> np.uint64(bits - 24)) * np.uint64(owners) >> np.uint64(24)
    return np.searchsorted(owner, np.arange(owners + 1, dtype=np.uint64))


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts that are mostly 1: places of the others, and these."""
    more = np.flatnonzero(counts > 1)
    places = golomb.encode(more.astype(np.uint64))
    return len(places).to_bytes(4, "little") + places + counts[more].astype("<u4").tobytes()


def _unpack_counts(blob: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(blob[:4], "little")
    out = np.ones(n, np.int64)
    out[golomb.decode(blob[4 : 4 + size]).astype(np.int64)] = np.frombuffer(blob, "<u4", offset=4 + size)
    return out


def _frequency_blocks(owners: int):
    def flush(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = _edges(keys, DF_BITS, owners)
        rows = [(o, golomb.encode(keys[a:b]), _pack_counts(counts[a:b])) for o, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["owner", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, own in shingle_sets(b.column(0)):
                held.append(own >> np.uint64(64 - DF_BITS))
                size += len(own)
                if size > HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [golomb.decode(b) for b in pdf["keys"]]
    counts = np.concatenate([_unpack_counts(b, len(k)) for b, k in zip(pdf["counts"], keys, strict=True)])
    keys = np.concatenate(keys)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total, keys = np.add.reduceat(counts, start), keys[start]
    often = total >= LEAST_FREQUENT
    return pd.DataFrame({"key": keys[often].view(np.int64), "df": total[often]})


def frequent_keys(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the most frequent shingles and their document frequencies; at most FREQUENT."""
    blocks = texts.select("text").mapInArrow(trimmed(_frequency_blocks(shares(texts))), "owner int, keys binary, counts binary")
    counted = shared(blocks.groupBy("owner").applyInPandas(_frequencies, "key long, df long"))
    found = frequent(counted, FREQUENT, "key", "df").sort_values("key")
    return found["key"].to_numpy(np.int64).astype(np.uint64), found["df"].to_numpy(np.int64)


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def prefix(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set by (frequency, hash): as many as the bound needs."""
    keys, df = frequent
    p = prefix_length(len(own))
    if not len(keys):
        return own[:p]
    short = own >> np.uint64(64 - DF_BITS)
    at = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
    known = keys[at] == short
    rare = own[~known]
    if len(rare) >= p:
        return rare[:p]
    often = own[known]
    return np.concatenate([rare, often[np.lexsort((often, df[at[known]]))[: p - len(rare)]]])


def _candidate_blocks(shared_frequent, owners: int):
    """Per owner: the coded prefix keys, how many sets each has here, these sets, their hashes and sizes.

    Hot keys' entries have owner -1.
    """

    def row(o, keys, member, s1, n):
        distinct, counts = np.unique(keys, return_counts=True)
        used, place = np.unique(member, return_inverse=True)
        return o, golomb.encode(distinct), _pack_counts(counts), place.astype("<u4").tobytes(), s1[used].tobytes(), n[used].astype("<u4").tobytes()

    def flush(tokens, members, hot):
        sizes = np.array([len(t) for t in tokens])
        keys = np.concatenate(tokens) >> np.uint64(64 - KEY_BITS)
        member = np.repeat(np.arange(len(tokens)), sizes)
        order = np.argsort(keys, kind="stable")
        keys, member = keys[order], member[order]
        s1, n = (np.array(x, np.int64) for x in zip(*members, strict=True))
        often = np.isin(keys >> np.uint64(KEY_BITS - DF_BITS), hot)
        rows = [row(-1, keys[often], member[often], s1, n)] if often.any() else []
        keys, member = keys[~often], member[~often]
        edges = _edges(keys, KEY_BITS, owners)
        rows += [row(o, keys[a:b], member[a:b], s1, n) for o, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        names = ["owner", "keys", "counts", "places", "sets", "sizes"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int32() if not i else pa.binary()) for i in range(6)], names)

    def run(batches):
        often, hot = shared_frequent.value
        tokens, members, seen, size = [], [], set(), 0
        for b in batches:
            for _, own in shingle_sets(b.column(0)):
                if len(own) and (s := set_hash(own)) not in seen:
                    seen.add(s)
                    tokens.append(prefix(own, often))
                    members.append((s[0], len(own)))
                    size += len(tokens[-1])
                    if size > HELD:
                        yield flush(tokens, members, hot)
                        tokens, members, seen, size = [], [], set(), 0
        if tokens:
            yield flush(tokens, members, hot)

    return run


def _entries(keys: bytes, counts: bytes, places: bytes, s1: bytes, n: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A coded block's entries: key, set and its size."""
    keys, at = golomb.decode(keys), np.frombuffer(places, "<u4")
    return np.repeat(keys, _unpack_counts(counts, len(keys))), np.frombuffer(s1, np.int64)[at], np.frombuffer(n, "<u4")[at].astype(np.int64)


def _hot_rows(batches):
    """Entries of hot keys as rows; each key is a group."""
    for b in batches:
        for r in b.to_pylist():
            tok, sets, size = _entries(r["keys"], r["counts"], r["places"], r["sets"], r["sizes"])
            yield pa.RecordBatch.from_arrays([pa.array(mix64(tok).view(np.int64)), pa.array(sets), pa.array(size)], ["block", "s1", "n"])


def _groups(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's columns: the sets of compatible size that share a prefix key, each distinct group once."""
    blocks = (_entries(*x) for x in zip(pdf["keys"], pdf["counts"], pdf["places"], pdf["sets"], pdf["sizes"], strict=True))
    tok, sets, size = map(np.concatenate, zip(*blocks, strict=True))
    # columns with one row hold no pair
    order = np.argsort(tok, kind="stable")
    tok, sets, size = tok[order], sets[order], size[order]
    same = tok[1:] == tok[:-1]
    live = np.append(same, False) | np.append(False, same)
    tok, sets, size = tok[live], sets[live], size[live]
    order = np.lexsort((sets, size, tok))
    tok, sets, size = tok[order], sets[order], size[order]
    fresh = np.append(True, (tok[1:] != tok[:-1]) | (sets[1:] != sets[:-1]))[: len(tok)]
    tok, sets, size = tok[fresh], sets[fresh], size[fresh]
    start = np.flatnonzero(np.append(True, (tok[1:] != tok[:-1]) | (100 * size[:-1] < PERCENT * size[1:]))[: len(tok)])
    end = np.append(start[1:], len(tok))[: len(start)]
    many = end - start > 1
    start, end = start[many], end[many]
    code = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(sets.view(np.uint64)), dtype=np.uint64)])
    name = mix64(code[end] - code[start] + (end - start).astype(np.uint64))
    name, once = np.unique(name, return_index=True)
    start, length = start[once], (end - start)[once]
    at = np.repeat(start - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum()) if len(once) else np.zeros(0, np.int64)
    return pd.DataFrame({"block": np.repeat(name, length).view(np.int64), "s1": sets[at], "n": size[at]})


def _may_link(n: np.ndarray, small: np.ndarray, large: np.ndarray, has_large: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Which sets may link with set ``k``: sizes and differing parities leave room for the overlap."""
    both = n + n[k]
    room = both - 2 * -(-percent * both // (100 + percent))
    ok = 100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k])
    ok &= np.bitwise_count(small ^ small[k]).sum(1) <= room
    if has_large[k]:
        ok[has_large] &= np.bitwise_count(large ^ large[np.searchsorted(np.flatnonzero(has_large), k)]).sum(1) <= room[has_large]
    return ok


def _split_group(n: np.ndarray, bits: list[bytes], percent: int = PERCENT) -> np.ndarray:
    """Label of each set's component under ``_may_link``; -1 for sets that may link with none."""
    small = np.frombuffer(b"".join(b[:256] for b in bits), np.uint64).reshape(-1, 32)
    has_large = np.array([len(b) > 256 for b in bits])
    large = np.frombuffer(b"".join(b[256:] for b in bits), np.uint64).reshape(-1, 256)
    label, m = np.full(len(n), -1), len(n)
    left = np.ones(m, bool)
    for seed in range(m):
        if not left[seed]:
            continue
        queue, left[seed] = [seed], False
        while queue:
            k = queue.pop()
            new = np.flatnonzero(_may_link(n, small, large, has_large, k, percent) & left)
            left[new] = False
            if len(new) or k != seed:
                label[k] = label[new] = seed
            queue += new.tolist()
    return label


def _sieve(percent: int):
    """Rows come sorted by block: (block, s1, n, bits); groups lose sets that can link with none in them."""

    def solve(block, s1, n, bits):
        keys, first = np.unique(np.array(s1, np.int64), return_index=True)
        n = np.array(n, np.int64)[first]
        label = _split_group(n, [bits[k] for k in first], percent)
        name = mix64(np.array([block], np.int64).view(np.uint64))[0] + label.astype(np.uint64)
        kept = label >= 0
        return mix64(name[kept]).view(np.int64), keys[kept], n[kept]

    def rows(found):
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "s1", "n"])

    def run(batches):
        now, held = None, ([], [], [])
        for b in batches:
            blocks, s1, n = (b.column(i).to_numpy() for i in range(3))
            bits, found = b.column(3), []
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if z > a:
                    if blocks[a] != now:
                        if len(held[0]) > 1:
                            found.append(solve(now, *held))
                        now, held = blocks[a], ([], [], [])
                    held[0].extend(s1[a:z].tolist())
                    held[1].extend(n[a:z].tolist())
                    held[2].extend(bits.slice(a, z - a).to_pylist())
            yield rows(found)
        yield rows([solve(now, *held)] if len(held[0]) > 1 else [])

    return run


def sieved(groups: DataFrame, signed: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Groups without the pairs that sizes and parities rule out; no linked pair is ever parted."""
    large = groups.groupBy("block").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > SIEVED).select("block")
    small = groups.join(large, "block", "left_anti")
    live = small.select("s1").distinct()
    bits = signed.where("n > 0").select("s1", "bits").join(live, "s1", "left_semi").groupBy("s1").agg(F.first("bits").alias("bits"))
    rows = small.join(bits, "s1").select("block", "s1", "n", "bits")
    rows = rows.repartition(shares(groups), "block").sortWithinPartitions("block").mapInArrow(trimmed(_sieve(percent)), "block long, s1 long, n long")
    return rows.union(groups.join(large, "block", "left_semi").select("block", "s1", "n")).distinct()


def placements(groups: DataFrame) -> DataFrame:
    """(s1, blocks): where each set's shingles must go so that every candidate pair meets.

    Groups that share sets form a cluster. A set goes once to its cluster, or to each of
    its groups where that is fewer rows; whatever has more than a tile's sets or shingles
    is cut in runs by size, and each two runs meet in a block of their own.
    """
    star = groups.groupBy("block").agg(F.min("s1").alias("a"))
    near = components(groups.join(star, "block").select("a", F.col("s1").alias("b")))
    named = near.select(F.col("id").alias("s1"), F.col("component").alias("cluster"))
    own = groups.join(named, "s1", "left").select("block", "s1", "n", F.coalesce("cluster", "s1").alias("cluster"))
    half = F.lit(TILE // 2)
    rows = lambda m: m * F.greatest(F.lit(1), F.ceil(m / half) - 1)
    in_groups = own.groupBy("block", "cluster").agg(F.count(F.lit(1)).alias("m")).groupBy("cluster").agg(F.sum(rows(F.col("m"))).alias("cost"))
    members = own.groupBy("cluster", "s1").agg(F.min("n").alias("n"))
    in_cluster = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    # written, so that the joins below are plain ones whose hot clusters adaptive execution can split
    whole = shared(in_cluster.join(in_groups, "cluster").select("cluster", (rows(F.col("m")) <= F.col("cost")).alias("whole")))
    by_cluster = members.join(whole.where("whole"), "cluster").select(F.col("cluster").alias("block"), "s1", "n")
    by_group = own.join(whole.where("not whole"), "cluster").select("block", "s1", "n")
    cut = shared(by_cluster.union(by_group).withColumn("cell", F.pmod(F.xxhash64("s1"), F.lit(CELLS))))
    # ranks by size without one task for a block: counts of small cells first, then ranks inside each cell
    cells = cut.groupBy("block", "n", "cell").agg(F.count(F.lit(1)).alias("m"))
    every = Window.partitionBy("block")
    before = every.orderBy("n", "cell").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda sets, shingles: F.greatest(F.floor(sets / half), F.floor(shingles / SHINGLES)).cast("int")
    cells = cells.select(
        "block", "n", "cell",
        F.coalesce(F.sum("m").over(before), F.lit(0)).alias("sets"),
        F.coalesce(F.sum(F.col("m") * F.col("n")).over(before), F.lit(0)).alias("shingles"),
        place(F.sum("m").over(every) - 1, F.sum(F.col("m") * F.col("n")).over(every) - F.max("n").over(every)).alias("last"),
    )
    k = F.row_number().over(Window.partitionBy("block", "n", "cell").orderBy("s1")) - 1
    ranked = cut.join(cells, ["block", "n", "cell"]).withColumn("k", k)
    ranked = ranked.withColumn("run", place(F.col("sets") + F.col("k"), F.col("shingles") + F.col("k") * F.col("n")))
    other = F.filter(F.sequence(F.lit(0), F.col("last")), lambda j: (j != F.col("run")) | (F.col("last") == 0))
    met = F.transform(other, lambda j: F.xxhash64("block", F.least("run", j), F.greatest("run", j)))
    return ranked.select("s1", F.explode(met).alias("block")).distinct().groupBy("s1").agg(F.collect_list("block").alias("blocks"))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all pairs: the incidence matrix times its transpose, a slab of columns at a time."""
    sizes = np.array([len(s) for s in sets])
    columns, place = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    useful = np.bincount(place)[place] > 1
    place, row = place[useful], row[useful]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    if len(place):
        place = np.cumsum(np.append(0, np.diff(place) != 0))
        for low in range(0, int(place[-1]) + 1, SLAB):
            a, b = np.searchsorted(place, [low, low + SLAB])
            block = np.zeros((len(sets), min(SLAB, int(place[b - 1]) - low + 1)), np.float32)
            block[row[a:b], place[a:b] - low] = 1
            out += block @ block.T
    return out.astype(np.int64)


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``: (smaller id of the tree, id)."""
    n = np.array([len(s) for s in sets])
    if len(ids) == 2:
        if 100 * n.min() < percent * n.max():
            return []
        both = np.concatenate(sets)
        both.sort()
        c = int((both[1:] == both[:-1]).sum())
        return [(int(ids.min()), int(ids.max()))] if 100 * c >= percent * (int(n.sum()) - c) else []
    c = overlaps(sets)
    linked = 100 * c >= percent * (n[:, None] + n[None, :] - c)
    label = ids.copy()
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        least = np.minimum(least, label)
        if (least == label).all():
            break
        label = least
    return [(int(a), int(b)) for a, b in zip(label, ids, strict=True) if a != b]


def _verify(percent: int):
    """Rows come sorted by block: (block, node, tokens)."""

    def solve(ids, sets):
        ids, first = np.unique(np.array(ids, np.int64), return_index=True)
        return forest(ids, [sets[k] for k in first], percent) if len(ids) > 1 else []

    def run(batches):
        now, ids, sets = None, [], []
        for b in batches:
            blocks, reps, tokens = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            flat = tokens.values.to_numpy().view(np.uint64)
            offs = tokens.offsets.to_numpy()
            edges, found = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)], []
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if z > a:
                    if blocks[a] != now:
                        found += solve(ids, sets) if len(ids) > 1 else []
                        now, ids, sets = blocks[a], [], []
                    ids += reps[a:z].tolist()
                    sets += [flat[offs[k] : offs[k + 1]] for k in range(a, z)]
            sets = [s.copy() for s in sets]  # the batch's buffer goes
            yield _links(found)
        yield _links(solve(ids, sets) if len(ids) > 1 else [])

    return run


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _tokens(words: int):
    """Each asked-for set's shingles once for each of its blocks; another text with its row key is left out."""

    def run(batches):
        for b in batches:
            s1, nodes, blocks, out, size = b.column(0).to_numpy(), b.column(1).to_pylist(), b.column(2).to_pylist(), [], 0
            for k, own in shingle_sets(b.column(3), words):
                if len(own) and set_hash(own)[0] == s1[k]:
                    out += [(x, nodes[k], own) for x in blocks[k]]
                    size += len(own) * len(blocks[k])
                if size > HELD:
                    yield _rows(out)
                    out, size = [], 0
            yield _rows(out)

    return run


def _rows(out: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    offs = np.concatenate([[0], np.cumsum([len(x) for *_, x in out])]).astype(np.int32)
    flat = np.concatenate([x for *_, x in out]).view(np.int64) if out else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))
    return pa.RecordBatch.from_arrays([pa.array([x for x, *_ in out], pa.int64()), pa.array([r for _, r, _ in out], pa.int64()), lists], ["block", "node", "tokens"])


_ROW = "struct<none: boolean, id: long, text: long>"


def _row_key(id_col: str, text: str) -> Column:
    """Names a row by its id and its text's hash; null ids are one id."""
    own = F.col(id_col).cast("long")
    return F.struct(own.isNull().alias("none"), F.coalesce(own, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("text"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row key, set size, 128-bit set hash and parity cells of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"), _row_key(id_col, text).alias("row"))
    return rows.mapInArrow(trimmed(_signatures), f"doc_id long, row {_ROW}, n long, s1 long, s2 long, bits binary")


def distinct_sets(signed: DataFrame) -> DataFrame:
    """The distinct sets with words, each with a node number, its least doc_id and a row that has it."""
    sets = signed.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"))
    return shared(sets.withColumn("node", F.monotonically_increasing_id()))


def text_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(_row_key(id_col, text).alias("row"), F.col(text).alias("text"))


def candidates(rows: DataFrame) -> DataFrame:
    """(block, s1, n): distinct groups of sets that share a shingle of their prefixes."""
    keys, df = frequent_keys(rows)
    held = rows.sparkSession.sparkContext.broadcast(((keys, df), keys[df > HOT]))
    blocks = shared(rows.select("text").mapInArrow(trimmed(_candidate_blocks(held, shares(rows))), "owner int, keys binary, counts binary, places binary, sets binary, sizes binary"))
    few = blocks.where("owner >= 0").groupBy("owner").applyInPandas(_groups, "block long, s1 long, n long")
    hot = blocks.where("owner < 0").mapInArrow(trimmed(_hot_rows), "block long, s1 long, n long")
    return shared(few.union(hot).distinct())


def confirmed(rows: DataFrame, signed: DataFrame, sets: DataFrame, groups: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Spanning links (a, b) between the nodes of distinct sets that share a group, each by the whole sets; may repeat."""
    placed = placements(shared(sieved(groups, signed, percent)))
    # equal rows share a key, so a set's blocks may come twice; they are made distinct where they meet
    asked = shared(sets.join(placed, "s1").select("s1", "node", "row", "blocks"))
    wanted, _ = split_by(rows, F.xxhash64("row"), bloom(asked.select(F.xxhash64("row"))))
    fetched = asked.join(wanted, "row").select("s1", "node", "blocks", "text")
    tokens = fetched.mapInArrow(trimmed(_tokens(words)), "block long, node long, tokens array<bigint>")
    return tokens.repartition(shares(rows), "block").sortWithinPartitions("block").mapInArrow(trimmed(_verify(percent)), "a long, b long").distinct()


def links(docs: DataFrame, signed: DataFrame, sets: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Spanning links (a, b) between the nodes of distinct sets; may repeat."""
    rows = text_rows(docs, id_col, text)
    return confirmed(rows, signed, sets, candidates(rows))


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id with a link: alternating large and small stars until nothing changes."""
    edges = shared(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    print_of = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before, after = None, print_of(edges)
    while after[0] and after != before:
        # large star: larger neighbours of u point to the least of u and its neighbours
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: smaller neighbours of u, and u, point to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b")))).alias("e"))
        edges = shared(small.select("e.a", "e.b").where("a <> b").distinct())
        before, after = after, print_of(edges)
    return edges.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component"))


def grouped(signed: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """One row per signed row: doc_id, row key, n, and the least doc_id of its component, null where none has an id."""
    found = components(found)
    named = shared(sets.join(found, sets["node"] == found["id"], "left").select("s1", "s2", "rep", F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("s1", "s2", "component", "component_id")
    return signed.select("doc_id", "row", "n", "s1", "s2").join(named, ["s1", "s2"], "left")


def members(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their components; see ``grouped``."""
    signed = shared(signatures(docs, id_col, text))
    sets = distinct_sets(signed)
    return grouped(signed, sets, links(docs, signed, sets, id_col, text))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return members(docs, id_col, text).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows without words stay.

    Of several rows with that id (or, where no row of a component has an id, of all its
    rows) the one of least row key stays, and one of rows equal in id and text. Rows whose
    key is surely not among the dropped ones pass unshuffled.
    """
    rows = shared(members(docs, id_col, text).where("n > 0").select("component", "row"))
    kept = rows.groupBy("component").agg(F.min("row").alias("kept"), F.count(F.lit(1)).alias("m")).where("m > 1")
    many = shared(rows.join(kept, "component").groupBy("row").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("n")))
    drop, twice = many.where("row <> kept").select("row"), many.where("row = kept and n > 1").select("row")
    doubtful, clear = split_by(docs, F.xxhash64(_row_key(id_col, text)), bloom(drop.union(twice).select(F.xxhash64("row"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = doubtful.select(_row_key(id_col, text).alias("row"), F.struct(*columns).alias("all"))
    single = keyed.join(drop.union(twice), "row", "left_anti").select("all.*")
    one = keyed.join(twice, "row").groupBy("row").agg(F.first("all").alias("all")).select("all.*")
    return clear.unionByName(single).unionByName(one)
