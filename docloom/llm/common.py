"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.sources.shared import shared, shares  # noqa: F401

#: ASCII white space; a word is a maximal run of other characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/documents.parquet")


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def trimmed(run: Callable) -> Callable:
    """``run`` over the batches of a task, then the memory that it freed goes back to the system.

    Python workers outlive their tasks; without this each keeps the most it ever held.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return task


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def frequent(rows: DataFrame, most: int, key: str, n: str, *more: str) -> pd.DataFrame:
    """The keys of the highest counts, at most ``most``, with any further columns: all of each count level or none.

    A histogram of fewer than 1,100 levels - each count below 64, then sixteenths of a
    doubling - gives the least count to take, so the driver receives no row too many.
    """
    level = F.when(F.col(n) < 64, F.col(n)).otherwise((F.log2(F.col(n).cast("double")) * 16).cast("long"))
    above, least = 0, None
    for r in sorted(rows.groupBy(level.alias("level")).count().collect(), reverse=True):
        above += r["count"]
        if above > most:
            break
        least = r["level"]
    if least is None:
        return pd.DataFrame({key: np.zeros(0, np.int64), n: np.zeros(0, np.int64)} | {c: [] for c in more})
    return rows.where(level >= least).select(key, n, *more).toPandas()


#: Bits of a filter for each key, and the most that a filter has (32 MB).
BLOOM_BITS, BLOOM_MOST, _RANGES = 8, 1 << 28, 64


def _probes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two places of each key among ``bits``, a power of two."""
    mixed = mix64(keys.view(np.uint64))
    return np.concatenate([mixed & np.uint64(bits - 1), (mixed >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


def bloom(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of a column of longs, as packed bits; ``keys`` is read twice.

    It has BLOOM_BITS a key up to BLOOM_MOST bits in all, so the broadcast is bounded;
    beyond, it lets more rows through and nothing is lost. Each task sends its own
    bitmap in at most _RANGES parts; these are joined bit by bit in a tree whose groups
    hold the root of the number of tasks.
    """
    n = keys.count()
    bits = min(max(1 << 16, 1 << (BLOOM_BITS * n).bit_length()), BLOOM_MOST)
    width = bits // _RANGES // 8
    slots = math.isqrt(max(1, keys.rdd.getNumPartitions() - 1)) + 1

    def partial(batches):
        flags = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = np.unique(_probes(b.column(0).to_numpy(zero_copy_only=False), bits))
            if len(at):
                place = at >> 3
                start = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                flags[place[start]] |= np.bitwise_or.reduceat((128 >> (at & 7)).astype(np.uint8), start)
        used = [r for r in range(_RANGES) if flags[r * width : (r + 1) * width].any()]
        parts = [zlib.compress(flags[r * width : (r + 1) * width].tobytes(), 1) for r in used]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(parts, pa.binary())], ["range", "bits"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(width, np.uint8)
        for blob in pdf["bits"]:
            flags |= np.frombuffer(zlib.decompress(blob), np.uint8)
        return pd.DataFrame({"range": pdf["range"].iloc[:1], "bits": [zlib.compress(flags.tobytes(), 1)]})

    out = np.zeros(bits // 8, np.uint8)
    parts = keys.mapInArrow(trimmed(partial), "range int, bits binary").withColumn("slot", F.spark_partition_id() % slots)
    for by in (("range", "slot"), ("range",)):
        parts = parts.groupBy(*by).applyInPandas(join, "range int, bits binary")
    for r in parts.collect():
        out[r["range"] * width : (r["range"] + 1) * width] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def split_by(df: DataFrame, key: Column, bits: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose key may be in the filter, and rows whose key is not. No shuffle."""
    held = df.sparkSession.sparkContext.broadcast(bits)
    name = "_key"
    while name in df.columns:
        name += "_"

    def run(inside: bool):
        def pick(batches):
            flags, places = held.value, len(df_names)
            for b in batches:
                probes = _probes(b.column(places).to_numpy(zero_copy_only=False), len(flags) * 8)
                hit = (flags[probes >> 3] >> (7 - (probes & 7)).astype(np.uint8)) & 1
                maybe = hit[: b.num_rows] & hit[b.num_rows :] == 1
                yield pa.RecordBatch.from_arrays(b.columns[:places], schema=pa.schema(list(b.schema)[:places])).filter(pa.array(maybe == inside))

        return pick

    df_names = df.columns
    keyed = df.withColumn(name, key)
    return keyed.mapInArrow(trimmed(run(True)), df.schema), keyed.mapInArrow(trimmed(run(False)), df.schema)


def remainder(column: str, modulus: int):
    """crc32 of the decimal id modulo ``modulus``, the fold rule of the contracts."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array, without copying; null counts as empty."""
    array = array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, offsets, data = array.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64) if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        m = max(n, (1 << 20) + 1)
        for name, b in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(m, b, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _byte_table() -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    t[65:91] = t[97:123]  # A-Z as a-z
    return t


_LOWER = _byte_table()
_EXACT = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and each text's first word index (n + 1 values).

    Words are maximal runs without ASCII white space, A-Z lower-cased if asked.
    """
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inside = ~_SPACES[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    start[cuts] = inside[cuts]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    end[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    first = np.searchsorted(s, offs)
    out = np.empty(len(s), np.uint64)
    step = 1 << 20  # bytes at a time: bounds the memory of the running sums
    at = 0
    table = _LOWER if lower else _EXACT
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + step, "right")))
        b0, b1 = s[at], e[to - 1]
        up, down = _powers(b1 - b0 + 1)
        run = np.zeros(b1 - b0 + 1, np.uint64)
        np.cumsum(table[data[b0:b1]] * up[: b1 - b0], dtype=np.uint64, out=run[1:])
        ss, ee = s[at:to] - b0, e[at:to] - b0
        out[at:to] = mix64((run[ee] - run[ss]) * down[ss] + (ee - ss).astype(np.uint64))
        at = to
    return out, first
