"""Packing token sequences into windows by best-fit decreasing.

Documents are tokenised in Arrow batches; words that recur are encoded once per
worker. Overlong documents are first cut into full windows; every remaining piece
goes to a packing group by the hash of its id, some thousand pieces each, and each
group is packed on its own: longest piece first, into the open window that it fills
most tightly, found by a segment tree over remaining capacities. A group's size does
not depend on any key of the data, so a hot source cannot make one large.

Defined results: null or empty text is the end id alone; ties in length go by doc_id
and start; repeated rows are packed each; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import shared, text_buffer, trimmed

WINDOW = 4096
END_ID = 2
#: Pieces in one packing group, on average.
GROUP = 4096
#: Entries a worker's word cache holds before it starts anew, and bytes of text encoded at a time.
CACHE, SLICE = 700_000, 2 << 20

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordEncoder:
    """Ids of texts, word by word: the vocabulary's rules never look across ASCII white space."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def _learn(self, words: set[bytes]) -> None:
        new = list(words)
        found = [e.ids for e in self.tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(sizes.sum()))
        at = len(self.index)
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, flat])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each text's bounds in them.

        The vocabulary ignores case, so A-Z are lowered first, but for texts that may spell a special token.
        """
        words, counts = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = (t if b"<|" in t else t.lower()).split()
            counts[k] = len(own)
            words += own
        if len(self.index) > CACHE:
            self.reset()
        place = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(place < 0)):
            new = new.tolist()
            self._learn({words[k] for k in new})
            place[new] = [self.index[words[k]] for k in new]
        first, size = self.bounds[place], self.bounds[place + 1] - self.bounds[place]
        ends = np.cumsum(size)
        flat = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]
        word_at = np.concatenate([[0], np.cumsum(counts)])
        return flat, np.concatenate([[0], ends])[word_at]


def slices(ids: pa.Array, texts: pa.Array, size: int = SLICE) -> Iterator[tuple[list, list[bytes]]]:
    """The rows of a batch, about ``size`` bytes of text at a time."""
    data, offs = text_buffer(texts)
    doc_ids, at = ids.to_pylist(), 0
    while at < len(doc_ids):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        raw, low = data[offs[at] : offs[to]].tobytes(), offs[at]
        yield doc_ids[at:to], [raw[offs[i] - low : offs[i + 1] - low] for i in range(at, to)]
        at = to


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """This worker's encoder; its word cache outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _tokenise(path: str, with_ids: bool):
    def run(batches):
        encoder = encoder_of(path)
        for b in batches:
            for doc_ids, texts in slices(b.column(0), b.column(1)):
                flat, bounds = encoder.encode(texts)
                rows, pieces = [], []
                for k, d in enumerate(doc_ids):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(ids), WINDOW):
                        piece = ids[s : s + WINDOW]
                        rows.append((d, s, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
                        if with_ids:
                            pieces.append(piece)
                arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    arrays.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces of at most a window, with their ids if asked."""
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(_tokenise(path, with_ids)), schema)


class CapacityTree:
    """Open windows by remaining capacity; a segment tree finds the tightest that still fits."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        i, count = capacity + self.leaves, self.count
        while i:
            count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The open window of least capacity >= size, removed from the tree."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return capacity, self.open[capacity].pop()


def best_fit(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; ``lengths`` come longest first."""
    tree, fresh = CapacityTree(window), 0
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, size in enumerate(lengths.tolist()):
        found = tree.take(size)
        if found is None:
            found, fresh = (window, fresh), fresh + 1
        capacity, where[k] = found
        offset[k] = window - capacity
        if capacity > size:
            tree.put(capacity - size, int(where[k]))
    return where, offset


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable")
    where, offset = best_fit(pdf["length"].to_numpy())
    return pd.DataFrame({"_piece": pdf["_piece"], "offset": offset, "sequence_id": (pdf["_part"].to_numpy(np.int64) << 24) + where})


def pack(cut: DataFrame) -> DataFrame:
    """Place pieces into windows: adds sequence_id and offset. Only lengths go through the groups; ids are joined to their places."""
    cut = shared(cut.withColumn("_piece", F.monotonically_increasing_id()))
    groups = max(1, cut.count() // GROUP)
    part = F.pmod(F.xxhash64("_piece"), F.lit(groups)).alias("_part")
    placed = cut.select("_piece", "doc_id", "start", "length", part).groupBy("_part").applyInPandas(_pack, "_piece long, offset long, sequence_id long")
    return cut.join(placed, "_piece").drop("_piece")


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """All pieces of ``docs`` with their places: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]."""
    return pack(pieces(docs, path, id_col, text, with_ids))
