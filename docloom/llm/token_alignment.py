"""Alignment of two tokenizers: which tokens of one overlap which of the other, and how often over the corpus.

A text is tokenised twice, by a byte-level BPE with a space before it (side A) and by a
piece BPE that adds one (side B). Byte offsets where tokens of both end cut the text in
groups; an A and a B token whose byte ranges overlap are linked.

1. Texts are cut before spaces and line ends that follow other characters: no token of
   either side crosses such a place. A distinct chunk is tokenised once for each worker
   until its cache starts anew.
2. Each slice of documents is a block. Its distinct links of a document go to rows, one for
   each stripe of A ids (id modulo ``STRIPES``): distinct id pairs, the documents that
   have each, and how often. These rows are written to the shared folder.
3. Counts: rows of a stripe add the numbers of documents into dense matrices of a stripe's
   ids by B ids, some A ids at a time (np.add.at). Rows are dealt by stripe and salt
   first, then the salts' cells of a stripe are added; row maxima give each A id's best count.
4. Scores: link rows are dealt by (stripe, salt) again and meet the stripe's cells there;
   what leaves are sums by document and stripe, which meet the documents by block.

A salt's group holds a bounded share of a partition's links, so an id with a third of
all links is spread over its salts; cells of a stripe are bounded by the two vocabularies.

Defined results: null and empty texts, and texts whose joined token bytes are not the
space and the text, have no tokens: zeros and an empty string; repeated rows count as
documents of their own; an empty table gives no rows; extra columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import golomb
from docloom.llm.common import shared, shares, trimmed
from docloom.llm.packing import slices

#: Stripes of A ids; A ids of a dense matrix, of some 16 MB.
STRIPES, ROWS = 32, 64
#: B ids are below this.
WIDTH = 1 << 15
#: Chunks that a worker remembers before it starts anew; bytes of text and links of a block; documents of a block at most.
CACHE, SLICE, HELD, DOCS = 300_000, 1 << 20, 1 << 19, 1 << 12
_SPACE = "▁"
#: Before a space or line end, after a printable ASCII character or one of U+00C0 to U+07FF: surely no white space.
_CUT = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf]))(?=[ \n])")


def byte_table() -> dict[str, int]:
    """The byte of each character that byte-level BPE writes bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers, the bytes of their tokens, and what distinct chunks of text give."""

    def __init__(self, a_path: str, b_path: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        code = byte_table()
        special = {i for i, x in self.a.get_added_tokens_decoder().items() if x.special}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [b"" if i in special else bytes(code[c] for c in names[i]) for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        if len(self.b_bytes) > WIDTH:
            raise ValueError("the second vocabulary has too many ids")
        self.b_space = self.b.piece_to_id(_SPACE)
        self.sizes = [np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes)]
        #: Each id in decimal with the sign that follows it in a group's text: inside a side, after side A, after side B.
        self.n_ids = max(len(self.a_bytes), len(self.b_bytes))
        self.marked = [b"%d%s" % (i, sign) for sign in (b",", b"|", b";") for i in range(self.n_ids)]
        if any(b" " in x.lstrip(b" ") or b"\n" in x[:-1] or x[1:].endswith(b"\n") for x in self.b_bytes):
            raise ValueError("a token of the second vocabulary spans words")
        self.reset()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return b"" if self.b.is_control(i) or self.b.is_unknown(i) else self.b.id_to_piece(i).replace(_SPACE, " ").encode()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.count: np.ndarray = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.groups: list[bytes | None] = []  # None: joined bytes differ from the chunk
        self.codes, self.bounds = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def chunks(self, text: bytes) -> list[bytes]:
        return _CUT.split(b" " + text)

    def _sides(self, chunks: list[bytes]):
        """Ids of both sides of each chunk."""
        texts = [c.decode() for c in chunks]
        a = [e.ids for e in self.a.encode_batch(texts, add_special_tokens=False)]
        # a chunk starts with the space that side B adds, or with a line end, before which the added space goes
        b = self.b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            if t[0] != " ":
                b[k] = b[k][1:] if b[k][:1] == [self.b_space] else []
            elif t == " ":
                b[k] = [self.b_space]
        return a, b

    def _learn(self, new: list[bytes]) -> None:
        """Align new chunks, all at once.

        The ends of the tokens of both sides, laid end to end, cut the bytes in stretches; each
        stretch lies in one A and one B token and is one link, and ends of both sides close a group.
        """
        sides, n = self._sides(new), len(new)
        sizes = np.fromiter(map(len, new), np.int64, n)
        counts = [np.fromiter(map(len, x), np.int64, n) for x in sides]
        ids = [np.fromiter(chain.from_iterable(x), np.int64, c.sum()) for x, c in zip(sides, counts, strict=True)]
        surfaces, whole = (self.a_bytes, self.b_bytes), b"".join(new)
        good = np.ones(n, bool)
        if any(b"".join([t[i] for i in own.tolist()]) != whole for t, own in zip(surfaces, ids, strict=True)):
            good[:] = [all(b"".join([t[i] for i in own]) == c for t, own in zip(surfaces, (a, b), strict=True)) for c, a, b in zip(new, *sides, strict=True)]
            ids = [own[np.repeat(good, c)] for own, c in zip(ids, counts, strict=True)]
            counts = [np.where(good, c, 0) for c in counts]
        ends = [np.cumsum(t[own]) for t, own in zip(self.sizes, ids, strict=True)]
        close = np.cumsum(np.where(good, sizes, 0))
        cuts, both = np.union1d(*ends), np.intersect1d(*ends, assume_unique=True)
        a, b = (own[np.searchsorted(e, cuts)] for own, e in zip(ids, ends, strict=True))
        per = lambda points: np.diff(np.searchsorted(points, close, "right"), prepend=0)
        # tokens in the order of the groups' text: of each group side A, then side B
        key = np.concatenate([2 * np.searchsorted(both, e) + side for side, e in enumerate(ends)])
        order = np.argsort(key, kind="stable")
        key = key[order]
        last = np.append(key[1:] != key[:-1], True)[: len(key)]
        mark = np.where(last, 1 + key % 2, 0)
        parts = [self.marked[k] for k in (mark * self.n_ids + np.concatenate(ids)[order]).tolist()]
        bounds = np.append(0, np.cumsum(counts[0] + counts[1])).tolist()
        self.groups += [b"".join(parts[x:y])[:-1] if ok else None for x, y, ok in zip(bounds, bounds[1:], good.tolist(), strict=False)]
        at = len(self.index)
        self.index.update(zip(new, range(at, at + n), strict=True))
        self.count = np.concatenate([self.count, np.stack([*counts, per(both)], 1)])
        self.codes = np.concatenate([self.codes, a * WIDTH + b])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(per(cuts))])

    def align(self, texts: list[bytes]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """For each text n_a, n_b, n_groups and the digest of its groups; link codes of all texts and their bounds."""
        cut = [self.chunks(t) if t else [] for t in texts]
        flat = [c for own in cut for c in own]
        if len(self.index) > CACHE:
            self.reset()
        place = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        if len(new := np.flatnonzero(place < 0)):
            new = new.tolist()
            self._learn(list({flat[k]: None for k in new}))
            place[new] = [self.index[flat[k]] for k in new]
        at, digests, groups = np.append(0, np.cumsum([len(x) for x in cut])), [], self.groups
        keep = np.ones(len(flat), bool)
        for k, own in enumerate(cut):
            parts = [groups[p] for p in place[at[k] : at[k + 1]].tolist()]
            if own and None not in parts:
                digests.append(hashlib.sha256(b";".join(parts)).hexdigest())
            else:
                digests.append("")
                keep[at[k] : at[k + 1]] = False
        owner = np.repeat(np.arange(len(texts)), np.diff(at))[keep]
        place = place[keep]
        counts = np.zeros((len(texts), 3), np.int64)
        np.add.at(counts, owner, self.count[place])
        size = self.bounds[place + 1] - self.bounds[place]
        ends = np.cumsum(size)
        codes = self.codes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bounds[place] - (ends - size), size)]
        return counts, digests, codes, np.repeat(owner, size)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair_of(a_path: str, b_path: str) -> Pair:
    """This worker's pair of tokenizers; its chunks outlive a task."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def _packed(values: np.ndarray) -> bytes:
    """Small positive numbers, by the least type that holds them all."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(values) or values.max() <= np.iinfo(k).max)
    return kind[2].encode() + values.astype(kind).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[:1].decode()}", offset=1).astype(np.int64)


def _link_rows(block: int, codes: np.ndarray, doc: np.ndarray):
    """(block, stripe, pairs, docs of each, these documents, times) of a block's links, one row for each stripe."""
    order = np.lexsort((doc, codes))
    codes, doc = codes[order], doc[order]
    first = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (doc[1:] != doc[:-1])))
    times = np.diff(np.append(first, len(codes)))
    codes, doc = codes[first], doc[first]
    stripe = codes // WIDTH % STRIPES
    for s in np.unique(stripe).tolist():
        own = stripe == s
        distinct, n = np.unique(codes[own], return_counts=True)
        yield block, s, golomb.encode(distinct), _packed(n), _packed(doc[own]), _packed(times[own])


_BLOCK = "block long, stripe int, codes binary, n binary, docs binary, times binary, heads binary"
_HEAD = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])


def _head_blob(ids: list, counts: np.ndarray, n_links: np.ndarray, digests: list[str]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HEAD) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, counts.T), pa.array(n_links), pa.array(digests, pa.string())], schema=_HEAD))
    return sink.getvalue().to_pybytes()


def _blocks(a_path: str, b_path: str):
    """Per block a row for each stripe, and one of stripe -1 with what the documents have by themselves."""
    names = ["block", "stripe", "codes", "n", "docs", "times", "heads"]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 5]

    def flush(block, held):
        ids, counts, digests, codes, doc = [], [], [], [], []
        for own_ids, own_counts, own_digests, own_codes, own_doc in held:
            codes.append(own_codes)
            doc.append(own_doc + len(ids))
            ids += own_ids
            counts.append(own_counts)
            digests += own_digests
        codes, doc = np.concatenate(codes), np.concatenate(doc)
        heads = _head_blob(ids, np.concatenate(counts), np.bincount(doc, minlength=len(ids)), digests)
        rows = [(block, -1, b"", b"", b"", b"", heads), *((*r, None) for r in (_link_rows(block, codes, doc) if len(codes) else ()))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        from pyspark import TaskContext

        pair, block = pair_of(a_path, b_path), TaskContext.get().partitionId() << 32
        held, n_docs, n_links = [], 0, 0
        for b in batches:
            for ids, texts in slices(b.column(0), b.column(1), SLICE):
                held.append((ids, *pair.align(texts)))
                n_docs, n_links = n_docs + len(ids), n_links + len(held[-1][3])
                if n_links > HELD or n_docs > DOCS:
                    yield flush(block, held)
                    held, n_docs, n_links, block = [], 0, 0, block + 1
        if held:
            yield flush(block, held)

    return run


def link_rows(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of documents with their links by stripe, in the shared folder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return shared(rows.mapInArrow(trimmed(_blocks(a_path, b_path)), _BLOCK))


def _added(codes: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of a stripe with their sums, and whether each is its A id's largest; a dense block of A ids at a time."""
    codes, n = np.concatenate(codes), np.concatenate(n)
    row = codes // WIDTH // STRIPES
    order = np.argsort(row // ROWS, kind="stable")
    codes, n, row = codes[order], n[order], row[order]
    out = []
    for low in np.unique(row // ROWS).tolist():
        a, z = np.searchsorted(row // ROWS, [low, low + 1])
        dense = np.zeros((ROWS, WIDTH), np.int64)
        np.add.at(dense, (row[a:z] - low * ROWS, codes[a:z] % WIDTH), n[a:z])
        i, j = np.nonzero(dense)
        count = dense[i, j]
        stripe = codes[a] // WIDTH % STRIPES
        out.append((((i + low * ROWS) * STRIPES + stripe) * WIDTH + j, count, count == dense.max(1)[i]))
    codes, n, best = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(codes)
    return codes[order], n[order], best[order]


def _sum_cells(pdf: pd.DataFrame) -> pd.DataFrame:
    codes, n, best = _added([golomb.decode(x).astype(np.int64) for x in pdf["codes"]], [_unpacked(x) for x in pdf["n"]])
    return pd.DataFrame({"stripe": pdf["stripe"].iloc[:1], "codes": [golomb.encode(codes)], "n": [_packed(n)], "best": [golomb.bitmap(best)]})


_CELLS = "stripe int, codes binary, n binary, best binary"


def salted(links: DataFrame, salts: int) -> DataFrame:
    return links.where("stripe >= 0").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))


def cells(links: DataFrame, salts: int) -> DataFrame:
    """By stripe: the linked id pairs, the number of documents that hold each, and which are the best of their A id."""
    rows = salted(links, salts).select("stripe", "salt", "codes", "n")
    parts = rows.groupBy("stripe", "salt").applyInPandas(_sum_cells, _CELLS).select("stripe", "codes", "n")
    return shared(parts.groupBy("stripe").applyInPandas(_sum_cells, _CELLS))


def pair_counts(cells: DataFrame) -> DataFrame:
    """(a, b, documents, best) of every linked id pair of the corpus, as rows."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                codes = golomb.decode(r["codes"]).astype(np.int64)
                columns = [codes // WIDTH, codes % WIDTH, _unpacked(r["n"]), golomb.unbitmap(r["best"], len(codes))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "documents", "best"])

    return cells.mapInArrow(run, "a long, b long, documents long, best boolean")


def _score(links: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    """Sums by document over the links of one stripe and salt."""
    known = golomb.decode(cells["codes"].iloc[0]).astype(np.int64)
    count, best = _unpacked(cells["n"].iloc[0]), golomb.unbitmap(cells["best"].iloc[0], len(known))
    out = []
    for block, codes, n, docs, times in zip(*(links[c] for c in ("block", "codes", "n", "docs", "times")), strict=True):
        at = np.repeat(np.searchsorted(known, golomb.decode(codes).astype(np.int64)), _unpacked(n))
        doc, times = _unpacked(docs), _unpacked(times)
        used, place = np.unique(doc, return_inverse=True)
        sums = np.zeros((2, len(used)), np.int64)
        np.add.at(sums[0], place, times * best[at])
        np.add.at(sums[1], place, times * count[at])
        out.append((block, _packed(used), _packed(sums[0]), _packed(sums[1])))
    return pd.DataFrame(out, columns=["block", "docs", "n_best", "count_sum"])


def _finish(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with their sums over all stripes."""
    blob = pdf.loc[pdf["heads"].notna(), "heads"].iloc[0]
    out = pa.ipc.open_stream(blob).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
    sums = np.zeros((2, len(out)), np.int64)
    for docs, n_best, count_sum in zip(pdf["docs"], pdf["n_best"], pdf["count_sum"], strict=True):
        if docs is not None:
            at = _unpacked(docs)
            sums[0, at] += _unpacked(n_best)
            sums[1, at] += _unpacked(count_sum)
    return out.assign(n_best=sums[0], count_sum=sums[1])


_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = link_rows(docs, a_path, b_path, id_col, text)
    salts = max(1, 4 * shares(docs) // STRIPES)
    spread = cells(links, salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = salted(links, salts).groupBy("stripe", "salt").cogroup(spread.groupBy("stripe", "salt"))
    sums = both.applyInPandas(lambda left, right: _score(left, right) if len(left) else _NO_SUMS, "block long, docs binary, n_best binary, count_sum binary")
    heads = links.where("stripe < 0").select("block", "heads")
    empty = F.lit(None).cast("binary")
    rows = heads.select("block", "heads", empty.alias("docs"), empty.alias("n_best"), empty.alias("count_sum")).unionByName(sums.withColumn("heads", empty))
    return rows.groupBy("block").applyInPandas(_finish, _OUT).select(*(c.split(" ")[0] for c in _OUT.split(", ")))


_NO_SUMS = pd.DataFrame({"block": np.zeros(0, np.int64), "docs": [], "n_best": [], "count_sum": []})
