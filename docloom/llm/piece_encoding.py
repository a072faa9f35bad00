"""Encoding and decoding with a SentencePiece BPE model by vectorised merge rounds.

A text is cut before each run of spaces (and line ends) - no piece of the model spans
such a place - and each distinct chunk is merged once per worker, many chunks at a
time in flat numpy arrays. Chunks are cut further between two characters that stand
together in no piece, as no merge can cross there. In every round each part's
best-ranked pair is found by a segmented minimum, its leftmost non-overlapping
occurrences are merged together, and the arrays are compacted, until no pair remains.
Where merging could make a pair that ranks as high as the current one, only the leftmost
occurrence is merged. A part of more than ``PART`` characters - a long run of one
character, say - would need a round for each rank and takes a queue of its pairs
instead, so rounds are bounded and time is near linear in the text. Characters without a
piece become byte pieces.

Defined results: null or empty text is the end id alone and decodes to the empty
text; rows are independent, so repeated rows and clashing extra columns do not
matter; an empty table gives no rows. Very long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re
from functools import cached_property
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.packing import slices

SPACE = "▁"
END_ID = 2
_NONE = np.int64(1) << 40
#: Chunks that a worker remembers before it starts anew.
CACHE = 400_000
#: Characters of a part that is merged in rounds; longer ones take a queue.
PART = 64


class PieceModel:
    """Tables of a model: symbols, ranked pairs, byte pieces."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        self.n, self.names = n, names
        self.bytes = np.array([next((i for i in (sp.piece_to_id(f"<0x{b:02X}>"),)), 0) for b in range(256)], np.int64)
        ids = {p: i for i, p in enumerate(names) if not special[i]}
        symbols = dict(ids)
        for p in ids:
            for c in p:
                symbols.setdefault(c, len(symbols) + n)
        self.nothing = n + len(symbols) + 1  # characters that no piece has
        scores = np.array([sp.get_score(i) for i in ids.values()])
        rank = dict(zip(ids, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        self.width = np.int64(self.nothing + 1)
        keys, ranks, merged, unsafe = [], [], [], set()
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    ranks.append(rank[p])
                    merged.append(i)
                    unsafe.update(s for s, x in ((a, p[:k]), (b, p[k:])) if rank.get(x, -1) >= rank[p])
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(ranks, np.int64)[order]
        self.merged = np.array(merged, np.int64)[order]
        self.unsafe = np.zeros(self.nothing + 1, bool)
        self.unsafe[list(unsafe)] = True
        self.chars = {ord(c): s for c, s in symbols.items() if len(c) == 1}
        #: Pairs of characters that stand together in some piece.
        self.joined = np.unique(np.array([ord(x) << 21 | ord(y) for p in ids for x, y in zip(p, p[1:], strict=False)], np.int64))
        self.cuts_lines = not any("\n" in p for p in ids)
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece of this model spans words")
        self.table = np.full(0x3000, self.nothing, np.int64)
        for cp, s in self.chars.items():
            if cp < len(self.table):
                self.table[cp] = s
        self.surface = [p.replace(SPACE, " ").encode() for p in names]
        for i in range(n):
            if special[i]:
                self.surface[i] = b""
        for b, i in enumerate(self.bytes.tolist()):
            self.surface[i] = bytes([b])

    def symbols(self, code: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(code, len(self.table) - 1)]
        for k in np.flatnonzero(code >= len(self.table)):
            out[k] = self.chars.get(int(code[k]), self.nothing)
        return out

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist(), strict=True), strict=True))

    def _parts(self, code: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Number of the part of each character: parts end with their word, and where no merge can cross."""
        pair = code[:-1] << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.joined, pair), len(self.joined) - 1)
        return np.append(0, np.cumsum((word[1:] != word[:-1]) | (self.joined[at] != pair)))

    def queued(self, sym: list[int]) -> list[int]:
        """Places of the symbols that remain of one part, merged in ``sym``: best rank first, then leftmost."""
        n, width, get = len(sym), int(self.width), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        now = [get(a * width + b) for a, b in zip(sym, sym[1:], strict=False)] + [None]
        heap = [x[0] << 40 | k for k, x in enumerate(now) if x]
        heapify(heap)
        gone = bytearray(n)
        while heap:
            top = heappop(heap)
            k = top & (1 << 40) - 1
            if gone[k] or now[k] is None or now[k][0] != top >> 40:
                continue
            other = after[k]
            sym[k], gone[other], after[k] = now[k][1], 1, after[other]
            if after[k] < n:
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0:
                    x = get(sym[left] * width + sym[after[left]]) if after[left] < n else None
                    now[left] = x
                    if x:
                        heappush(heap, x[0] << 40 | left)
        return [k for k in range(n) if not gone[k]]

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all chunks and each chunk's bounds."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(chunks)), np.fromiter(map(len, chunks), np.int64, len(chunks)))
        word = self._parts(code, owner) if len(code) else owner
        sym, cp = self.symbols(code), code
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))[: len(word)]
        sizes, of_part = np.diff(np.append(starts, len(word))), owner[starts]
        for k in np.flatnonzero(sizes > PART).tolist():
            own = sym[starts[k] : starts[k] + sizes[k]].tolist()
            at = np.array(self.queued(own), np.int64)
            done.append((np.full(len(at), k), np.array(own, np.int64)[at], cp[starts[k] + at]))
        if done:
            short = np.repeat(sizes <= PART, sizes)
            sym, cp, word = sym[short], cp[short], word[short]
        while len(sym):
            key = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], _NONE), _NONE)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, starts)
            spread = np.repeat(best, np.diff(np.append(starts, len(sym))))
            if (over := spread == _NONE).any():
                done.append((word[over], sym[over], cp[over]))
                live = ~over
                sym, cp, word, rank, spread = sym[live], cp[live], word[live], rank[live], spread[live]
                at = at[live[:-1]] if not len(sym) else np.append(at, 0)[live][:-1]
                if not len(sym):
                    break
            pick = np.flatnonzero(rank == spread)  # a part's last symbol never has a pair
            into = self.merged[at[pick]]
            run = np.append(True, np.diff(pick) != 1) | np.append(True, word[pick[1:]] != word[pick[:-1]])
            ordinal = np.arange(len(pick)) - np.maximum.accumulate(np.where(run, np.arange(len(pick)), 0))
            take = ordinal % 2 == 0
            risky = self.unsafe[into]
            if risky.any():
                leading = np.append(True, word[pick[1:]] != word[pick[:-1]])
                alone = np.zeros(len(of_part), bool)
                alone[word[pick[risky]]] = True
                take = np.where(alone[word[pick]], leading, take)
            pick, into = pick[take], into[take]
            sym[pick] = into
            keep = np.ones(len(sym), bool)
            keep[pick + 1] = False
            sym, cp, word = sym[keep], cp[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(chunks) + 1, np.int64)
        word, sym, cp = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, sym, cp = of_part[word[order]], sym[order], cp[order]
        foreign = np.flatnonzero(sym >= self.n)
        if len(foreign):
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in cp[foreign].tolist()]
            reps = np.ones(len(sym), np.int64)
            reps[foreign] = [len(r) for r in raw]
            out = np.repeat(sym, reps)
            out[np.repeat(sym >= self.n, reps)] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
            sym, word = out, np.repeat(word, reps)
        return sym, np.searchsorted(word, np.arange(len(chunks) + 1))

    def decode(self, ids) -> str:
        """The text of a sequence of ids: byte pieces are joined, the leading dummy space goes."""
        return without_prefix(b"".join(self.surface[i] for i in ids)).decode("utf-8", "replace")


def without_prefix(surface: bytes) -> bytes:
    return surface[1:] if surface[:1] == b" " else surface


class ChunkEncoder:
    """Ids and surfaces of chunks, each distinct one merged once until the cache starts anew."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.cut = re.compile(rb" +[^ \n]*|\n[^ \n]*" if self.model.cuts_lines else rb" +[^ ]*")
        self.known: dict[bytes, tuple[int, bytes, bytes]] = {}

    def chunks(self, text: bytes) -> list[bytes]:
        text = text.replace(SPACE.encode(), b" ")
        return self.cut.findall(b" " + text) if text else []

    def learn(self, wanted: set[bytes]) -> None:
        new = list(wanted)
        ids, bounds = self.model.merge([c.decode().replace(" ", SPACE) for c in new])
        ids, bounds, surface = ids.tolist(), bounds.tolist(), self.model.surface
        for k, c in enumerate(new):
            own = ids[bounds[k] : bounds[k + 1]]
            self.known[c] = (len(own), " ".join(map(str, own)).encode(), b"".join([surface[i] for i in own]))

    def digest(self, texts: list[bytes]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, digest of the ids, digest of the decoded text."""
        cut = [self.chunks(t) for t in texts]
        wanted = set().union(*cut)
        if len(self.known) > CACHE:
            self.known = {}
        if wanted := wanted.difference(self.known):
            self.learn(wanted)
        out, get, end = [], self.known.__getitem__, str(END_ID).encode()
        for own in cut:
            sizes, ids, surfaces = zip(*map(get, own), strict=True) if own else ((), (), ())
            text = without_prefix(b"".join(surfaces)).decode("utf-8", "replace").encode()
            out.append((sum(sizes) + 1, hashlib.sha256(b" ".join([*ids, end])).hexdigest(), hashlib.sha256(text).hexdigest()))
        return out

    def encode(self, text: bytes) -> list[int]:
        own = self.chunks(text)
        if wanted := set(own).difference(self.known):
            self.learn(wanted)
        return [int(i) for c in own for i in self.known[c][1].split()] + [END_ID]


def _digests(path: str):
    def run(batches):
        encoder = ChunkEncoder(path)
        for b in batches:
            for doc_ids, texts in slices(b.column(0), b.column(1)):
                n, a, d = zip(*encoder.digest(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(a), pa.array(d)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def _codes(path: str):
    def run(batches):
        encoder = ChunkEncoder(path)
        for b in batches:
            for doc_ids, texts in slices(b.column(0), b.column(1)):
                ids = [encoder.encode(t) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array([encoder.model.decode(x) for x in ids])],
                    ["doc_id", "ids", "decoded"],
                )

    return run


def _pair(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (with the end id) and the text that they decode to."""
    return _pair(docs, id_col, text).mapInArrow(_codes(path), "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, without shipping the ids."""
    return _pair(docs, id_col, text).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
