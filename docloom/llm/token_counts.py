"""Token counts of texts under a unigram vocabulary, by dynamic programming over a trie.

Words of a text (with the word mark put before them) are pre-tokens. A worker inserts the
distinct new ones of a slice in a trie, all words at once, one character deeper in each step; a
node holds the best forward score of its prefix - over
all ways to cut it in pieces, the highest sum of piece scores - and the pieces that
this takes, so a prefix that many words share is scored once. Ends of words keep their
counts, and a text's count is a sum of look-ups. Words of more than ``LONG`` characters are
inserted one by one, by the same recurrence, as steps with few words do not pay.

Piece scores are log shares fitted to the corpus, as a vocabulary of merges has ranks but
no probabilities: Spark counts the distinct words of all texts, and ``ROUNDS`` rounds of
hard expectation and maximisation follow, from shares by rank (Zipf). A round cuts each
distinct word once by the same trie, sums the words' counts by piece, and takes the
smoothed shares of the sums; what the driver gets is no longer than the vocabulary.

Equal scores go to fewer pieces. A character that no piece has becomes its UTF-8 bytes.
Defined results: null or empty text has no words and no tokens; rows are independent,
so repeated rows, ties and extra columns do not matter; an empty table gives no rows.
Texts are counted whole.
"""

from __future__ import annotations

import math
import uuid
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_CLASS, shared
from docloom.llm.packing import slices

MARK = "▁"
#: Nodes of long words, and distinct words, that a worker's trie may have before it starts anew (some 200 bytes each).
NODES, ENDS = 300_000, 500_000
#: Characters of the longest word that is inserted together with others, and words that are at a time.
LONG, SLICE = 64, 1 << 15
#: Rounds of the fit, and what is added to each piece's count.
ROUNDS, ADD = 2, 0.5


def unigram_scores(path: str) -> dict[str, float]:
    """Log share of each ordinary piece by its rank."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    own = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    own.sort(key=lambda i: (-sp.get_score(i), i))
    total = math.log(sum(1 / (r + 1) for r in range(len(own))))
    return {sp.id_to_piece(i): -math.log(r + 1) - total for r, i in enumerate(own)}


class Pieces:
    """The vocabulary as a trie in sorted arrays, for many searches at once."""

    def __init__(self, scores: dict[str, float]):
        self.names, self.score = list(scores), np.array(list(scores.values()), np.float64)
        below: dict[int, int] = {}
        piece = [-1]
        for k, name in enumerate(self.names):
            node = 0
            for c in name:
                key = node << 21 | ord(c)
                node = below.get(key)
                if node is None:
                    node = below[key] = len(piece)
                    piece.append(-1)
            piece[node] = k
        self.piece = np.array(piece, np.int64)
        keys = np.fromiter(below, np.int64, len(below))
        order = np.argsort(keys)
        self.keys, self.below = keys[order], np.fromiter(below.values(), np.int64, len(below))[order]
        self.longest, self.unknown = max(map(len, scores), default=1), min(scores.values(), default=0.0) - 10

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes below ``node`` by ``code``; -1 where there are none or ``node`` is -1."""
        out = np.full(node.shape, -1, np.int64)
        live = np.flatnonzero(node.ravel() >= 0)
        if len(self.keys) and len(live):
            key = node.ravel()[live] << 21 | np.broadcast_to(code, node.shape).ravel()[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out.ravel()[live] = np.where(self.keys[at] == key, self.below[at], -1)
        return out


def _with(values: np.ndarray, places: np.ndarray, new: np.ndarray) -> np.ndarray:
    values[places] = new
    return values


class Forest:
    """The trie of some words: by node its best score and pieces, the node where its last piece starts, and that piece."""

    def __init__(self, words: list[str], pieces: Pieces):
        texts = [MARK + w for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-size, kind="stable")  # words that end early are at the end
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        first, size = (np.append(0, np.cumsum(size))[:-1])[order], size[order]
        self.ends = np.zeros(len(texts), np.int64)
        best, count, cut, last = ([np.zeros(1, kind)] for kind in (np.float64, np.int64, np.int64, np.int64))
        # pieces that may end later, those of a node together and the longest first: the vocabulary's node, and
        # the score, count and node where the piece starts
        number = np.zeros(1, np.int64)
        state, at_best, at_count, at_node = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        here, base, known = np.zeros(len(texts), np.int64), 0, 1
        for depth in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -depth, "left"))
            key, here = np.unique(here[:live] << 21 | code[first[:live] + depth], return_inverse=True)
            above, c = key >> 21, key & (1 << 21) - 1
            # a node takes over its parent's open pieces, and one more starts at the parent
            own = number[above] + 1
            new = np.cumsum(own) - 1
            row = np.repeat(np.arange(len(key)), own)
            start = new + 1 - own
            old = np.arange(len(row)) - start[row] + (np.cumsum(number) - number)[above][row]
            old[new] = 0
            taken = lambda fresh, held: _with(held[old] if len(held) else np.zeros(len(old), fresh.dtype), new, fresh)  # noqa: B023, E731
            state = pieces.step(taken(np.zeros(len(key), np.int64), state), c[row])
            at_best, at_count, at_node = taken(best[-1][above], at_best), taken(count[-1][above], at_count), taken(base + above, at_node)
            piece = np.where(state >= 0, pieces.piece[state], -1)
            value, n = np.where(piece >= 0, pieces.score[piece] + at_best, -np.inf), at_count + 1
            alone = new[piece[new] < 0]  # characters that are no piece become bytes
            octets = 1 + (c[row[alone]] >= 0x80) + (c[row[alone]] >= 0x800) + (c[row[alone]] >= 0x10000)
            value[alone], n[alone] = pieces.unknown * octets + at_best[alone], octets + at_count[alone]
            top = np.maximum.reduceat(value, start)
            n[value != top[row]] = np.iinfo(np.int64).max
            fewest = np.minimum.reduceat(n, start)
            pick = np.minimum.reduceat(np.where(n == fewest[row], np.arange(len(row)), len(row)), start)  # of equals the longest piece
            best.append(top)
            count.append(fewest)
            cut.append(at_node[pick])
            last.append(piece[pick])
            base, known = known, known + len(key)
            done = int(np.searchsorted(-size, -depth - 1, "left"))
            self.ends[order[done:live]] = base + here[done:live]
            keep = state >= 0
            number = np.add.reduceat(keep.astype(np.int64), start)
            state, at_best, at_count, at_node = (x[keep] for x in (state, at_best, at_count, at_node))
        self.best, self.count, self.cut, self.last = (np.concatenate(x) for x in (best, count, cut, last))

    def add(self, total: np.ndarray, weight: np.ndarray) -> None:
        """Add the words' weights to ``total`` at the pieces of their best cuts."""
        node = self.ends
        while len(node):
            piece, known = self.last[node], self.last[node] >= 0
            np.add.at(total, piece[known], weight[known])
            node = self.cut[node]
            node, weight = node[node > 0], weight[node > 0]


class ForwardTrie:
    """Trie of pre-tokens with the best forward score and piece count of every prefix."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        #: Scores of the pieces, and None for what is only the end of some piece: a search from the right stops beyond these.
        self.tails: dict[str, float | None] = {p[k:]: None for p in scores for k in range(1, len(p))} | scores
        self.unknown = min(scores.values(), default=0.0) - 10
        self.vocabulary = Pieces(scores)
        self.clear()

    def clear(self) -> None:
        #: Node below a node by a character: one table for all, by node * 2**21 + character.
        self.below: dict[int, int] = {}
        self.best, self.pieces, self.cut = [0.0], [0], [0]
        self.ends: dict[bytes, int] = {}
        self.end_pieces: list[int] = []
        self.end_scores: list[float] = []

    def _grow(self, text: str, depth: int, path: list[int]) -> int:
        """A node for ``text[:depth]``; ``path`` holds the nodes of its prefixes."""
        best, pieces, tails, c = self.best, self.pieces, self.tails, text[depth - 1]
        top, count, cut = -math.inf, 0, depth - 1
        if c not in self.scores:
            n = len(c.encode("utf-8", "surrogatepass"))
            top, count = self.unknown * n + best[path[cut]], n + pieces[path[cut]]
        for start in range(depth - 1, -1, -1):
            s = tails.get(text[start:depth], 1.0)  # no logarithm of a share is above 0
            if s is None:
                continue
            if s > 0:
                break
            s += best[path[start]]
            n = 1 + pieces[path[start]]
            if s > top or s == top and n <= count:
                top, count, cut = s, n, start
        best.append(top)
        pieces.append(count)
        self.cut.append(cut)
        return len(best) - 1

    def _walk(self, text: str) -> list[int]:
        """The nodes of all prefixes of ``text``, grown where they are new."""
        node, path = 0, [0]
        for depth, c in enumerate(text, 1):
            key = node << 21 | ord(c)
            node = self.below.get(key)
            if node is None:
                node = self.below[key] = self._grow(text, depth, path)
            path.append(node)
        return path

    def cuts(self, word: str) -> list[str]:
        """The pieces of the best cut of ``word``, its mark included."""
        text = MARK + word
        path, at, out = self._walk(text), len(text), []
        while at:
            start = self.cut[path[at]]
            out.append(text[start:at])
            at = start
        return out[::-1]

    def insert(self, words: list[bytes]) -> None:
        """Insert new words and keep their counts and scores."""
        short, long = [], []
        for w in words:
            text = w.decode("utf-8", "replace")
            (short if len(text) < LONG else long).append((w, text))
        for low in range(0, len(short), SLICE):
            own = short[low : low + SLICE]
            grown = Forest([t for _, t in own], self.vocabulary)
            at = len(self.end_pieces)
            self.ends.update(zip((w for w, _ in own), range(at, at + len(own)), strict=True))
            self.end_pieces += grown.count[grown.ends].tolist()
            self.end_scores += grown.best[grown.ends].tolist()
        for w, text in long:
            node = self._walk(MARK + text)[-1]
            self.ends[w] = len(self.end_pieces)
            self.end_pieces.append(self.pieces[node])
            self.end_scores.append(self.best[node])

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, tokens and score of each text."""
        words, sizes = [], np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            own = t.split()
            sizes[k] = len(own)
            words += own
        if len(self.best) > NODES or len(self.ends) > ENDS:
            self.clear()
        place = np.fromiter(map(self.ends.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0).tolist()
        self.insert(list({words[k]: None for k in new}))
        place[new] = [self.ends[words[k]] for k in new]
        tokens = np.append(0, np.cumsum(np.array(self.end_pieces, np.int64)[place] if len(place) else []))
        score = np.append(0.0, np.cumsum(np.array(self.end_scores)[place] if len(place) else []))
        at = np.append(0, np.cumsum(sizes))
        return sizes, np.diff(tokens[at]).astype(np.int64), np.diff(score[at])


def _pieces(shared_scores):
    """Sums of the words' counts by piece, over a task's distinct words."""

    def run(batches):
        trie = ForwardTrie(shared_scores.value)
        names = trie.vocabulary.names
        place, total = {p: k for k, p in enumerate(names)}, np.zeros(len(names), np.int64)
        for b in batches:
            words, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            short = np.fromiter((len(w) < LONG for w in words), bool, len(words))
            few = np.flatnonzero(short)
            for low in range(0, len(few), SLICE):
                own = few[low : low + SLICE]
                Forest([words[k] for k in own.tolist()], trie.vocabulary).add(total, n[own])
            for k in np.flatnonzero(~short).tolist():
                for piece in trie.cuts(words[k]):
                    if piece in place:
                        total[place[piece]] += n[k]
                if len(trie.best) > NODES:
                    trie.clear()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in used.tolist()], pa.string()), pa.array(total[used])], ["piece", "n"])

    return run


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts."""
    words = docs.select(F.explode(F.split(F.col(text), f"{SPACE_CLASS}+")).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def fitted_scores(docs: DataFrame, path: str, text: str = "text") -> dict[str, float]:
    """Log shares of the pieces, fitted to all words of ``docs``; without words, those by rank."""
    scores, words = unigram_scores(path), shared(distinct_words(docs, text))
    for _ in range(ROUNDS):
        held = docs.sparkSession.sparkContext.broadcast(scores)
        found = words.mapInArrow(_pieces(held), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
        counts = {r["piece"]: r["n"] for r in found.collect()}
        if not counts:
            break
        total = math.log(sum(counts.values()) + ADD * len(scores))
        scores = {p: math.log(counts.get(p, 0) + ADD) - total for p in scores}
    return scores


#: This worker's trie, by the name of its scores; it outlives a task.
_TRIES: dict[str, ForwardTrie] = {}


def trie_of(name: str, scores: dict[str, float]) -> ForwardTrie:
    if name not in _TRIES:
        _TRIES.clear()
        _TRIES[name] = ForwardTrie(scores)
    return _TRIES[name]


def _counts(shared_scores, name: str):
    def run(batches):
        trie = trie_of(name, shared_scores.value)
        for b in batches:
            for doc_ids, texts in slices(b.column(0), b.column(1)):
                words, tokens, score = trie.count(texts)
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(words), pa.array(tokens), pa.array(score)], ["doc_id", "n_words", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", scores: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_words, n_tokens and score (natural log) of every row, under ``scores`` or those fitted to ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(scores or fitted_scores(docs, path, text))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counts(held, uuid.uuid4().hex), "doc_id long, n_words long, n_tokens long, score double")
