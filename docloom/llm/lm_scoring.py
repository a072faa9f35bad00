"""Language-model scores from a hashed maximum-entropy model.

Tokens are words and one end mark a text. The model predicts a token's class from
hashed features - the word before, the word two before (skip) and both together - by a
softmax over classes, and the token within its class by a softmax whose features are the
classes of the two words before (or the start), ``CONTEXTS`` values each. Rare words form one
class, in which a word's share follows its exact training count, so every word that the
corpus holds is scored, and an unseen one too.

1. Counts: tasks send sorted Golomb-coded word hashes with counts to owners of hash
   ranges. Owners know every count exactly; the driver gets totals and the most
   frequent words, whole levels of count up to ``VOCABULARY`` words, a fixed number.
2. Classes: vocabulary words are clustered by the frequent words they follow, counted
   over all training text and summed by a tree of groups of ``FAN`` tasks.
3. Weights: in each of ``ROUNDS`` rounds every task descends the class gradient over its
   part of the texts (those whose hash falls to the round) in minibatches (AdaGrad),
   starting from the weights of the round before; the tasks' weights are averaged by
   tokens in the same tree. The gradient within classes needs only how often each word
   follows each context: these counts are summed with the weights, and the driver climbs
   the exact likelihood of all training text, whose size is fixed.
4. Scores: one pass scores whole texts in sparse numpy batches. Rare words go to their
   owners in blocks - entries of a document by word matrix - and come back as sums per
   document.

Defined results: null or empty text is one end token; texts with repeated ids are
scored each; with no training text the model is uniform over classes and nothing is
known; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import golomb
from docloom.llm.common import frequent, mix64, remainder, shared, shares, text_buffer, word_hashes
from docloom.llm.ngram_join import _pack_counts as pack_counts
from docloom.llm.ngram_join import _unpack_counts as unpack_counts

VOCABULARY, SEEDS, CLUSTERS = 16_384, 64, 30
CLASSES = CLUSTERS + 2  # and one each for rare words and the end
FEATURES = (4096, 4096, 8192)
#: Contexts of a word within its class: the classes, and the start of a text.
CONTEXTS = CLASSES + 1
ROUNDS, STEPS, RIDGE = 2, 12, 2.0
FAN, CHUNKS = 64, 16
BATCH, SLICE, HELD, RATE = 32_768, 4 << 20, 1 << 20, 0.25
ADD = 0.1
END = mix64(np.array([0xE0D], np.uint64))[0]


def tokens(texts: pa.Array):
    """Yields (first row, word hashes with END after each text, bounds) some megabytes at a time."""
    data, offs = text_buffer(texts)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1)
        words, first = word_hashes(data[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        ends = first[1:] + np.arange(to - at)
        out = np.empty(len(words) + to - at, np.uint64)
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask], out[ends] = words, END
        yield at, out, np.append(0, ends + 1)
        at = to


def _owner_bounds(keys: np.ndarray, owners: int) -> np.ndarray:
    return np.searchsorted((keys >> np.uint64(40)) * np.uint64(owners) >> np.uint64(24), np.arange(owners + 1, dtype=np.uint64))


# --- 1. counts -------------------------------------------------------------------


def _count_blocks(owners: int):
    def flush(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        edges = _owner_bounds(keys, owners)
        rows = [(o, golomb.encode(keys[a:b]), pack_counts(counts[a:b])) for o, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows])], ["owner", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for _, own, _ in tokens(b.column(0)):
                held.append(own)
                size += len(own)
                if size > 8 * HELD:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _count_owner(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's totals (a row with ``distinct``), and its words of the highest counts, as many as the vocabulary can take."""
    keys = [golomb.decode(b) for b in pdf["keys"]]
    counts = np.concatenate([unpack_counts(b, len(k)) for b, k in zip(pdf["counts"], keys, strict=True)])
    keys, back = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(back, counts).astype(np.int64)
    top = np.argsort(-total, kind="stable")[: VOCABULARY + 1]
    rows = {"key": np.append(np.int64(0), keys[top].view(np.int64)), "n": np.append(total.sum(), total[top]), "distinct": np.append(len(keys), np.zeros(len(top), np.int64))}
    return pd.DataFrame(rows)


class Vocabulary:
    """The most frequent words by hash, their exact counts, and the corpus totals."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(keys)
        self.keys, self.counts, self.total, self.distinct = keys[order], counts[order], total, distinct
        self.size = len(keys)
        by_count = np.lexsort((self.keys, -self.counts))
        self.rank = np.empty(self.size, np.int64)
        self.rank[by_count] = np.arange(self.size)
        self.rare_total = float(total - self.counts.sum()) + ADD * (distinct - self.size) + ADD

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ranks by frequency; ``size`` for rare words."""
        if not self.size:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), self.size - 1)
        return np.where(self.keys[at] == hashes, self.rank[at], self.size)

    def ranked(self) -> np.ndarray:
        out = np.empty(self.size, np.int64)
        out[self.rank] = self.counts
        return out


def vocabulary(texts: DataFrame) -> Vocabulary:
    owners = shares(texts)
    blocks = texts.select("text").mapInArrow(_count_blocks(owners), "owner int, keys binary, counts binary")
    found = shared(blocks.groupBy("owner").applyInPandas(_count_owner, "key long, n long, distinct long"))
    sums = found.where("distinct > 0").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).first()
    top = frequent(found.where("distinct = 0"), VOCABULARY, "key", "n")
    return Vocabulary(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), int(sums["n"] or 0), int(sums["distinct"] or 0))


# --- sums over tasks ---------------------------------------------------------------


def _vector_rows(vector: np.ndarray, weight: float):
    """One task's vector, cut in chunks, as rows to be summed."""
    part = TaskContext.get().partitionId()
    cut = np.array_split(vector.ravel(), CHUNKS)
    return pa.RecordBatch.from_arrays(
        [pa.array(range(CHUNKS), pa.int32()), pa.array([part] * CHUNKS, pa.int32()), pa.array([weight] * CHUNKS, pa.float64()), pa.array([zlib.compress(c.tobytes(), 1) for c in cut])],
        ["chunk", "part", "weight", "vector"],
    )


VECTORS = "chunk int, part int, weight double, vector binary"


def _sum_vectors(kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(v), kind).astype(np.float64) for v in pdf["vector"])
        part = int(pdf["part"].iloc[0]) // FAN
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": [part], "weight": [pdf["weight"].sum()], "vector": [zlib.compress(total.astype(kind).tobytes(), 1)]})

    return run


def tree_sum(vectors: DataFrame, parts: int, kind: str) -> tuple[np.ndarray, float]:
    """Sum of the tasks' vectors and weights; no group ever has more than FAN members."""
    while True:
        vectors = vectors.groupBy("chunk", F.floor(F.col("part") / FAN).alias("g")).applyInPandas(_sum_vectors(kind), VECTORS)
        parts = -(-parts // FAN)
        if parts <= 1:
            break
    rows = sorted(vectors.collect(), key=lambda r: r["chunk"])
    if not rows:
        return np.zeros(0), 0.0
    return np.concatenate([np.frombuffer(zlib.decompress(r["vector"]), kind) for r in rows]).astype(np.float64), rows[0]["weight"]


# --- 2. classes ---------------------------------------------------------------------


def _follows(shared_vocabulary):
    """Counts of (vocabulary word, frequent word before it) over a task's text."""

    def run(batches):
        v = shared_vocabulary.value
        total = np.zeros(v.size * SEEDS, np.int64)
        for b in batches:
            for _, own, bounds in tokens(b.column(0)):
                ids = v.ids(own)
                pair = (ids[1:] < v.size) & (ids[:-1] < SEEDS)
                pair[bounds[1:-1] - 1] = False
                total += np.bincount(ids[1:][pair] * SEEDS + ids[:-1][pair], minlength=len(total))
        yield _vector_rows(total.astype(np.int64), 1.0)

    return run


def cluster(follows: np.ndarray, counts: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Cluster of each word by the distribution of what it follows (k-means, Hellinger distance)."""
    share = follows + follows.sum(0) / max(follows.sum(), 1)
    points = np.sqrt(share / np.maximum(share.sum(1, keepdims=True), 1e-12))
    centres = points[: min(len(points), 4 * CLUSTERS) : max(1, min(len(points), 4 * CLUSTERS) // CLUSTERS)][:CLUSTERS].copy()
    weight = np.log1p(counts)[:, None]
    label = np.zeros(len(points), np.int64)
    for _ in range(rounds):
        label = (points @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (own := label == k).any():
                centre = (points[own] * weight[own]).sum(0)
                centres[k] = centre / max(np.linalg.norm(centre), 1e-12)
    return label


# --- 3. weights ------------------------------------------------------------------------


class Model:
    """Classes and feature weights; scores tokens given the two before."""

    def __init__(self, v: Vocabulary, label: np.ndarray):
        counts = v.ranked().astype(np.float64)
        self.rare, self.start = v.size, v.size + 1
        self.label = np.append(label, CLUSTERS + 1).astype(np.int64)
        self.label[v.ids(np.array([END], np.uint64))[0]] = CLUSTERS if v.size else CLUSTERS + 1
        if len(counts):
            inside = np.bincount(self.label[:-1], counts, CLASSES)
            self.share = np.append(np.log(counts / inside[self.label[:-1]]), 0.0)
        else:
            self.share = np.zeros(1)
        self.lean = np.zeros((2, CONTEXTS, v.size + 1), np.float32)
        self.norm = np.zeros((CONTEXTS, CONTEXTS, CLASSES), np.float32)
        rare = v.rare_total if v.size else 1.0
        prior = np.bincount(self.label, np.append(counts, rare), CLASSES) + 1e-3
        self.bias = np.log(prior / prior.sum()).astype(np.float32)
        word = np.arange(v.size + 2)
        spread = mix64(word.astype(np.uint64)) % np.uint64(FEATURES[0] - 1024)
        self.bucket = np.where(word < FEATURES[0] - 2, word, spread.astype(np.int64))
        self.bucket[self.rare], self.bucket[self.start] = FEATURES[0] - 2, FEATURES[0] - 1
        self.weights = np.zeros((sum(FEATURES), CLASSES), np.float32)

    def before(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The word before each token and the one two before."""
        one, two = np.empty_like(ids), np.empty_like(ids)
        one[1:], two[2:] = ids[:-1], ids[:-2]
        one[bounds[:-1]] = self.start
        two[bounds[:-1]] = self.start
        second = bounds[:-1][np.diff(bounds) > 1] + 1
        two[second] = self.start
        return one, two

    def features(self, one: np.ndarray, two: np.ndarray) -> list[np.ndarray]:
        a, b = self.bucket[one], self.bucket[two]
        both = (a * 40_503 + b * 30_011 + (a * b >> 3)) % FEATURES[2]
        return [a, b + FEATURES[0], both + FEATURES[0] + FEATURES[1]]

    def context(self, word: np.ndarray) -> np.ndarray:
        """The class of a word before, or the start."""
        return np.append(self.label, CLASSES)[word]

    def count(self, ids: np.ndarray, bounds: np.ndarray, total: np.ndarray) -> None:
        """Add how often each word follows each context, and each class each pair of contexts."""
        one, two = map(self.context, self.before(ids, bounds))
        words, size = self.rare + 1, CONTEXTS * (self.rare + 1)
        total[:size] += np.bincount(one * words + ids, minlength=size)
        total[size : 2 * size] += np.bincount(two * words + ids, minlength=size)
        total[2 * size :] += np.bincount((one * CONTEXTS + two) * CLASSES + self.label[ids], minlength=CONTEXTS**2 * CLASSES)

    def climb(self, total: np.ndarray) -> None:
        """Fit the softmax within classes to the summed counts: damped steps on the exact gradient."""
        words = self.rare + 1
        seen = total[: 2 * CONTEXTS * words].reshape(2, CONTEXTS, words)
        asked = total[2 * CONTEXTS * words :].reshape(CONTEXTS, CONTEXTS, CLASSES)
        order = np.argsort(self.label, kind="stable")
        present, starts = np.unique(self.label[order], return_index=True)
        back = np.empty(words, np.int64)
        back[order] = np.arange(words)
        place = np.searchsorted(present, self.label[order])

        def shares(k: int) -> np.ndarray:
            """Softmax of the words in each class, in order of class, for all second contexts; sets the norms."""
            x = (self.share + self.lean[0, k] + self.lean[1])[:, order]
            np.exp(x, out=x)
            z = np.add.reduceat(x, starts, axis=1)
            self.norm[k][:, present] = np.log(z)
            return x / z[:, place]

        for _ in range(STEPS):
            first, second = np.zeros((CONTEXTS, words)), np.zeros((CONTEXTS, words))
            for k in range(CONTEXTS):
                x = shares(k) * asked[k][:, present][:, place]
                first[k], second = x.sum(0)[back], second + x
            for side, expected in ((0, first), (1, second[:, back])):
                step = (seen[side] - expected - RIDGE * self.lean[side]) / (expected + seen[side] + RIDGE)
                self.lean[side] += step.astype(np.float32)
            self.lean[:, :, self.rare] = 0
        for k in range(CONTEXTS):
            shares(k)

    def logits(self, features: list[np.ndarray]) -> np.ndarray:
        out = self.weights[features[0]]
        out += self.weights[features[1]]
        out += self.weights[features[2]]
        out += self.bias
        out -= out.max(1, keepdims=True)
        return out

    def log_probs(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural log probabilities; a rare word's share of its class is left to its owner."""
        one, two = self.before(ids, bounds)
        features, label = self.features(one, two), self.label[ids]
        one, two = self.context(one), self.context(two)
        out = self.share[ids] + self.lean[0, one, ids] + self.lean[1, two, ids] - self.norm[one, two, label]
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            x = self.logits([f[part] for f in features])
            picked = x[np.arange(len(x)), label[part]]
            np.exp(x, out=x)
            out[part] += picked - np.log(x.sum(1))
        return out

    def descend(self, ids: np.ndarray, bounds: np.ndarray, past: np.ndarray) -> None:
        """One pass of minibatch gradient steps; ``past`` holds AdaGrad's sums by feature."""
        features, label = self.features(*self.before(ids, bounds)), self.label[ids]
        for at in range(0, len(ids), BATCH):
            part = slice(at, at + BATCH)
            own = [f[part] for f in features]
            x = self.logits(own)
            np.exp(x, out=x)
            x /= x.sum(1, keepdims=True)
            x[np.arange(len(x)), label[part]] -= 1
            for f in own:
                order = np.argsort(f.astype(np.uint16), kind="stable")
                f = f[order]
                start = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
                rows = f[start]
                step = np.add.reduceat(x[order], start, axis=0)
                past[rows] += np.square(step).mean(1)
                self.weights[rows] -= RATE * step / np.sqrt(past[rows] + 1e-6)[:, None]


def _descent(shared_parts):
    def run(batches):
        v, model = shared_parts.value
        model.weights = model.weights.copy()
        total = np.zeros(2 * CONTEXTS * (v.size + 1) + CONTEXTS**2 * CLASSES, np.int64)
        past, seen = np.zeros(sum(FEATURES), np.float32), 0
        for b in batches:
            for _, own, bounds in tokens(b.column(0)):
                ids = v.ids(own)
                model.descend(ids, bounds, past)
                model.count(ids, bounds, total)
                seen += len(own)
        yield _vector_rows(np.append(model.weights.ravel() * float(seen), total), float(seen))

    return run


def train(docs: DataFrame) -> tuple[Vocabulary, Model]:
    """Vocabulary and model from every row of ``docs`` (a column text)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    parts = texts.rdd.getNumPartitions()
    v = vocabulary(texts)
    held = spark.sparkContext.broadcast(v)
    follows, _ = tree_sum(texts.mapInArrow(_follows(held), VECTORS), parts, "<i8")
    label = cluster(follows.reshape(v.size, SEEDS), v.ranked()) if v.size else np.zeros(0, np.int64)
    model, counts = Model(v, label), 0
    for k in range(ROUNDS):
        both = spark.sparkContext.broadcast((v, model))
        own = texts.where(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k)
        total, seen = tree_sum(own.mapInArrow(_descent(both), VECTORS), parts, "<f8")
        if seen:
            cells = model.weights.size
            model.weights = (total[:cells] / seen).astype(np.float32).reshape(model.weights.shape)
            counts = counts + total[cells:]
    if v.size and np.ndim(counts):
        model.climb(counts)
    return v, model


# --- 4. scores -------------------------------------------------------------------------

_BLOCK = "block long, owner int, ids array<long>, a binary, b binary, c binary, d binary"


def _score_blocks(shared_parts, owners: int):
    """Per block a head (ids, tokens, rare tokens, base and model sums), per owner its rare entries."""

    def flush(block, ids, train, n, rare, base, score, words, docs):
        heads = [np.concatenate(x) for x in (n, rare, base, score)]
        rows = [(block, -1, ids, *(x.tobytes() for x in heads))]
        word, doc = np.concatenate(words), np.concatenate(docs)
        order = np.lexsort((doc, word))
        word, doc = word[order], doc[order]
        fresh = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])))[: len(word)]
        tf = np.diff(np.append(fresh, len(word)))
        word, doc = word[fresh], doc[fresh]
        edges = _owner_bounds(word, owners)
        flags = golomb.bitmap(np.concatenate(train))
        for o, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if a < b:
                distinct, counts = np.unique(word[a:b], return_counts=True)
                places = zlib.compress(doc[a:b].astype("<u4").tobytes(), 1)
                rows.append((block, o, None, golomb.encode(distinct), pack_counts(counts), len(flags).to_bytes(4, "little") + flags + places, pack_counts(tf[a:b])))
        types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["block", "owner", "ids", "a", "b", "c", "d"])

    def run(batches):
        v, model = shared_parts.value
        counts = np.append(np.log10(v.ranked() + ADD), 0.0)
        block, held = TaskContext.get().partitionId() << 24, None
        for b in batches:
            all_ids, all_train = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, own, bounds in tokens(b.column(2)):
                if held is None:
                    held, size, rows = [[], *([] for _ in range(7))], 0, 0
                ids = v.ids(own)
                doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                rare = ids == model.rare
                held[0] += all_ids[at : at + len(bounds) - 1]
                columns = (
                    all_train[at : at + len(bounds) - 1],
                    np.diff(bounds).astype("<i8"),
                    np.bincount(doc, rare, len(bounds) - 1).astype("<i8"),
                    np.add.reduceat(counts[ids], bounds[:-1]),
                    np.add.reduceat(model.log_probs(ids, bounds), bounds[:-1]) / np.log(10),
                    own[rare],
                    doc[rare] + rows,
                )
                for x, y in zip(held[1:], columns, strict=True):
                    x.append(y)
                size, rows = size + len(own), rows + len(bounds) - 1
                if size > HELD:
                    yield flush(block, *held)
                    block, held = block + 1, None
        if held is not None:
            yield flush(block, *held)

    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """An owner's rare words: exact training counts, and each block's sums by document."""
    word, doc, tf, train, block = [], [], [], [], []
    for k, (a, b, c, d) in enumerate(zip(pdf["a"], pdf["b"], pdf["c"], pdf["d"], strict=True)):
        keys = golomb.decode(a)
        word.append(np.repeat(keys, unpack_counts(b, len(keys))))
        n = int.from_bytes(c[:4], "little")
        flags = np.unpackbits(np.frombuffer(c[4 : 4 + n], np.uint8)).astype(bool)
        doc.append(np.frombuffer(zlib.decompress(c[4 + n :]), "<u4").astype(np.int64))
        tf.append(unpack_counts(d, len(doc[-1])))
        train.append(flags[doc[-1]])
        block.append(np.full(len(doc[-1]), k))
    word, doc, tf, train, block = map(np.concatenate, (word, doc, tf, train, block))
    _, back = np.unique(word, return_inverse=True)
    c = np.bincount(back, tf * train)[back]
    width = int(doc.max()) + 1
    cell, back = np.unique(block * width + doc, return_inverse=True)
    known, logs = np.bincount(back, tf * (c > 0)).astype("<i8"), np.bincount(back, tf * np.log10(c + ADD))
    edges = np.searchsorted(cell, np.arange(len(pdf) + 1) * width)
    part = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    out = pdf[["block", "owner"]].copy()
    out["ids"], out["a"], out["b"], out["c"], out["d"] = None, part((cell % width).astype("<i8")), part(known), part(logs), b""
    return out


def _finish(denominator: float, rare_total: float, total: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf[pdf["owner"] < 0].iloc[0]
        n, rare = (np.frombuffer(head[x], "<i8") for x in "ab")
        base, score = (np.frombuffer(head[x], np.float64).copy() for x in "cd")
        known, logs = n - rare, np.zeros(len(n))
        for r in pdf[pdf["owner"] >= 0].itertuples():
            at = np.frombuffer(r.a, "<i8")
            known[at] += np.frombuffer(r.b, "<i8")
            logs[at] += np.frombuffer(r.c, np.float64)
        base += logs - n * np.log10(denominator)
        score += logs - rare * np.log10(rare_total)
        return pd.DataFrame({"doc_id": pd.array(list(head["ids"]), "Int64"), "n_tokens": n, "n_known": known, "train_tokens": total, "base_score": base, "score": score})

    return run


def score(docs: DataFrame, v: Vocabulary, model: Model) -> DataFrame:
    """Scores of rows (doc_id, train, text); ``train`` tells which rows count as training text.

    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score (log10).
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((v, model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("train", F.lit(False)).alias("train"), "text")
    blocks = shared(rows.mapInArrow(_score_blocks(held, shares(rows)), _BLOCK))
    answers = blocks.where("owner >= 0").groupBy("owner").applyInPandas(_answer, _BLOCK)
    denominator = v.total + ADD * (v.distinct + 1)
    joined = blocks.where("owner < 0").union(answers)
    return joined.groupBy("block").applyInPandas(
        _finish(denominator, v.rare_total, v.total), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def folds(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, train, text by the fold rule: training rows have remainder 1 to 9."""
    return docs.select(F.col(id_col).alias("doc_id"), (remainder(id_col, 10) != 0).alias("train"), F.col(text).alias("text"))
