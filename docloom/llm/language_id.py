"""Language identification by interpolated Kneser-Ney character models.

Letters are lower-cased; the ``LETTERS`` most frequent of the training texts have a
symbol each, all rarer ones share one, and a run of anything else is a space, so a 4-gram
is 40 bits. Every training text is counted: tasks count by sorting, Spark sums by (lang,
n-gram) with map-side combining. A model is all counts of its language, turned into sorted
arrays of n-grams and interpolated log probabilities. A text takes the language of least
cross-entropy per character.

The driver and the broadcast never get more than ``ENTRIES`` n-grams. Where the languages
have more, the models stay tables (``ModelTables``): the most frequent n-grams are broadcast
with the probabilities of the whole models, and what a text has beyond them is looked up by
joins, so the bound changes no result.

Rejection is calibrated: one training row in ``HELD_BACK`` is left out of the counts, and
what their cross-entropy exceeds the language's own by, at the quantile ``QUANTILE`` of
texts of like length, is the most that is let pass. Lengths with few such rows lean on a
prior of ``SLACK`` bits and ``SLACK_SHORT`` / sqrt(length), as if of ``PRIOR`` rows.

Defined results: null text and text without a letter get ``und``, score 0; equal
cross-entropies go to the first language by name; repeated rows are scored each; with
no training rows everything is ``und``; extra columns are ignored. Texts are scored
whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import frequent, remainder, shared, trimmed
from docloom.llm.packing import slices

UNDETERMINED = "und"
ORDER, BITS = 4, 10
LETTERS, ENTRIES = (1 << BITS) - 2, 1 << 22
#: Characters of evidence that count at most toward the score.
EVIDENCE = 40
#: Calibration of the rejection.
HELD_BACK, QUANTILE, MARGIN = 16, 0.9995, 0.25
SLACK, SLACK_SHORT, PRIOR, LENGTHS = 1.5, 8.0, 200, 32
#: Bytes of text in hand at a time.
SLICE = 1 << 19


class Alphabet:
    """Symbols of code points: 0 is anything but a letter, the given letters have one each, all others the last."""

    def __init__(self, letters):
        self.letters = np.sort(np.array(letters, np.int64))[:LETTERS]
        self.size = 0x3000
        self.table = np.array([self.one(c) for c in range(self.size)], np.int64)

    def one(self, cp: int) -> int:
        if not chr(cp).isalpha():
            return 0
        at = int(np.searchsorted(self.letters, cp))
        return at + 1 if at < len(self.letters) and self.letters[at] == cp else (1 << BITS) - 1

    def fold(self, code: np.ndarray) -> np.ndarray:
        out = self.table[np.minimum(code, self.size - 1)]
        if (far := code >= self.size).any():
            values, back = np.unique(code[far], return_inverse=True)
            out[far] = np.array([self.one(int(v)) for v in values], np.int64)[back]
        return out


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def _letter_counts(batches):
    total = np.zeros(0x110000, np.int64)
    for b in batches:
        for _, texts in slices(b.column(0), b.column(0), SLICE):
            total += np.bincount(_codes([t.decode().lower() for t in texts]), minlength=len(total))
    found = np.flatnonzero(total)
    found = found[[chr(c).isalpha() for c in found.tolist()]]
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["cp", "n"])


def alphabet(docs: DataFrame, text: str = "text") -> Alphabet:
    """The most frequent letters of all given texts."""
    found = docs.select(F.col(text).alias("text")).mapInArrow(trimmed(_letter_counts), "cp long, n long").groupBy("cp").agg(F.sum("n").alias("n"))
    return Alphabet(frequent(shared(found), LETTERS, "cp", "n")["cp"])


def keys(folder: Folder, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """4-gram keys of the texts, one per character after runs of non-letters are one space; bounds by text."""
    texts = [" " + t.lower() for t in texts]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = folder.fold(_codes(texts))
    starts = np.cumsum(sizes) - sizes
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    bounds = before[np.append(starts, len(code))]
    c = code[keep]
    key, place = c.copy(), np.arange(len(c)) - np.repeat(bounds[:-1], np.diff(bounds))
    for back in range(1, ORDER):
        prior = np.zeros(len(c), np.int64)
        prior[back:] = c[:-back]
        prior[place < back] = 0
        key |= prior << BITS * back
    key[place == 0] = 0  # the space put before each text; carries no evidence
    return key, bounds


def _count(folder: Alphabet, batches):
    held: dict[str, list] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(lang):
        values, n = np.unique(np.concatenate(held.pop(lang)), return_counts=True)
        if lang in totals:
            old, m = totals[lang]
            both, back = np.unique(np.concatenate([old, values]), return_inverse=True)
            values, n = both, np.bincount(back, np.concatenate([m, n])).astype(np.int64)
        totals[lang] = values, n

    for b in batches:
        for langs, texts in slices(b.column(0), b.column(1), SLICE):
            key, bounds = keys(folder, [t.decode() for t in texts])
            names = np.array(langs, object)
            owner = np.repeat(np.arange(len(langs)), np.diff(bounds))
            for lang in dict.fromkeys(langs):
                own = key[(names == lang)[owner] & (key != 0)]
                held.setdefault(lang, []).append(own)
                if sum(map(len, held[lang])) > 1 << 20:
                    settle(lang)
    for lang in list(held):
        settle(lang)
    for lang, (values, n) in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(values, pa.int64()), pa.array(n, pa.int64())], ["lang", "key", "n"])


def counts(docs: DataFrame, folder: Alphabet, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, key, n) over all given documents with a language."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = rows.mapInArrow(trimmed(lambda batches: _count(folder, batches)), "lang string, key long, n long")
    return found.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def _letterless(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.add.reduceat((key & ((1 << BITS) - 1) != 0).astype(np.int64), bounds[:-1]) == 0


class KneserNey:
    """One language: for each order sorted n-gram keys with discounted shares, and contexts with back-off weights."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        order = np.argsort(key)
        key, n = np.asarray(key)[order].astype(np.int64), np.asarray(n)[order].astype(np.float64)
        self.levels = {}
        self.total, grams, weight = float(n.sum()), key, n
        for k in range(ORDER, 0, -1):
            once, twice = float((weight == 1).sum()), float((weight == 2).sum())
            d = once / (once + 2 * twice) if once and twice else 0.5
            ctx, back = np.unique(grams >> BITS, return_inverse=True)
            denom, kinds = np.bincount(back, weight), np.bincount(back)
            self.levels[k] = (grams, np.maximum(weight - d, 0) / denom[back], ctx, d * kinds / denom)
            grams, kept = np.unique(grams & ((1 << BITS * (k - 1)) - 1), return_counts=True)
            weight = kept.astype(np.float64)  # lower orders count distinct left neighbours
        self.entropy = float(-(n * np.log2(self.prob(key))).sum() / max(self.total, 1))

    def prob(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), 1.0 / (1 << BITS))
        for k in range(1, ORDER + 1):
            grams, share, ctx, back = self.levels[k]
            own = key & ((1 << BITS * k) - 1)
            at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
            direct = np.where(grams[at] == own, share[at], 0.0)
            at = np.minimum(np.searchsorted(ctx, own >> BITS), len(ctx) - 1)
            seen = ctx[at] == own >> BITS
            p = np.where(seen, direct + back[at] * p, p)
        return p


class ModelTables:
    """``KneserNey`` of all languages as tables: for each order (lang, gram, share) and (lang, ctx, back)."""

    def __init__(self, found: DataFrame, langs: list[str]):
        self.langs, self.levels = langs, {}
        grams, weight = found.select("lang", F.col("key").alias("gram"), F.col("n").alias("weight")), F.col("weight")
        for k in range(ORDER, 0, -1):
            grams = shared(grams.withColumn("ctx", F.shiftright("gram", BITS)))
            once, twice = F.count_if(weight == 1), F.count_if(weight == 2)
            d = grams.groupBy("lang").agg(F.when((once > 0) & (twice > 0), once / (once + 2 * twice)).otherwise(0.5).alias("d"))
            ctx = shared(grams.groupBy("lang", "ctx").agg(F.sum("weight").alias("denom"), F.count(F.lit(1)).alias("kinds")).join(d, "lang"))
            share = F.greatest(weight - F.col("d"), F.lit(0.0)) / F.col("denom")
            rows = shared(grams.join(ctx, ["lang", "ctx"]).select("lang", "gram", share.alias("share")))
            self.levels[k] = rows, ctx.select("lang", "ctx", (F.col("d") * F.col("kinds") / F.col("denom")).alias("back"))
            grams = grams.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("weight"))

    def logs(self, asked: DataFrame) -> DataFrame:
        """(lang, key, log) of each distinct key of ``asked`` under each language."""
        p = asked.select("key").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, self.langs)))).withColumn("p", F.lit(1.0 / (1 << BITS)))
        for k in range(1, ORDER + 1):
            rows, ctx = self.levels[k]
            p = p.withColumn("gram", F.col("key").bitwiseAND(F.lit((1 << BITS * k) - 1))).withColumn("ctx", F.shiftright("gram", BITS))
            p = p.join(rows, ["lang", "gram"], "left").join(ctx, ["lang", "ctx"], "left")
            p = p.select("lang", "key", F.coalesce(F.coalesce("share", F.lit(0.0)) + F.col("back") * F.col("p"), "p").alias("p"))
        return p.select("lang", "key", F.log2("p").cast("float").alias("log"))

    def by_key(self, logs: DataFrame, *more) -> DataFrame:
        """The rows of ``logs`` with a column for each language, ``log0`` onwards."""
        return logs.groupBy("key").agg(*[F.max(F.when(F.col("lang") == g, F.col("log"))).alias(f"log{j}") for j, g in enumerate(self.langs)], *more)


class LanguageModels:
    """All languages: the union of their n-grams, sorted, with a log2 probability for each language.

    ``tables`` are the whole models where these arrays hold their most frequent n-grams only; they stay on the driver.
    """

    tables: ModelTables | None = None

    def __init__(self, table: pd.DataFrame, folder: Alphabet):
        self.folder = folder
        self.slack = SLACK + SLACK_SHORT / np.sqrt(np.exp2(np.arange(LENGTHS)))
        self.langs = sorted(table["lang"].unique()) if len(table) else []
        self.models = [KneserNey(g["key"].to_numpy(), g["n"].to_numpy()) for _, g in (table.groupby("lang", sort=True) if len(table) else [])]
        self.grams = np.unique(table["key"].to_numpy(np.int64)) if len(table) else np.zeros(0, np.int64)
        self.logs = self._logs(self.grams)
        self.entropy = np.array([m.entropy for m in self.models])

    @classmethod
    def of_tables(cls, found: DataFrame, langs: list[str], folder: Alphabet) -> LanguageModels:
        """Models of more n-grams than are broadcast, from (lang, key, n)."""
        out, tables = cls(pd.DataFrame({"lang": []}), folder), ModelTables(found, langs)
        logs = shared(tables.logs(found).join(found, ["lang", "key"], "left"))
        bits = {r["lang"]: r["bits"] for r in logs.groupBy("lang").agg((-F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("bits")).collect()}
        names = [f"log{j}" for j in range(len(langs))]
        held = frequent(shared(tables.by_key(logs, F.sum("n").alias("n"))), ENTRIES // len(langs), "key", "n", *names).sort_values("key")
        out.tables, out.langs, out.entropy = tables, langs, np.array([bits[g] for g in langs])
        out.grams, out.logs = held["key"].to_numpy(np.int64), held[names].to_numpy(np.float32)
        return out

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def _logs(self, key: np.ndarray) -> np.ndarray:
        return np.stack([np.log2(m.prob(key)) for m in self.models], 1).astype(np.float32) if self.models else np.zeros((len(key), 0), np.float32)

    def entropies(self, key: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character of each text under each language, and the texts' characters."""
        logs, place = self.logs, np.minimum(np.searchsorted(self.grams, key), max(len(self.grams) - 1, 0))
        if (new := self.grams[place] != key).any():
            values, back = np.unique(key[new], return_inverse=True)
            place[new] = len(logs) + back
            logs = np.concatenate([logs, self._logs(values)])
        n = np.diff(bounds) - 1
        return self._bits(logs, place, key, bounds) / np.maximum(n, 1)[:, None], n

    def _bits(self, logs: np.ndarray, place: np.ndarray, key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        bits = np.zeros((len(bounds) - 1, len(self.langs)))
        for j in range(len(self.langs)):
            column = np.ascontiguousarray(logs[:, j])[place]
            column[key == 0] = 0
            bits[:, j] = -np.add.reduceat(column.astype(np.float64), bounds[:-1]) if len(bits) else 0
        return bits

    def known(self, key: np.ndarray, bounds: np.ndarray):
        """Bits of each text's n-grams that are held here; the others by text with their counts, and where each text's begin."""
        at = np.minimum(np.searchsorted(self.grams, key), max(len(self.grams) - 1, 0))
        new = (key != 0) & (self.grams[at] != key if len(self.grams) else True)
        at[new] = len(self.logs)
        zero = np.zeros((1, len(self.langs)), np.float32)
        bits = self._bits(np.concatenate([self.logs, zero]), np.where(key == 0, len(self.logs), at), key, bounds)
        owner, others = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[new], key[new]
        order = np.lexsort((others, owner))
        owner, others = owner[order], others[order]
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (others[1:] != others[:-1]))[: len(others)])
        return bits, others[first], np.diff(np.append(first, len(others))), np.searchsorted(owner[first], np.arange(len(bounds)))

    def judge(self, texts: list[bytes]):
        """For each text: place of the best language, score, excess over its own entropy, class of length, and whether it has no letter."""
        key, bounds = keys(self.folder, [t.decode() for t in texts])
        none = _letterless(key, bounds)
        if not self.langs:
            nothing = np.zeros(len(texts))
            return nothing.astype(int), nothing, nothing, nothing.astype(int), np.ones(len(texts), bool)
        return self.verdicts(*self.entropies(key, bounds), none)

    def verdicts(self, ce: np.ndarray, n: np.ndarray, none: np.ndarray):
        """``judge`` from the bits per character."""
        best = ce.argmin(1)
        low = ce[np.arange(len(best)), best]
        score = 1 / np.exp2(-(ce - low[:, None]) * np.minimum(n, EVIDENCE)[:, None]).sum(1)
        return best, score, low - self.entropy[best], np.log2(np.maximum(n, 1)).astype(int), none

    def calibrate(self, found) -> None:
        """Take the rows (length, excess, m): the quantile of m held-back texts of a class of length."""
        for length, excess, m in found:
            self.slack[length] = (m * (excess + MARGIN) + PRIOR * self.slack[length]) / (m + PRIOR)


def _models(found: DataFrame, folder: Alphabet) -> LanguageModels:
    """Models of all counts: as arrays up to ENTRIES n-grams, as tables beyond."""
    found = shared(found)
    langs = sorted(r["lang"] for r in found.select("lang").distinct().collect())
    if langs and found.count() > ENTRIES:
        return LanguageModels.of_tables(found, langs, folder)
    parts = [found.where(F.col("lang") == g).select("key", "n").toPandas().assign(lang=g) for g in langs]
    return LanguageModels(pd.concat(parts) if parts else pd.DataFrame({"lang": [], "key": [], "n": []}), folder)


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> LanguageModels:
    """Models of all languages of ``docs``, with rejection calibrated on the rows held back."""
    back = F.pmod(F.xxhash64(F.lit(HELD_BACK), text), F.lit(HELD_BACK)) == 0
    folder = alphabet(docs.where(~back), text)
    models = _models(counts(docs.where(~back), folder, lang, text), folder)
    if models.langs:
        rows = docs.where(back & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
        if models.tables:
            measured = _judged(rows, models).where((F.col("lang") == F.col("name")) & ~F.col("none"))
        else:
            measured = rows.mapInArrow(trimmed(_measured(docs.sparkSession.sparkContext.broadcast(models))), "length int, excess double")
        levels = measured.groupBy("length").agg(F.percentile_approx("excess", QUANTILE, 100_000).alias("q"), F.count(F.lit(1)).alias("m"))
        models.calibrate([(r["length"], r["q"], r["m"]) for r in levels.collect()])
    return models


def _known(shared_models):
    """Each row's first column with what its text's broadcast n-grams come to, and its other n-grams with their counts."""

    def run(batches):
        models = shared_models.value
        for b in batches:
            for ids, texts in slices(b.column(0), b.column(1), SLICE):
                key, bounds = keys(models.folder, [t.decode() for t in texts])
                bits, others, times, at = models.known(key, bounds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, b.column(0).type),
                        pa.array(np.diff(bounds) - 1),
                        pa.array(_letterless(key, bounds)),
                        pa.array(bits.tolist(), pa.list_(pa.float64())),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(others, pa.int64())),
                        pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(times, pa.int64())),
                    ],
                    [b.schema.names[0], "chars", "none", "bits", "others", "times"],
                )

    return run


def _verdicts(shared_models):
    """``judge`` of rows of ``_known`` whose bits are whole."""

    def run(batches):
        models = shared_models.value
        names = np.array(models.langs, object)
        for b in batches:
            if b.num_rows:
                n, none = (b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
                ce = np.array(b.column(3).to_pylist(), np.float64) / np.maximum(n, 1)[:, None]
                best, score, excess, length, none = models.verdicts(ce, n, none)
                found = [pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(excess), pa.array(length, pa.int32()), pa.array(none)]
                yield pa.RecordBatch.from_arrays([b.column(0), *found], [b.schema.names[0], "name", "score", "excess", "length", "none"])

    return run


def _judged(rows: DataFrame, models: LanguageModels) -> DataFrame:
    """name, score, excess, length and none of each (id, text) under models that stay tables.

    What a text has beyond the broadcast n-grams becomes rows; each distinct one is looked
    up once, and a text's are summed. Only counts are shuffled, never texts.
    """
    held, kind = rows.sparkSession.sparkContext.broadcast(models), f"{rows.columns[0]} {rows.dtypes[0][1]}"
    known = rows.mapInArrow(trimmed(_known(held)), f"{kind}, chars long, none boolean, bits array<double>, others array<long>, times array<long>")
    known = shared(known.withColumn("_row", F.monotonically_increasing_id()))
    asked = known.select("_row", F.inline(F.arrays_zip(F.col("others").alias("key"), F.col("times").alias("n"))))
    logs = models.tables.by_key(models.tables.logs(asked))
    each = [F.sum(F.col(f"log{j}").cast("double") * F.col("n")) for j in range(len(models.langs))]
    sums = asked.join(logs, "key").groupBy("_row").agg(F.array(*each).alias("more"))
    bits = F.when(F.col("more").isNull(), F.col("bits")).otherwise(F.zip_with("bits", "more", lambda x, y: x - y))
    whole = known.join(sums, "_row", "left").select(rows.columns[0], "chars", "none", bits.alias("bits"))
    return whole.mapInArrow(trimmed(_verdicts(held)), f"{kind}, name string, score double, excess double, length int, none boolean")


def _judged_predictions(rows: DataFrame, models: LanguageModels) -> DataFrame:
    """``predict`` under models that stay tables."""
    none, slack = F.col("none"), F.get(F.array(*[F.lit(float(x)) for x in models.slack]), F.col("length"))
    return _judged(rows, models).select(
        "doc_id",
        F.when(none, F.lit(UNDETERMINED)).otherwise(F.col("name")).alias("lang_pred"),
        F.when(none, F.lit(0.0)).otherwise(F.col("score")).alias("score"),
        (none | (F.col("excess") > slack)).alias("rejected"),
    )


def _measured(shared_models):
    """Class of length and excess of the texts whose language is predicted as given."""

    def run(batches):
        names = np.array([*shared_models.value.langs, UNDETERMINED], object)
        for b in batches:
            for langs, texts in slices(b.column(0), b.column(1), SLICE):
                best, _, excess, length, none = shared_models.value.judge(texts)
                right = (names[best] == np.array(langs, object)) & ~none
                yield pa.RecordBatch.from_arrays([pa.array(length[right], pa.int32()), pa.array(excess[right])], ["length", "excess"])

    return run


def _predict(shared_models):
    def run(batches):
        models = shared_models.value
        names = np.array([*models.langs, UNDETERMINED], object)
        for b in batches:
            for doc_ids, texts in slices(b.column(0), b.column(1), SLICE):
                best, score, excess, length, none = models.judge(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, pa.int64()),
                        pa.array(names[np.where(none, len(models.langs), best)].tolist(), pa.string()),
                        pa.array(np.where(none, 0.0, score)),
                        pa.array(none | (excess > models.slack[length])),
                    ],
                    ["doc_id", "lang_pred", "score", "rejected"],
                )

    return run


def predict(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and rejected for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if models.tables:
        return _judged_predictions(rows, models)
    held = docs.sparkSession.sparkContext.broadcast(models)
    return rows.mapInArrow(trimmed(_predict(held)), "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, models: LanguageModels, lang: str = "lang", text: str = "text") -> DataFrame:
    """``docs`` without the rows that are rejected; a null language becomes the predicted one. No shuffle, unless the models stay tables."""
    if models.tables:
        rows = shared(docs.withColumn("_doc", F.monotonically_increasing_id()))
        found = _judged_predictions(rows.select(F.col("_doc").alias("doc_id"), F.col(text).alias("text")), models).where("not rejected")
        kept = rows.join(found.select(F.col("doc_id").alias("_doc"), "lang_pred"), "_doc")
        names = [F.coalesce(lang, F.col("lang_pred").cast(docs.schema[lang].dataType)).alias(lang) if c == lang else F.col(c) for c in docs.columns]
        return kept.select(*names)
    held = docs.sparkSession.sparkContext.broadcast(models)
    at, names = docs.columns.index(text), docs.columns
    run = _predict(held)

    def keep(batches):
        for b in batches:
            place = pa.array(range(b.num_rows), pa.int64())
            parts = list(run([pa.RecordBatch.from_arrays([place, b.column(at)], ["doc_id", "text"])]))
            if not parts:
                continue
            found = pa.Table.from_batches(parts).combine_chunks()
            if lang in names:
                k = names.index(lang)
                filled = pc.coalesce(b.column(k), found.column("lang_pred").combine_chunks().cast(b.column(k).type))
                b = b.set_column(k, names[k], filled)
            yield b.filter(pc.invert(found.column("rejected").combine_chunks()))

    return docs.mapInArrow(trimmed(keep), docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The documents that the fold rule allows to learn from."""
    return docs.where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
