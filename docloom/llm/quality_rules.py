"""Quality rules: a threshold table compiled into Spark column expressions.

Everything runs in the JVM: the text is split once, the measures are array
expressions over its words and lines, and the verdict is one boolean built from
``RULES``. Nothing is shuffled, so skewed keys cannot matter.

Repeated windows are found by hashes: a text whose window hashes are all distinct has
none, else they are sorted and the words behind equal hashes compared, so the count is
exact at any length.

Defined results: null or empty text has zero words and fails; repeated rows are
judged one by one; extra columns are kept unless they clash with a measure's
name, in which case the measure wins; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACE_CLASS, WORD_CLASS

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "in", "for", "is", "it", "on", "was", "are", "this",
    "der", "die", "das", "und", "ist", "nicht", "mit", "ein", "eine", "von", "zu", "den", "auf", "sich", "auch",
    "le", "la", "les", "de", "des", "et", "que", "en", "un", "une", "du", "est", "pour", "qui", "dans",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "al", "lo", "como", "no",
)

#: A word with a letter; possessive, so that no place of a text is tried twice.
_ALPHA_WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+"
#: Longer than any array.
MOST = 1 << 30

#: measure, lowest, highest value that passes (None: open).
RULES = (
    ("n_words", 50, None),
    ("mean_word_length", 2.0, 14.0),
    ("symbol_ratio", None, 0.3),
    ("stop_words", 2, None),
    ("dup_line_ratio", None, 0.3),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
    ("alpha_word_ratio", 0.6, None),
    ("repeat_word_ratio", None, 0.5),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _windows(words: Column) -> Column:
    """A hash of each 3-word window."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(hashes, F.slice(hashes, 2, MOST), lambda x, y: F.xxhash64(x, y))
    return F.slice(F.zip_with(pairs, F.slice(hashes, 3, MOST), lambda x, y: F.xxhash64(x, y)), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))


def _repeated(windows: Column, words: Column) -> Column:
    """Sorted places of the windows that occur twice or more.

    Windows are sorted by hash, so equal hashes stand side by side; where two such windows
    differ, the others of that hash are asked too.
    """
    near = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    alike = lambda x, y: F.slice(words, x["i"] + 1, 3) == F.slice(words, y["i"] + 1, 3)

    def twice(s: Column) -> Column:
        def of(x: Column, i: Column) -> Column:
            beside = F.slice(s, F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2))
            near_by = F.exists(beside, lambda y: (x["i"] != y["i"]) & near(x, y))
            alike_by = F.exists(beside, lambda y: (x["i"] != y["i"]) & near(x, y) & alike(x, y))
            return F.when(~near_by, False).when(alike_by, True).otherwise(F.exists(s, lambda y: (x["i"] != y["i"]) & near(x, y) & alike(x, y)))

        return F.sort_array(F.transform(F.filter(s, of), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # an array of one gives the sorted windows a name, so that they are not sorted for each use
    return F.get(F.transform(F.array(ordered), twice), F.lit(0))


def _count(text: Column, pattern: str, into: str) -> Column:
    """How often ``pattern`` occurs, counted as characters ``into`` that stand for it in a text without others."""
    found = F.regexp_replace(text, pattern, into)
    return (F.length(found) - F.length(F.replace(found, F.lit(into), F.lit("")))).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column for each measure; ``text`` itself is not changed."""
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    words, lines, windows, places = (own + x for x in ("words", "lines", "windows", "places"))
    raw = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({words: _words(raw), lines: F.filter(F.split(raw, "\n"), lambda x: x.rlike(WORD_CLASS))})
    w, n_lines = F.col(words), F.size(lines)
    out = out.withColumn(windows, _windows(w))
    some = F.size(F.array_distinct(windows)) < F.size(windows)
    out = out.withColumn(places, F.when(some, _repeated(F.col(windows), w)).otherwise(F.array().cast("array<int>")))
    r, size = F.col(places), F.size(places)
    covered = F.aggregate(
        F.transform(r, lambda x, i: F.when(i + 1 < size, F.least(F.lit(3), F.get(r, i + 1) - x)).otherwise(F.lit(3))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    share = lambda pattern: _ratio(F.size(F.filter(lines, lambda x: x.rlike(pattern))), n_lines)
    n = F.size(w).cast("long")
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(raw) - F.length(F.regexp_replace(raw, r"[#*$%&|<>]", ""))).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": covered,
        "stop_words": F.size(F.array_intersect(F.split(F.lower(raw), f"{SPACE_CLASS}+"), stop)).cast("long"),
        "alpha_word_ratio": _ratio(_count(raw, _ALPHA_WORD, "a"), n),
        "ellipsis_line_ratio": share(r"(\.\.\.|…)\s*$"),
        "bullet_line_ratio": share(r"^\s*[-•*]"),
    }
    out = out.withColumns({own + k: v for k, v in counts.items()} | {f"{own}n_lines": n_lines})
    of = lambda name: F.col(own + name)
    ratios = {
        "mean_word_length": _ratio(of("word_chars"), of("n_words")),
        "symbol_ratio": _ratio(of("n_symbols"), of("n_words")),
        "dup_line_ratio": _ratio(of("n_dup_lines"), of("n_lines")),
        "repeat_word_ratio": _ratio(of("n_repeat_words"), of("n_words")),
    }
    out = out.withColumns({k: of(k) for k in counts} | ratios)
    return out.drop(*[c for c in out.columns if c.startswith(own)])


def verdict(rules=RULES) -> Column:
    """All thresholds as one boolean column over the measures."""
    tests = []
    for name, low, high in rules:
        if low is not None:
            tests.append(F.col(name) >= low)
        if high is not None:
            tests.append(F.col(name) <= high)
    return reduce(lambda a, b: a & b, tests)


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """``docs`` with measures, ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = measures(docs, text).withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
