"""Secret scan: fixed patterns, and formats learned by grammar inference.

The base patterns are matched as stated in ``BASE``. Their matches in the corpus, with
a few public credential formats, are the labelled credentials: for each format a
prefix tree is built and its statistically compatible states are merged (ALERGIA, with
Hoeffding's bound) into a probabilistic automaton. Every run of at least ``LEAST`` token
characters - the shortest value that a base pattern takes - is then scored by its likelihood under each automaton
against a background of ordinary text. It becomes a ``format`` span where the evidence
exceeds ``THRESHOLD`` bits a character and, as secrets are rare among words, ``PRIOR`` bits in all,
unless a base span holds it whole. A worker remembers the verdicts on recent candidates.

Scanning is one pass in Arrow batches: RE2 finds the texts that can hold a match at
all, and only those are searched, one at a time; a batch of long texts needs no memory
beyond one text's. Fitting uses at most ``SAMPLE`` distinct labelled values a kind, whole
ones (those of least hash); scanning covers every whole text.

Defined results: null text is empty and has no spans; rows are independent, so
repeated rows, ties and extra columns do not matter; an empty table gives no rows and
is fitted from the public formats alone.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import shared, trimmed

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, pattern, group whose length counts, least length
BASE = (
    ("assign", re.compile(_ASSIGN, re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Bound on the labelled values a kind from which automata are fitted.
SAMPLE = 500
ALPHA, THRESHOLD = 0.02, 1.0
LEAST, PRIOR = 6, 24.0
#: Verdicts that a worker remembers before it starts anew.
KNOWN = 50_000
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}+")
#: What a text with a base match, and one with a candidate, holds (RE2).
_ANY_BASE = r"(?i:(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6})|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_ANY_CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST}}}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place, end) of the base matches, sorted."""
    out = []
    for k, (_, pattern, group, least) in enumerate(BASE):
        out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


# --- formats ---------------------------------------------------------------------

_CLASSES = (("d", string.digits), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("H", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ"))
_CLASS = {c: (name, len(chars)) for name, chars in _CLASSES for c in chars}
#: Shares of the classes in ordinary text.
_PLAIN = {"d": 0.03, "h": 0.24, "l": 0.6, "H": 0.03, "U": 0.05}
LITERAL = 4  # so many leading characters are kept as they are


def symbols(value: str) -> list[str]:
    return [c if i < LITERAL else _CLASS.get(c, (c, 1))[0] for i, c in enumerate(value)]


def background(value: str) -> float:
    """log2 probability of ``value`` as ordinary text: a number, or letters and signs as prose has them."""
    if value.isdigit() and value.isascii():
        return -math.log2(10) * len(value)
    return sum(math.log2(_PLAIN[x[0]] / x[1]) if (x := _CLASS.get(c)) else math.log2(0.01) for c in value)


class Automaton:
    """Probabilistic automaton: prefix tree of the samples with compatible states merged."""

    def __init__(self, values: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.end, self.total = [0], [0]
        for v in values:
            at = 0
            for s in symbols(v):
                self.total[at] += 1
                self.count[at][s] += 1
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    self.count.append(defaultdict(int))
                    self.end.append(0)
                    self.total.append(0)
                at = self.next[at][s]
            self.total[at] += 1
            self.end[at] += 1
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        self.shift = {}

    def _alike(self, a: int, b: int, c: float) -> bool:
        """Hoeffding's test on the end and symbol shares of a, b and all their joint successors."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total[a], self.total[b]
            bound = c * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.end[a] / n - self.end[b] / m) > bound:
                return False
            for s in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(s, 0) / n - self.count[b].get(s, 0) / m) > bound:
                    return False
            stack += [(self.next[a][s], self.next[b][s]) for s in self.next[a].keys() & self.next[b].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.total[a] += self.total[b]
            self.end[a] += self.end[b]
            for s, n in self.count[b].items():
                self.count[a][s] += n
                if s in self.next[a]:
                    stack.append((self.next[a][s], self.next[b][s]))
                else:
                    self.next[a][s] = self.next[b][s]

    def _merge(self, c: float) -> None:
        red, blue = [0], [(0, s) for s in sorted(self.next[0])]
        while blue:
            parent, s = blue.pop(0)
            b = self.next[parent][s]
            if b in red:
                continue
            for r in red:
                if self._alike(r, b, c):
                    self.next[parent][s] = r
                    self._fold(r, b)
                    break
            else:
                red.append(b)
            known = set(red)
            blue = sorted({(r, x) for r in red for x, t in self.next[r].items() if t not in known}, key=lambda y: (red.index(y[0]), y[1]))
        self.states = len(red)

    def score(self, value: str) -> float:
        """log2 probability of ``value``; none if a state lacks a symbol."""
        at, total = 0, 0.0
        for i, c in enumerate(value):
            s, size = (c, 1) if i < LITERAL else _CLASS.get(c, (c, 1))
            n = self.count[at].get(s, 0)
            if not n:
                return -math.inf
            total += math.log2(n / self.total[at] / size)
            at = self.next[at][s]
        return total + math.log2(max(self.end[at], 0.01) / self.total[at])


def public_formats(n: int = 60) -> dict[str, list[str]]:
    """Invented examples of credential formats that are public knowledge."""
    rng = random.Random(7)
    word = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    alnum, upper, lower = string.ascii_letters + string.digits, string.ascii_uppercase + string.digits, "0123456789abcdef"
    return {
        "github": ["ghp_" + word(alnum, 36) for _ in range(n)],
        "slack": [f"xoxb-{word(string.digits, 12)}-{word(string.digits, 12)}-{word(alnum, 24)}" for _ in range(n)],
        "google": ["AIza" + word(alnum + "_-", 35) for _ in range(n)],
        "stripe": ["sk_live_" + word(alnum, 24) for _ in range(n)],
        "access": ["AKIA" + word(upper, 16) for _ in range(n)],
        "hex": [word(lower, k) for k in (32, 40, 64) for _ in range(n)],
    }


def fit(labelled: dict[str, list[str]], alpha: float = ALPHA) -> dict[str, Automaton]:
    return {k: Automaton(sorted(set(v)), alpha) for k, v in sorted(labelled.items()) if v}


def likely(automata: dict[str, Automaton], value: str) -> bool:
    """Whether some format explains ``value`` better than ordinary text, by THRESHOLD bits a character and PRIOR in all."""
    # every other automaton has no path for the first character
    best = max((a.score(value) for a in automata.values() if value[0] in a.next[0]), default=-math.inf)
    return best > -math.inf and best - background(value) > max(PRIOR, THRESHOLD * len(value))


class Formats:
    """The automata, and the verdicts on recent candidates."""

    def __init__(self, automata: dict[str, Automaton]):
        self.automata, self.known = automata, {}

    def hold(self, values: set[str]) -> set[str]:
        """Those of ``values`` that some format explains."""
        if len(self.known) > KNOWN:
            self.known = {}
        for v in values.difference(self.known):
            self.known[v] = likely(self.automata, v)
        return {v for v in values if self.known[v]}


def spans(text: str, formats: Formats, with_base: bool = True) -> tuple[list, list]:
    """Base spans, and all spans; ``with_base`` false where the text is known to have none."""
    base = base_spans(text) if with_base else []
    more, k, reach = [], 0, -1
    held = formats.hold(set(_CANDIDATE.findall(text)))
    for m in _CANDIDATE.finditer(text) if held else ():
        # both lists ascend by start, so a base span holds the candidate if the furthest end so far does
        while k < len(base) and base[k][0] <= m.start():
            reach = max(reach, base[k][2])
            k += 1
        if m.end() > reach and m.group() in held:
            more.append((m.start(), KINDS.index("format"), m.end()))
    return base, sorted(base + more)


# --- scanning --------------------------------------------------------------------


def _matching(texts: pa.Array, pattern: str) -> np.ndarray:
    found = pc.match_substring_regex(texts, pattern=pattern)
    return pc.fill_null(found, False).to_numpy(zero_copy_only=False)


def suspicious(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts hold a base match, and which hold one or a candidate; nulls hold none."""
    base = _matching(texts, _ANY_BASE)
    return base, base | _matching(texts, _ANY_CANDIDATE)


def _labelled(batches):
    """Distinct values of base matches."""
    for b in batches:
        seen = set()
        texts = b.column(0)
        for k in np.flatnonzero(_matching(texts, _ANY_BASE)):
            text = texts[int(k)].as_py()
            for start, kind, end in base_spans(text):
                value = text[start:end]
                if KINDS[kind] == "assign":
                    value = BASE[0][1].match(value).group(2)
                if len(value) >= LEAST:
                    seen.add((KINDS[kind], value))
        kinds, values = zip(*sorted(seen), strict=True) if seen else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])


def train(docs: DataFrame, text: str = "text") -> dict[str, Automaton]:
    """Automata from the public formats and from at most SAMPLE distinct base matches a kind."""
    values = docs.select(F.col(text).alias("text")).mapInArrow(trimmed(_labelled), "kind string, value string").distinct()
    values = shared(values.select("kind", "value", F.xxhash64("value").alias("h")))
    labelled = public_formats()
    for kind, *_ in BASE:
        least = values.where(F.col("kind") == kind).orderBy("h", "value").limit(SAMPLE).collect()
        labelled[f"corpus_{kind}"] = [x["value"] for x in least]
    return fit(labelled)


def _found(texts: pa.Array, formats: Formats):
    """Yields (row, text, base spans, all spans) of the texts that have a span."""
    base, any_ = suspicious(texts)
    for k in np.flatnonzero(any_).tolist():
        text = texts[k].as_py()
        own, every = spans(text, formats, bool(base[k]))
        if every:
            yield k, text, own, every


def _replaced(array: pa.Array, changed: dict[int, object]) -> pa.Array:
    """``array`` with some values replaced, without taking the others apart."""
    mask = np.zeros(len(array), bool)
    mask[list(changed)] = True
    return pc.replace_with_mask(array, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], array.type))


def _scan(shared_automata, keep_text: bool):
    def run(batches):
        formats = Formats(shared_automata.value)
        empty = hashlib.sha256(b"").hexdigest()
        label = lambda s: ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in s)
        for b in batches:
            texts, n = b.column(1), b.num_rows
            counts = np.zeros((3, n), np.int64)
            digest, joined, redacted = [empty] * n, [""] * n, {}
            for k, text, base, every in _found(texts, formats):
                for _, kind, _ in base:
                    counts[kind, k] += 1
                digest[k], joined[k] = hashlib.sha256(label(base).encode()).hexdigest(), label(every)
                if keep_text:
                    redacted[k] = redact(text, every)
            columns = [b.column(0), *(pa.array(c) for c in counts), pa.array(digest), pa.array(joined)]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if keep_text:
                columns.append(_replaced(texts, redacted))
                names.append("redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def redact(text: str, found: list, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    out, at = [], 0
    reach = -1
    for start, _, end in found:
        if start >= reach:
            out += [text[at:start], mark]
        at = reach = max(reach, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, automata: dict[str, Automaton], text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced, and the length column brought up to date. No shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(automata)
    at, names = docs.columns.index(text), docs.columns

    def run(batches):
        formats = Formats(held.value)
        for b in batches:
            texts = b.column(at)
            changed = {k: redact(value, every) for k, value, _, every in _found(texts, formats)}
            if changed:
                b = b.set_column(at, text, _replaced(texts, changed))
                if length in names:
                    k = names.index(length)
                    b = b.set_column(k, length, _replaced(b.column(k), {row: len(value) for row, value in changed.items()}))
            yield b

    return docs.mapInArrow(trimmed(run), docs.schema)


def scan(docs: DataFrame, automata: dict[str, Automaton], id_col: str = "doc_id", text: str = "text", redacted: bool = False) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans [and the text with its spans replaced] for every row."""
    held = docs.sparkSession.sparkContext.broadcast(automata)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + (", redacted string" if redacted else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(trimmed(_scan(held, redacted)), schema)
