"""Ids in text replaced by their labels: leftmost, longest, at word bounds, literally."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class LabelTrie:
    """A trie of ids. One pass over a text finds the ids, whatever their number.

    An id counts where both its ends are word bounds: a word character on one side only.
    Of the ids that start at a place the longest that counts is taken, and the search goes on behind it.
    Blank labels and empty ids are left out.
    """

    _END = ""  # no character

    def __init__(self, labels: dict[str, str]):
        self.root: dict = {}
        for key, label in labels.items():
            if key and label and label.strip():
                node = self.root
                for c in key:
                    node = node.setdefault(c, {})
                node[self._END] = label.strip()

    def replace(self, text: str) -> str:
        if not self.root:
            return text
        n, at, done, out, root, end = len(text), 0, 0, [], self.root, self._END
        before = False  # whether the character before is one of a word
        while at < n:
            c = text[at]
            inside = _word(c)
            if inside != before and c in root:
                node, k, found = root, at, None
                while k < n and (node := node.get(text[k])) is not None:
                    k += 1
                    if end in node and _word(text[k - 1]) != (k < n and _word(text[k])):
                        found = k, node[end]
                if found:
                    out += (text[done:at], found[1])
                    at = done = found[0]
                    before = _word(text[at - 1])
                    continue
            before = inside
            at += 1
        return "".join([*out, text[done:]])


def substituted(text: Column, labels: Column) -> Column:
    """``text`` with the ids of the map ``labels`` replaced; null labels change nothing.

    Rows of one document mostly come together, so the trie of the last map is kept.
    """

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, trie = None, LabelTrie({})
        for texts, keys, values in parts:
            out = []
            for t, k, v in zip(texts, keys, values, strict=True):
                if t is not None and k is not None:
                    own = tuple(k), tuple(v)
                    if own != last:
                        last, trie = own, LabelTrie(dict(zip(*own, strict=True)))
                    t = trie.replace(t)
                out.append(t)
            yield pd.Series(out, dtype="object")

    return run(text, F.map_keys(labels), F.map_values(labels))
