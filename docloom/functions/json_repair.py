"""JSON that a model wrote: strict objects stay in the JVM, others are read tolerantly in an Arrow function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GAP = re.compile(r"(?:[\s,;]|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_EMPTY = re.compile(r"\{\s*\}")
_BARE = re.compile(r"[^\s,:;{}\[\]\"']+")
_QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\]|\\.)*)(?:{q}|\\?\Z)", re.S) for q in "\"'"}
_WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}


def _scalar(word: str):
    if word in _WORDS:
        return _WORDS[word]
    try:
        return json.loads(word)
    except ValueError:
        return word


def _string(body: str) -> str:
    """A quoted string's value; escapes that JSON does not know stand for themselves."""
    try:
        return json.loads('"' + re.sub(r'\\\'', "'", body).replace('"', '\\"').replace('\\\\"', '\\"') + '"', strict=False)
    except ValueError:
        return body


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the objects in ``text`` that lie in no other, in order; one that is open at the end goes to the end.

    One scan: braces outside strings are matched. A quote starts a string only inside an
    object and behind a sign of its syntax, so apostrophes in prose do not; a quote that nothing closes is an ordinary character.
    """
    out, depth, start, before, at, n = [], 0, 0, "", 0, len(text)
    unclosed: set[str] = set()
    for_string = {q: re.compile(rf"(?:[^{q}\\]|\\.)*{q}", re.S) for q in "\"'"}
    while at < n:
        c = text[at]
        if c == "{":
            if not depth:
                start = at
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append((start, at + 1))
        elif c in for_string and depth and before in "{[:,;" and c not in unclosed:
            if m := for_string[c].match(text, at + 1):
                at = m.end() - 1
            else:
                unclosed.add(c)
        if not c.isspace():
            before = c
        at += 1
    return out + [(start, n)] * (depth > 0)


class _Open:
    """An object or a list that is not closed yet: its values as pieces of JSON text, and the name that waits for one."""

    __slots__ = ("start", "values", "name", "key")

    def __init__(self, mark: str, start: int):
        self.start, self.values, self.name, self.key = start, {} if mark == "{" else [], None, None

    def put(self, value) -> None:
        if isinstance(self.values, list):
            self.values.append(value)
        elif self.key is not None:
            self.values[self.key], self.key, self.name = value, None, None
        else:
            self.name = value if isinstance(value, str) else None

    def pieces(self) -> list:
        if isinstance(self.values, list):
            parts = [x for v in self.values for x in (", ", v)][1:]
            return ["[", *parts, "]"]
        if self.key is not None:
            self.values.setdefault(self.key, "null")
        parts = [x for k in sorted(self.values) for x in (", ", json.dumps(k, ensure_ascii=False), ": ", self.values[k])][1:]
        return ["{", *parts, "}"]


def _text(pieces) -> str:
    """Pieces within pieces, laid out without recursion."""
    out, stack = [], [pieces]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x))
    return "".join(out)


def _read(text: str) -> str | None:
    """The object that ``text`` starts with, as JSON text, or else the first in it that has a member.

    Either quote, bare names, stray commas, comments and a missing end are all taken; what is open when the
    text ends is closed there. The open objects are a list, so depth costs memory only.
    """
    stack: list[_Open] = []
    whole, best, at = None, None, 0

    def close() -> None:
        nonlocal whole, best
        top = stack.pop()
        value = top.pieces()
        if isinstance(top.values, dict) and (top.values or _EMPTY.match(text, top.start)) and (best is None or top.start < best[0]):
            best = top.start, value
        if stack:
            stack[-1].put(value)
        else:
            whole = value

    while (at := _GAP.match(text, at).end()) < len(text) and whole is None:
        mark = text[at]
        if mark in "{[":
            stack.append(_Open(mark, at))
        elif mark in "}]":
            close()
        elif mark in _QUOTED:
            m = _QUOTED[mark].match(text, at)
            stack[-1].put(json.dumps(_string(m[1]), ensure_ascii=False))
            at = m.end() - 1
        elif mark == ":":
            top = stack[-1]
            if isinstance(top.values, dict) and top.name is not None and top.key is None:
                top.key = json.loads(top.name) if top.name.startswith('"') else top.name
        else:
            m = _BARE.match(text, at)
            stack[-1].put(json.dumps(_scalar(m[0]), ensure_ascii=False))
            at = m.end() - 1
        at += 1
    while stack:
        close()
    return _text(best[1]) if best else None


def recovered(text: str | None) -> str | None:
    """The first JSON object in ``text``, as it stands, in prose or a code fence, lax or cut off; null if there is none.

    Balanced objects are tried in order, each as it stands and then tolerantly; the time is linear in the text and nothing
    depends on how deep it is nested.
    """
    for start, end in candidates(text or ""):
        try:
            value = json.loads(text[start:end])
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False, sort_keys=True)
        except (ValueError, RecursionError):
            pass
        if (found := _read(text[start:end])) is not None:
            return found
    return None


def with_recovered(df: DataFrame, column: str, out: str) -> DataFrame:
    """``out``: the object of ``column`` as JSON text, or null. Strict objects are taken as they are."""

    @F.pandas_udf("string")
    def repair(s: pd.Series) -> pd.Series:
        return s.map(recovered, na_action="ignore")

    x = F.col(column)
    strict = F.trim(x).startswith("{") & F.try_parse_json(x).isNotNull()
    return df.withColumn(out, F.when(strict, x).otherwise(repair(F.when(~F.coalesce(strict, F.lit(False)), x))))


def parent_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"^(.*)\.[^.]*$", 1), F.lit(""))


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, r"\."))


def coalesced_chunk(raw: Column) -> Column:
    """A chunk from JSON with alias keys: content, heading and id."""
    get = lambda *names: F.coalesce(*[F.nullif(F.trim(F.get_json_object(raw, f"$.{n}")), F.lit("")) for n in names])
    return F.struct(get("content", "markdown", "body", "text").alias("content"), get("heading", "title", "question").alias("heading"), get("id", "chunk_id").alias("id"))
