"""Pipe tables and figures in markdown, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

CONTENT_CHARS = 900
# Header aliases of the logical fields of a matrix.
FIELD_ALIASES = {
    "device": ("DEVICE", "TAG"),
    "description": ("DESCRIPTION", "DESC"),
    "pid_or_page": ("P AND ID", "P ID", "PID", "P ID OR PAGE", "P AND ID OR PAGE", "PAGE", "PAGE NUMBER", "P AND ID NUMBER"),
    "interlock_no": ("INTERLOCK", "INTERLOCK NUMBER", "INTERLOCK NO"),
    "notes": ("NOTE", "NOTES", "REMARK", "REMARKS"),
    "interacting_device": ("INTERACTING DEVICE", "INTERACT DEVICE"),
    "control_device": ("CONTROL DEVICE", "CTRL DEVICE"),
    "device_or_equip": ("DEVICE OR EQUIP", "DEVICE OR EQUIPMENT", "DEVICE EQUIP", "EQUIPMENT"),
}
# Words of a figure's description.
GENERIC_TERMS = ("image", "picture", "figure", "diagram")
INDICATOR_WORDS = ("shows", "displays", "illustrates", "depicts")


def lines(markdown: Column) -> Column:
    return F.split(markdown, "\n")


def normal_cell(cell: Column) -> Column:
    """Trimmed, spaces collapsed, and formulas joined: ``C 1 H 4`` becomes ``C1H4``."""
    x = F.regexp_replace(T.strip(cell), r"[\s\p{Z}]{2,}", " ")
    return F.regexp_replace(F.regexp_replace(x, r"([A-Z])[\s\p{Z}]+(\d)", "$1$2"), r"(\d)[\s\p{Z}]+([A-Z])", "$1$2")


def normal_tables(markdown: Column) -> Column:
    """Every line with a pipe has its cells in normal form; fences and other lines stay."""
    row = lambda x: F.array_join(F.transform(F.split(x, r"\|"), normal_cell), "|")
    return F.array_join(F.transform(lines(markdown), lambda x: F.when(x.contains("|") & ~T.strip(x).startswith("```"), row(x)).otherwise(x)), "\n")


def header_label(value: Column) -> Column:
    x = F.regexp_replace(F.upper(T.strip(F.coalesce(value, F.lit("")))), "&+", " AND ")
    return F.trim(F.regexp_replace(x, "[^A-Z0-9]+", " "))


def header_field(value: Column, expected: tuple[str, ...]) -> Column:
    """The first expected field one of whose aliases stands in the header as whole words; null if none."""
    padded = F.concat(F.lit(" "), header_label(value), F.lit(" "))
    has = lambda field: reduce(lambda a, b: a | b, [padded.contains(f" {alias} ") for alias in FIELD_ALIASES[field]])
    return F.coalesce(*[F.when(has(field), F.lit(field)) for field in expected])


def sheet_facts(markdown: Column, sheet: Column) -> Column:
    """``Columns: ...`` without generated names, and the number of rows after the separator; the sheet's name if there is no table."""
    rows = F.filter(F.transform(lines(markdown), T.strip), lambda x: x.startswith("|"))
    header = F.get(F.filter(rows, lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"))) >= 2), F.lit(0))
    names = F.filter(F.transform(F.split(header, r"\|"), T.strip), lambda c: c != "")
    real = F.filter(names, lambda c: ~c.rlike(r"^Col\d+$"))
    rule = lambda x: F.regexp_replace(x, r"[|\-: ]", "") == ""
    first = F.array_position(F.transform(rows, rule), True)
    n = F.size(F.filter(rows, lambda x, i: (first > 0) & (i >= first) & ~rule(x)))
    shown = F.concat(F.lit("Columns: "), F.array_join(F.when(F.size(real) > 0, real).otherwise(names), ", "))
    found = F.array_compact(F.array(F.when(F.size(names) > 0, shown), F.when(n > 0, F.concat(F.lit("Contains "), n.cast("string"), F.lit(" data rows")))))
    return F.when(header.isNull(), F.array(F.concat(F.lit("Sheet: "), sheet))).otherwise(found)


def bounded_content(heading: Column, answers: Column, citation: Column, most: int = CONTENT_CHARS) -> Column:
    """Heading, the answers that are not blank and the citation, in at most ``most`` characters."""
    kept = F.filter(answers, lambda x: T.strip(x) != "")
    body = T.strip(F.concat_ws("\n", F.concat(F.lit("## "), heading), F.lit(""), F.array_join(kept, "\n")))
    room = most - F.length(citation) - 2
    cut = F.concat(T.rstrip(F.substring(body, F.lit(1), F.greatest(F.lit(0), room - 1))), F.lit("…"))
    return T.strip(F.concat(F.when(F.length(body) > room, cut).otherwise(body), F.lit("\n\n"), citation))


def description_issues(description: Column, location: Column) -> Column:
    """What is wrong with a figure's description and place; an empty list is valid."""
    low = F.lower(description)
    short = description.isNull() | (F.length(description) < 10)
    told = reduce(lambda a, b: a | b, [low.contains(w) for w in INDICATOR_WORDS])
    return F.array_compact(
        F.array(
            F.when(short, "Description too short or missing"),
            F.when(~short & low.isin(*GENERIC_TERMS), "Description is too generic"),
            F.when(~short & ~told, "Description should explain what the figure shows"),
            F.when(location.isNull() | location.isin("", "Unknown"), "Source page number missing"),
        )
    )


def preceding(markdown: Column, at: Column, window: int = 200) -> Column:
    """The ``window`` characters before the 1-based place ``at``."""
    start = F.greatest(F.lit(1), at - window)
    return F.substring(markdown, start, at - start)


def caption(context: Column) -> Column:
    """What follows ``Figure n`` on the first line that has it; null if none has."""
    lines = F.transform(F.split(context, "\n"), T.collapse_spaces)
    place = lambda x: F.regexp_instr(x, F.lit("[Ff]igure [0-9]"))
    line = F.get(F.filter(lines, lambda x: place(x) > 0), F.lit(0))
    behind = F.regexp_replace(F.substr(line, place(line) + len("figure ")), "^[0-9]+", "")
    mark = F.substring(behind, 1, 1).isin(":", ".")
    return F.trim(F.when(mark, F.substr(behind, F.lit(2))).otherwise(behind))


# Fixed value: the heading of an appended block of visual elements, before its page in brackets.
VISUAL_HEADING = "Additional Visual Elements"
_BREAK = "\x1e\x1f"


def _visual_page(line: Column) -> Column:
    """The page of a block's heading line, by its parts: two signs, the words, a number in brackets; null for other lines."""
    words, number = F.substring_index(line, "(", 1), F.substring_index(line, "(", -1)
    named = line.startswith("##") & (T.collapse_spaces(words) == f"## {VISUAL_HEADING}")
    inner = T.strip(number)
    closed = inner.endswith(")") & T.strip(F.substring(inner, 1, 4)).eqNullSafe("Page")
    page = T.strip(F.substr(inner, F.lit(5), F.length(inner) - 5))
    return F.when(named & closed & page.rlike("^[0-9]+$"), page.try_cast("int"))


def visual_parts(markdown: Column) -> Column:
    """``clean`` markdown, and ``blocks`` (page, text): the appended blocks of visual elements, each up to the next.

    Heading lines are marked by two control characters that texts do not hold, at which the text is cut.
    """
    marked = F.transform(F.split(markdown, "\n"), lambda x: F.when(_visual_page(x).isNotNull(), F.concat(F.lit(_BREAK), x)).otherwise(x))
    parts = F.split(F.array_join(marked, "\n"), _BREAK)
    blocks = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.struct(_visual_page(F.substring_index(x, "\n", 1)).alias("page"), x.alias("text")))
    return F.struct(F.get(parts, F.lit(0)).alias("clean"), blocks.alias("blocks"))
