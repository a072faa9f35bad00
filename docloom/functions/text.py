"""Column builders for text: trimming, tokens, overlap, truncation, normal forms.

The patterns take ``(?U)`` where classes must be Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of the known workspaces, by their lower-case alias.
WORKSPACE_ALIASES = {
    "power block": "Power Block",
    "pre treatment": "Pre Treatment",
    "pretreatment": "Pre Treatment",
    "liquefaction": "Liquefaction",
    "osbl": "OSBL (Outside Battery Limits)",
    "outside battery limits": "OSBL (Outside Battery Limits)",
    "maintenance": "Maintenance",
    "instrumentation": "Instrumentation",
    "dcs": "DCS (Distributed Control System)",
    "distributed control system": "DCS (Distributed Control System)",
    "electrical": "Electrical",
    "mechanical": "Mechanical",
}


def strip(x: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"[\s\p{Z}]+$", "")


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def scope_token(x: Column) -> Column:
    """Trimmed, lower-cased, blank as null."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def tokens(x: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, repeats kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def overlap_score(terms: Column, text: Column) -> Column:
    """Share of the query terms, with their multiplicity, that the text has."""
    own = F.array_intersect(tokens(text), terms)  # by hash; at most the terms remain
    hits = F.aggregate(own, F.lit(0), lambda n, word: n + F.size(F.filter(terms, lambda t: t == word)))  # the text stays out of the lambda, which is run for each term
    return F.when(F.size(terms) > 0, hits / F.size(terms)).otherwise(F.lit(0.0))


def truncate(x: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters; longer texts end in ``mark``."""
    return F.when(F.length(x) > limit, F.concat(F.substring(x, 1, limit - len(mark)), F.lit(mark))).otherwise(x)


def collapse_spaces(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def conversation_title(x: Column, limit: int = 80, default: str = "New Conversation") -> Column:
    short = F.concat(F.regexp_replace(F.substring(collapse_spaces(x), 1, limit - 3), r"(?U)\s+$", ""), F.lit("..."))
    text = collapse_spaces(x)
    return F.coalesce(F.nullif(F.when(F.length(text) > limit, short).otherwise(text), F.lit("")), F.lit(default))


def workspace_name(x: Column) -> Column:
    """The display name of a workspace: a known alias, else each word capitalised."""
    table = F.create_map(*[F.lit(v) for kv in WORKSPACE_ALIASES.items() for v in kv])
    return F.when(blank_to_null(x).isNotNull(), F.coalesce(F.try_element_at(table, F.lower(strip(x))), F.initcap(collapse_spaces(x))))


def title_case(x: Column) -> Column:
    """Upper case after any character that is no letter, lower case after a letter."""
    letters = F.filter(F.split(F.lower(x), ""), lambda c: c != "")
    return F.array_join(
        F.transform(
            letters,
            lambda c, i: F.when((i > 0) & F.get(letters, F.when(i > 0, i - 1).otherwise(F.lit(0))).rlike(r"\p{L}"), c).otherwise(F.upper(c)),
        ),
        "",
    )


def without_comments(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)<!--.*?-->", "")


def page_numbers(x: Column) -> Column:
    """Numbers after the word page, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"(?i)page\s+(\d{1,9})"), F.lit(1)), lambda s: s.cast("int")))


def match_form(x: Column) -> Column:
    """Lower-case form for comparing lines: &amp; decoded, white space collapsed, odd characters dropped."""
    text = F.regexp_replace(F.regexp_replace(x, "&amp;", "&"), r"(?U)\s+", " ")
    return F.lower(strip(F.regexp_replace(text, r"(?U)[^\w\s|%-]", "")))


# What is asked of a section, by what its heading tells; {} is the page, the heading in lower case, or the heading.
QUESTIONS = {
    "page": "What is covered on page {}?",
    "nothing": "What should you know from this section?",
    "page heading": "What is covered on {}?",
    "topic": "What does this section explain about {}?",
}


def heading_question(heading: Column, page: Column) -> Column:
    """A heading as a question; without one, a question about the page."""
    name = F.btrim(collapse_spaces(F.coalesce(heading, F.lit(""))), F.lit(" #:-"))
    words = F.split(F.lower(name), " ")
    is_page = (F.size(words) == 2) & (F.get(words, F.lit(0)) == "page") & F.get(words, F.lit(1)).rlike(r"(?U)^\d+$")
    empty = F.when(page > 0, "page").otherwise("nothing")
    kind = F.when(name == "", empty).when(is_page, "page heading").otherwise("topic")
    about = F.when(kind == "page", page.cast("string")).when(kind == "page heading", F.lower(name)).otherwise(name)
    form = F.create_map(*[F.lit(x) for pair in QUESTIONS.items() for x in pair])[kind]
    return F.when(name.endswith("?"), name).otherwise(F.replace(form, F.lit("{}"), F.coalesce(about, F.lit(""))))
