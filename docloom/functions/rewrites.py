"""An ordered table of line rewrites compiled into one alternation: the first rule that matches decides, one replacement follows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import text as T

# Log lines of an optimization job and what a viewer is shown; null drops the line.
LOG_RULES: tuple[tuple[str, str | None], ...] = (
    (r"^STAGE 10: .*", None),
    (r"^This will take .*", None),
    (r"^Sending to .* for RAG optimization\.\.\.$", None),
    (r"^Text Reformatting \(model=.*\)$", None),
    (r"^Text Reformatting complete \((.+)\)$", r"Job completed in \1"),
    (r"^Optimization started$", "Starting job"),
    (r"^Load Tokenizer$", "Initialize tokenizer"),
    (r"^Load Tokenizer complete \((.+)\)$", r"Tokenizer ready in \1"),
    (r"^Load Model$", "Initialize model"),
    (r"^Load Model complete \((.+)\)$", r"Model ready in \1"),
    (r"^Generate Response \(chars=(.+)\)$", r"Prepare generation request (\1 chars)"),
    (r"^Generating \((.+) max tokens\)\.\.\.$", r"Generate output (up to \1 tokens)"),
    (r"^Generate Response complete \((.+)\)$", r"Generation finished in \1"),
    (r"^Generation progress: (.+)$", r"Generate output: \1"),
    (r"^Unloading model resources\.\.\.$", "Finalize output"),
    (r"^Model resources released$", None),
    (r"^Parse Response$", "Validate output"),
    (r"^Parse Response complete \((.+)\)$", r"Validation finished in \1"),
    (r"^JSON parsed and normalized successfully$", "Output validated"),
    (r"^Using built-in reformatter prompt fallback because .*", "Using fallback prompt"),
    (r"^Structured JSON response could not be recovered; using deterministic optimization-prep synthesis$", "Fallback output generated"),
    (r"^Generation unavailable; using deterministic optimization-prep synthesis: (.+)$", "Generation unavailable; using fallback output"),
    (r"^Insufficient free GPU memory after model load \((.+) available\); using deterministic optimization-prep synthesis$", r"Insufficient GPU memory (\1 available); using fallback output"),
    (r"^Saving optimization artifacts$", "Write artifacts"),
    (r"^Optimized artifacts written in (.+)$", r"Artifacts written in \1"),
    (r"^Reformatting complete$", "Artifacts ready"),
    (r"^Optimization completed in (.+)$", r"Job completed in \1"),
    (r"^JSON: .*$", None),
    (r"^Markdown: .*$", None),
)


def rewritten(x: Column, rules: tuple[tuple[str, str | None], ...]) -> Column:
    """``x`` by the first rule that matches it whole; null where that rule drops it, ``x`` itself where none matches.

    A rule whose pattern does not end in ``$`` takes the rest of the line along.
    """
    whole = tuple((p if p.endswith("$") else f"{p}$", r) for p, r in rules)
    literal = [re.match(r"(?:[^\\.^$*+?()[\]{}|]|\\[^\w])*", p.removeprefix("^"))[0] for p, _ in whole]
    # the alternation names the rule by its literal beginning; what follows is only looked at
    heads = [re.sub(r"\\(.)", r"\1", h) for h in literal]
    if len(set(heads)) < len(heads):
        raise ValueError("two rules begin alike")
    look = "^(?:" + "|".join(f"{h}(?={p.removeprefix('^')[len(h):]})" for h, (p, _) in zip(literal, whole, strict=True)) + ")"
    head = F.regexp_extract(x, look, 0)
    table = lambda values: F.create_map(*[F.lit(v) for pair in zip(heads, values, strict=True) for v in pair])
    pattern = F.try_element_at(table([p for p, _ in whole]), head)
    kept = {h: re.sub(r"\\(\d)", r"$\1", r) for h, (_, r) in zip(heads, whole, strict=True) if r is not None}
    text = F.try_element_at(F.create_map(*[F.lit(v) for pair in kept.items() for v in pair]), head)
    return F.when(head == "", x).when(text.isNotNull(), F.regexp_replace(x, pattern, text))


def log_line(x: Column, rules: tuple[tuple[str, str | None], ...] = LOG_RULES) -> Column:
    """A job's log line as a viewer is shown it: leading signs go, white space is one space, then the rewrites; null for blank and dropped lines."""
    text = T.collapse_spaces(F.regexp_replace(T.strip(x), r"(?U)^(?:[^\w\s]+\s*)+", ""))
    return rewritten(F.when(T.strip(x) != "", text), rules)
