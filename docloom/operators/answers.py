"""The events of a streamed answer, and the risk by which sections are sampled for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

# Words of a section's heading, or of its content, that set its risk, and the percent that is sampled.
CRITICAL_HEADINGS = ("safety", "warning", "critical", "specification")
LOW_HEADINGS = ("introduction", "overview", "summary")
HIGH_CONTENT = "specification"
SAMPLE_PERCENT = {"critical": 100, "high": 100, "medium": 50, "low": 15}


def risk_level(heading: Column, content: Column, has_tables: Column) -> Column:
    """``critical``, ``high``, ``medium`` or ``low`` by heading, tables and content; the first of these that tells."""
    title, body = F.lower(F.coalesce(heading, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    names = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(title, w))
    return (
        F.when(names(CRITICAL_HEADINGS), "critical").when(F.coalesce(has_tables, F.lit(False)) | body.contains(HIGH_CONTENT), "high").when(names(LOW_HEADINGS), "low").otherwise("medium")
    )


def sampled(sections: DataFrame, key: list[str], risk: str = "risk_level") -> DataFrame:
    """``sections`` with ``sampled``: drawn by the digest of the key at the rate of the risk, so that a rerun draws the same rows."""
    place = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *key)), 1, 8), 16, 10).cast("long") % 100
    rate = F.create_map(*[F.lit(x) for pair in SAMPLE_PERCENT.items() for x in pair])[F.col(risk)]
    return sections.withColumn("sampled", place < F.coalesce(rate, F.lit(100)))


def answer_events(turns: DataFrame, key: list[str], no_context: str) -> DataFrame:
    """(key, seq, event, payload): what a client is sent for each turn, in order.

    ``turns`` has ``tokens`` (as generated; null where generation failed), ``whole`` (the text of a
    generation at once, asked for where the tokens are blank), ``citations`` and ``error``. Without
    citations the answer is ``no_context``. Tokens come first, then citations, then ``complete``; a failed turn sends
    what it had and ``error`` instead.
    """
    event = lambda kind, x: F.struct(F.lit(kind).alias("event"), x.cast("string").alias("payload"))
    each = lambda kind, xs: F.transform(xs, lambda x: event(kind, x))
    none = F.array().cast("array<struct<event: string, payload: string>>")
    own = F.coalesce("tokens", F.array().cast("array<string>"))
    blank = T.strip(F.array_join(own, "")) == ""
    again = F.when(blank & (F.coalesce("whole", F.lit("")) != ""), F.array(event("token", F.col("whole")))).otherwise(none)
    answer = F.concat(each("token", own), again, each("citation", F.col("citations")))
    found = F.coalesce(F.size("citations") > 0, F.lit(False))
    body = F.when(F.col("error").isNotNull(), F.concat(each("token", own), F.array(event("error", F.col("error"))))).otherwise(
        F.concat(F.when(found, answer).otherwise(F.array(event("token", F.lit(no_context)))), F.array(event("complete", F.lit(None))))
    )
    return turns.select(*key, F.posexplode(body).alias("seq", "e")).select(*key, "seq", "e.event", "e.payload")
