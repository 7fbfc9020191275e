"""Scalar text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import patterns as P

WHITE_ENDS = r"(?U)^\s+|\s+$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, WHITE_ENDS, "")


def truncated(text: Column, n: int) -> Column:
    """The first n characters of the stripped text; null for null and empty."""
    return F.when(F.length(text) > 0, F.substring(stripped(text), 1, n))


def without_wrappers(text: Column) -> Column:
    """The user's own words: tagged insertions removed."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?s)<({'|'.join(P.WRAPPER_TAGS)})>.*?</\1>", ""))


def collapsed(text: Column) -> Column:
    """Runs of white space as single blanks, none at the ends."""
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, pattern: str | Column, width: int = 80, longest: int = 220) -> Column:
    """The first match with ``width`` characters around it, collapsed; null without a match.

    Lengths count code points: the part before the match is measured, not the
    regex engine's own offset.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    hit = F.regexp_substr(text, pattern)
    before = F.length(F.element_at(F.split(text, pattern, 2), 1))
    start = F.greatest(F.lit(0), before - width)
    return F.when(hit.isNotNull(), F.substring(collapsed(F.substring(text, start + 1, before - start + F.length(hit) + width)), 1, longest))


def substring_hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words the text contains.  A loop over a literal: an expression for each word would outgrow a compiled method."""
    return F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)))


def occurrences(text: Column, word: str) -> Column:
    """Non-overlapping occurrences of a plain string."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("long")


def unwrapped_prompt(text: Column) -> Column:
    """The prompt inside a dispatch envelope (a JSON object that begins with an agent's name), else the text."""
    inner = F.try_variant_get(F.try_parse_json(text), "$.prompt", "string")
    wrapped = text.rlike(P.BRIDGE_START) & (F.length(stripped(inner)) > 0)
    return F.when(wrapped, inner).otherwise(text)


def task_type(text: Column, n_tools: Column, n_orchestration: Column) -> Column:
    """struct(type, confidence) of a session by its first words and its tools; the first fitting rule wins."""
    raw = F.coalesce(text, F.lit(""))
    own = unwrapped_prompt(raw)
    low = F.lower(own)
    tell = lambda kind, sure: F.struct(F.lit(kind).alias("type"), sure.alias("confidence"))
    med = F.lit("med")
    rules = F.when((n_orchestration >= 3) & (n_orchestration > 0.15 * n_tools), tell("orchestration", med))
    rules = rules.when(F.substring(raw, 1, 600).rlike(P.PROBE), tell("probe_check", med))
    rules = rules.when(own.rlike(P.EVALUATION), tell("eval_harness", med))
    for kind, words in P.TASK_KEYWORDS.items():
        hits = substring_hits(low, words)
        rules = rules.when(hits >= 1, tell(kind, F.when(hits >= 2, "med").otherwise("low")))
    return rules.otherwise(tell("other", F.lit("low")))


def project_path(folder: Column) -> Column:
    """A transcript folder's name as a path (lossy: every hyphen is a slash)."""
    return F.replace(folder, F.lit("-"), F.lit("/"))


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from one ISO time to another; null where either is no time."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(60_000_000.0)


def as_boolean(value: Column) -> Column:
    """The strings true, 1 and yes, in any case; all else is false."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "yes"), F.lit(False))


def tokens_used(log: Column) -> Column:
    """The number after ``tokens used``, thousands commas removed; null without one."""
    digits = F.regexp_extract(log, r"(?i)tokens used:?\s*([0-9][0-9,]*)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("long")


def last_section(text: Column, heading: str) -> Column:
    """What follows the last occurrence of a heading; null without one."""
    return F.when(F.contains(text, F.lit(heading)), F.substring_index(text, heading, -1))


def json_object(text: Column) -> Column:
    """From the first brace to the last, where that parses; else null."""
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(F.try_parse_json(braces).isNotNull(), braces)


def open_slots(text: Column) -> Column:
    """The template slots ({{name}}) that a text still holds: filling them in has been forgotten."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\{\{\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}\}"), F.lit(1)))


def without_comments(text: Column) -> Column:
    """Markup comments and a leading front matter removed."""
    bare = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?s)\A---\n.*?\n---\n", "")


def section(text: Column, title: str) -> Column:
    """A second-level section from its heading to the next, or to the end."""
    found = F.regexp_extract(text, rf"(?ms)(^## {title}\b.*?)(?=^## |\z)", 1)
    return F.when(found != "", found)


def passed_tests(log: Column) -> Column:
    """Passing tests reported by a log: per line, one runner's count before another's."""
    one = F.regexp_extract
    counts = F.transform(
        F.split(F.coalesce(log, F.lit("")), "\n"),
        lambda line: F.coalesce(
            F.when(line.rlike(r"test result: \w+\. [0-9]+ passed"), one(line, r"test result: \w+\. ([0-9]+) passed", 1).try_cast("long")),
            F.when(line.rlike(r"[0-9]+ passed"), one(line, r"([0-9]+) passed", 1).try_cast("long")),
            F.lit(0).cast("long"),
        ),
    )
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def quote_key(text: Column) -> Column:
    """A form in which quotes compare: compatibility characters, quotes and dashes folded, markup and case gone."""
    # only what is not plain ASCII goes through Python; of the rest nothing is sent but nulls
    odd = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    folded = F.translate(F.coalesce(compatible(odd), text), "‘’‚‛“”„‟–—―−", "''''\"\"\"\"----")
    return F.lower(collapsed(F.regexp_replace(folded, r"[*_`]", "")))


@F.pandas_udf(StringType())
def compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFKC, for which Spark has no function."""
    import unicodedata

    for texts in batches:
        yield texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def evidence_key(source: Column, kind: Column, session: Column, line: Column) -> Column:
    return F.concat_ws("|", source, kind, session, F.concat(F.lit("L"), line.cast("string")))
