"""Text functions. All are native expressions (higher-order ones are interpreted inside the generated code), but for an injected tokenizer."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space (Unicode's too) at both ends; ``trim`` would keep line feeds."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Runs of blanks become one, three line feeds or more become two, ends are stripped."""
    return strip(F.regexp_replace(F.regexp_replace(c, "[ \t]+", " "), "\n{3,}", "\n\n"))


def is_number(c: Column) -> Column:
    """Whether a string is a plain decimal number; null and empty aren't."""
    return F.coalesce(c.rlike(r"^-?\d+(\.\d+)?$"), F.lit(False))


def leading_number(c: Column) -> Column:
    """The first decimal number in a string as a double, or 0."""
    found = F.regexp_extract(c.cast("string"), r"-?[0-9]+(\.[0-9]+)?", 0)
    return F.coalesce(F.when(found != "", found).try_cast("double"), F.lit(0.0))


def display_number(c: Column) -> Column:
    """A double as text; whole ones lose their ``.0``."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def paragraphs(c: Column, delimiter: str = "\n\n") -> Column:
    """The array of non-empty, stripped paragraphs."""
    return F.filter(F.transform(F.split(c, delimiter), strip), lambda p: p != "")


def tokens(c: Column) -> Column:
    """Lossless default tokens: each a word with the white space before it. White space at the end belongs to no token."""
    return F.regexp_extract_all(c, F.lit(r"\s*\S+"), F.lit(0))


def token_count(c: Column) -> Column:
    return F.size(tokens(c))


def token_arrays(texts: Column, tokenizer: Callable[[str], list[str]] | None = None) -> Column:
    """The tokens of each text of an array: the default ones, or those of an injected tokenizer whose tokens joined give the text back."""
    if tokenizer is None:
        return F.transform(texts, tokens)

    @F.pandas_udf("array<array<string>>")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [tokenizer(t) for t in row] for row in rows], dtype="object")

    return run(texts)


def content_id(source: Column, text: Column) -> Column:
    """An id that depends on source and text alone, so that moved pages keep it."""
    return F.concat(source, F.lit("-"), F.substring(F.sha1(F.concat_ws("|", source, text)), 1, 14))


#: Model-name part that asks for role prefixes, and the prefixes. Fixed values.
PREFIXED_MODEL, DOCUMENT_PREFIX, QUERY_PREFIX = "nomic-embed", "search_document: ", "search_query: "


def embed_input(text: Column, model: Column, role: str = "document") -> Column:
    """What goes to the encoder; the stored text has no prefix."""
    prefix = DOCUMENT_PREFIX if role == "document" else QUERY_PREFIX
    return F.when(F.lower(model).contains(PREFIXED_MODEL), F.concat(F.lit(prefix), text)).otherwise(text)


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whole-word phrase containment, with Unicode word characters."""
    return F.rlike(text, F.concat(F.lit(r"(?U)(?:^|\W)\Q"), phrase, F.lit(r"\E(?:\W|$)")))


def page_key(start: Column, end: Column, dash: str = "-") -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws(dash, start.cast("string"), end.cast("string")))


def cite_tag(source: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("["), source, F.lit(" p."), page_key(start, end), F.lit("]"))


def page_label(start: Column, end: Column) -> Column:
    return F.concat(F.lit("p."), page_key(start, end, "–"))


def model_name(c: Column) -> Column:
    """Without the publisher before the first slash and the file suffix; a dash for none."""
    short = F.regexp_replace(F.regexp_replace(c, r"^[^/]*/", ""), r"(?i)\.gguf$", "")
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("—")).otherwise(short)


def escape_attribute(c: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(char), F.lit(name))
    return c


def grouped(c: Column) -> Column:
    """A whole number with thousands separators."""
    return F.format_number(c.cast("bigint"), 0)


def storage_label(gb: Column) -> Column:
    """Terabytes with one decimal from 1024 GB on, else whole gigabytes."""
    return F.when(gb >= 1024, F.concat(F.format_string("%.1f", F.round(gb / 1024, 1)), F.lit(" TB"))).otherwise(F.concat(grouped(gb), F.lit(" GB")))


def relative_time(then: Column, now: Column) -> Column:
    """Seconds, minutes, hours or days ago, rounded; the date from 30 days on."""
    sec = F.greatest(F.lit(1), (F.unix_timestamp(now) - F.unix_timestamp(then)).cast("long"))
    minutes = F.floor(sec / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    days = F.floor(hours / 24 + 0.5)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(sec < 60, ago(sec, "s"))
        .when(minutes < 60, ago(minutes, "m"))
        .when(hours < 24, ago(hours, "h"))
        .when(days < 30, ago(days, "d"))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )


def sse_frame(event: Column, data: Column) -> Column:
    """An event-stream frame of an event and its JSON."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), data, F.lit("\n\n"))


def sse_event(frame: Column) -> Column:
    return F.regexp_extract(frame, r"event: ?([^\n]*)", 1)


def sse_data(frame: Column) -> Column:
    return F.regexp_extract(frame, r"\ndata: ?([^\n]*)", 1)


# The wording that marks a question as asking for everything.
BREADTH = r"(?i)\b(all|every|each|full|complete|entire)\b[^.?!]{0,40}\bcomponents?\b|\bcomponents?\b[^.?!]{0,40}\b(all|every|each|list)\b"

# The wording that marks an answer as not found in the context.
NOT_FOUND = (
    r"(?i)context (?:provided )?does not|"
    r"does not (?:contain|specify|provide|include|mention|detail)|"
    r"not (?:specified|provided|mentioned|detailed|present|available) in|"
    r"cannot find|no information (?:on|about|in|is)|don't have (?:enough|that|the)"
)

#: A citation with source and pages, and the looser form that counts as one. Fixed values.
CITATION = r"\[([A-Za-z0-9_][A-Za-z0-9_.-]*)\s+p\.([0-9]+)(?:[–-]([0-9]+))?\]"
ANY_CITATION = r"\[[^\]]*p\.[0-9]+[^\]]*\]"


# What follows a component's name in the question how it is classified.
CLASSIFICATION = " a required, optional, essential, or always-deployed management component of the VCF management domain?"


def asks_breadth(question: Column) -> Column:
    return question.rlike(BREADTH)


def says_not_found(answer: Column) -> Column:
    return answer.rlike(NOT_FOUND)


def classification_question(component: Column) -> Column:
    """A sub-query that fetches how the documents classify a component."""
    return F.concat(F.lit("Is "), component, F.lit(CLASSIFICATION))


def now_iso() -> str:
    """The present second in UTC, as update logs write it."""
    return datetime.now(UTC).isoformat(timespec="seconds")
