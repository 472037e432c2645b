"""Text expressions: tokens, words, truncation, query preparation and rendering."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from forumlens.schemas import MAX_TOKENS

# A token keeps the blanks in front of it, so that joining tokens restores the text.
TOKEN_PATTERN = r"[ \t\n\r\f]*(?:\p{L}+|\p{N}+|[^ \t\n\r\f\p{L}\p{N}])"
WORD_PATTERN = r"[\p{L}\p{N}]+"

# Characters HTML text must not hold, ampersand first.
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;"))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def is_over_limit(text: Column, limit: int = MAX_TOKENS) -> Column:
    """More than ``limit`` tokens. A text of that many characters or fewer cannot be, and is not scanned."""
    return (F.length(text) > limit) & (token_count(text) > limit)


def truncate_tokens(text: Column, over_limit: Column, limit: int = MAX_TOKENS) -> Column:
    """The text up to its ``limit``-th token; texts within the limit stay as they are."""
    kept = F.slice(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), 1, limit)
    return F.when(over_limit, F.array_join(kept, "")).otherwise(text)


def words(text: Column) -> Column:
    """Lower-case words in text order. NULL text has none."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def padded_words(text: Column) -> Column:
    """Words joined and framed by single blanks: a phrase matches as a plain substring."""
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def is_blank(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) == 0


def join_words(parts: Column) -> Column:
    return F.concat_ws(" ", parts)


def html_escape(text: Column) -> Column:
    for raw, escaped in HTML_ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def epoch_text(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC, whatever the session time zone is."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return (start + F.make_dt_interval(secs=seconds)).cast("string")


def four_decimals(value: Column) -> Column:
    return F.format_string("%.4f", value)
