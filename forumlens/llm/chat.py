"""Prefix-target expansion of conversations: one training example for every assistant turn.

An example holds all turns up to and including the reply that it trains; only that reply's text is under the
loss mask. Turns are marked as ``<|role|>`` line feed text ``<|end|>`` line feed. Control strings inside roles
and texts are escaped: ``&``, ``<``, ``[`` and, in roles, ``|`` and the line feed become character references, so neither
this template's marks nor other common ones (``</s>``, ``[INST]``) can occur in them, and the escape is undone
exactly. Everything is expressions; no Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ASSISTANT = "assistant"

# Fixed values of the template.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
TEXT_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
ROLE_ESCAPES = (*TEXT_ESCAPES, ("|", "&#124;"), ("\n", "&#10;"))


def _escape(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    for plain, escaped in table:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _unescape(text: Column, table: tuple[tuple[str, str], ...]) -> Column:
    for plain, escaped in reversed(table):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def head(role: Column) -> Column:
    return F.concat(F.lit(OPEN), _escape(role, ROLE_ESCAPES), F.lit(CLOSE))


def expand(turns: DataFrame, by: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples of all conversations: ``by, example, formatted, loss_start, loss_length`` (code points).

    Example ``n`` trains the reply at position ``n`` of its conversation. A conversation that doesn't end with
    a reply has one more example, of all its turns, whose mask is empty (``loss_start`` NULL, length 0), so that
    no turn is lost. NULL roles and texts count as empty, rows of equal turn number follow role and text, a NULL
    turn comes first, repeated rows are repeated turns, a NULL ``by`` is a conversation of its own. Other columns
    are not carried. No rows give no examples.
    """
    rows = turns.select(
        F.col(by).alias("conversation"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy("conversation").agg(F.sort_array(F.collect_list("said")).alias("said"))
    # Every turn is formatted once, however many examples it takes part in.
    marked = whole.select(
        "conversation",
        F.transform(
            "said",
            lambda s: F.struct(
                head(s["role"]).alias("head"),
                _escape(s["text"], TEXT_ESCAPES).alias("body"),
                (s["role"] == ASSISTANT).alias("reply"),
            ),
        ).alias("said"),
    ).withColumn("formatted", F.transform("said", lambda s: F.concat(s["head"], s["body"], F.lit(END))))
    each = marked.select("conversation", "formatted", F.size("said").alias("turns"), F.posexplode("said").alias("at", "own"))
    wanted = each.where(F.col("own.reply") | (F.col("at") == F.col("turns") - 1))
    before = F.array_join(F.slice("formatted", F.lit(1), F.col("at")), "")
    start = F.length("before") + F.length("own.head")
    return wanted.withColumn("before", before).select(
        F.col("conversation").alias(by),
        F.col("at").alias("example"),
        F.concat("before", "own.head", "own.body", F.lit(END)).alias("formatted"),
        F.when(F.col("own.reply"), start).alias("loss_start"),
        F.when(F.col("own.reply"), F.length("own.body")).otherwise(0).alias("loss_length"),
    )


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the mask of an example, without escapes; empty where the mask is."""
    masked = F.coalesce(F.substring(formatted, start + 1, length), F.lit(""))
    return _unescape(masked, TEXT_ESCAPES)


def turns_of(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text), without escapes."""
    parts = F.split(formatted, r"<\|end\|>\n")
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda part: F.struct(
            _unescape(F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), CLOSE, 1), ROLE_ESCAPES).alias("role"),
            _unescape(
                F.substr(part, F.instr(part, CLOSE) + len(CLOSE)), TEXT_ESCAPES
            ).alias("text"),
        ),
    )
