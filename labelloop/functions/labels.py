"""Label expressions: answer parsing, class words, casts, response extraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_one_dot(s) -> Column:
    """drop exactly one trailing '.'; the empty string stays empty."""
    return F.regexp_replace(_c(s), r"\.$", "")


def parse_answer(s, words: Sequence[str], trim: bool = False) -> Column:
    """lower-cased exact match to a class word -> class index, else -1.

    No trim by default (quirk 8: ' positive' is -1); NULL answers are -1 too.
    """
    x = strip_one_dot(_c(s))
    if trim:
        x = F.trim(x)
    x = F.lower(x)
    expr = F.lit(-1)
    for i in reversed(range(len(words))):
        expr = F.when(x == F.lit(words[i].lower()), F.lit(i)).otherwise(expr)
    return F.coalesce(expr, F.lit(-1)).cast("int")


def label_word(label, words: Sequence[str]) -> Column:
    """Class index -> word. For two classes this is the reference rule
    (truthy -> 'positive', falsy -> 'negative') when words = (negative, positive)."""
    return F.element_at(F.array(*[F.lit(w) for w in words]), _c(label).cast("int") + 1)


def cast_label(s) -> Column:
    """Text -> INT; NULL when it does not parse (ANSI-safe)."""
    return _c(s).try_cast("int")


def response_text(raw_json) -> Column:
    """``choices[0].message.content`` out of a chat-completion JSON."""
    return F.get_json_object(_c(raw_json), "$.choices[0].message.content")
