"""Text cleaning and tokens as built-in expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketmood.functions.words import STOP_WORDS

# Letters, numbers and underscore of every script; marks are not word
# characters. Java's own \w would differ on both counts. The control characters
# x1c-x1f count as white space.
NOT_WORD = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]"
SPACES = r"(?U)[\s\x1c-\x1f]+"
VISIBLE = r"(?U)[^\s\x1c-\x1f]"
# Words the tokeniser splits in two, and the cut after their first part.
CONTRACTED = ("cannot", "gimme", "gonna", "gotta", "lemme", "wanna")
CONTRACTION = (
    r"(?U)(?<!\S)(can(?=not(?!\S))|gim(?=me(?!\S))|gon(?=na(?!\S))"
    r"|got(?=ta(?!\S))|lem(?=me(?!\S))|wan(?=na(?!\S)))"
)
VECTOR_WORD = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def has_text(text: Column) -> Column:
    """True if anything but white space is left; NULL for NULL."""
    return text.rlike(VISIBLE)


def spaced_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def clean_text(text: Column) -> Column:
    """Lower case, no punctuation, no stop words, words joined by one space."""
    bare = F.regexp_replace(F.lower(or_empty(text)), NOT_WORD, "")
    return let(bare, _without_stop_words)


def _without_stop_words(bare: Column) -> Column:
    # A plain substring test spares nearly every text the look-around pattern.
    contracted = reduce(or_, [F.contains(bare, F.lit(w)) for w in CONTRACTED])
    parted = F.when(contracted, F.regexp_replace(bare, CONTRACTION, "$1 ")).otherwise(bare)
    kept = F.filter(
        F.split(parted, SPACES), lambda w: (w != "") & ~w.isin(STOP_WORDS)
    )
    return F.array_join(kept, " ")


def vector_words(text: Column) -> Column:
    """Lower-case runs of at least two word characters, as count vectors use."""
    return F.regexp_extract_all(F.lower(or_empty(text)), F.lit(VECTOR_WORD), F.lit(0))


def counted(words: Column) -> Column:
    """``array<struct<token, n>>``: each distinct word with its count.

    Works inside the row (sort, then run lengths), so counting the words of a
    document needs no shuffle.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        first = F.filter(
            F.sequence(F.lit(1), F.greatest(size, F.lit(1))),
            lambda i: (i <= size)
            & ((i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))),
        )
        return let(
            first,
            lambda starts: F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(ordered, at - 1).alias("token"),
                    (F.coalesce(F.get(starts, k + 1), size + 1) - at).alias("n"),
                ),
            ),
        )

    return let(F.sort_array(words), runs)
