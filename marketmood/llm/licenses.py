"""License scans with a positional index of rare words, in built-in expressions only.

Templates are licence texts with mandatory key phrases. Every key phrase is indexed
under its rarest word: the one with the highest inverse document frequency over all
documents. A document's licence words are looked up there; each posting gives the
place where the phrase, and with it the template, would start. The phrase is verified
word by word, and a template is found where the starts of all its phrases agree.
A phrase cannot stand in a document without its rarest word, so the index misses none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases of the base rules and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Label, text, key phrases of the text that must stand at their relative places.
TEMPLATES = (
    ("mit", "released under the mit license", ("under the mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that "
        "the following conditions are met",
        ("redistribution and use in source and binary forms", "provided that the following conditions are met"),
    ),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
)
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]

    @staticmethod
    def of(label: str, text: str, phrases: tuple[str, ...]) -> Template:
        return Template(label, tuple(text.split()), tuple(tuple(p.split()) for p in phrases))

    def offset(self, phrase: tuple[str, ...]) -> int:
        """The place of a key phrase in the template's text."""
        n = len(phrase)
        return next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == phrase)


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; none for null."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    parts = F.split(F.coalesce(lowered, F.lit("")), BREAKS)
    return F.filter(parts, lambda w: w != "")


def word_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of the (fixed) vocabulary stands, over all of them."""
    known = F.array(*[F.lit(w) for w in vocabulary])
    found = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), known)).alias("word"))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return {w: counts.get(w, 0) for w in vocabulary}


def _literal(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _places(phrase: tuple[str, ...], rarest: str) -> Column:
    """Where a phrase stands, from the places of its rarest word."""
    offset, n = phrase.index(rarest), len(phrase)
    starts = F.transform(
        F.filter("anchors", lambda a: a["word"] == rarest),
        lambda a: a["place"] - offset,
    )
    fits = lambda s: (s >= 0) & (F.slice("words", F.greatest(s, F.lit(0)) + 1, F.lit(n)) == _literal(phrase))
    return F.filter(starts, fits)


def _shifted(places: str, offset: int) -> Column:
    return F.transform(places, lambda place: place - offset)


def _share(item: Template):
    """The share of a template's words that stand at their places after a start."""

    def share(start: Column) -> Column:
        same = (F.coalesce(F.get("words", start + i) == w, F.lit(False)).cast("int") for i, w in enumerate(item.words))
        return sum(same, F.lit(0)) / F.lit(float(len(item.words)))

    return share


def scan(docs: DataFrame, templates: tuple = TEMPLATES, base: tuple = BASE, carry: list[str] | None = None) -> DataFrame:
    """Licence mentions in every whole text: the columns of ``docs`` with ADDED behind.

    n_words (long); n_base, first_word, last_word (long): places of base phrases, the
    smallest and the largest start, null where there are none; base_labels and labels
    (string): distinct, sorted, comma-joined, empty where there are none; score (double):
    the largest share of a found template's words that stand at their places, 0 without
    one. A null or empty text has no words. ``carry`` names the columns to return; those
    with an added name are replaced. Repeated rows stay; nothing but the counts of the
    fixed vocabulary is shuffled.
    """
    items = [Template.of(label, text, phrases) for label, text, phrases in templates]
    base_phrases = [(label, tuple(p.split())) for label, p in base]
    phrases = sorted({p for t in items for p in t.phrases} | {p for _, p in base_phrases})
    counts = word_counts(docs, sorted({w for p in phrases for w in p}))
    rarest = {p: min(p, key=lambda w: (counts[w], w)) for p in phrases}
    index = _literal(tuple(sorted(set(rarest.values()))))

    carried = [c for c in carry or docs.columns if c not in ADDED]
    # Nested in one struct, so that no name of the caller's columns can clash.
    rows = docs.select(F.struct(*carried).alias("own"), words_of(F.col("text")).alias("words"))
    placed = F.filter(
        F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("place"))),
        lambda x: F.array_contains(index, x["word"]),
    )
    nothing = F.expr("cast(array() as array<struct<word: string, place: int>>)")
    rows = rows.select("own", "words", F.when(F.arrays_overlap("words", index), placed).otherwise(nothing).alias("anchors"))
    hit = F.size("anchors") > 0
    no_places = F.expr("cast(array() as array<int>)")
    names = {p: f"places_{i}" for i, p in enumerate(phrases)}
    rows = rows.select("own", "words", *[F.when(hit, _places(p, rarest[p])).otherwise(no_places).alias(n) for p, n in names.items()])

    all_base = F.concat(*[F.col(names[p]) for p in dict.fromkeys(p for _, p in base_phrases)])
    found_base = F.array_compact(F.array(*[F.when(F.size(names[p]) > 0, F.lit(label)) for label, p in base_phrases]))
    marks, shares = [], []
    for item in items:
        starts = None
        for phrase in item.phrases:
            own = _shifted(names[phrase], item.offset(phrase))
            starts = own if starts is None else F.array_intersect(starts, own)
        marks.append(F.when(F.size(starts) > 0, F.lit(item.label)))
        shares.append(F.array_max(F.transform(starts, _share(item))))
    any_place = F.greatest(*[F.size(n) for n in names.values()]) > 0
    labels = F.when(any_place, F.array_union(found_base, F.array_compact(F.array(*marks))))
    score = F.when(any_place, F.coalesce(F.greatest(*shares), F.lit(0.0))).otherwise(F.lit(0.0))
    found = rows.select(
        "own",
        F.size("words").cast("long").alias("n_words"),
        F.size(all_base).cast("long").alias("n_base"),
        F.array_min(all_base).cast("long").alias("first_word"),
        F.array_max(all_base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(found_base)), ",").alias("base_labels"),
        F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit("")).alias("labels"),
        score.alias("score"),
    )
    return found.select(*[F.col("own")[c].alias(c) for c in carried], *ADDED)
