"""Language identification by bit-sliced Bloom filters over letter n-grams.

One table holds the filters of all languages: slot i has a bit per language, so a
lookup of an n-gram in k slots, and-ed, gives the mask of all languages that contain
it. A text's hits are counted per language and corrected for the filter's own rate of
false positives; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketmood.llm.common import added_schema, mix, sliced, stored, texts_of

# The model is fitted on about this many texts of each language, chosen by id hash.
TEXTS_PER_LANGUAGE = 3_000
# n-grams kept per language, the most frequent.
GRAMS_PER_LANGUAGE = 30_000
# Languages whose n-grams are collected at a time.
BLOCK_LANGUAGES = 256
# A language contains an n-gram that is at least this common relative to where it is most common.
RELATIVE = 0.25
SIZES = (2, 3, 4)
HASHES = 3
SLOTS_PER_GRAM = 8
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    """A bit for each code point that is a letter."""
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))


def grams(text: str | None, letters: np.ndarray) -> np.ndarray:
    """Hashes of all letter n-grams of a lower-cased text; other characters end words.

    A word is taken with one blank on each side; n-grams of blanks alone are left out.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    is_letter = np.zeros(len(points) + 2, bool)
    is_letter[1:-1] = (letters[points >> 3] >> (7 - (points & 7)).astype(np.uint8)) & 1
    if not is_letter.any():
        return np.empty(0, np.uint64)
    chars = np.zeros(len(points) + 2, np.uint64)
    chars[1:-1] = points
    chars[~is_letter] = 0x20
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[:-1] |= is_letter[1:]
    chars, is_letter = chars[keep], is_letter[keep]
    found = []
    with np.errstate(over="ignore"):
        for size in SIZES:
            n = len(chars) - size + 1
            if n <= 0:
                continue
            packed = np.full(n, size, np.uint64)
            for i in range(size):
                packed *= np.uint64(0x9E3779B97F4A7C15)
                packed += chars[i : i + n]
            # A blank may open or close an n-gram, but not stand inside it.
            inner = np.ones(n, bool)
            for i in range(1, size - 1):
                inner &= is_letter[i : i + n]
            inner &= is_letter[:n] | is_letter[size - 1 :]
            found.append(packed[inner])
    return mix(np.concatenate(found))


@dataclass
class Filters:
    languages: list[str]
    shares: np.ndarray
    table: np.ndarray
    letters: np.ndarray

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        slots = np.uint64(len(self.table) - 1)
        with np.errstate(over="ignore"):
            return [(mix(hashes + np.uint64(i + 1)) if i else hashes) & slots for i in range(HASHES)]

    def add(self, language: int, hashes: np.ndarray) -> None:
        bit = np.uint64(1) << np.uint64(language % 64)
        for place in self.places(hashes):
            np.bitwise_or.at(self.table[:, language // 64], place, bit)

    def rates(self) -> np.ndarray:
        """The false-positive rate of each language's filter, from its fill."""
        return np.array([self.bits(self.table, i).mean() ** HASHES for i in range(len(self.languages))])

    @staticmethod
    def bits(masks: np.ndarray, language: int) -> np.ndarray:
        return (masks[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    def predict(self, text: str | None, rates: np.ndarray) -> tuple[str, float]:
        hashes = grams(text, self.letters)
        if not len(hashes):
            return UNKNOWN, 0.0
        if not self.languages:
            return UNKNOWN, 0.0
        first, *rest = self.places(hashes)
        masks = self.table[first]
        for place in rest:
            masks = masks & self.table[place]
        hits = np.array([self.bits(masks, i).sum() for i in range(len(self.languages))], float)
        shares = np.clip((hits / len(hashes) - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
        if shares.max() <= 0:
            shares = self.shares
        best = int(shares.argmax())
        return self.languages[best], float(shares[best] / shares.sum())


def fit(docs: DataFrame, where: Column, texts: int = TEXTS_PER_LANGUAGE) -> Filters:
    """Filters learnt from ``text`` and non-null ``lang`` of the rows where ``where`` holds.

    n-grams are counted by Spark over about ``texts`` texts of each language. Every
    language is learned: the table grows by a 64-bit word a slot per 64 languages, and
    n-grams are collected for BLOCK_LANGUAGES languages at a time. Texts are chosen by the
    hash of the id: rows that repeat an id are all chosen or none, and each counts.
    """
    rows = docs.filter(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    names = [r["lang"] for r in sizes]
    total = sum(r["count"] for r in sizes)
    letters = letter_table()
    if not names:
        return Filters([], np.empty(0), np.zeros((1, 1), np.uint64), letters)
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, texts / r["count"])) for r in sizes], "lang string, share double")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000.0
    chosen = rows.join(F.broadcast(shares), "lang").filter(place < F.coalesce("share", F.lit(0.0))).select("lang", "text")
    schema = "lang string, gram long, n long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch.column("text"))):
                own.setdefault(lang, []).append(grams(text, letters))
            for lang, parts in own.items():
                gram, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"],
                )

    counted = chosen.mapInArrow(sliced(count), schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = counted.filter("n >= 2").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= GRAMS_PER_LANGUAGE)
    kept = stored(kept.select("lang", "gram", "n"), "grams")
    totals = kept.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = kept.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate"))
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    found = stored(rated.join(most, "gram").filter(F.col("rate") >= RELATIVE * F.col("most")).select("lang", "gram"), "typical")
    longest = found.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    slots = 1 << max(10, int(SLOTS_PER_GRAM * longest).bit_length())
    order_of = sorted(names)
    counts = {r["lang"]: r["count"] for r in sizes}
    model = Filters(
        order_of,
        np.array([counts[n] / total for n in order_of]),
        np.zeros((slots, -(-len(names) // 64)), np.uint64),
        letters,
    )
    index = {n: i for i, n in enumerate(order_of)}
    for at in range(0, len(order_of), BLOCK_LANGUAGES):
        block = spark.createDataFrame([(n,) for n in order_of[at : at + BLOCK_LANGUAGES]], "lang string")
        for lang, part in found.join(F.broadcast(block), "lang").toPandas().groupby("lang"):
            model.add(index[lang], part["gram"].to_numpy(np.int64).view(np.uint64))
    return model


def identify(docs: DataFrame, model: Filters, carry: list[str] | None = None) -> DataFrame:
    """lang_pred (string) and score (double, 0 to 1) for every whole text.

    A null text, one without a letter, or a model without languages gives ``und`` with
    score 0; a text none of whose n-grams is known gets the most frequent language, with
    its share. Equal shares go to the name first in order. Columns of ``docs`` (or those
    in ``carry``) come first; equal names are replaced. Bytes that are not UTF-8 are no
    letters. Nothing is shuffled.
    """
    added = {"lang_pred": "string", "score": "double"}
    carried = [c for c in carry or docs.columns if c not in added]
    source = docs.select(*dict.fromkeys([*carried, "text"]))
    rates = model.rates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.predict(t, rates) for t in texts_of(batch.column("text"))]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *columns], [*carried, *added])

    return source.mapInArrow(sliced(run), added_schema(docs, carried, added))
