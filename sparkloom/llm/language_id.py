"""Language identification by language-bitmask n-gram filters."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Write, bound_batches, temporary
from .words import small_batches

#: Letters of an n-gram, word boundaries included.
LENGTHS = (1, 2, 3, 4)
#: Documents that the filters are fitted to, for each language: the bound of the labelled sample.
FIT_ROWS = 20_000
#: Languages that are told apart, and n-grams of each that are kept, the most frequent ones: the bounds of the model.
MOST_LANGUAGES, MOST_GRAMS = 1024, 100_000
#: Places of the filter (a power of two), and places that an n-gram sets: 60 bits of its hash name them.
PLACES, PROBES = 1 << 20, 3
#: An n-gram is a language's if it is at least this part as frequent there as in the language where it is most frequent, and met so often.
SHARE, LEAST = 0.5, 2
UNKNOWN = "und"
#: N-gram places of a text that are hashed at a time.
PIECE = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    """Lower-case letters with one space at each boundary; empty without letters."""
    points = np.frombuffer(unicodedata.normalize("NFC", text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    padded = np.full(len(points) + 2, _SPACE, np.uint32)
    padded[1:-1][letter] = points[letter]
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != _SPACE) | (padded[:-1] != _SPACE)
    return padded[keep]


def pieces(text: str) -> Iterator[np.ndarray]:
    """The n-grams of a text, those that start in a stretch of ``PIECE`` letters at a time."""
    points = code_points(text)
    for at in range(0, len(points), PIECE):
        yield grams(points[at : at + PIECE + max(LENGTHS) - 1].astype(np.uint64), PIECE)


def grams(points: np.ndarray, starts: int) -> np.ndarray:
    """64-bit hashes of the n-grams that hold no boundary inside, of the first ``starts`` places."""
    found = []
    inner = points != _SPACE
    for n in LENGTHS:
        m = min(starts, len(points) - n + 1)
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for j in range(n):
            h = (h ^ points[j : j + m]) * _ODD
            h ^= h >> np.uint64(29)
        whole = inner[:m].copy() if n == 1 else np.ones(m, bool)
        for j in range(1, n - 1):
            whole &= inner[j : j + m]
        found.append(h[whole])
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def places(hashes: np.ndarray) -> list[np.ndarray]:
    return [(hashes >> np.uint64(20 * j)) & np.uint64(PLACES - 1) for j in range(PROBES)]


@dataclass(frozen=True)
class Filters:
    """Bit-sliced Bloom filters: ``slices[place]`` holds one bit for each language, in words of 64."""

    languages: tuple[str, ...]
    slices: np.ndarray

    def false_positives(self) -> np.ndarray:
        """The chance that a foreign n-gram passes a language's filter, from the share of its set bits."""
        return np.array([self.bit(self.slices, i).mean() for i in range(len(self.languages))]) ** PROBES

    @staticmethod
    def bit(rows: np.ndarray, language: int) -> np.ndarray:
        return (rows[:, language // 64] >> np.uint64(language % 64)) & np.uint64(1)

    def languages_of(self, hashes: np.ndarray) -> np.ndarray:
        """Masks of all languages whose filter holds the n-gram: the AND of its slices."""
        first, *others = places(hashes)
        masks = self.slices[first]
        for p in others:
            masks &= self.slices[p]
        return masks

    def votes(self, text: str, false: np.ndarray) -> np.ndarray | None:
        """N-grams of the text that are each language's: popcounts of the masks, less what false positives add; None without n-grams."""
        n, hits = 0, np.zeros(len(self.languages))
        for hashes in pieces(text):
            n += len(hashes)
            masks = self.languages_of(hashes)
            hits += [int(self.bit(masks, i).sum()) for i in range(len(self.languages))]
        return np.maximum(0.0, (hits - false * n) / np.maximum(1e-9, 1 - false)) if n else None


def _sampled(labelled: DataFrame, sizes: dict[str, int], fit_rows: int) -> DataFrame:
    """At most some ``fit_rows`` rows of each language, by a hash of the text, so that any run takes the same."""
    codes = F.create_map(*[x for i, name in enumerate(sizes) for x in (F.lit(name), F.lit(i))])
    chances = F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, fit_rows / n)))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    return labelled.filter(F.col("lang").isin(*sizes)).filter(draw < chances[F.col("lang")]).select(codes[F.col("lang")].alias("language"), "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2000):
        texts: dict[int, list[str]] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            texts.setdefault(language, []).append(text)
        for language, hashes in ((k, h) for k, several in texts.items() for h in pieces("\n".join(several))):
            unique, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), language, np.int32)), pa.array(unique.view(np.int64)), pa.array(n.astype(np.int64))], names=["language", "gram", "n"])


def chosen_grams(counts: DataFrame, write: Write, most: int = MOST_GRAMS) -> DataFrame:
    """(language, gram): the n-grams that tell languages apart, of ``counts(language, gram, n)``."""
    totals = counts.groupBy("language").agg(F.sum("n").alias("total"))  # one row a language
    rates = counts.join(F.broadcast(totals), "language").select("gram", F.struct("language", "n", (F.col("n") / F.col("total")).alias("rate")).alias("in"))
    by_gram = rates.groupBy("gram").agg(F.collect_list("in").alias("all"))  # at most MOST_LANGUAGES entries
    top = F.array_max(F.transform("all", lambda x: x["rate"]))
    held = F.filter("all", lambda x: (x["rate"] >= top * SHARE) & (x["n"] >= LEAST))
    fit = write(by_gram.select("gram", F.explode(held).alias("x")).select("gram", "x.language", F.floor(F.log2("x.n") * 16).alias("level")), "language-grams")
    cut: dict[int, int] = {}
    kept: dict[int, int] = {}
    for language, level, n in sorted(map(tuple, fit.groupBy("language", "level").count().collect()), key=lambda r: -r[1]):  # some hundred levels a language
        kept[language] = kept.get(language, 0) + n
        if kept[language] <= most or language not in cut:
            cut[language] = level
    if not cut:
        return fit.select("language", "gram")
    least = F.create_map(*[F.lit(x) for pair in cut.items() for x in pair])
    return fit.filter(F.col("level") >= least[F.col("language")]).select("language", "gram")


def _place(j: int) -> Column:
    return F.shiftrightunsigned("gram", 20 * j).bitwiseAND(F.lit(PLACES - 1)).cast("int")


def fit_filters(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Filters:
    """Filters from ``labelled(text, lang)``; rows without either are left out.

    The sample is bounded by ``fit_rows`` rows a language; its n-grams are
    counted, compared and hashed into the filter as DataFrames, and only the
    filter's slices, at most ``PLACES`` rows for 64 languages, reach the driver.
    Languages are in order of their rows, then of their names.
    """
    spark = labelled.sparkSession
    bound_batches(spark)
    rows = labelled.filter("text is not null and lang is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    sizes = {r["lang"]: r["count"] for r in found}
    words = max(1, math.ceil(len(sizes) / 64))
    slices = np.zeros((PLACES, words), np.uint64)
    if sizes:
        with temporary(spark) as write:
            counts = _sampled(rows, sizes, fit_rows).mapInArrow(_counted, "language int, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
            chosen = chosen_grams(write(counts, "language-counts"), write)
            set_bits = chosen.select((F.col("language") / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("language") % 64).alias("mask"), F.explode(F.array(*map(_place, range(PROBES)))).alias("place"))
            table = set_bits.groupBy("place", "word").agg(F.bit_or("mask").alias("mask")).toArrow()
            place, word, mask = (table.column(c).to_numpy() for c in ("place", "word", "mask"))
            slices[place, word] = mask.view(np.uint64)
    return Filters(tuple(sizes), slices)


def predict_languages(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score in place of the text; columns keep their order.

    The language of most corrected n-grams; of equal ones the first of the
    filters.  The score is its part of all languages' corrected n-grams.  A text
    whose n-grams are all unknown gets the first language and 0; a null text,
    one without letters, or filters without languages give ``und`` and 0.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((filters, filters.false_positives()))
    others = [c for c in docs.columns if c != text_col]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in others]).schema.fields)
    schema = ", ".join(filter(None, [fields, "lang_pred string, score double"]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, false = shared.value
        for batch in small_batches(batches):
            named, scores = [], []
            for text in batch.column(len(others)).to_pylist():
                votes = model.votes(text, false) if text and model.languages else None
                best, total = (0, 0.0) if votes is None else (int(votes.argmax()), float(votes.sum()))
                named.append(UNKNOWN if votes is None else model.languages[best])
                scores.append(float(votes[best]) / total if total else 0.0)
            kept = [batch.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*others, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in [*others, text_col]]).mapInArrow(work, schema)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``documents``.

    Filters are fitted to the rows outside fold ``held`` (crc32 of the id's
    digits modulo ``folds``) that have a text and a language; a prediction sees
    the text alone.  A null id is in no fold, so it is fitted to and not held
    out; repeated rows count as often as they come and get equal answers; an
    empty table gives an empty result; other columns are ignored.  Texts are
    read whole; long ones are taken one at a time.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    marked = docs.select("doc_id", fold.alias("held_out"), "text", "lang")
    filters = fit_filters(marked.filter("not held_out").select("text", "lang"), fit_rows)
    return predict_languages(marked.drop("lang"), filters)
