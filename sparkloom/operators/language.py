"""Language detection by character n-gram profiles."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Labelled texts of each language that profiles are fitted to, n-grams of a profile, and the least share that any n-gram is given.
FIT_ROWS, PROFILE, FLOOR = 2000, 4000, 1e-6
#: Shorter texts are not looked at.
LEAST_LENGTH = 10
SUPPORTED, DEFAULT = ("en", "nl"), "en"
#: Sample texts of the supported languages, for corpora that have none of them.
SEEDS = {
    "en": "The weather has been mild this week, so we have walked along the river every evening. Which of these documents should be read first, and who "
    "wrote them? You can find the answer in the second chapter, where all of the steps are explained with examples. It would be better to wait until "
    "the others have arrived, because they know the way through the forest. What is the difference between both methods? Please write down your name.",
    "nl": "Het weer was deze week zacht, dus hebben we elke avond langs de rivier gewandeld. Welke van deze documenten moet ik eerst lezen, en wie heeft ze "
    "geschreven? Je vindt het antwoord in het tweede hoofdstuk, waar alle stappen met voorbeelden worden uitgelegd. Het zou beter zijn om te wachten tot "
    "de anderen er zijn, want zij weten de weg door het bos. Wat is het verschil tussen beide methoden en hoe werkt dit? Ik wil graag een kopje koffie, "
    "maar niet zonder suiker. Dat is ook mogelijk als u vandaag nog naar ons kantoor komt; wij zijn open van negen tot vijf uur en helpen u graag verder.",
}


def grams(text: str) -> np.ndarray:
    """Codes of all runs of one to three letters, spaces at word ends included; three code points fill 63 bits."""
    lowered = unicodedata.normalize("NFC", text.lower())
    points = np.frombuffer("".join(c if c.isalpha() else " " for c in f" {lowered} ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))]
    letter = points != 32
    out = [points[letter]]
    if len(points) > 1:
        out.append((points[:-1] << 21 | points[1:]))
    if len(points) > 2:
        out.append((points[:-2] << 42 | points[1:-1] << 21 | points[2:])[letter[1:-1]])
    return np.concatenate(out)


@dataclass(frozen=True)
class Profiles:
    """Log shares of n-grams (rows, sorted by code) in languages (columns)."""

    languages: tuple[str, ...]
    codes: np.ndarray
    shares: np.ndarray

    def best(self, text: str) -> str | None:
        """The most likely language, the first of equal ones; None for a text without known n-grams."""
        found = grams(text)
        at = np.searchsorted(self.codes, found)
        at = at[(at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == found)] if len(self.codes) else at[:0]
        if not len(at):
            return None
        return self.languages[int((np.bincount(at, minlength=len(self.codes)) @ self.shares).argmax())]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, n = np.unique(grams(text), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])


def fit_profiles(labelled: DataFrame, rows: int = FIT_ROWS, seeds: dict[str, str] = SEEDS) -> Profiles:
    """From ``labelled(text, lang)``: at most some ``rows`` texts of each language, drawn by a hash of the text, and ``seeds``.

    A profile is its language's most frequent n-grams.  The profiles, at most
    ``PROFILE`` rows a language, are all that reaches the driver.
    """
    known = labelled.filter("text is not null and lang is not null").select("lang", "text")
    sizes = known.groupBy("lang").count()
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.join(F.broadcast(sizes), "lang").filter(draw < rows / F.col("count")).select("lang", "text")  # one row a language
    sample = sample.unionAll(labelled.sparkSession.createDataFrame(list(seeds.items()) or [("", "")], "lang string, text string"))
    counts = sample.mapInArrow(_counted, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    top = counts.withColumn("share", share).withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= PROFILE)
    found = top.select("lang", "code", "share").collect()
    languages = sorted({r["lang"] for r in found}, key=lambda x: (x != DEFAULT, x))
    codes = np.array(sorted({r["code"] for r in found}), np.int64)
    shares = np.full((len(codes), len(languages)), np.log(FLOOR))
    for r in found:
        shares[np.searchsorted(codes, r["code"]), languages.index(r["lang"])] = np.log(max(FLOOR, r["share"]))
    return Profiles(tuple(languages), codes, shares)


def detected(text: Column, profiles: Profiles) -> Column:
    """The language of each text; the default for null and short texts and for those without letters."""

    @F.arrow_udf("string")
    def work(texts: pa.Array) -> pa.Array:
        return pa.array([(profiles.best(t) if t and len(t.strip()) >= LEAST_LENGTH else None) or DEFAULT for t in texts.to_pylist()], pa.string())

    return work(text)


def supported(language: Column) -> Column:
    """A language that templates exist for, else the default."""
    return F.when(language.isin(*SUPPORTED), language).otherwise(DEFAULT)
