"""Places of pattern matches as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: A word boundary between ASCII letters, digits and the underscore, and anything else, the same in every engine.
BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
_SPAN = "array<struct<kind:string,start:int,stop:int>>"


def ascii_bounds(pattern: str) -> str:
    """The pattern with explicit ASCII boundaries for each ``\\b``: accented letters are no word letters, in any engine."""
    return pattern.replace(r"\b", BOUNDARY)


def found_spans(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern that matches no empty string: (kind, start, stop) in characters from 0.

    A match starts where the pieces between matches and the matches before it end.
    """
    between, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    sized = F.zip_with(F.transform(between, lambda x: F.length(x)), F.transform(matches, lambda x: F.length(x)), lambda a, b: F.struct(a.alias("gap"), b.alias("size")))
    folded = F.aggregate(
        F.filter(sized, lambda x: x["size"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + x["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), (acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["size"]).alias("stop")))).alias("out"),
        ),
    )
    return F.when(text.rlike(pattern), folded["out"]).otherwise(F.array().cast(_SPAN))


def first_come_spans(text: Column, patterns: dict[str, str]) -> Column:
    """Matches of all patterns, in their order; one that overlaps an earlier find is none."""
    kept = F.array().cast(_SPAN)
    every = F.concat(*[found_spans(text, kind, p) for kind, p in patterns.items()])
    return F.aggregate(
        every,
        kept,
        lambda acc, s: F.when(F.exists(acc, lambda k: (s["start"] < k["stop"]) & (k["start"] < s["stop"])), acc).otherwise(F.concat(acc, F.array(s))),
    )
