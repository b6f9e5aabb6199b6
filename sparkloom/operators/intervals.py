"""Time windows over recordings and joins of intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Milliseconds: target, overlap, least and largest length of a window.
TARGET_MS, OVERLAP_MS, LEAST_MS, MOST_MS = 30_000, 2_000, 5_000, 60_000


def window_bounds(duration: Column, target: int = TARGET_MS, overlap: int = OVERLAP_MS, least: int = LEAST_MS, most: int = MOST_MS) -> Column:
    """Windows (start_ms, end_ms) of a duration: steps of target - overlap, a remainder shorter than ``least`` joins
    the window before it unless that grows past ``most``."""
    step = target - overlap
    starts = F.filter(F.sequence(F.lit(0).cast("bigint"), F.greatest(duration - 1, F.lit(0).cast("bigint")), F.lit(step).cast("bigint")), lambda s: (s == 0) | (s + overlap < duration))
    # A window whose successor would leave less than ``least`` takes the rest.
    cut = F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start_ms"),
            F.when((duration - (s + target) > 0) & (duration - (s + target) < least) & (duration - s <= most), duration).otherwise(F.least(s + target, duration)).alias("end_ms"),
        ),
    )
    closed = F.filter(cut, lambda w, i: (i == 0) | (F.coalesce(F.get(cut, i - 1)["end_ms"], F.lit(0)) < duration))
    return F.when(duration <= 0, F.array().cast("array<struct<start_ms:bigint,end_ms:bigint>>")).otherwise(closed)


def overlap_join(left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Rows of left(key, lo, hi) and right(key, r_lo, r_hi) whose half-open intervals meet.

    Both sides are dealt into buckets of ``width``; a pair that meets in several
    buckets is kept in the one where the later interval starts, so nothing has
    to be made distinct afterwards.
    """

    def dealt(side: DataFrame, lo: str, hi: str) -> DataFrame:
        return side.filter(F.col(lo) < F.col(hi)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width))))

    pairs = dealt(left, "lo", "hi").join(dealt(right, "r_lo", "r_hi"), ["key", "__b"])
    meets = (F.col("lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("hi"))
    return pairs.filter(meets & (F.col("__b") == F.floor(F.greatest("lo", "r_lo") / width))).drop("__b")


def point_join(left: DataFrame, points: DataFrame, width: int) -> DataFrame:
    """Points(key, at) inside half-open left(key, lo, hi)."""
    dealt = left.filter("lo < hi").withColumn("__b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    pairs = dealt.join(points.withColumn("__b", F.floor(F.col("at") / width)), ["key", "__b"])
    return pairs.filter((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).drop("__b")


def first_texts(texts: Column) -> Column:
    """Texts in order without those contained in, or containing, an earlier one."""
    return F.aggregate(
        texts,
        F.array().cast("array<string>"),
        lambda kept, t: F.when((F.trim(t) == "") | F.exists(kept, lambda k: F.contains(k, t) | F.contains(t, k)), kept).otherwise(F.concat(kept, F.array(t))),
    )
