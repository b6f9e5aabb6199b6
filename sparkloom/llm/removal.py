"""Bit filters of a size fitted to their keys, and the removal of decided rows without moving the others."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import Write

#: Bits for each key: one row in sixteen passes by chance.
BITS_PER_KEY = 16
#: Largest filter: 2**26 bits, a million (slot, mask) rows.  More keys take several filters, each for some of the files.
MOST_BITS = 1 << 26


def bits_for(keys: int) -> int | None:
    """A power of two of bits; None beyond what may be broadcast."""
    bits = 1 << max(12, (keys * BITS_PER_KEY - 1).bit_length())
    return bits if bits <= MOST_BITS else None


def _mask(place: Column) -> Column:
    """The bits of one slot."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))).alias("__mask")


def bit_filter(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """Set one bit for each key: at most bits/64 rows (slot, mask)."""
    place = F.pmod(F.col(key), F.lit(bits))
    return keys.groupBy(F.floor(place / 64).cast("int").alias("__slot")).agg(_mask(place))


def survives(df: DataFrame, key: str, bits: int | None, filt: DataFrame | None) -> DataFrame:
    """Adds ``__alive``: whether the key's bit is set.  The filter's size is bounded by ``MOST_BITS``, so it is broadcast."""
    if filt is None:
        return df.withColumn("__alive", F.lit(True))
    place = F.pmod(F.col(key), F.lit(bits))
    hit = df.withColumn("__slot", F.floor(place / 64).cast("int")).join(F.broadcast(filt), "__slot", "left")
    bit = F.call_function("shiftrightunsigned", F.col("__mask"), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
    return hit.withColumn("__alive", F.coalesce(bit == 1, F.lit(False))).drop("__slot", "__mask")


def filter_of(keys: DataFrame, key: str, write: Write, tag: str, bits: int | None = None) -> tuple[int | None, DataFrame | None]:
    """(bits, filter) for a written table of keys; (None, None) where it would be too large to broadcast."""
    bits = bits or bits_for(keys.count())
    return (bits, write(bit_filter(keys, key, bits), tag)) if bits else (None, None)


def _files(docs: DataFrame) -> Column | None:
    """The file of each row; None where ``docs`` is more than a projection or selection of files."""
    try:
        return docs.metadataColumn("_metadata").getField("file_path")
    except AnalysisException:
        return None


def flagged(docs: DataFrame, key: Column, gone: DataFrame, write: Write) -> DataFrame:
    """``docs`` with ``__key`` and ``__alive``, which is true for all rows whose key ``gone`` holds and for few others.

    Keys that one filter holds are looked up in it.  More of them are dealt over
    as many groups of files as there must be filters: a pass over the keys alone
    finds which group each is in, and each group's files are read with that
    group's filter, which is broadcast.  Groups with more keys than others have
    denser filters, so more of their rows are alive by chance.  Rows that come
    from no files are written to some before.  No text is shuffled.
    """
    keys = gone.count()
    bits = bits_for(keys)
    if bits:
        return survives(docs.withColumn("__key", key), "__key", bits, write(bit_filter(gone, "key", bits), "removal-filter"))
    if _files(docs) is None:
        docs = write(docs, "removal-rows")
    groups = math.ceil(keys * BITS_PER_KEY / MOST_BITS)
    group = F.pmod(F.xxhash64(_files(docs)), F.lit(groups)).cast("int")
    place = F.pmod(F.col("key"), F.lit(MOST_BITS))
    at = docs.select(group.alias("__group"), key.alias("key")).join(gone.select("key").hint("merge"), "key", "left_semi")
    filters = at.groupBy("__group", F.floor(place / 64).cast("int").alias("__slot")).agg(_mask(place))
    filters = write(filters.repartitionByRange("__group").sortWithinPartitions("__group"), "removal-filters")
    parts = [
        survives(docs.filter(group == k).withColumn("__key", key), "__key", MOST_BITS, filters.filter(F.col("__group") == k).drop("__group"))
        for k in range(groups)
    ]
    return reduce(DataFrame.unionAll, parts)


def without(docs: DataFrame, id_col: str, key: Column, gone: DataFrame, write: Write) -> DataFrame:
    """``docs`` less the rows that ``gone(id, key, once)`` names; where ``once`` is set, one row of that id and key stays.

    Rows whose bit is unset stay in their task, however many are removed (see
    ``flagged``).  Only the others, the removed rows and one in sixteen besides,
    are shuffled to meet ``gone``, which has no bound and is never broadcast.
    Columns of ``docs`` keep names and order.
    """
    seen = flagged(docs, key, gone, write)
    names = docs.columns
    marks = gone.select(F.col("key").alias("__gone"), F.col("id").alias("__id"), F.col("once").alias("__once")).hint("merge")
    met = seen.filter("__alive").join(marks, (F.col("__key") == F.col("__gone")) & F.col(id_col).eqNullSafe(F.col("__id")), "left")
    parts = [seen.filter("not __alive"), met.filter("__gone is null"), met.filter("__once").dropDuplicates(["__key", id_col])]
    return reduce(DataFrame.unionAll, [p.select(names) for p in parts])
