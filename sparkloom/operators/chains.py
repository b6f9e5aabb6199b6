"""Hash chains: each entry's hash covers the one before it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def chained(entries: DataFrame, key: str, order: list[str], body: str) -> DataFrame:
    """``entries`` with ``previous_hash`` and ``chain_hash``: the SHA-256 of the previous hash and the row's ``body``.

    A chain can't be worked out in parts, so a key's rows are one task's; they
    stream through it in order and the carried state is one hash, whatever the
    key's length.  The first entry follows the empty string; a null body is
    empty; a null key is a chain of its own.
    """
    schema = entries.withColumns({"previous_hash": F.lit("").cast("string"), "chain_hash": F.lit("").cast("string")}).schema
    at_key, at_body = entries.columns.index(key), entries.columns.index(body)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last = object(), ""
        for batch in batches:
            before, after = [], []
            for k, text in zip(batch.column(at_key).to_pylist(), batch.column(at_body).to_pylist(), strict=True):
                if k != chain:
                    chain, last = k, ""
                before.append(last)
                last = hashlib.sha256((last + (text or "")).encode()).hexdigest()
                after.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*batch.schema.names, "previous_hash", "chain_hash"])

    return entries.repartition(key).sortWithinPartitions(key, *order).mapInArrow(work, schema)
