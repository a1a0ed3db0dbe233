"""A filter of fixed size that lets through all rows of some keys, and few others, without a shuffle of the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bits of the filter, for any number of keys; a million bytes go to the driver and to each task
BITS = 1 << 23


def bits_of(hashes: DataFrame) -> np.ndarray:
    """The BITS bits of a column h of hashes, as 64-bit words."""
    at = F.pmod("h", F.lit(BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(h, {BITS}) % 64 as int))")
    rows = hashes.groupBy((at / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()
    words = np.zeros(BITS // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy()
    return words.view(np.uint64)


def passing(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the filter lets through."""
    at = np.mod(hashes, BITS)
    return np.flatnonzero((words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1))


def sieved(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` whose key's hash is that of a key of ``wanted`` (one column); too many wanted keys let all rows through."""
    (name,) = wanted.columns
    bits = rows.sparkSession.sparkContext.broadcast(bits_of(wanted.select(F.xxhash64(name).alias("h"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = passing(bits.value, batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([c.take(pa.array(some)) for c in batch.columns[1:]], names=batch.schema.names[1:])

    return rows.select(F.xxhash64(key).alias("_h"), "*").mapInArrow(run, rows.schema)
