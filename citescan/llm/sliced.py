"""Slices of Arrow batches, so that a task's memory does not depend on how many rows a batch has."""

from collections.abc import Iterator

import pyarrow as pa

ROWS = 512


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in order, at most ``ROWS`` at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)
