"""Record blobs: many small (key, payload) records of a batch travel as one row per hash bucket.

A row of two longs costs Spark more in bookkeeping than in content. Records of one input batch that fall into one bucket are
therefore packed into binary columns; after the shuffle a bucket is one group, whose blobs are joined again with numpy.
The number of buckets follows the session's shuffle partitions, so a bucket stays at a partition's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def split(bucket: np.ndarray, count: int, columns: list[np.ndarray]):
    """Yield (bucket, columns cut to it) for the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(count + 1))
    sorted_columns = [c[order] for c in columns]
    for k in range(count):
        if ends[k] < ends[k + 1]:
            yield k, [c[ends[k] : ends[k + 1]] for c in sorted_columns]


def join(table: pa.Table, name: str, kind) -> np.ndarray:
    """All blobs of a column, end to end."""
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
