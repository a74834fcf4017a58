"""Document frequencies of hashed features in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequencies(texts: DataFrame, buckets: int, present: Callable[[pa.Array, np.ndarray], int]) -> tuple[int, np.ndarray]:
    """The count of documents with any feature, and in how many of them each bucket occurs; both over all rows.

    present adds a column of texts to the counts and returns how many had a feature. Each task sends one row of sums, and
    these are added in the cluster, so that the driver gets one table whose size is fixed.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(buckets, np.int64), 0
        for b in batches:
            n += present(b.column(0), sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(sums[at], n))], ["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    out = np.zeros(buckets, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return int(n[bucket < 0].sum()), out
