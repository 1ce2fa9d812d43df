"""Helpers shared by the operators: the shared folder, written steps, small Arrow batches, unions of linked nodes."""

from __future__ import annotations

import contextlib
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgraph.session import checkpoint_dir

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read back, so a lost executor costs no earlier step."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Python stages that run inside get at most so many rows at once; for rows that hold whole blocks."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def crc_fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


class Unions:
    """Union-find over 0..n-1 on whole arrays of links; a root is the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _settle(self) -> None:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            self._settle()

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """One link to its root for each member that is not a root."""
        member = np.flatnonzero(self.root != np.arange(len(self.root)))
        return member, self.root[member]


def slices(batches, size_of: str, most_bytes: int):
    """Arrow batches cut so that the text or binary column ``size_of`` holds at most so many bytes, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(size_of)), 0).to_numpy(zero_copy_only=False).astype("i8"))
        start, base = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(total, base + most_bytes, "right")))
            yield batch.slice(start, end - start)
            start, base = end, int(total[end - 1])


def spread(starts: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Indices of the members of the chosen runs, one run after the other."""
    n = lengths[chosen]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts[chosen] - (ends - n), n) + np.arange(total)
