"""What the training-data operators share: the shared folder, written tables, documents and hashes."""

from __future__ import annotations

import os
import uuid
import weakref
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.storage import shared_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that are worked on together: so many bytes, or one text.
SLICE_BYTES = 4 << 20
_PATHS: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()


@contextmanager
def cleaned(spark: SparkSession):
    """Shuffle files of queries that run inside are removed when they have ended."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written as Parquet into the shared folder and read again: lineage ends here, and a lost executor loses nothing.

    With by, rows of one value of that column have files of their own.

    The shuffle files of the write, which nothing needs any more, are removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with cleaned(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored table that no later plan reads."""
    path = _PATHS.pop(df, None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Rows of whole texts are large, so that Spark's default of 10,000 rows a batch is lowered to 2,000; other settings stay."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, modulus: int):
    """crc32 of the id written as text, modulo modulus; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A vocabulary file: below folder, else where the public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(n: int, step: int):
    for at in range(0, n, step):
        yield at, min(n, at + step)


def text_slices(column: pa.Array, rows: int, most: int = SLICE_BYTES):
    """(a, b) of at most rows texts that have most bytes together, or of a single text that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, min(n, at + rows, int(np.searchsorted(ends, before + most, "right"))))
        yield at, stop
        at = stop


def filtered(df: DataFrame, text_col: str, decide, rows: int = 512) -> DataFrame:
    """The rows of df, with all their columns, whose texts (null: empty) decide() keeps: in each task it gives a function from texts to booleans."""
    at = df.columns.index(text_col)

    def run(batches):
        keep = decide()
        for batch in batches:
            for a, b in text_slices(batch.column(at), rows):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(np.asarray(keep([t or "" for t in part.column(at).to_pylist()]), bool)))

    return df.mapInArrow(run, df.schema)


def release() -> None:
    """Gives memory that a task has used and freed back to the machine, where the C library can: workers outlive their tasks."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class TwoGenerationCache:
    """A memo for one task: when the young generation is full it becomes the old one, and what the old one held is forgotten.

    Keys of more than LONG characters are forgotten after each turn, so that limit bounds the bytes too.
    """

    LONG = 64

    def __init__(self, limit: int):
        self.limit, self.young, self.old, self.long = limit, {}, {}, []

    def missing(self, keys: set) -> list:
        """Moves what is known into the young generation and returns the rest."""
        young, old = self.young, self.old
        lost = keys - young.keys()
        known = lost & old.keys()
        for k in known:
            young[k] = old[k]
        found = list(lost - known)
        if found and max(map(len, found)) > self.LONG:
            self.long += [k for k in found if len(k) > self.LONG]
        return found

    def turn(self) -> None:
        for k in self.long:
            self.young.pop(k, None)
        self.long = []
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
