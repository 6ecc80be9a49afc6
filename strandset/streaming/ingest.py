"""K-mer sets that grow as genomes arrive: Structured Streaming over files of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.operators.count import kmers


def new_kmers(stream: DataFrame, k: int, seq_col: str = "seq", time_col: str | None = None, lateness: str = "1 hour", **how) -> DataFrame:
    """The k-mers of a stream of sequences that were not seen before.

    With time_col, state is kept for k-mers seen within the watermark only; without it, for all, on the state store's disk.
    """
    if time_col:
        found = kmers(stream.withWatermark(time_col, lateness), k, seq_col, keep=(time_col,), **how)
        return found.select("code", time_col).dropDuplicatesWithinWatermark(["code"])
    return kmers(stream, k, seq_col, **how).select("code").dropDuplicates(["code"])


def kmer_counts(stream: DataFrame, k: int, time_col: str, window: str = "1 hour", lateness: str = "1 hour", seq_col: str = "seq", **how) -> DataFrame:
    """Occurrences of each k-mer in tumbling windows of the records' time."""
    found = kmers(stream.withWatermark(time_col, lateness), k, seq_col, keep=(time_col,), **how)
    return found.groupBy(F.window(time_col, window).alias("window"), "code").agg(F.count(F.lit(1)).alias("n"))
