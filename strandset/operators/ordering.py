"""Order: sort, merge, split, head, sample and split by taxid."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.functions.codec import unsigned_key
from strandset.meta import KmerSet, SetTable, check_compatible
from strandset.operators.count import chunks, kmers
from strandset.operators.numbering import numbered
from strandset.operators.setops import stacked
from strandset.operators.taxonomy import Taxonomy
from strandset.sources.readers import write_sets
from strandset.storage import shared_folder


def _order():
    return unsigned_key(F.col("code"))


def _reduced(df: DataFrame, mode: str, taxonomy: Taxonomy | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """plain: all rows; unique: each code once; repeated: each code that occurs more than once, once."""
    if mode == "plain":
        return df
    if mode not in ("unique", "repeated"):
        raise ValueError(f"unknown mode {mode}")
    n = F.count(F.lit(1)).alias("n")
    if "taxid" in df.columns:
        out = taxonomy.lca(df, [*keys, "code"], n) if taxonomy is not None else df.groupBy(*keys, "code").agg(F.min("taxid").alias("taxid"), n)
    else:
        out = df.groupBy(*keys, "code").agg(n)
    return (out if mode == "unique" else out.where("n > 1")).drop("n")


def sort(s: KmerSet, mode: str = "plain", taxonomy: Taxonomy | None = None) -> KmerSet:
    """Total order by unsigned code (then taxid), after the aggregate of mode."""
    out = _reduced(s.df, mode, taxonomy)
    return s.with_df(out.orderBy(_order(), *[c for c in ("taxid",) if c in out.columns]), sorted=True)


def merge(sets: list[KmerSet], mode: str = "plain", taxonomy: Taxonomy | None = None) -> KmerSet:
    meta = check_compatible(sets)
    return sort(KmerSet(stacked(sets, sets[0].has_taxid).drop("source"), meta), mode, taxonomy)


def merge_table(table: SetTable, mode: str = "plain", taxonomy: Taxonomy | None = None) -> KmerSet:
    """merge() of all sets of a table, such as read_sets() gives of a folder."""
    return sort(KmerSet(table.df.drop("set_id"), replace(table.meta, sorted=False)), mode, taxonomy)


def split(s: KmerSet, size: int, mode: str = "plain", taxonomy: Taxonomy | None = None) -> DataFrame:
    """(chunk, code...): sorted chunks of at most size rows, numbered from 0. See numbered() for how rows are dealt."""
    if size < 1:
        raise ValueError("chunk size must be positive")
    df = _reduced(s.df, mode, taxonomy)
    ranked = numbered(df, _order(), *[c for c in df.columns if c != "code"])
    return ranked.select(F.floor((F.col("number") - 1) / size).alias("chunk"), *df.columns)


def parse_size(text: str) -> int:
    """A number of k-mers with an optional K, M or G, of 1024 each."""
    text = text.strip().upper()
    factor = {"K": 1 << 10, "M": 1 << 20, "G": 1 << 30}.get(text[-1:], 1)
    return int(float(text[:-1] if factor > 1 else text) * factor)


def head(df: DataFrame, n: int = 10, *order: str) -> DataFrame:
    """The first n rows in the order given."""
    if n < 1:
        raise ValueError("n must be positive")
    return df.orderBy(*order).limit(n)


def sample(df: DataFrame, start: int = 1, window: int = 1, set_col: str = "set_id", order: tuple[str, ...] = ("row_no",)) -> DataFrame:
    """Row j of a set, from 1, stays if j >= start and (j - start) is a multiple of window."""
    if start < 1 or window < 1:
        raise ValueError("start and window must be positive")
    ranked = numbered(df, set_col, *order)
    firsts = ranked.groupBy(F.col(set_col).alias("__set")).agg(F.min("number").alias("__first"))
    j = F.col("number") - F.col("__first") + 1
    kept = ranked.join(firsts, F.col(set_col).eqNullSafe(F.col("__set"))).where((j >= start) & ((j - start) % window == 0))
    return kept.select(*df.columns)


def sample_kmers(df: DataFrame, k: int, start: int = 1, window: int = 1, set_col: str = "set_id", order: tuple[str, ...] = ("id",), seq_col: str = "seq", canonical: bool = False) -> DataFrame:
    """sample() of the k-mers of sequences, those of a set in the order given and then by pos: set_col, order, pos, code.

    Sequences are put in order, not their k-mers: the driver sees the first and the last set of each range and how many k-mers they have
    there, so that a range knows the number of its first k-mer. Sequences that share set and order are told apart k-mer by k-mer.
    """
    if start < 1 or window < 1:
        raise ValueError("start and window must be positive")
    keys = [set_col, *order]
    alike = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if alike:
        return sample(kmers(df, k, seq_col, tuple(keys), canonical), start, window, set_col, (*order, "pos"))
    shared_folder(df.sparkSession)  # checkpoints need one
    ranged = df.select(*keys, F.col(seq_col).alias("__seq")).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    at = len(keys)

    def counted(batches):
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for c in chunks(batch, at, k):
                n[c.at : c.stop] = np.bincount(c.owner, minlength=c.stop - c.at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], names=[*batch.schema.names, "__n"])

    ranged = ranged.mapInArrow(counted, ranged.withColumn("__n", F.lit(0).cast("long")).schema).where("__n > 0").checkpoint()
    sums = ranged.groupBy("__part", set_col).agg(F.sum("__n").alias("n"))
    pair = F.struct(F.col(set_col).alias("of"), "n")
    before, last, total = {}, None, 0
    for r in sorted(sums.groupBy("__part").agg(F.min(pair).alias("a"), F.max(pair).alias("z")).collect(), key=lambda r: r["__part"]):
        before[r["__part"]] = total if (r["a"]["of"],) == last else 0
        total = r["z"]["n"] + (before[r["__part"]] if r["a"]["of"] == r["z"]["of"] else 0)
        last = (r["z"]["of"],)

    def kept(batches):
        now, told = None, 0
        for batch in batches:
            n, first = batch.column(at + 2).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for i, key in enumerate(zip(batch.column(at + 1).to_pylist(), batch.column(0).to_pylist())):
                if key != now:
                    told = before[key[0]] if now is None or key[0] != now[0] else 0
                    now = key
                first[i] = told
                told += int(n[i])
            for c in chunks(batch, at, k):
                own = np.bincount(c.owner, minlength=c.stop - c.at)
                j = first[c.at : c.stop][c.owner] + np.arange(len(c.starts)) - (np.cumsum(own) - own)[c.owner] + 1
                pick = np.flatnonzero((j >= start) & ((j - start) % window == 0))
                rows = pa.array(c.owner[pick] + c.at)
                arrays = [batch.column(i).take(rows) for i in range(at)] + [pa.array(c.pos()[pick]), pa.array(c.codes(canonical)[1][pick].view(np.int64))]
                whole = pa.RecordBatch.from_arrays(arrays, names=[*keys, "pos", "code"])
                for a in range(0, whole.num_rows, 200_000):
                    yield whole.slice(a, 200_000)

    schema = df.select(*keys).withColumns({c: F.lit(0).cast("long") for c in ("pos", "code")}).schema
    return ranged.sortWithinPartitions(*keys).select(*keys, "__seq", "__part", "__n").mapInArrow(kept, schema)


def tsplit(s: KmerSet, prefix: str = "taxid") -> SetTable:
    """A set for each taxid, which becomes the set's global taxid, with each k-mer once. Rows without a taxid are an error."""
    if not s.has_taxid:
        raise ValueError("the k-mer set has no taxids")
    taxid = F.when(F.col("taxid").isNotNull(), F.col("taxid")).otherwise(F.raise_error(F.lit("a k-mer without a taxid")).cast("long"))
    name = F.concat(F.lit(f"{prefix}-"), F.col("taxid").cast("string"), F.lit(f".k{s.meta.k}"))
    rows = s.df.select("code", taxid.alias("taxid")).distinct()
    return SetTable(rows.select(name.alias("set_id"), "code", "taxid"), replace(s.meta, sorted=False, global_taxid=None))


def write_by_taxid(s: KmerSet, path: str, mode: str = "error", prefix: str = "taxid") -> None:
    """The sets of tsplit() as stored sets, a folder each, with their global taxids."""
    write_sets(tsplit(s, prefix), path, mode)
