"""Sequences to k-mers: every k-mer with its place, and the counting modes on top."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.functions import sequence as S
from strandset.meta import KmerMeta, KmerSet, SetTable

if TYPE_CHECKING:
    from strandset.operators.taxonomy import Taxonomy


#: Rows are whole sequences, so that Spark's default for an Arrow batch, 64 MB, is lowered to 16; another setting stays.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bases that are worked on together.
CHUNK = 1 << 20


def groups(batch: pa.RecordBatch, a: int, b: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for each row from a to b by its values in the first columns, and for each number a row that has them."""
    group = np.zeros(b - a, np.int64)
    for c in range(columns):
        values = batch.column(c).slice(a, b - a).dictionary_encode()
        own = np.nan_to_num(values.indices.to_numpy(zero_copy_only=False), nan=len(values.dictionary)).astype(np.int64)
        _, group = np.unique(group * (len(values.dictionary) + 1) + own, return_inverse=True)
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    return group, a + first


def unique_counts(code: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, group, count) of the different pairs."""
    bits = int(code.max()).bit_length() if len(code) else 0
    if bits + int(group.max() if len(group) else 0).bit_length() <= 64:
        shift = np.uint64(bits)
        both = np.sort(code if bits == 64 else group.astype(np.uint64) << shift | code)
        start = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
        both, n = both[start], np.diff(np.append(start, len(both)))
        if bits == 64:
            return both, np.zeros(len(both), np.int64), n
        return both & ((np.uint64(1) << shift) - np.uint64(1)), (both >> shift).astype(np.int64), n
    if int(group.max()) < 1 << 12:
        order = np.argsort(group.astype(np.uint16), kind="stable")
        code, group = code[order], group[order]
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        for a, b in zip(edges, np.append(edges[1:], len(code))):
            code[a:b].sort()
    else:
        order = np.lexsort((code, group))
        code, group = code[order], group[order]
    start = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (group[1:] != group[:-1]))))
    return code[start], group[start], np.diff(np.append(start, len(code)))


@dataclass
class Chunk:
    """Some sequences of a batch, rows at to stop: their bases, the ends of the sequences, and of each whole k-mer its start and its sequence."""

    at: int
    stop: int
    raw: list[bytes]
    k: int
    base: np.ndarray
    ends: np.ndarray
    starts: np.ndarray
    owner: np.ndarray

    def codes(self, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
        """(code of the forward strand, code) of every k-mer."""
        one, other = S.codes(self.base, self.k)
        return one[self.starts], np.minimum(one, other)[self.starts] if canonical else one[self.starts]

    def pos(self) -> np.ndarray:
        return self.starts - np.concatenate(([0], self.ends))[self.owner]


def chunks(batch: pa.RecordBatch, column: int, k: int, circular: bool = False, twice: bool = False) -> Iterator[Chunk]:
    """The sequences of a column in chunks of about CHUNK bases; those without a whole k-mer are left out. circular adds the bases over the end, twice the sequence again."""
    texts, at = batch.column(column), 0
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) * (1 + twice))
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + CHUNK, side="right")))
        raw = [(s or "").encode("utf-8", "replace") for s in texts.slice(at, stop - at).to_pylist()]
        if circular:
            raw = [s + s[: k - 1] if len(s) >= k else s for s in raw]
        walk = [s + s if len(s) >= k else s for s in raw] if twice else raw
        ends = np.cumsum(np.array(list(map(len, walk)), np.int64))
        base = S.bases(b"".join(walk))
        starts = S.valid(base, ends, k)
        if len(starts):
            yield Chunk(at, stop, raw, k, base, ends, starts, np.searchsorted(ends, starts, side="right"))
        at = stop


def kmers(df: DataFrame, k: int, seq_col: str = "seq", keep: tuple[str, ...] = (), canonical: bool = False, hashed: bool = False, circular: bool = False, scale: int = 1, minimizer: int = 0, syncmer: int = 0, strands: bool = False, reduce: bool = False, packed: bool = False) -> DataFrame:
    """One row per k-mer: the columns of keep, pos (from 0) and code (or hash), in Arrow batches.

    Sequences shorter than k and null ones give none; k-mers with a letter other than A, C, G, T in any case are left
    out. circular adds the k-mers over the end. scale keeps hashes up to 2^64 / scale, after any sketch. minimizer is
    the number of neighbouring k-mers, syncmer the length of the inner s-mers; both, like scale, use hashes.
    strands adds the text of the forward strand as the code fwd. With reduce, equal rows of a batch are one row, and n, how
    often it occurs, takes the place of pos; packed gives the different rows of a chunk as arrays by bucket instead.
    """
    if minimizer and syncmer:
        raise ValueError("minimizers and syncmers exclude each other")
    if minimizer < 0 or syncmer < 0 or syncmer > k or scale < 1:
        raise ValueError("sketch parameters out of range")
    hashed = hashed or k > 32 or bool(minimizer or syncmer) or scale > 1
    if strands and k > 32:
        raise ValueError("strands are given for up to 32 bases")
    if strands and reduce:
        raise ValueError("reduced k-mers have no strand")
    KmerMeta(k, canonical, hashed)
    if df.sparkSession.conf.get(BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(BATCH_BYTES, "16m")
    most = (1 << 64) - 1 if scale == 1 else int(float((1 << 64) - 1) / scale)
    schema = df.select(*keep).withColumns({"n" if reduce else "pos": F.lit(0).cast("long"), "code": F.lit(0).cast("long")} | ({"fwd": F.lit(0).cast("long")} if strands else {})).schema
    names = [*keep, "n" if reduce else "pos", "code"] + ["fwd"] * strands
    if packed:
        schema = df.select(*[F.lit(None).cast(x).alias(c) for c, x in zip(PACKED, ("int", "binary", "binary", "binary", "int"))]).schema

    def run(batches):
        for batch in batches:
            for c in chunks(batch, len(keep), k, circular):
                starts, owner = c.starts, c.owner
                if hashed:
                    value = S.nthash(c.base, k)
                    pick = S.minimizers(value, starts, owner, minimizer) if minimizer else S.syncmers(c.base, starts, k, syncmer) if syncmer else np.arange(len(starts))
                    pick = pick[value[starts[pick]] <= np.uint64(most)]
                    starts, owner = starts[pick], owner[pick]
                    code = value[starts]
                    fwd = S.codes(c.base, k)[0][starts] if strands else None
                else:
                    fwd, code = c.codes(canonical)
                if reduce:
                    group, first = groups(batch, c.at, c.stop, len(keep))
                    code, of, n = unique_counts(code, group[owner])
                    if packed:
                        own = [batch.column(i).take(pa.array(first)) for i in range(len(keep))]
                        if len(code):
                            yield _packed(pa.RecordBatch.from_arrays(own or [pa.nulls(1, pa.int32())], names=list(keep) or ["none"]), code, of)
                        continue
                    arrays = [batch.column(i).take(pa.array(first[of])) for i in range(len(keep))] + [pa.array(n), pa.array(code.view(np.int64))]
                else:
                    rows, begin = pa.array(owner + c.at), np.concatenate(([0], c.ends))[owner]
                    arrays = [batch.column(i).take(rows) for i in range(len(keep))] + [pa.array(starts - begin), pa.array(code.view(np.int64))] + ([pa.array(fwd.view(np.int64))] if strands else [])
                whole = pa.RecordBatch.from_arrays(arrays, names=names)
                for a in range(0, whole.num_rows, 200_000):
                    yield whole.slice(a, 200_000)

    return df.select(*keep, F.col(seq_col).alias("__seq")).mapInArrow(run, schema)


#: Different k-mers are put together in so many buckets, a few of which a task has at a time.
BUCKETS = 1024
#: Pairs of set and code that a task puts together at once, if a bucket has no more.
TOGETHER = 1 << 20


def distinct_kmers(df: DataFrame, k: int, keep: tuple[str, ...] = (), seq_col: str = "seq", **how) -> DataFrame:
    """(keep, code) of the different k-mers. What is shuffled are arrays of codes by bucket, not rows."""
    found = kmers(df, k, seq_col, keep, reduce=True, packed=True, **how)
    schema = df.select(*keep).withColumns({"code": F.lit(0).cast("long")}).schema

    def together(heads, parts):
        places, tables, rows = {}, [], 0
        for h in heads:
            if h not in places:
                table = pa.ipc.open_stream(h).read_all()
                places[h] = rows, table.num_rows
                tables.append(table)
                rows += table.num_rows
        sets = pa.concat_tables(tables).combine_chunks().to_batches()[0]
        same, first = groups(sets, 0, rows, len(keep))
        code = np.concatenate([np.frombuffer(c, np.uint32 if wide == 4 else np.uint64).astype(np.uint64) for _, c, wide in parts])
        group = np.concatenate([same[places[h][0] + np.frombuffer(g, np.uint16 if places[h][1] <= 1 << 16 else np.uint32).astype(np.int64)] for h, (g, _, _) in zip(heads, parts)])
        code, of, _ = unique_counts(code, group)
        for a in range(0, len(code), 200_000):
            own = pa.array(first[of[a : a + 200_000]])
            yield pa.RecordBatch.from_arrays([sets.column(i).take(own) for i in range(len(keep))] + [pa.array(code[a : a + 200_000].view(np.int64))], names=[*keep, "code"])

    def run(batches):
        heads, parts, size, last = [], [], 0, None
        for batch in batches:
            numbers, widths = batch.column(0).to_pylist(), batch.column(4).to_pylist()
            for i, (bucket, wide) in enumerate(zip(numbers, widths)):
                if bucket != last and size >= TOGETHER:
                    yield from together(heads, parts)
                    heads, parts, size = [], [], 0
                head, group, code = (batch.column(c)[i].as_buffer() for c in (1, 2, 3))
                last, size = bucket, size + code.size // wide
                head = head.to_pybytes()
                heads.append(heads[-1] if heads and heads[-1] == head else head)
                parts.append((group, code, wide))
        if parts:
            yield from together(heads, parts)

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _packed(sets: pa.RecordBatch, code: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    """The pairs of a chunk, a bucket a row; sets has the values of the numbers in of."""
    bucket = (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    code, of, bucket = code[order], of[order], bucket[order]
    edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    there = np.flatnonzero(edges[1:] > edges[:-1])
    wide = 4 if not len(code) or int(code.max()) < 1 << 32 else 8
    code, of = code.astype(np.uint32 if wide == 4 else np.uint64), of.astype(np.uint16 if sets.num_rows <= 1 << 16 else np.uint32)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, sets.schema) as out:
        out.write_batch(sets)
    head = sink.getvalue().to_pybytes()
    cut = lambda x: pa.array([x[edges[b] : edges[b + 1]].tobytes() for b in there], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array([head] * len(there), pa.binary()), cut(of), cut(code), pa.array(np.full(len(there), wide, np.int32))], names=PACKED)


PACKED = ["bucket", "sets", "set", "codes", "bytes"]


def set_table(df: DataFrame, k: int, set_col: str, **how) -> SetTable:
    """The k-mers of the sequences as sets, one for each value of set_col. K-mers may repeat, since what combines sets sees to that."""
    hashed = bool(how.get("hashed")) or k > 32 or any(how.get(x, 0) for x in ("minimizer", "syncmer")) or how.get("scale", 1) > 1
    meta = KmerMeta(k, bool(how.get("canonical")) or hashed, hashed, how.get("scale", 1))
    rows = kmers(df.withColumn(set_col, F.col(set_col).cast("string")), k, keep=(set_col,), reduce=True, **how)
    return SetTable(rows.select(F.col(set_col).alias("set_id"), "code"), meta)


def name_filter(df: DataFrame, patterns: list[str], name_col: str = "name") -> DataFrame:
    """Drops records whose header matches any pattern; patterns ignore case unless they say otherwise."""
    for p in patterns:
        df = df.where(~F.coalesce(F.col(name_col).rlike(p if p.startswith("(?") else f"(?i){p}"), F.lit(False)))
    return df


def parse_taxid(df: DataFrame, pattern: str, name_col: str = "name") -> DataFrame:
    """Adds taxid, the number that group 1 of the pattern finds in the header; a header without it is an error."""
    found = F.regexp_extract(name_col, pattern, 1)
    return df.withColumn("taxid", F.when(found.rlike("^[0-9]+$"), found.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no taxid in header: "), F.coalesce(name_col, F.lit("null"))))))


def count(df: DataFrame, k: int, mode: str = "distinct", set_cols: tuple[str, ...] = (), taxonomy: "Taxonomy | None" = None, global_taxid: int | None = None, sort: bool = False, row_cols: tuple[str, ...] = (), **how) -> KmerSet:
    """The k-mer set of the sequences, one for each value of set_cols.

    mode: distinct (each once), unique (those that occur once in all), repeated (more often), linear (all, with pos and
    row_cols, which tell the sequence, in no order but that of pos). Occurrences are counted over all records of a set. With a taxonomy, df has a column taxid
    and codes get the lowest common ancestor of their occurrences; a unique one has its own taxid.
    """
    if mode not in ("distinct", "unique", "repeated", "linear"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "linear" and sort:
        raise ValueError("linear k-mers keep the order of their sequence")
    if taxonomy is not None and global_taxid is not None:
        raise ValueError("a global taxid and parsed taxids exclude each other")
    taxed = ("taxid",) if taxonomy is not None else ()
    hashed = bool(how.get("hashed")) or k > 32 or any(how.get(x, 0) for x in ("minimizer", "syncmer")) or how.get("scale", 1) > 1
    meta = KmerMeta(k, bool(how.get("canonical")) or hashed, hashed, how.get("scale", 1), global_taxid, sort, within=how.get("scale", 1))
    if mode == "linear":
        extra = tuple(c for c in row_cols if c not in set_cols)
        out = kmers(df, k, keep=(*set_cols, *extra, *taxed), **how)
    else:
        n = F.sum("n").alias("n")
        if taxonomy is None and mode == "distinct":
            out = distinct_kmers(df, k, set_cols, **how)
        else:
            found = kmers(df, k, keep=(*set_cols, *taxed), reduce=True, **how)
            out = taxonomy.lca(found, [*set_cols, "code"], n) if taxonomy is not None else found.groupBy(*set_cols, "code").agg(n)
        if mode != "distinct":
            out = out.where("n = 1" if mode == "unique" else "n > 1")
        out = out.drop("n")
    if global_taxid is not None:
        out = out.withColumn("taxid", F.lit(global_taxid).cast("long"))
    if sort:
        from strandset.functions.codec import unsigned_key

        out = out.orderBy(*set_cols, unsigned_key(F.col("code")))
    return KmerSet(out, meta)
