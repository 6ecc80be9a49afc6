"""K-mers that every task knows: sets of short codes as bits, sent to the tasks once, so that the k-mers of genomes stay where their sequence is."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from strandset.operators.count import chunks, groups, unique_counts

#: Codes of up to so many bits are told apart by a bit each.
BITS = 26
#: Bytes of the bits of all units that are sent to the tasks; more of them go by joins.
MOST = 32 << 20
#: Codes whose bits are one row between tasks.
BLOCK = 1 << 15


def short(k: int, hashed: bool) -> bool:
    return not hashed and 2 * k <= BITS


class Known:
    """The bits of codes of k bases, a row for each unit and an empty one at the end."""

    def __init__(self, k: int, rows: dict, bits: np.ndarray):
        self.width, self.rows, self.bits = 4 ** max(k, 2) // 8, rows, bits

    def row(self, unit=None) -> int:
        return self.rows.get(unit, len(self.rows))

    def has(self, code: np.ndarray, row: np.ndarray | int = 0) -> np.ndarray:
        """Whether the bit of each code, in the row of its unit, is set."""
        at = (code >> np.uint64(3)).astype(np.int64) + row * self.width
        return (self.bits[at] >> (code & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _blocks(held: dict, k: int, names: list[str], kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
    """The flags of a task's units (1 for a code that it saw, 2 for one that it saw again) as bits of codes seen and seen again, a block of codes a row."""
    size = min(BLOCK, 4**k)
    for unit, flags in held.items():
        at = np.flatnonzero(flags.reshape(-1, size).any(1))
        bits = [[np.packbits(flags[i * size : (i + 1) * size] >= x, bitorder="little").tobytes() for i in at] for x in (1, 2)]
        columns = [pa.array([unit] * len(at), kind)] if kind is not None else []
        if len(at):
            yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int64)), *[pa.array(b, pa.binary()) for b in bits]], names=names)


def _known(rows: DataFrame, k: int, unit: str | None, second: bool) -> Known | None:
    """The bits of all tasks together: those of codes seen, or with second those of codes seen more than once. None if they are more than MOST bytes."""
    keys = [unit] if unit else []
    size = min(BLOCK, 4**k)
    width, step = 4**k // 8, size // 8

    def run(batches):
        last, once, twice = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in range(len(keys) + 1))
                a, b = (np.frombuffer(batch.column(len(keys) + c)[i].as_buffer(), np.uint8) for c in (1, 2))
                if key == last:
                    twice |= b | once & a
                    once |= a
                    continue
                if last is not None:
                    yield out(last, twice if second else once)
                last, once, twice = key, a.copy(), b.copy()
        if last is not None:
            yield out(last, twice if second else once)

    def out(key, bits):
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(key, kinds)] + [pa.array([bits.tobytes()], pa.binary())], names=[*keys, "at", "bits"])

    kinds = [to_arrow_type(rows.schema[c].dataType) for c in (*keys, "at")]
    schema = rows.select(*keys, "at", F.col("once").alias("bits")).schema
    merged = rows.repartition(*keys, "at").sortWithinPartitions(*keys, "at").mapInArrow(run, schema)
    most = MOST // step
    found = merged.limit(most + 1).collect()
    at: dict = {} if keys else {None: 0}
    for r in found:
        at.setdefault(r[unit] if unit else None, len(at))
    if len(found) > most or len(at) * width > MOST:
        return None
    bits = np.zeros((len(at) + 1) * width, np.uint8)
    for r in found:
        begin = at[r[unit] if unit else None] * width + r["at"] * step
        bits[begin : begin + step] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return Known(k, at, bits)


def _schema(df: DataFrame, keys: list[str]):
    return df.select(*keys).withColumns({"at": F.lit(0).cast("long"), "once": F.lit(b"").cast("binary"), "twice": F.lit(b"").cast("binary")}).schema


def of_codes(df: DataFrame, k: int) -> Known | None:
    """The codes of df."""

    def run(batches):
        flags = np.zeros(4**k2, np.uint8)
        for batch in batches:
            flags[batch.column(0).to_numpy(zero_copy_only=False)] = 1
        yield from _blocks({None: flags}, k2, ["at", "once", "twice"], None)

    k2 = max(k, 2)
    return _known(df.select("code").where(F.col("code").between(0, 4**k - 1)).mapInArrow(run, _schema(df, [])), k2, None, False)


def repeated(genomes: DataFrame, k: int, seq_col: str, unit: str | None, circular: bool = False) -> Known | None:
    """The canonical codes that occur more than once in their unit (or in all sequences); a null unit has none."""
    keys, k2 = [unit] if unit else [], max(k, 2)
    if unit:
        genomes, most = genomes.where(F.col(unit).isNotNull()), MOST * 8 // 4**k2
        if genomes.select(unit).distinct().limit(most + 1).count() > most:
            return None

    def run(batches):
        held, kind = {}, None
        for batch in batches:
            kind = batch.schema.field(0).type if keys else None
            for c in chunks(batch, len(keys), k, circular):
                group, first = groups(batch, c.at, c.stop, len(keys))
                code, of, n = unique_counts(c.codes(True)[1], group[c.owner])
                edges = np.searchsorted(of, np.arange(len(first) + 1))
                for g, row in enumerate(first):
                    name = batch.column(0)[int(row)].as_py() if keys else None
                    if name not in held:
                        held[name] = np.zeros(4**k2, np.uint8)
                    own = slice(edges[g], edges[g + 1])
                    flags, mine = held[name], code[own].astype(np.int64)
                    flags[mine] = 1 + ((flags[mine] > 0) | (n[own] > 1))
        yield from _blocks(held, k2, [*keys, "at", "once", "twice"], kind)

    rows = genomes.select(*keys, F.col(seq_col).alias("__seq")).mapInArrow(run, _schema(genomes, keys))
    return _known(rows, k2, unit, True)
