"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, and a rerank with original vectors.

Unit vectors are centred, turned to their principal axes and rotated so that the signs lose least (iterative
quantisation), which gives balanced binary codes. Codes are indexed by several tables: each holds one part of the code, and
is asked for that part with so many flipped bits that every pair within the radius meets in some table; or it holds
randomly drawn bits, with so many tables that all but MISS of the pairs meet. Among these layouts the one with the fewest
requests and expected candidates for the number of vectors is taken. The radius is measured on the fitted codes: vectors of
the sample are turned by the angle of the threshold, in directions like those in which vectors of the sample differ and
in any direction, and all but MISS of them stay within it. A pair counts in the first table where it meets, and only
if the cosine of the original vectors reaches the threshold. Entries of many vectors are compared in blocks.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, stored, table
from .components import components
from .minhash import forest
from .vectors import matrix, sample_matrix, sound, usual_size

BITS = 64
SAMPLE = 20_000
ROUNDS = 30
#: Of pairs just at the threshold, the share whose codes may differ in more bits than the radius.
MISS = 1e-3
#: Layouts of tables to choose from: parts of a code asked for with flipped bits, at most so many requests a vector, or tables of drawn bits.
PARTS, MOST_PROBES, MOST_TABLES = (8, 6, 4, 3, 2), 2048, 512
#: Vectors of a table's entry that are compared in blocks rather than pair by pair, and the vectors of a block.
HEAVY, BLOCK = 512, 512


class Quantiser:
    """mean and a projection (principal axes, rotated) whose signs are the code."""

    def __init__(self, sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 11):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(0)
        centred = unit - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :bits]
        short = axes.shape[1] < bits  # of few components, extra bits come from random directions
        rng = np.random.default_rng(seed)
        rotation = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        v = centred @ axes
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(v @ rotation >= 0, 1.0, -1.0).T @ v)
            rotation = (u @ w).T
        self.projection = axes @ rotation
        if short:
            self.projection = np.hstack((self.projection, rng.standard_normal((len(self.mean), bits - axes.shape[1]))))

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = (x / np.linalg.norm(x, axis=1, keepdims=True) - self.mean) @ self.projection >= 0
        return np.packbits(signs, axis=1, bitorder="little").view("<i8").ravel()


def apart(coder: Quantiser, sample: np.ndarray, threshold: float, pairs: int = 20_000, seed: int = 12) -> np.ndarray:
    """In how many bits the codes of pairs just at cosine threshold differ, in the wider of the two kinds of direction."""
    rng = np.random.default_rng(seed)
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    x = unit[rng.integers(0, len(unit), pairs)]
    bits = lambda v: coder.codes(v).view(np.uint8).reshape(-1, BITS // 8)
    found = np.zeros(1, np.int64)
    for turn in (rng.standard_normal(x.shape), unit[rng.integers(0, len(unit), pairs)] - unit[rng.integers(0, len(unit), pairs)]):
        turn = turn - (turn * x).sum(1, keepdims=True) * x
        size = np.linalg.norm(turn, axis=1, keepdims=True)
        y = threshold * x + np.sqrt(max(1 - threshold**2, 0.0)) * turn / np.maximum(size, 1e-300)
        some = size[:, 0] > 1e-9
        if some.any():
            own = np.unpackbits(bits(x[some]) ^ bits(y[some]), axis=1).sum(1)
            found = max(found, own, key=np.mean)
    return found


def cut_parts(parts: int) -> list[tuple[int, int]]:
    """(shift, width) of the parts of a code."""
    edges = [BITS * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:])]


def probes(parts: int, radius: int) -> int:
    """Requests a vector if every part is asked for with all flips that a pair within radius needs; 0 if that is too many."""
    n = sum(math.comb(w, k) for _, w in cut_parts(parts) for k in range(radius // parts + 1))
    return n if n <= MOST_PROBES else 0


def layout(differ: np.ndarray, n: int, miss: float = MISS) -> tuple[str, int, int]:
    """("parts", parts, flips) or ("drawn", tables, bits), whichever has the fewest requests and candidates a vector.

    differ tells in how many bits pairs at the threshold differ, n how many vectors a label has at most.
    """
    radius = int(np.quantile(differ, 1 - miss, method="higher"))
    found = [(probes(p, radius) * (1 + n / 2.0 ** (BITS // p)), "parts", p, radius // p) for p in PARTS if probes(p, radius)]
    for width in range(1, 41):
        share = np.prod([np.maximum(BITS - differ - i, 0) / (BITS - i) for i in range(width)], axis=0)
        tables = next((t for t in range(8, MOST_TABLES + 1, 8) if np.mean((1 - share) ** t) <= miss), 0)
        if tables:
            found.append((tables * (1 + n / 2.0**width), "drawn", tables, width))
    return min(found)[1:] if found else ("drawn", 1, 0)  # no bits: all pairs of a label


def drawn_masks(tables: int, width: int, seed: int = 13) -> list[int]:
    """Masks of randomly drawn bits."""
    rng = np.random.default_rng(seed)
    return [sum(1 << int(b) for b in rng.choice(BITS, width, replace=False)) for _ in range(tables)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def tables_of(classes: DataFrame, kind: str, count: int, more: int) -> tuple[DataFrame, DataFrame, object]:
    """The tables' entries (label, table, bits, b, code_b), the requests (label, table, bits, a, code_a), and the condition under
    which a pair that shares an entry meets there for the first time, so that it counts once."""
    differ = F.col("code_a").bitwiseXOR(F.col("code_b"))
    if kind == "parts":
        parts = cut_parts(count)
        own = F.posexplode(F.array(*[F.shiftrightunsigned(F.col("code"), s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in parts])).alias("table", "bits")
        flips = F.array(*[F.array(*[F.lit(sum(1 << i for i in x)).cast("long") for k in range(more + 1) for x in itertools.combinations(range(w), k)]) for _, w in parts])
        asked = classes.select("label", F.col("cls").alias("a"), F.col("code").alias("code_a"), own)
        asked = asked.select("label", "a", "code_a", "table", "bits", F.explode(flips[F.col("table")]).alias("flip")).withColumn("bits", F.col("bits").bitwiseXOR(F.col("flip"))).drop("flip")
        near = [F.bit_count(F.shiftrightunsigned(differ, s).bitwiseAND(F.lit((1 << w) - 1))) <= more for s, w in parts]
    else:
        masks = [signed(m) for m in drawn_masks(count, more)]
        own = F.posexplode(F.array(*[F.col("code").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "bits")
        asked = classes.select("label", F.col("cls").alias("a"), F.col("code").alias("code_a"), own)
        near = [differ.bitwiseAND(F.lit(m)) == 0 for m in masks]
    kept = classes.select("label", F.col("cls").alias("b"), F.col("code").alias("code_b"), own)
    return kept, asked, F.array_position(F.array(*near), True) == F.col("table") + 1


def first_meeting(kind: str, count: int, more: int):
    """The same condition for arrays: whether codes that differ in the bits given meet in a table for the first time."""
    if kind == "parts":
        shapes = [(np.uint64(a), np.uint64((1 << w) - 1)) for a, w in cut_parts(count)]
        near = lambda d, t: np.bitwise_count((d >> shapes[t][0]) & shapes[t][1]) <= more
    else:
        masks = [np.uint64(m) for m in drawn_masks(count, more)]
        near = lambda d, t: d & masks[t] == 0

    def met(differ: np.ndarray, at: int) -> np.ndarray:
        differ = differ.view(np.uint64)
        out = near(differ, at)
        for t in range(at):
            out &= ~near(differ, t)
        return out

    return met


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosine(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = matrix(a), matrix(b)
    return np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of df: id_col, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and their cosine, in double precision, reaches threshold.
    n_links counts the other rows linked directly, component_id is the smallest id reachable, kept marks it.
    Vectors that are null, empty, zero or not finite, or of another size than the most frequent one, and those without a
    label, are components of their own. Rows are rows, whatever their id: ids may repeat or be null (a null id is no
    smallest id if there is another, and a row is kept if its id is the component's). Equal vectors of a label are one
    class: they link with each other and share the links of their class, and only one of them is compared. Other columns
    are not read. An empty table gives no rows.
    """
    base = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    base = base.withColumn("part", F.col("label").isNotNull() & sound(F.col("v")))
    rows = base.where("part")
    size, total = usual_size(rows), rows.count()
    if not total:
        return base.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where(F.size("v") == size)
    sample = sample_matrix(rows, SAMPLE, total, "quantise")
    coder = Quantiser(sample)

    def encode(batches):
        import hashlib

        for batch in batches:
            x = matrix(batch.column(2))
            same = [hashlib.md5(r.tobytes()).digest() for r in x + 0.0]  # -0.0 and 0.0 are one number
            codes = coder.codes(x) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(same, pa.binary()), pa.array(codes, pa.int64())], names=["id", "label", "v", "same", "code"])

    label_type = dict(rows.dtypes)["label"]
    coded = stored(rows.select("id", "label", "v").mapInArrow(encode, f"id long, label {label_type}, v array<double>, same binary, code long"), "codes")
    own = coded.groupBy("label", "same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("code").alias("code"), F.first("v").alias("v"))
    classes = stored(own.withColumn("cls", F.monotonically_increasing_id()), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    plan = layout(apart(coder, sample, threshold), most)
    kept, asked, first = tables_of(classes, *plan)

    # entries with many vectors are compared in blocks, which give counts and a spanning forest instead of pairs
    entry = ["label", "table", "bits"]
    heavy = stored(kept.groupBy(*entry).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HEAVY).select(*entry, F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "heavy")
    # hints, since the planner takes the rows before the flips for small enough to broadcast
    pairs = asked.hint("merge").join(kept, entry).where((F.col("a") < F.col("b")) & first)
    dense = []
    if heavy.limit(1).count():
        pairs = asked.hint("merge").join(heavy.hint("merge"), entry, "left_anti").join(kept, entry).where((F.col("a") < F.col("b")) & first)
        vectors = classes.select("cls", "n", "v")
        requests = asked.hint("merge").join(heavy.select(*entry), entry).groupBy(*entry).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("shares"))
        heavy = stored(heavy.join(requests, entry), "requests")
        held = kept.join(heavy.hint("merge"), entry).join(vectors.withColumnRenamed("cls", "b").hint("merge"), "b").withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
        asking = asked.join(heavy.hint("merge"), entry).join(vectors.withColumnRenamed("cls", "a").hint("merge"), "a").withColumn("own", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int"))
        dealt = asking.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        held = held.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        met = first_meeting(*plan)

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            found = {"a": [], "b": [], "links": []}
            if left.num_rows and right.num_rows:
                b, n_b, code_b, y = right["b"].to_numpy(), right["n"].to_numpy(), right["code_b"].to_numpy(), unit(matrix(right["v"]))
                table = left["table"][0].as_py()
                for lo, hi in slices(left.num_rows, BLOCK):
                    part = left.slice(lo, hi - lo)
                    a, n_a, code_a, x = part["a"].to_numpy(), part["n"].to_numpy(), part["code_a"].to_numpy(), unit(matrix(part["v"]))
                    i, j = np.nonzero((x @ y.T >= threshold - 1e-9) & (a[:, None] < b) & met(code_a[:, None] ^ code_b, table))
                    good = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
                    i, j = i[good], j[good]
                    for names, n in ((a, np.bincount(i, n_b[j], len(a))), (b, np.bincount(j, n_a[i], len(b)))):
                        some = np.flatnonzero(n)
                        found["a"] += names[some].tolist()
                        found["b"] += [None] * len(some)
                        found["links"] += n[some].astype(int).tolist()
                    for k in forest(i, j + len(a)):
                        found["a"].append(int(a[i[k]]))
                        found["b"].append(int(b[j[k]]))
                        found["links"].append(0)
            return pa.table({c: pa.array(x, pa.int64()) for c, x in found.items()})

        key = [*entry, "own", "block"]
        other = [f"{c}_" for c in key]
        dense = [dealt.select(*key, "a", "code_a", "n", "v").groupBy(*key).cogroup(held.select(*key, "b", "code_b", "n", "v").toDF(*other, "b", "code_b", "n", "v").groupBy(*other)).applyInArrow(compare, "a long, b long, links long")]

    def rerank(batches):
        for batch in batches:
            if batch.num_rows:
                batch = batch.filter(pa.array(cosine(batch.column(4), batch.column(5)) >= threshold))
            n = batch.num_rows
            a, b, none = batch.column(0), batch.column(1), pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, a, b]), pa.concat_arrays([b, none, none]), pa.concat_arrays([pa.array(np.zeros(n, np.int64)), batch.column(3), batch.column(2)])], names=["a", "b", "links"])

    side = lambda c, v, n: classes.select(F.col("cls").alias(c), F.col("v").alias(v), F.col("n").alias(n)).hint("merge")
    both = pairs.select("a", "b").join(side("a", "x", "n_a"), "a").join(side("b", "y", "n_b"), "b")
    links = both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(rerank, "a long, b long, links long")
    links = stored(reduce(DataFrame.union, dense, links), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("others"))
    groups = components(links.where("b is not null").select("a", "b")).toDF("cls", "group")
    found = classes.select("cls", "label", "same", "rep", "n").join(counts, "cls", "left").join(groups, "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    names = found.groupBy("group").agg(F.min("rep").alias("component_id"))
    found = found.join(names, "group").select("label", "same", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    members = coded.select("id", "label", "same").join(found, ["label", "same"]).select("id", "n_links", "component_id")
    alone = base.where(~F.col("part") | (F.size("v") != size)).select("id", F.lit(0).cast("long"), F.col("id"))
    return members.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of embeddings; near_vectors() tells what odd rows give."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
