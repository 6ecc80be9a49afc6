"""Set algebra: concatenation, union, intersection, k-of-n and difference, with or without taxids."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandset.meta import KmerSet, SetTable, check_compatible
from strandset.operators.taxonomy import Taxonomy


#: More sets than these are told apart by their names, which then do not reach the driver.
MOST_SETS = 65_535


def stacked(sets: list[KmerSet], taxid: bool) -> DataFrame:
    """All rows with source, the number of their set."""
    columns = ["code"] + ["taxid"] * taxid
    rows = [(s.df if not taxid or "taxid" in s.df.columns else s.df.withColumn("taxid", F.lit(None).cast("long"))).select(*columns, F.lit(i).alias("source")) for i, s in enumerate(sets)]
    return reduce(DataFrame.unionByName, rows)


def concat(sets: list[KmerSet], global_taxid: int | None = None) -> KmerSet:
    """All rows of all sets, repeats included; a global taxid replaces theirs."""
    meta = check_compatible(sets, mix_taxid=global_taxid is not None)
    out = stacked(sets, taxid=global_taxid is None and sets[0].has_taxid).drop("source")
    if global_taxid is not None:
        out = out.withColumn("taxid", F.lit(global_taxid).cast("long"))
    return KmerSet(out, meta)


def common(sets: list[KmerSet], at_least: int | None = None, proportion: float = 1.0, taxonomy: Taxonomy | None = None, mix_taxid: bool = False) -> KmerSet:
    """K-mers in at least so many of the sets (or trunc(proportion * sets), 1 at least), each once, by one aggregate."""
    meta = check_compatible(sets, mix_taxid)
    if at_least is None:
        if not 0 < proportion <= 1:
            raise ValueError("proportion must be above 0 and at most 1")
        at_least = max(1, int(len(sets) * proportion))
    taxed = taxonomy is not None and any(s.has_taxid for s in sets)
    if at_least <= 1 and not taxed:
        return KmerSet(stacked(sets, False).select("code").distinct(), meta)
    return KmerSet(_in_many(stacked(sets, taxed), len(sets), at_least, taxonomy if taxed else None), meta)


#: Up to so many sets, which of them hold a k-mer is told by bits, 64 a column, in one aggregate.
BIT_SETS = 512


def _bits(total: int) -> list[Column]:
    """For each 64 of the sets, the bits of those among them that hold the k-mer."""
    bit = lambda k: F.when(F.col("source").between(64 * k, 64 * k + 63), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("source") - 64 * k).cast("int"))).otherwise(F.lit(0).cast("long"))
    return [F.bit_or(bit(k)).alias(f"bits{k}") for k in range(-(-total // 64))]


def _in_many(rows: DataFrame, total: int, at_least: int, taxonomy: Taxonomy | None) -> DataFrame:
    """(code [, taxid]) of the codes that at least so many sources (0 to total - 1) have."""
    few = total <= min(BIT_SETS, MOST_SETS)
    if few:
        have = _bits(total) if at_least > 1 else []
        enough = reduce(lambda a, b: a + b, [F.bit_count(f"bits{k}") for k in range(len(have))], F.lit(0)) >= (at_least if have else 0)
    else:
        have, enough = [F.count_distinct("source").alias("n")], F.col("n") >= at_least
    if taxonomy is None:
        if few:
            return (rows.groupBy("code").agg(*have) if have else rows.select("code").distinct()).where(enough).select("code")
        return rows.select("code", "source").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n")).where(enough).select("code")
    bounds = taxonomy.bounded(rows).groupBy("code").agg(F.min("tin").alias("lo"), F.max("tin").alias("hi"), *have).where(enough)
    return taxonomy.resolved(bounds.select("code", "lo", "hi"))


def common_of(table: SetTable, at_least: int | None = None, proportion: float = 1.0, taxonomy: Taxonomy | None = None, sets: list[str] | None = None) -> KmerSet:
    """common() of all sets of a table, however many, by one aggregate. sets names them, if some may be empty; else the table is asked."""
    table, total = _numbered_sets(table, sets)
    if at_least is None:
        if not 0 < proportion <= 1:
            raise ValueError("proportion must be above 0 and at most 1")
        at_least = max(1, int(total * proportion))
    taxed = taxonomy if taxonomy is not None and table.has_taxid else None
    return KmerSet(_in_many(table.df, total, at_least, taxed), replace(table.meta, sorted=False, global_taxid=None))


def union_of(table: SetTable, taxonomy: Taxonomy | None = None) -> KmerSet:
    return common_of(table, 1, taxonomy=taxonomy)


def inter_of(table: SetTable, taxonomy: Taxonomy | None = None, sets: list[str] | None = None) -> KmerSet:
    return common_of(table, proportion=1.0, taxonomy=taxonomy, sets=sets)


def diff_of(table: SetTable, first: str) -> KmerSet:
    """K-mers of the set first that no other set of the table has, each once, by one aggregate; taxids are left out."""
    own = F.col("set_id").eqNullSafe(F.lit(first))
    found = table.df.groupBy("code").agg(F.bool_and(own).alias("alone")).where("alone").select("code")
    return KmerSet(found, replace(table.meta, sorted=False, global_taxid=None))


def _numbered_sets(table: SetTable, sets: list[str] | None) -> tuple[SetTable, int]:
    """The table with source, the number of each set (its name where there are more than MOST_SETS), and how many sets there are."""
    table_of = table.df.withColumn("set_id", F.col("set_id").cast("string"))
    names = sets if sets is not None else [x["set_id"] for x in table_of.select("set_id").distinct().limit(MOST_SETS + 1).collect()]
    spark = table.df.sparkSession
    if len(names) > MOST_SETS:
        total = len(set(names)) if sets is not None else table_of.select("set_id").distinct().count()
        if sets is not None:
            asked = spark.createDataFrame([(n,) for n in names], "name string")
            table_of = table_of.join(asked, F.col("set_id").eqNullSafe(F.col("name")), "left_semi")
        # a null name is a set as well
        named = F.coalesce(F.concat(F.lit("="), "set_id"), F.lit(""))
        return SetTable(table_of.withColumn("source", named).drop("set_id"), table.meta), total
    numbers = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "set_id string, source int")
    rows = table_of.join(F.broadcast(numbers), table_of["set_id"].eqNullSafe(numbers["set_id"])).drop("set_id")
    return SetTable(rows, table.meta), len(names)


def union(sets: list[KmerSet], taxonomy: Taxonomy | None = None) -> KmerSet:
    return common(sets, 1, taxonomy=taxonomy)


def inter(sets: list[KmerSet], taxonomy: Taxonomy | None = None, mix_taxid: bool = False) -> KmerSet:
    return common(sets, len(sets), taxonomy=taxonomy, mix_taxid=mix_taxid)


def diff(first: KmerSet, rest: list[KmerSet], taxonomy: Taxonomy | None = None) -> KmerSet:
    """K-mers of the first set that no other has, each once.

    Without a taxonomy a k-mer of several taxids keeps the smallest. With a taxonomy, and taxids in all sets, another set's k-mer takes one away only if its taxid is neither equal
    nor below the first set's taxid for it. Without taxids the taxonomy is ignored.
    """
    meta = check_compatible([first, *rest], mix_taxid=taxonomy is None)
    taxed = taxonomy is not None and first.has_taxid and all(s.has_taxid for s in rest)
    own = (taxonomy.lca(first.df, ["code"]) if taxonomy is not None and first.has_taxid else first.df.groupBy("code").agg(F.min("taxid").alias("taxid"))) if first.has_taxid else first.df.select("code").distinct()
    own = own.select("code", *["taxid"] * first.has_taxid)
    if not rest:
        return KmerSet(own, meta)
    if not taxed:
        return KmerSet(own.join(stacked(rest, False).select("code"), "code", "left_anti"), meta)
    gone = stacked(rest, True).select("code", F.col("taxid").alias("target")).distinct().join(own.select("code", "taxid"), "code")
    gone = gone.join(taxonomy.ancestors().select(F.col("taxid").alias("target"), F.col("ancestor").alias("taxid")), ["target", "taxid"], "left_anti").select("code")
    return KmerSet(own.join(gone, "code", "left_anti"), meta)
