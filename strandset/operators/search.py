"""Search: membership, complexity and rank filters, and the way back from k-mers to places in genomes."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandset.functions import codec
from strandset.meta import KmerMeta, KmerSet, SetTable
from strandset.operators import members
from strandset.operators.count import chunks, kmers
from strandset.operators.taxonomy import Taxonomy


def queries_from_text(df: DataFrame, k: int, col: str = "query", canonical: bool = True, degenerate: bool = False) -> DataFrame:
    """(code) of the query k-mers of a text column, degenerate bases expanded if asked for."""
    text = F.upper(F.trim(col))
    rows = df.where(F.length(F.trim(col)) > 0).select(F.when(F.length(text) == k, text).otherwise(F.raise_error(F.concat(F.lit(f"query is not of length {k}: "), text))).alias("q"))
    if degenerate:
        rows = rows.select(F.explode(codec.expand_degenerate(F.col("q"), k)).alias("q"))
    rows = rows.select(F.translate("q", "U", "T").alias("q"))
    return rows.select(codec.encode(codec.canonical_text(F.col("q")) if canonical else F.col("q")).alias("code")).distinct()


def queries_from_set(s: KmerSet, wanted: KmerMeta | None = None) -> DataFrame:
    """(code [, taxid]) of a k-mer set as queries; with the meta of what is searched, its kind is checked, and plain codes are made canonical."""
    if wanted is not None and (s.meta.k != wanted.k or s.meta.hashed != wanted.hashed):
        raise ValueError("queries and k-mers differ in k or hashing")
    code = F.col("code") if s.meta.canonical or s.meta.hashed else codec.canonical(F.col("code"), s.meta.k)
    return s.df.withColumn("code", code).select("code", *["taxid"] * s.has_taxid).distinct()


def grep_table(table: SetTable, queries: DataFrame, invert: bool = False, taxid: bool = False, mode: str = "plain") -> SetTable:
    """grep() of every set of a table for itself; what is left keeps its set_id, so that write_sets() gives an output for each input.

    unique and repeated count within a set.
    """
    df = table.df
    if not taxid and not table.meta.canonical and not table.meta.hashed:
        df = df.withColumn("code", codec.canonical(F.col("code"), table.meta.k))
    key = "taxid" if taxid else "code"
    out = df.join(queries.select(key).distinct(), key, "left_anti" if invert else "left_semi").select(*df.columns)
    if mode != "plain":
        out = out.groupBy("set_id", "code").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in out.columns if c not in ("set_id", "code")])
        out = (out if mode == "unique" else out.where("n > 1")).drop("n")
    return SetTable(out, replace(table.meta, canonical=True, sorted=False))


def grep(s: KmerSet, queries: DataFrame, invert: bool = False, taxid: bool = False, mode: str = "plain", sort: bool = False) -> KmerSet:
    """Rows whose code (or taxid) is among the queries, or not with invert.

    K-mers that are neither canonical nor hashed are made canonical first, and the canonical code is returned. unique keeps one row
    of each code with the smallest taxid, repeated those codes that more than one row has.
    """
    df = s.df
    if not taxid and not s.meta.canonical and not s.meta.hashed:
        df = df.withColumn("code", codec.canonical(F.col("code"), s.meta.k))
    key = "taxid" if taxid else "code"
    out = df.join(queries.select(key).distinct(), key, "left_anti" if invert else "left_semi").select(*df.columns)
    if mode != "plain":
        out = out.groupBy("code").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in out.columns if c != "code"])
        out = (out if mode == "unique" else out.where("n > 1")).drop("n")
    if sort:
        out = out.orderBy(codec.unsigned_key(F.col("code")))
    return s.with_df(out, canonical=True, sorted=sort)


def filter_complexity(s: KmerSet, invert: bool = False, **how) -> KmerSet:
    """Drops k-mers of low complexity; invert keeps only those."""
    if s.meta.hashed:
        raise ValueError("hashed k-mers have no bases")
    low = codec.low_complexity(F.col("code"), s.meta.k, **how)
    return s.with_df(s.df.where(low if invert else ~low))


def filter_rank(s: KmerSet, taxonomy: Taxonomy, **how) -> KmerSet:
    """Keeps rows whose taxid passes the rank filter; see Taxonomy.passing."""
    if not s.has_taxid:
        raise ValueError("the k-mer set has no taxids")
    renamed = taxonomy.renamed(s.df)
    return s.with_df(renamed.join(taxonomy.passing(**how), "taxid", "left_semi").select(*s.df.columns))


def locate(s: KmerSet, genomes: DataFrame, id_col: str = "id", seq_col: str = "seq", circular: bool = False) -> DataFrame:
    """BED6 of every place of every k-mer of a canonical set; name is the forward strand's text. end may pass a circular genome's end.

    The tasks know the sets of short k-mers; places of longer ones are joined with theirs.
    """
    if not s.meta.canonical:
        raise ValueError("locating needs canonical k-mers")
    k = s.meta.k
    known = members.of_codes(s.df, k) if members.short(k, s.meta.hashed) else None
    if known is not None:
        hits = _known_places(genomes, k, seq_col, id_col, known, circular)
    else:
        places = kmers(genomes, k, seq_col, keep=(id_col,), canonical=True, hashed=s.meta.hashed, circular=circular, strands=k <= 32)
        hits = places.join(s.df.select("code").distinct(), "code", "left_semi")
    text = codec.decode(F.col("fwd"), k) if k <= 32 else codec.unsigned_text(F.col("code"))
    return hits.select(F.col(id_col).cast("string").alias("chrom"), F.col("pos").alias("start"), (F.col("pos") + k).alias("end"), text.alias("name"), F.lit("0").alias("score"), F.lit(".").alias("strand"))


def _known_places(genomes: DataFrame, k: int, seq_col: str, id_col: str, known: members.Known, circular: bool) -> DataFrame:
    """(id, pos, fwd) of the k-mers that are known."""
    sent = genomes.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            for c in chunks(batch, 1, k, circular):
                fwd, code = c.codes(True)
                at = np.flatnonzero(sent.value.has(code))
                ids = batch.column(0).take(pa.array(c.owner[at] + c.at))
                whole = pa.RecordBatch.from_arrays([ids, pa.array(c.pos()[at]), pa.array(fwd[at].view(np.int64))], names=[id_col, "pos", "fwd"])
                for a in range(0, whole.num_rows, 200_000):
                    yield whole.slice(a, 200_000)

    schema = genomes.select(id_col).withColumns({"pos": F.lit(0).cast("long"), "fwd": F.lit(0).cast("long")}).schema
    return genomes.select(id_col, F.col(seq_col).alias("__seq")).mapInArrow(run, schema)


def _again(owner: np.ndarray, code: np.ndarray, counted: np.ndarray | slice, bits: int) -> np.ndarray:
    """Whether the code of a place stands at two of its sequence's counted places."""
    key = owner.astype(np.uint64) << np.uint64(bits) | code
    inside = np.sort(key[counted])
    many = np.unique(inside[1:][inside[1:] == inside[:-1]])
    if not len(many):
        return np.zeros(len(key), bool)
    return many[np.minimum(np.searchsorted(many, key), len(many) - 1)] == key


def _joined(owner: np.ndarray, pos: np.ndarray, hit: np.ndarray, wall: np.ndarray, k: int, gap: int, gaps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, end) of the regions of hits; walls end a region."""
    at = np.flatnonzero(hit & ~wall)
    if not len(at):
        return at, at, at
    o, p, w = owner[at], pos[at], np.cumsum(wall)[at]
    apart = np.concatenate(([True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])))
    behind = np.concatenate(([0], p[1:] - p[:-1] - 1))
    run = np.flatnonzero(apart | (behind > 0))
    run_end = np.append(run[1:], len(at)) - 1
    chain = (apart | (behind > (gap if gaps else 0)))[run]
    number = np.arange(len(run))
    part = np.flatnonzero((number - np.maximum.accumulate(np.where(chain, number, 0))) % (gaps + 1) == 0)
    return o[run[part]], p[run[part]], p[run_end[np.append(part[1:], len(run)) - 1]] + k


def _known_regions(genomes: DataFrame, k: int, known: members.Known, many: members.Known | None, multi: str, min_len: int, gap: int, gaps: int, circular: bool, unit: bool, fasta: bool) -> DataFrame:
    """(chrom, start, end [, text]) of genomes (chrom [, unit], seq), sequence by sequence; ids must differ."""
    context = genomes.sparkSession.sparkContext
    sent, walls = context.broadcast(known), context.broadcast(many)
    names = ["chrom", "start", "end", *["text"] * fasta]

    def run(batches):
        for batch in batches:
            row = np.array([walls.value.row(x) for x in batch.column(1).to_pylist()], np.int64) if unit else np.zeros(batch.num_rows, np.int64)
            for c in chunks(batch, 1 + unit, k, twice=circular):
                code, pos = c.codes(True)[1], c.pos()
                n = np.array(list(map(len, c.raw)), np.int64)
                if multi == "drop":
                    wall = _again(c.owner, code, pos < n[c.owner] if circular else slice(None), 2 * k)
                else:
                    wall = np.zeros(len(code), bool) if multi == "keep" else walls.value.has(code, row[c.owner + c.at])
                of, start, end = _joined(c.owner, pos, sent.value.has(code), wall, k, gap, gaps)
                if circular:
                    end = np.minimum(end, start + n[of])
                keep = np.flatnonzero((end - start >= min_len) & (start < n[of]))
                of, start, end = of[keep], start[keep], end[keep]
                arrays = [batch.column(0).take(pa.array(of + c.at)), pa.array(start), pa.array(end)]
                if fasta:
                    walk = [s + s for s in c.raw] if circular else c.raw
                    arrays.append(pa.array([walk[i][a:b].decode("utf-8", "replace") for i, a, b in zip(of.tolist(), start.tolist(), end.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = genomes.select("chrom").withColumns({c: F.lit(0).cast("long") for c in ("start", "end")} | ({"text": F.lit("")} if fasta else {})).schema
    return genomes.select("chrom", *["unit"] * unit, "seq").mapInArrow(run, schema)


def map_regions(s: KmerSet, genomes: DataFrame, min_len: int = 200, multi: str = "drop", gap: int = 0, gaps: int = 0, id_col: str = "id", seq_col: str = "seq", circular: bool = False, unit: str | None = None, fasta: bool = False) -> DataFrame:
    """BED3 of the maximal regions that consecutive k-mers of a canonical set cover.

    A k-mer that occurs twice in its unit (the sequence, or with multi="whole" the value of unit, or all genomes) is no
    hit and ends a region; multi="keep" treats it as any other. A region may bridge up to gaps stretches of up to gap
    missing k-mers. Circular genomes are read twice over; a region starts in the first copy and is a sequence long at most.
    fasta adds name and seq in lines of 60.

    Where k-mers are short and ids differ, the tasks know the set (and which k-mers occur twice in their unit), and each sequence is
    mapped where it is. Otherwise places are joined with the set and ordered.
    """
    if not s.meta.canonical:
        raise ValueError("mapping needs canonical k-mers")
    if multi not in ("drop", "keep", "whole"):
        raise ValueError(f"unknown treatment of multi-mapped k-mers {multi}")
    if gap > 0 and gaps < 1:
        raise ValueError("gap needs gaps")
    k = s.meta.k
    if circular and min_len < k:
        raise ValueError("circular regions have at least k bases")
    size = F.length(seq_col)
    units = [F.col(unit).alias("unit")] if unit else []
    ids = genomes.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    differ = not ids.where("n > 1 or id is null").limit(1).count()
    genomes = genomes.where(size >= k).select(F.col(id_col).alias("chrom"), F.col(seq_col).alias("seq"), *units)
    name = F.concat(F.lit(">"), F.col("chrom").cast("string"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string")).alias("name")
    lines = lambda text: F.regexp_replace(text, "(.{60})(?=.)", "$1\n").alias("seq")
    if members.short(k, s.meta.hashed) and differ:
        known = members.of_codes(s.df, k)
        many = members.repeated(genomes, k, "seq", "unit" if unit else None, circular) if multi == "whole" else None
        if known is not None and (many is not None or multi != "whole"):
            found = _known_regions(genomes, k, known, many, multi, min_len, gap, gaps, circular, bool(unit) and multi == "whole", fasta)
            return found.select(name, lines(F.col("text"))) if fasta else found.select(F.col("chrom").cast("string").alias("chrom"), "start", "end")
    # a circular sequence is read as 2n - k + 1 k-mers of itself written twice
    walked = genomes.withColumn("n", F.length("seq")).withColumn("walk", F.concat("seq", "seq") if circular else F.col("seq"))
    keep = ("chrom", *["unit"] * bool(unit), *["n"] * circular)
    places = kmers(walked, k, "walk", keep=keep, canonical=True, hashed=s.meta.hashed)
    member = s.df.select("code").distinct().withColumn("member", F.lit(True))
    if multi == "keep":
        hits = places.join(member, "code", "left_semi").withColumn("multi", F.lit(0))
    else:
        by = ["code"] if multi == "whole" and not unit else ["unit", "code"] if multi == "whole" else ["chrom", "code"]
        once = places.where("pos < n") if circular else places
        many = once.groupBy(*by).agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times").withColumn("multi", F.lit(1))
        marked = places.join(member, "code", "left").join(many, by, "left")
        # of the misses only the multi-mapped ones matter, as they end regions
        hits = marked.where("member or multi = 1").withColumn("multi", F.coalesce("multi", F.lit(0)))
    order = Window.partitionBy("chrom").orderBy("pos")
    hits = hits.withColumn("walls", F.sum("multi").over(order)).where("multi = 0")
    behind = F.col("pos") - F.lag("pos").over(order) - 1
    new_run = F.coalesce((behind > 0) | (F.lag("walls").over(order) != F.col("walls")), F.lit(True))
    new_chain = F.coalesce((behind > (gap if gaps else 0)) | (F.lag("walls").over(order) != F.col("walls")), F.lit(True))
    runs = hits.withColumn("new_run", new_run.cast("int")).withColumn("new_chain", new_chain.cast("int"))
    runs = runs.withColumn("run", F.sum("new_run").over(order)).withColumn("chain", F.sum("new_chain").over(order))
    some = ["n"] * circular
    runs = runs.groupBy("chrom", "chain", "run", *some).agg(F.min("pos").alias("start"), F.max("pos").alias("last"))
    part = F.floor((F.row_number().over(Window.partitionBy("chrom", "chain").orderBy("run")) - 1) / (gaps + 1))
    regions = runs.withColumn("part", part).groupBy("chrom", "chain", "part", *some).agg(F.min("start").alias("start"), (F.max("last") + k).alias("end"))
    if circular:
        regions = regions.where("start < n").withColumn("end", F.least("end", F.col("start") + F.col("n")))
    regions = regions.where(F.col("end") - F.col("start") >= min_len).select("chrom", "start", "end")
    if not fasta:
        return regions.select(F.col("chrom").cast("string").alias("chrom"), "start", "end")
    whole = regions.join(genomes.select("chrom", F.concat("seq", "seq").alias("walk") if circular else F.col("seq").alias("walk")), "chrom")
    text = F.expr("substring(walk, cast(start + 1 as int), cast(end - start as int))")
    return whole.select(name, lines(text))
