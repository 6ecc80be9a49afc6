"""Views and writers: text, FASTA, FASTQ and BED of k-mer sets, and reports on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandset.functions import codec
from strandset.meta import KmerSet, SetTable
from strandset.operators.count import kmers


def view(s: KmerSet, style: str = "kmer", genomes: DataFrame | None = None, seq_col: str = "seq", id_cols: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per row of the set. style: kmer, kmer_code, code, kmer_taxid, taxid, fasta or fastq.

    Hashed k-mers show their number, or with genomes the text at the hash's first place (by id_cols, then position).
    """
    k = s.meta.k
    if not s.meta.hashed:
        df = s.df.withColumn("kmer", codec.decode(F.col("code"), k))
    elif genomes is None:
        df = s.df.withColumn("kmer", codec.unsigned_text(F.col("code")))
    else:
        if not s.meta.canonical:
            raise ValueError("genomes tell only canonical hashes")
        # a scaled set's hashes are small ones, so that only small ones of the genomes leave Python
        wanted = kmers(genomes, k, seq_col, keep=id_cols, hashed=True, circular=True, scale=s.meta.within, strands=k <= 32)
        wanted = wanted if s.meta.within > 1 else wanted.join(s.df.select("code").distinct(), "code", "left_semi")
        first = wanted.groupBy("code").agg(F.min(F.struct(*id_cols, "pos", *["fwd"] * (k <= 32))).alias("at"))
        if k <= 32:
            texts = first.select("code", codec.decode(F.col("at.fwd"), k).alias("kmer"))
        else:
            doubled = F.concat(F.col(seq_col), F.substring(F.col(seq_col), 1, k - 1))
            texts = first.select("code", *[F.col(f"at.{c}").alias(c) for c in id_cols], F.col("at.pos").alias("pos")).join(genomes.select(*id_cols, doubled.alias("walk")), list(id_cols))
            texts = texts.select("code", F.upper(F.expr(f"substring(walk, cast(pos + 1 as int), {k})")).alias("kmer"))
        df = s.df.join(texts, "code", "left").withColumn("kmer", F.coalesce("kmer", codec.unsigned_text(F.col("code"))))
    number = codec.unsigned_text(F.col("code"))
    lines = {
        "kmer": [F.col("kmer")],
        "kmer_code": [F.col("kmer"), number.alias("code")],
        "code": [number.alias("code")],
        "kmer_taxid": [F.col("kmer"), F.col("taxid")] if s.has_taxid else [],
        "taxid": [F.col("taxid")] if s.has_taxid else [],
        "fasta": [F.concat(F.lit(">"), number, F.lit("\n"), F.col("kmer")).alias("record")],
        "fastq": [F.concat(F.lit("@"), number, F.lit("\n"), F.col("kmer"), F.lit("\n+\n"), F.repeat(F.lit("g"), F.length("kmer"))).alias("record")],
    }
    if style not in lines or not lines[style]:
        raise ValueError(f"no view {style} of this set")
    return df.select(*lines[style])


def write_text(df: DataFrame, path: str, mode: str = "error") -> None:
    """Rows as tab-separated text (BED, TSV), a single column as it is (FASTA, FASTQ)."""
    df.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in df.columns])).write.mode(mode).text(path)


def num(df: DataFrame, *set_cols: str) -> DataFrame:
    """Exact numbers of k-mers, for each set."""
    return df.groupBy(*set_cols).agg(F.count(F.lit(1)).alias("number"))


def info(sets: dict[str, KmerSet] | SetTable, number: bool = True, basename: bool = False, symbols: tuple[str, str] | None = None, skip_errors: bool = False) -> DataFrame:
    """A row for each set with what is known of it, in the order given, those of a table by name.

    Numbers come from one aggregate over all sets. basename cuts folders off the names, symbols replace true and false;
    skip_errors leaves out sets that cannot be read instead of raising.
    """
    if isinstance(sets, SetTable):
        m = sets.meta
        taxid = (F.when(F.min("taxid") == F.max("taxid"), F.min("taxid")) if sets.has_taxid else F.max(F.lit(None))).cast("long").alias("global_taxid")
        out = sets.df.groupBy(F.col("set_id").cast("string").alias("file")).agg(F.count(F.lit(1)).alias("number"), taxid)
        known = {"k": m.k, "canonical": m.canonical, "hashed": m.hashed, "include_taxid": sets.has_taxid, "sorted": m.sorted, "description": m.description}
        out = out.withColumns({c: F.lit(v) for c, v in known.items()} | {"scaled": F.lit(m.scale).cast("long")})
        out = out.select("file", "k", "canonical", "hashed", "scaled", "include_taxid", "global_taxid", "sorted", "description", *["number"] * number).orderBy("file")
    else:
        readable = {}
        for name, s in sets.items():
            try:
                s.df.schema
            except Exception:  # noqa: BLE001
                if not skip_errors:
                    raise
            else:
                readable[name] = s
        if not readable:
            raise ValueError("no k-mer sets that can be read")
        spark = next(iter(readable.values())).df.sparkSession
        rows = [(i, name, s.meta.k, s.meta.canonical, s.meta.hashed, s.meta.scale, s.has_taxid, s.meta.global_taxid, s.meta.sorted, s.meta.description) for i, (name, s) in enumerate(readable.items())]
        out = spark.createDataFrame(rows, "at int, file string, k int, canonical boolean, hashed boolean, scaled long, include_taxid boolean, global_taxid long, sorted boolean, description string")
        if number:
            marked = reduce(DataFrame.union, [s.df.select(F.lit(i).alias("at")) for i, s in enumerate(readable.values())])
            counts = marked.groupBy("at").agg(F.count(F.lit(1)).alias("number"))
            out = out.join(counts, "at", "left").withColumn("number", F.coalesce("number", F.lit(0).cast("long")))
        out = out.orderBy("at").drop("at")
    if basename:
        out = out.withColumn("file", F.regexp_extract("file", "([^/]*)/*$", 1))
    if symbols:
        yes, no = symbols
        out = out.withColumns({c: F.when(F.col(c), F.lit(yes)).otherwise(F.lit(no)) for c in ("canonical", "hashed", "include_taxid", "sorted")})
    return out
