"""Readers: FASTA, FASTQ, k-mer text, hashes, taxonomy dumps, and stored k-mer sets."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions import codec
from strandset.functions import sequence as S
from strandset.meta import KmerMeta, KmerSet, SetTable, check_metas

def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer files than there are cores, dealt to all of them: a file may be one piece, and sequences grow to many k-mers."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


RECORD = "file string, rec_no long, id string, name string, seq string, qual string"


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, name, seq) of FASTA files; large uncompressed ones are split between tasks. gzip, bzip2 and zstd as Hadoop reads them."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", "^>|\r", "").alias("v"))
    rows = rows.where(F.length(F.trim("v")) > 0)
    name = F.substring_index("v", "\n", 1)
    seq = F.regexp_replace(F.expr("substring(v, length(substring_index(v, '\n', 1)) + 2)"), "\\s", "")
    return rows.select("file", F.regexp_extract(name, r"^\s*(\S*)", 1).alias("id"), name.alias("name"), seq.alias("seq"))


def _open(name: str, data: bytes) -> bytes:
    if name.endswith(".gz"):
        import gzip

        return gzip.decompress(data)
    if name.endswith(".xz"):
        import lzma

        return lzma.decompress(data)
    if name.endswith(".bz2"):
        import bz2

        return bz2.decompress(data)
    if name.endswith(".zst"):
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def read_fastx(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """RECORD rows of FASTA or FASTQ files, plain or in gzip, xz, bzip2 or zstd; a file is one task's work."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out, lines, i = [], _open(name, data).decode("utf-8", "replace").splitlines(), 0
                while i < len(lines):
                    if not lines[i].strip():
                        i += 1
                    elif lines[i][0] == "@":
                        head, seq, qual = lines[i][1:], [], []
                        i += 1
                        while i < len(lines) and not lines[i].startswith("+"):
                            seq.append(lines[i].strip())
                            i += 1
                        i += 1
                        need = sum(map(len, seq))
                        while i < len(lines) and need > 0:
                            qual.append(lines[i].strip())
                            need -= len(qual[-1])
                            i += 1
                        out.append((name, len(out), head, "".join(seq), "".join(qual)))
                    else:
                        head, seq = lines[i].lstrip(">"), []
                        i += 1
                        while i < len(lines) and not lines[i].startswith(">"):
                            seq.append(lines[i].strip())
                            i += 1
                        out.append((name, len(out), head, "".join(seq), None))
                cols = list(zip(*out)) or [()] * 5
                ids = [(h.split() or [""])[0] for h in cols[2]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(ids, pa.string()), *(pa.array(cols[c], pa.string()) for c in (2, 3, 4))], names=["file", "rec_no", "id", "name", "seq", "qual"])

    return reader.load(path).select("path", "content").mapInArrow(run, RECORD)


def read_fastq_stream(spark: SparkSession, path: str) -> DataFrame:
    """RECORD rows of FASTQ files in gzip or zstd, of any size: a task streams through a file, line by line.

    Sequence and quality take a line each. Other files could be cut inside a record and are an error; read_fastx() reads them.
    """

    def run(batches):
        file, held, number = None, [], 0
        for batch in batches:
            out = []
            for name, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != file:
                    if held:
                        raise ValueError(f"{file} ends inside a record")
                    if not name.endswith((".gz", ".zst")):
                        raise ValueError(f"{name} is neither gzip nor zstd")
                    file, number = name, 0
                line = line.rstrip("\r")
                if held or line:
                    held.append(line)
                if len(held) == 4:
                    head, seq, plus, qual = held
                    if head[:1] != "@" or plus[:1] != "+" or len(seq) != len(qual):
                        raise ValueError(f"record {number} of {file} is no FASTQ record")
                    out.append((file, number, (head[1:].split() or [""])[0], head[1:], seq, qual))
                    held, number = [], number + 1
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.string()) for c in cols[2:])], names=["file", "rec_no", "id", "name", "seq", "qual"])
        if held:
            raise ValueError(f"{file} ends inside a record")

    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(run, RECORD)


def read_kmers(spark: SparkSession, path: str, k: int, hashed: bool = False, to_canonical: bool = False, only_canonical: bool = False, unique: bool = False, global_taxid: int | None = None, hash_text: bool = False) -> KmerSet:
    """K-mer text (kmer or kmer<tab>taxid a line), or hash numbers; blank lines are skipped, another length is an error."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.split("value", "\t").alias("p"))
    taxid = F.try_element_at("p", F.lit(2)).cast("long")
    return dump(rows.select(F.trim(F.col("p")[0]).alias("kmer"), taxid.alias("taxid")), k, hashed, to_canonical, only_canonical, unique, global_taxid, hash_text)


def hash_texts(df: DataFrame, k: int, col: str = "kmer") -> DataFrame:
    """df with code, the canonical hash of the k-mer text; texts of another length or with other letters than A, C, G, T are an error."""
    schema, columns = df.withColumn("code", F.lit(0).cast("long")).schema, df.columns
    at = columns.index(col)

    def run(batches):
        for batch in batches:
            texts = [(t or "").encode("utf-8", "replace") for t in batch.column(at).to_pylist()]
            if any(len(t) != k for t in texts):
                raise ValueError(f"k-mer is not of length {k}: {next(t for t in texts if len(t) != k)!r}")
            base = S.bases(b"".join(texts))
            if (base > 3).any():
                raise ValueError("k-mer with a letter other than A, C, G, T")
            code = S.nthash(base, k)[::k] if texts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.view(np.int64))], names=[*columns, "code"])

    return df.mapInArrow(run, schema)


def dump(df: DataFrame, k: int, hashed: bool = False, to_canonical: bool = False, only_canonical: bool = False, unique: bool = False, global_taxid: int | None = None, hash_text: bool = False) -> KmerSet:
    """(kmer [, taxid]) as a k-mer set. A taxid of a row comes before the global one; unique keeps the smallest taxid of a k-mer.

    hashed tells that kmer holds numbers; hash_text hashes the texts, as for more than 32 bases always.
    """
    hash_text = hash_text or k > 32 and not hashed
    if hashed and hash_text:
        raise ValueError("what is hashed is no text to hash")
    if hash_text and (to_canonical or only_canonical):
        raise ValueError("hashes are canonical already")
    if hashed and only_canonical or to_canonical and only_canonical:
        raise ValueError("only_canonical goes with neither hashes nor to_canonical")
    if hashed:
        code = F.conv("kmer", 10, -10).cast("long")
    elif hash_text:
        df, code = hash_texts(df.withColumn("kmer", F.upper("kmer")), k), F.col("code")
    else:
        text = F.upper("kmer")
        text = F.when(F.length(text) == k, text).otherwise(F.raise_error(F.concat(F.lit(f"k-mer is not of length {k}: "), text)))
        df = df.withColumn("kmer", text)
        if only_canonical:
            df = df.where(F.col("kmer") <= codec.reverse_complement(F.col("kmer")))
        code = codec.encode(codec.canonical_text(F.col("kmer")) if to_canonical else F.col("kmer"))
    columns = [code.alias("code")]
    if "taxid" in df.columns or global_taxid is not None:
        own = F.col("taxid") if "taxid" in df.columns else F.lit(None).cast("long")
        columns.append(F.coalesce(own, F.lit(global_taxid).cast("long")).alias("taxid"))
    out = df.select(*columns)
    if unique:
        out = out.groupBy("code").agg(F.min("taxid").alias("taxid")) if len(columns) > 1 else out.distinct()
    return KmerSet(out, KmerMeta(k, hashed or hash_text or to_canonical or only_canonical, hashed or hash_text, global_taxid=global_taxid))


def read_taxdump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, merged) of nodes.dmp and, if there, merged.dmp."""
    fields = lambda name, n: spark.read.text(f"{folder}/{name}").select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f")).select(*[F.trim(F.col("f")[i]).alias(f"c{i}") for i in range(n)])
    nodes = fields("nodes.dmp", 3).select(F.col("c0").cast("long").alias("taxid"), F.col("c1").cast("long").alias("parent"), F.col("c2").alias("rank"))
    files = spark.read.format("binaryFile").load(folder).select("path").where("path like '%/merged.dmp'").limit(1).collect()
    if not files:
        return nodes, None
    return nodes, fields("merged.dmp", 2).select(F.col("c0").cast("long").alias("old_taxid"), F.col("c1").cast("long").alias("new_taxid"))


def write_set(s: KmerSet, path: str, mode: str = "error") -> None:
    """A k-mer set as Parquet sorted by code within its files, with its meta beside it."""
    s.df.sortWithinPartitions("code").write.mode(mode).option("compression", "zstd").parquet(f"{path}/rows")
    text = json.dumps({k: getattr(s.meta, k) for k in s.meta.__dataclass_fields__})
    s.df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/meta")


def write_sets(table: SetTable, path: str, mode: str = "error") -> None:
    """The sets of a table below one folder, as read_sets() reads them; a set with one taxid throughout has it as its global taxid."""
    rows, spark = table.df, table.df.sparkSession
    rows.sortWithinPartitions("set_id", "code").write.mode(mode).option("compression", "zstd").partitionBy("set_id").parquet(f"{path}/rows")
    about = rows.groupBy("set_id").agg(F.count(F.lit(1)).alias("number"), *([F.min("taxid").alias("least"), F.max("taxid").alias("most")] if table.has_taxid else []))
    one = F.when(F.col("least") == F.col("most"), F.col("least")) if table.has_taxid else F.lit(None).cast("long")
    kind = [F.lit(getattr(table.meta, f)).alias(f) for f in ("k", "canonical", "hashed", "scale", "sorted", "description")]
    about.select("set_id", "number", one.alias("global_taxid"), *kind).write.mode(mode).parquet(f"{path}/about")


def read_sets(spark: SparkSession, path: str, pattern: str | None = None) -> SetTable:
    """All sets below a folder, or those whose names match a regular expression, as one table; sets of different kinds are an error."""
    about = spark.read.parquet(f"{path}/about")
    rows = spark.read.parquet(f"{path}/rows").withColumn("set_id", F.col("set_id").cast("string"))
    if pattern is not None:
        about, rows = about.where(F.col("set_id").rlike(pattern)), rows.where(F.col("set_id").rlike(pattern))
    kinds = about.select("k", "canonical", "hashed", "scale").distinct().limit(1000).collect()
    meta = check_metas([KmerMeta(r["k"], r["canonical"], r["hashed"], r["scale"]) for r in kinds])
    return SetTable(rows.select("set_id", *[c for c in rows.columns if c != "set_id"]), meta)


def read_set(spark: SparkSession, path: str) -> KmerSet:
    return KmerSet(spark.read.parquet(f"{path}/rows"), KmerMeta(**json.loads(spark.read.text(f"{path}/meta").first()[0])))
