"""The registered queries over the supplied tables, each beside the DuckDB SQL that gives the same rows.

documents.text, its letters turned to A, C, G, T in turn, serves as sequences; lineitem.l_partkey as ready-made codes of 8 bases;
region, nation and supplier as a taxonomy of a root and three levels.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandset.functions import codec
from strandset.functions import sequence as S
from strandset.meta import KmerMeta, KmerSet, SetTable
from strandset.operators import ordering, search, setops
from strandset.operators.count import count, name_filter, parse_taxid, set_table
from strandset.operators.taxonomy import Taxonomy
from strandset.sources.readers import dump, hash_texts, spread
from strandset.sources.writers import info, num, view

QUERIES, ORACLE_SQL = {}, {}
K, K8 = 11, 8
LETTERS, CYCLE = string.ascii_letters, "ACGT" * 13


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


# -- inputs -------------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sequences(spark: SparkSession, d: str) -> DataFrame:
    seq = F.regexp_replace(F.translate("text", LETTERS, CYCLE), "[^ACGT]", "")
    return spread(read(spark, d, "documents").select("doc_id", "source", "lang", "text")).select("doc_id", "source", F.concat_ws(" ", "source", "lang").alias("name"), seq.alias("seq"))


def by_source(spark: SparkSession, d: str) -> SetTable:
    """Every source is a set."""
    return set_table(sequences(spark, d), K, "source", canonical=True)


def sources(spark: SparkSession, d: str) -> list[str]:
    return [r["source"] for r in read(spark, d, "documents").select("source").distinct().collect()]


def items(spark: SparkSession, d: str, flag: str | None = None, taxid: bool = True) -> KmerSet:
    rows = read(spark, d, "lineitem")
    rows = rows.where(F.col("l_returnflag") == flag) if flag else rows
    return KmerSet(rows.select(F.col("l_partkey").alias("code"), *[(F.col("l_suppkey") + 1000).alias("taxid")] * taxid), KmerMeta(K8))


def suppliers(spark: SparkSession, d: str) -> SetTable:
    """Every supplier is a set: many sets."""
    return SetTable(read(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("set_id"), F.col("l_partkey").alias("code")), KmerMeta(K8))


def taxonomy(spark: SparkSession, d: str) -> Taxonomy:
    node = lambda a, b, rank: [a.cast("long").alias("taxid"), b.cast("long").alias("parent"), F.lit(rank).alias("rank")]
    nation = read(spark, d, "nation")
    nodes = spark.range(1).select(*node(F.lit(1), F.lit(1), "no rank"))
    nodes = nodes.union(read(spark, d, "region").select(*node(F.col("r_regionkey") + 10, F.lit(1), "superkingdom")))
    nodes = nodes.union(nation.select(*node(F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, "family")))
    return Taxonomy(nodes.union(read(spark, d, "supplier").select(*node(F.col("s_suppkey") + 1000, F.col("s_nationkey") + 100, "species"))))


def flags(spark: SparkSession, d: str) -> SetTable:
    """Every return flag is a set."""
    rows = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_partkey").alias("code"), (F.col("l_suppkey") + 1000).alias("taxid"))
    return SetTable(rows, KmerMeta(K8))


def member_set(spark: SparkSession, d: str) -> KmerSet:
    """Canonical k-mers of documents of at least 15 sources, by one aggregate over sets."""
    return setops.common_of(by_source(spark, d), 15, sets=sources(spark, d))


SEQS = f"seqs AS (SELECT doc_id, source, source || ' ' || lang AS name, regexp_replace(translate(text, '{LETTERS}', '{CYCLE}'), '[^ACGT]', '', 'g') AS seq FROM documents)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def sql_code(e: str, k: int = K) -> str:
    return "(" + " + ".join(f"(instr('ACGT', substr({e}, {i + 1}, 1)) - 1)::BIGINT * {4 ** (k - 1 - i)}" for i in range(k)) + ")"


def sql_kmer(e: str, k: int = K8) -> str:
    return "(" + " || ".join(f"substr('ACGT', (({e} // {4 ** (k - 1 - i)}) % 4 + 1)::INT, 1)" for i in range(k)) + ")"


KM = f"""{SEQS}, raw AS (SELECT doc_id, source, name, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM seqs),
fwd AS (SELECT doc_id, source, name, i - 1 AS pos, substr(seq, i, {K}) AS kmer FROM raw),
km AS (SELECT doc_id, source, name, pos, kmer, least(kmer, {RC.format('kmer')}) AS can FROM fwd)"""
TX = "tx AS (SELECT s_suppkey + 1000 AS s, s_nationkey + 100 AS n, n_regionkey + 10 AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
IT = "it AS (SELECT l_partkey AS code, l_suppkey + 1000 AS taxid, l_returnflag AS f, s, n, r FROM lineitem JOIN tx ON l_suppkey + 1000 = s)"
LCA = "CAST(CASE WHEN count(DISTINCT s) = 1 THEN min(s) WHEN count(DISTINCT n) = 1 THEN min(n) WHEN count(DISTINCT r) = 1 THEN min(r) ELSE 1 END AS BIGINT)"
MEMBER = "mem AS (SELECT can FROM (SELECT DISTINCT source, can FROM km) GROUP BY can HAVING count(*) >= 15)"

# -- count --------------------------------------------------------------------------------------------------------------


@query(f"WITH {KM} SELECT DISTINCT {sql_code('kmer')} AS code FROM (SELECT DISTINCT kmer FROM km)")
def count_distinct_kmers(spark, d):
    return count(sequences(spark, d), K).df


@query(f"WITH {KM} SELECT source, count(DISTINCT can) AS number FROM km GROUP BY source")
def count_canonical(spark, d):
    return num(count(sequences(spark, d), K, set_cols=("source",), canonical=True).df, "source")


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM km GROUP BY can HAVING count(*) = 1")
def count_unique(spark, d):
    return count(sequences(spark, d), K, mode="unique", canonical=True).df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM km GROUP BY can HAVING count(*) > 1")
def count_repeated(spark, d):
    return count(sequences(spark, d), K, mode="repeated", canonical=True).df


@query(f"""WITH {KM}, c AS (SELECT doc_id, pos, {sql_code('kmer')} AS code FROM km)
SELECT doc_id, count(*) AS n, min_by(code, pos) AS first_code, max_by(code, pos) AS last_code, CAST(sum(code * (pos % 97)) AS BIGINT) AS walk FROM c GROUP BY doc_id""")
def count_linear(spark, d):
    rows = count(sequences(spark, d), K, mode="linear", row_cols=("doc_id",)).df
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("code", "pos").alias("first_code"), F.max_by("code", "pos").alias("last_code"), F.sum(F.col("code") * (F.col("pos") % 97)).alias("walk"))


@query(f"WITH {KM} SELECT count(DISTINCT can) AS number FROM km WHERE NOT regexp_matches(name, '(?i)SRC1') AND NOT regexp_matches(name, '(?i) de$')")
def count_name_filter(spark, d):
    return num(count(name_filter(sequences(spark, d), ["SRC1", " de$"]), K, canonical=True).df)


@query(f"WITH {KM}, t AS (SELECT can, doc_id % 5 + 10 AS t FROM km) SELECT {sql_code('can')} AS code, CAST(CASE WHEN min(t) = max(t) THEN min(t) ELSE 1 END AS BIGINT) AS taxid FROM t GROUP BY can")
def count_parse_taxid_lca(spark, d):
    header = F.concat(F.col("name"), F.lit(" tax|"), (F.col("doc_id") % 5 + 10).cast("string"), F.lit("|"))
    rows = parse_taxid(sequences(spark, d).withColumn("name", header), r"tax\|(\d+)\|")
    return count(rows, K, canonical=True, taxonomy=taxonomy(spark, d)).df


@query(f"""WITH {SEQS}, c AS (SELECT doc_id, seq || substr(seq, 1, {K - 1}) AS seq FROM seqs WHERE length(seq) >= {K}),
raw AS (SELECT doc_id, substr(seq, unnest(range(1, length(seq) - {K} + 2)), {K}) AS kmer FROM c) SELECT doc_id, count(DISTINCT kmer) AS number FROM raw GROUP BY doc_id""")
def count_circular(spark, d):
    return num(count(sequences(spark, d), K, set_cols=("doc_id",), circular=True).df, "doc_id")


def _rotated(value: int, by: int) -> int:
    by %= 64
    return (value << by | value >> 64 - by) & (1 << 64) - 1


def sql_hash(e: str, k: int) -> str:
    """The canonical hash of a text of k bases as UBIGINT: for each strand the exclusive or of seeds turned by their distance from the strand's end."""
    def strand(seeds, turn):
        out = "0::UBIGINT"
        for j in range(k):
            cases = " ".join(f"WHEN '{c}' THEN {_rotated(int(seed), turn(j))}::UBIGINT" for c, seed in zip("ACGT", seeds))
            out = f"xor({out}, CASE substr({e}, {j + 1}, 1) {cases} END)"
        return out

    seeds = S.SEEDS[:4].tolist()
    return f"least({strand(seeds, lambda j: k - 1 - j)}, {strand(seeds[::-1], lambda j: j)})"


def sql_signed(e: str) -> str:
    return f"CAST(CASE WHEN {e} > 9223372036854775807 THEN {e}::HUGEINT - 18446744073709551616 ELSE {e}::HUGEINT END AS BIGINT)"


def sql_hashes(k: int, more: str = "") -> str:
    """h: doc_id, source, i (from 1), the k-mer and its hash h."""
    return f"{SEQS}, windows AS (SELECT doc_id, source, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM seqs), texts AS (SELECT doc_id, source, i, substr(seq, i, {k}) AS kmer FROM windows), h AS (SELECT doc_id, source, i, kmer, {sql_hash('kmer', k)} AS h FROM texts){more}"


@query(f"WITH {sql_hashes(23)} SELECT DISTINCT source, {sql_signed('h')} AS code FROM h")
def hash_kmers(spark, d):
    return count(sequences(spark, d), 23, set_cols=("source",), hashed=True).df


@query(f"WITH {sql_hashes(31)} SELECT DISTINCT source, {sql_signed('h')} AS code FROM h WHERE h <= {int(float((1 << 64) - 1) / 15)}::UBIGINT")
def sketch_scaled(spark, d):
    return count(sequences(spark, d), 31, set_cols=("source",), scale=15).df


@query(f"""WITH {sql_hashes(31)}, m AS (SELECT source, min(h) OVER w AS h, count(*) OVER w AS n FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 14 FOLLOWING))
SELECT DISTINCT source, {sql_signed('h')} AS code FROM m WHERE n = 15""")
def sketch_minimizer(spark, d):
    return count(sequences(spark, d), 31, set_cols=("source",), minimizer=15).df


@query(f"""WITH {sql_hashes(31)}, parts AS (SELECT doc_id, seq, unnest(range(1, length(seq) - 16 + 2)) AS i FROM seqs), small AS (SELECT doc_id, i, {sql_hash('substr(seq, i, 16)', 16)} AS s FROM parts),
w AS (SELECT doc_id, i, s AS a, last_value(s) OVER o AS z, min(s) OVER o AS least, count(*) OVER o AS n FROM small WINDOW o AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING))
SELECT DISTINCT source, {sql_signed('h')} AS code FROM h JOIN w USING (doc_id, i) WHERE n = 16 AND (a = least OR z = least)""")
def sketch_syncmer(spark, d):
    return count(sequences(spark, d), 31, set_cols=("source",), syncmer=16).df


# -- reports, views, text -----------------------------------------------------------------------------------------------


@query("SELECT l_returnflag AS set_id, count(*) AS number FROM lineitem GROUP BY 1")
def num_per_set(spark, d):
    return num(read(spark, d, "lineitem").select(F.col("l_returnflag").alias("set_id")), "set_id")


@query("""SELECT l_returnflag AS file, 8 AS k, false AS canonical, false AS hashed, CAST(1 AS BIGINT) AS scaled, true AS include_taxid, false AS sorted,
'' AS description, count(*) AS number FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1""")
def info_sets(spark, d):
    return info({f: items(spark, d, f) for f in "ANR"}).drop("global_taxid")


@query("""SELECT l_returnflag AS file, 'no' AS canonical, 'no' AS hashed, 'yes' AS include_taxid, 'no' AS sorted, CASE WHEN min(l_suppkey) = max(l_suppkey) THEN 'one' ELSE 'none' END AS global_taxid, count(*) AS number
FROM lineitem GROUP BY 1""")
def info_table(spark, d):
    found = info(flags(spark, d), symbols=("yes", "no"), basename=True)
    one = F.when(F.col("global_taxid").isNotNull(), F.lit("one")).otherwise(F.lit("none")).alias("global_taxid")
    return found.select("file", "canonical", "hashed", "include_taxid", "sorted", one, "number")


CODES = "c AS (SELECT DISTINCT l_partkey AS code FROM lineitem)"


@query(f"WITH {CODES} SELECT {sql_kmer('code')} AS kmer, CAST(code AS VARCHAR) AS code FROM c")
def view_kmer_code(spark, d):
    return view(setops.union([items(spark, d, taxid=False)]), "kmer_code")


@query(f"WITH {CODES} SELECT '>' || code || chr(10) || {sql_kmer('code')} AS record FROM c")
def view_fasta(spark, d):
    return view(setops.union([items(spark, d, taxid=False)]), "fasta")


@query(f"WITH {CODES} SELECT '@' || code || chr(10) || {sql_kmer('code')} || chr(10) || '+' || chr(10) || 'gggggggg' AS record FROM c")
def view_fastq(spark, d):
    return view(setops.union([items(spark, d, taxid=False)]), "fastq")


@query(f"""WITH {sql_hashes(23)}, kept AS (SELECT DISTINCT h FROM h WHERE h <= {int(float((1 << 64) - 1) / 50)}::UBIGINT),
ring AS (SELECT doc_id, seq || substr(seq, 1, 22) AS seq FROM seqs WHERE length(seq) >= 23), turn AS (SELECT doc_id, seq, unnest(range(1, length(seq) - 23 + 2)) AS i FROM ring),
every AS (SELECT doc_id, i, kmer, {sql_hash('kmer', 23)} AS h FROM (SELECT doc_id, i, substr(seq, i, 23) AS kmer FROM turn)),
named AS (SELECT h, kmer, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS place FROM every JOIN kept USING (h))
SELECT kmer, CAST(h AS VARCHAR) AS code FROM named WHERE place = 1""")
def view_hashed_genome(spark, d):
    rows = sequences(spark, d)
    return view(count(rows, 23, hashed=True, scale=50), "kmer_code", rows, id_cols=("doc_id",))


def kmer_text(spark, d):
    return read(spark, d, "lineitem").select(codec.decode(F.col("l_partkey"), K8).alias("kmer"), (F.col("l_suppkey") + 1000).alias("taxid"))


TEXT = f"t AS (SELECT {sql_kmer('l_partkey')} AS kmer, l_suppkey + 1000 AS taxid FROM lineitem)"


@query(f"WITH {TEXT} SELECT {sql_code('kmer', K8)} AS code, taxid FROM t WHERE kmer <= {RC.format('kmer')}")
def dump_canonical_only(spark, d):
    return dump(kmer_text(spark, d), K8, only_canonical=True).df


@query(f"WITH {TEXT} SELECT {sql_code(f'least(kmer, {RC.format("kmer")})', K8)} AS code, min(taxid) AS taxid FROM t GROUP BY 1")
def dump_unique(spark, d):
    return dump(kmer_text(spark, d), K8, to_canonical=True, unique=True).df


@query(f"WITH {TEXT} SELECT DISTINCT {sql_signed(sql_hash('kmer', K8))} AS code FROM t")
def dump_hash_text(spark, d):
    return dump(kmer_text(spark, d).select("kmer"), K8, hash_text=True, unique=True).df


@query(f"WITH {TEXT}, u AS (SELECT DISTINCT kmer FROM t) SELECT kmer, CAST({sql_hash('kmer', K8)} AS VARCHAR) AS code FROM u")
def encode_hash(spark, d):
    return hash_texts(kmer_text(spark, d).select("kmer").distinct(), K8).select("kmer", codec.unsigned_text(F.col("code")).alias("code"))


@query(f"""WITH p AS (SELECT DISTINCT {sql_kmer('l_partkey')} AS kmer FROM lineitem), q AS (SELECT kmer, least(kmer, {RC.format('kmer')}) AS parsed FROM p)
SELECT kmer, parsed, CAST({sql_code('parsed', K8)} AS VARCHAR) AS code, replace(replace(replace(replace(parsed, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11') AS bits FROM q""")
def encode_all(spark, d):
    rows = kmer_text(spark, d).select("kmer").distinct().withColumn("parsed", codec.canonical_text(F.col("kmer")))
    code = codec.encode(F.col("parsed"))
    return rows.select("kmer", "parsed", codec.unsigned_text(code).alias("code"), codec.bits(code, K8).alias("bits"))


@query(f"WITH {CODES} SELECT code, {sql_kmer('code')} AS kmer FROM c")
def decode_all(spark, d):
    return setops.union([items(spark, d, taxid=False)]).df.select("code", codec.decode(F.col("code"), K8).alias("kmer"))


# -- set algebra --------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS code, l_suppkey + 1000 AS taxid FROM lineitem")
def concat_sets(spark, d):
    return setops.concat([items(spark, d, f) for f in "ANR"]).df


@query("SELECT l_partkey AS code, CAST(7 AS BIGINT) AS taxid FROM lineitem")
def concat_global_taxid(spark, d):
    return setops.concat([items(spark, d, f) for f in "ANR"], global_taxid=7).df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM km GROUP BY can HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM documents)")
def inter_sets(spark, d):
    return setops.inter_of(by_source(spark, d), sets=sources(spark, d)).df


@query(f"WITH {TX}, {IT} SELECT code, {LCA} AS taxid FROM it GROUP BY code HAVING count(DISTINCT f) = 3")
def inter_lca(spark, d):
    return setops.inter([items(spark, d, f) for f in "ANR"], taxonomy(spark, d)).df


@query(f"WITH {TX}, {IT}, x AS (SELECT * FROM it WHERE f = 'A' AND code IN (SELECT code FROM it WHERE f = 'R') AND code IN (SELECT code FROM it WHERE f = 'N')) SELECT code, {LCA} AS taxid FROM x GROUP BY code")
def inter_mix_taxid(spark, d):
    return setops.inter([items(spark, d, "R", taxid=False), items(spark, d, "N", taxid=False), items(spark, d, "A")], taxonomy(spark, d), mix_taxid=True).df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM km GROUP BY can HAVING count(DISTINCT source) >= 2")
def common_n(spark, d):
    return setops.common_of(by_source(spark, d), 2, sets=sources(spark, d)).df


@query("SELECT l_partkey AS code FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 3")
def common_many_sets(spark, d):
    return setops.common_of(suppliers(spark, d), 3).df


@query(f"WITH {TX}, {IT} SELECT code, {LCA} AS taxid FROM it GROUP BY code HAVING count(DISTINCT f) >= 2")
def common_proportion(spark, d):
    return setops.common([items(spark, d, f) for f in "ANR"], proportion=0.7, taxonomy=taxonomy(spark, d)).df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM (SELECT DISTINCT can FROM km)")
def union_sets(spark, d):
    return setops.common_of(by_source(spark, d), 1, sets=sources(spark, d)).df


@query(f"WITH {TX}, {IT} SELECT code, {LCA} AS taxid FROM it GROUP BY code")
def union_lca(spark, d):
    return setops.union([items(spark, d, f) for f in "ANR"], taxonomy(spark, d)).df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM km GROUP BY can HAVING bool_and(source = 'src1')")
def diff_sets(spark, d):
    return setops.diff_of(by_source(spark, d), "src1").df


@query(f"""WITH {TX}, {IT}, q AS (SELECT code, {LCA} AS q FROM it WHERE f = 'A' GROUP BY code),
gone AS (SELECT DISTINCT code FROM q JOIN it USING (code) WHERE f IN ('N', 'R') AND q NOT IN (s, n, r, 1)) SELECT code, q AS taxid FROM q WHERE code NOT IN (SELECT code FROM gone)""")
def diff_compare_taxid(spark, d):
    return setops.diff(items(spark, d, "A"), [items(spark, d, "N"), items(spark, d, "R")], taxonomy(spark, d)).df


# -- order --------------------------------------------------------------------------------------------------------------


@query("SELECT l_partkey AS code, l_suppkey + 1000 AS taxid FROM lineitem")
def sort_plain(spark, d):
    return ordering.sort(items(spark, d)).df


@query(f"WITH {TX}, {IT} SELECT code, {LCA} AS taxid FROM it GROUP BY code")
def sort_unique_lca(spark, d):
    return ordering.sort(items(spark, d), "unique", taxonomy(spark, d)).df


@query(f"WITH {TX}, {IT} SELECT code, {LCA} AS taxid FROM it GROUP BY code HAVING count(*) > 1")
def sort_repeated(spark, d):
    return ordering.sort(items(spark, d), "repeated", taxonomy(spark, d)).df


@query("SELECT (row_number() OVER (ORDER BY l_partkey, l_suppkey) - 1) // 1000 AS chunk, l_partkey AS code, l_suppkey + 1000 AS taxid FROM lineitem")
def split_chunks(spark, d):
    return ordering.split(items(spark, d), 1000)


@query("SELECT l_suppkey + 1000 AS taxid, count(DISTINCT l_partkey) AS number FROM lineitem GROUP BY 1")
def tsplit_counts(spark, d):
    return num(ordering.tsplit(items(spark, d)).df, "taxid")


@query("SELECT DISTINCT 'part-' || (l_suppkey + 1000) || '.k8' AS set_id, l_partkey AS code, l_suppkey + 1000 AS taxid FROM lineitem")
def tsplit_sets(spark, d):
    return ordering.tsplit(items(spark, d), "part").df


@query("SELECT DISTINCT l_partkey AS code FROM lineitem")
def merge_unique(spark, d):
    return ordering.merge([items(spark, d, f, False) for f in "ANR"], "unique").df


@query("SELECT l_partkey AS code FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def merge_repeated(spark, d):
    return ordering.merge([items(spark, d, f, False) for f in "ANR"], "repeated").df


@query("SELECT l_partkey AS code FROM lineitem")
def merge_many_sets(spark, d):
    return ordering.merge_table(suppliers(spark, d)).df


@query("SELECT l_partkey AS code, l_suppkey + 1000 AS taxid FROM lineitem ORDER BY 1, 2 LIMIT 25")
def head_n(spark, d):
    return ordering.head(items(spark, d).df, 25, "code", "taxid")


@query(f"WITH {KM}, j AS (SELECT source, doc_id, pos, kmer, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) AS j FROM km) SELECT source, doc_id, pos, {sql_code('kmer')} AS code FROM j WHERE j >= 5 AND (j - 5) % 500 = 0")
def sample_window(spark, d):
    return ordering.sample_kmers(sequences(spark, d), K, 5, 500, "source", ("doc_id",))


# -- search -------------------------------------------------------------------------------------------------------------


def asked(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


@query(f"WITH {TEXT}, c AS (SELECT least(kmer, {RC.format('kmer')}) AS can, taxid FROM t) SELECT {sql_code('can', K8)} AS code, taxid FROM c WHERE can IN ('AAACAGTC', 'AAAAACGT', least('AACGTTCA', {RC.format("'AACGTTCA'")}))")
def grep_kmers(spark, d):
    return search.grep(items(spark, d), search.queries_from_text(asked(spark, "AAACAGTC", "aaaaacgt", "AACGTTCA", " "), K8)).df


@query(f"WITH {TEXT}, c AS (SELECT DISTINCT least(kmer, {RC.format('kmer')}) AS can, kmer FROM t) SELECT DISTINCT {sql_code('can', K8)} AS code FROM c WHERE regexp_full_match(can, 'AAA[ACGT][AG]C[ACGT]T') OR regexp_full_match({RC.format('can')}, 'AAA[ACGT][AG]C[ACGT]T')")
def grep_degenerate(spark, d):
    return search.grep(items(spark, d, taxid=False), search.queries_from_text(asked(spark, "AAANRCNT"), K8, degenerate=True), mode="unique").df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM (SELECT can FROM km WHERE source = 'src1' EXCEPT SELECT can FROM km WHERE source <> 'src1')")
def grep_invert(spark, d):
    rows = sequences(spark, d)
    own, others = (count(rows.where(w), K, canonical=True) for w in ("source = 'src1'", "source <> 'src1'"))
    return search.grep(own, search.queries_from_set(others, own.meta), invert=True).df


@query(f"""WITH q AS (SELECT DISTINCT {sql_code(f'least(kmer, {RC.format("kmer")})', K8)} AS code FROM (SELECT {sql_kmer('l_partkey')} AS kmer FROM lineitem WHERE l_suppkey = 1)),
t AS (SELECT l_returnflag AS set_id, {sql_code(f'least(kmer, {RC.format("kmer")})', K8)} AS code, taxid FROM (SELECT l_returnflag, {sql_kmer('l_partkey')} AS kmer, l_suppkey + 1000 AS taxid FROM lineitem))
SELECT set_id, code, taxid FROM t WHERE code IN (SELECT code FROM q)""")
def grep_each_set(spark, d):
    asked_for = suppliers(spark, d).one("1")
    return search.grep_table(flags(spark, d), search.queries_from_set(asked_for, asked_for.meta)).df


@query(f"""WITH q AS (SELECT DISTINCT {sql_code(f'least(kmer, {RC.format("kmer")})', K8)} AS code FROM (SELECT {sql_kmer('l_partkey')} AS kmer FROM lineitem WHERE l_suppkey IN (1, 2))),
t AS (SELECT {sql_code(f'least(kmer, {RC.format("kmer")})', K8)} AS code FROM (SELECT {sql_kmer('l_partkey')} AS kmer FROM lineitem)) SELECT code FROM t WHERE code IN (SELECT code FROM q) GROUP BY code HAVING count(*) > 1""")
def grep_repeated(spark, d):
    wanted = KmerSet(read(spark, d, "lineitem").where("l_suppkey IN (1, 2)").select(F.col("l_partkey").alias("code")), KmerMeta(K8))
    return search.grep(items(spark, d, taxid=False), search.queries_from_set(wanted), mode="repeated").df


@query("SELECT l_partkey AS code, l_suppkey + 1000 AS taxid FROM lineitem WHERE l_suppkey IN (1, 3, 7)")
def grep_taxid(spark, d):
    return search.grep(items(spark, d), spark.createDataFrame([(1001,), (1003,), (1007,)], "taxid long"), taxid=True).df


_R = "reverse(can)"
_SCORE = ["1"] + [f"(CASE WHEN substr({_R}, {i + 1}, 1) = substr({_R}, {i}, 1) THEN 3 ELSE 1 END)" for i in range(1, K)]
LOW = "(" + " OR ".join("(" + " + ".join(_SCORE[i : i + 7]) + ") >= 15" for i in range(K - 7)) + ")"


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM (SELECT DISTINCT can FROM km) WHERE NOT {LOW}")
def filter_low_complexity(spark, d):
    return search.filter_complexity(count(sequences(spark, d), K, canonical=True)).df


@query(f"WITH {KM} SELECT {sql_code('can')} AS code FROM (SELECT DISTINCT can FROM km) WHERE {LOW}")
def filter_low_complexity_invert(spark, d):
    return search.filter_complexity(count(sequences(spark, d), K, canonical=True), invert=True).df


#: Rows of the ancestors' levels, so that the rank filter has ranks of every level to look at.
LEVELS = f"{TX}, {IT}, u AS (SELECT code, {LCA} AS taxid FROM it GROUP BY code), ranked AS (SELECT code, taxid, CASE WHEN taxid = 1 THEN 'no rank' WHEN taxid < 100 THEN 'superkingdom' WHEN taxid < 1000 THEN 'family' ELSE 'species' END AS rank FROM (SELECT code, taxid FROM u UNION ALL SELECT code, s FROM it UNION ALL SELECT code, n FROM it UNION ALL SELECT code, r FROM it))"


def levels(spark, d):
    tx, rows = taxonomy(spark, d), items(spark, d)
    up = rows.df.join(tx.ancestors(), "taxid").where("ancestor <> 1").select("code", F.col("ancestor").alias("taxid"))
    return rows.with_df(setops.union([rows], tx).df.union(up)), tx


def _rank(name, where, **how):
    def f(spark, d):
        rows, tx = levels(spark, d)
        return search.filter_rank(rows, tx, **how).df.groupBy("taxid").agg(F.count(F.lit(1)).alias("number"))

    f.__name__ = name
    query(f"WITH {LEVELS} SELECT taxid, count(*) AS number FROM ranked WHERE {where} GROUP BY taxid")(f)


@query("SELECT * FROM (VALUES ('no rank'), ('superkingdom'), ('family'), ('species')) t(rank)")
def rfilter_list_ranks(spark, d):
    return taxonomy(spark, d).list_ranks()


@query("SELECT rank, CAST(ord AS INT) AS ord FROM (VALUES ('superkingdom', 67), ('family', 25), ('species', 10)) t(rank, ord)")
def rfilter_list_order(spark, d):
    return taxonomy(spark, d).list_order()


_rank("rfilter_lower", "rank IN ('species', 'no rank')", lower="family")
_rank("rfilter_higher", "rank = 'superkingdom'", higher="family")
_rank("rfilter_equal", "rank = 'family'", equal=("family",))
_rank("rfilter_blacklist", "rank <> 'species' AND taxid <> 1", black=("species",), discard_root=True)
_rank("rfilter_norank_climb", "rank IN ('species', 'family')", lower="superkingdom", discard_unordered=True, climb=True)


@query(f"WITH {KM}, one AS (SELECT can FROM km GROUP BY can HAVING count(*) = 1) SELECT CAST(doc_id AS VARCHAR) AS chrom, pos AS start, pos + {K} AS \"end\", kmer AS name, '0' AS score, '.' AS strand FROM km JOIN one USING (can)")
def locate_bed6(spark, d):
    rows = sequences(spark, d)
    return search.locate(count(rows, K, mode="unique", canonical=True), rows, "doc_id")


@query(f"""WITH {KM}, c AS (SELECT doc_id, seq || substr(seq, 1, {K - 1}) AS seq FROM seqs WHERE length(seq) >= {K}), r2 AS (SELECT doc_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM c),
w AS (SELECT doc_id, i - 1 AS pos, substr(seq, i, {K}) AS kmer FROM r2), one AS (SELECT can FROM km GROUP BY can HAVING count(*) = 1)
SELECT CAST(doc_id AS VARCHAR) AS chrom, pos AS start, pos + {K} AS "end", kmer AS name, '0' AS score, '.' AS strand FROM w JOIN one ON least(kmer, {RC.format('kmer')}) = can""")
def locate_circular(spark, d):
    rows = sequences(spark, d)
    return search.locate(count(rows, K, mode="unique", canonical=True), rows, "doc_id", circular=True)


def sql_ring(min_len: int) -> str:
    """map of circular sequences: k-mers of the sequence written twice, regions that begin in the first copy and are a sequence long at most."""
    return f"""{KM}, {MEMBER}, ring AS (SELECT doc_id, length(seq) AS n, seq || seq AS walk FROM seqs WHERE length(seq) >= {K}), turn AS (SELECT doc_id, n, walk, unnest(range(1, length(walk) - {K} + 2)) AS i FROM ring),
p AS (SELECT doc_id, n, i - 1 AS pos, least(kmer, {RC.format('kmer')}) AS can FROM (SELECT doc_id, n, i, substr(walk, i, {K}) AS kmer FROM turn)),
many AS (SELECT doc_id, can FROM p WHERE pos < n GROUP BY doc_id, can HAVING count(*) > 1), h AS (SELECT doc_id, n, pos FROM p WHERE can IN (SELECT can FROM mem) AND (doc_id, can) NOT IN (SELECT doc_id, can FROM many)),
g AS (SELECT doc_id, n, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM h), runs AS (SELECT doc_id, n, min(pos) AS a, max(pos) + {K} AS b FROM g GROUP BY doc_id, n, island),
reg AS (SELECT doc_id, a, least(b, a + n) AS b FROM runs WHERE a < n AND least(b, a + n) - a >= {min_len})"""


def sql_regions(multi: str, min_len: int, gap: int, gaps: int) -> str:
    member = MEMBER if multi != "whole" else "mem AS (SELECT DISTINCT can FROM km)"
    many = {"keep": "SELECT NULL AS doc_id, NULL AS can WHERE false", "drop": "SELECT doc_id, can FROM km GROUP BY doc_id, can HAVING count(*) > 1", "whole": "SELECT NULL AS doc_id, can FROM km GROUP BY can HAVING count(*) > 1", "unit": "SELECT source, can FROM km GROUP BY source, can HAVING count(*) > 1"}[multi]
    join = "km.can = many.can" + (" AND km.doc_id = many.doc_id" if multi == "drop" else " AND km.source = many.source" if multi == "unit" else "")
    return f"""{KM}, {member}, many AS ({many}), cls AS (SELECT km.doc_id, pos, mem.can IS NOT NULL AS hit, many.can IS NOT NULL AS wall FROM km LEFT JOIN mem USING (can) LEFT JOIN many ON {join}),
w AS (SELECT doc_id, pos, hit, wall, sum(wall::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS walls FROM cls), h AS (SELECT doc_id, pos, walls FROM w WHERE hit AND NOT wall),
g AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER o - 1, 1000000) AS behind, coalesce(walls <> lag(walls) OVER o, true) AS wall FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
x AS (SELECT doc_id, pos, sum((behind > 0 OR wall)::INT) OVER o AS run, sum((behind > {gap} OR wall)::INT) OVER o AS chain FROM g WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
runs AS (SELECT doc_id, chain, run, min(pos) AS a, max(pos) AS b FROM x GROUP BY 1, 2, 3), parts AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, chain ORDER BY run) - 1) // {gaps + 1} AS part FROM runs),
reg AS (SELECT doc_id, min(a) AS a, max(b) + {K} AS b FROM parts GROUP BY doc_id, chain, part HAVING max(b) + {K} - min(a) >= {min_len})"""


def _map(name, multi="drop", min_len=16, gap=0, gaps=0, fasta=False):
    def f(spark, d):
        members = member_set(spark, d) if multi != "whole" else count(sequences(spark, d), K, canonical=True)
        return search.map_regions(members, sequences(spark, d), min_len, multi, gap, gaps, "doc_id", fasta=fasta)

    f.__name__ = name
    out = "CAST(doc_id AS VARCHAR) AS chrom, a AS start, b AS \"end\" FROM reg"
    if fasta:
        out = "'>' || doc_id || ':' || (a + 1) || '-' || b AS name, regexp_replace(substr(seq, (a + 1)::BIGINT, (b - a)::BIGINT), '(.{60})', '\\1' || chr(10), 'g') AS seq FROM reg JOIN seqs USING (doc_id)"
        out = f"name, rtrim(seq, chr(10)) AS seq FROM (SELECT {out})"
    query(f"WITH {sql_regions(multi, min_len, gap, gaps)} SELECT {out}")(f)


@query(f"WITH {sql_ring(16)} SELECT CAST(doc_id AS VARCHAR) AS chrom, a AS start, b AS \"end\" FROM reg")
def map_circular(spark, d):
    return search.map_regions(member_set(spark, d), sequences(spark, d), 16, "drop", id_col="doc_id", circular=True)


@query(f"WITH {sql_regions('unit', 16, 0, 0)} SELECT CAST(doc_id AS VARCHAR) AS chrom, a AS start, b AS \"end\" FROM reg")
def map_unit(spark, d):
    return search.map_regions(member_set(spark, d), sequences(spark, d), 16, "whole", id_col="doc_id", unit="source")


_map("map_bed3")
_map("map_gaps", gap=4, gaps=2)
_map("map_multi_allowed", "keep", 20)
_map("map_whole_genome", "whole", 20)
_map("map_fasta", "keep", 20, fasta=True)
