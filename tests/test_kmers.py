"""Codec, hashes, counting, set algebra, taxonomy and mapping on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.functions import codec
from strandset.functions import sequence as S
from strandset.meta import KmerMeta, KmerSet, check_compatible
from strandset.operators import ordering, search, setops
from strandset.operators.count import count, name_filter, parse_taxid
from strandset.operators.taxonomy import Taxonomy, default_ranks, parse_ranks
from strandset.sources import readers, writers

GOLDEN = {"CATCCGCCATCTTTGGGGTGTCG": 1210726578792, "AGCGCAAAATCCCCAAACATGTA": 2286899379883, "AACTGATTTTTGATGATGACTCC": 3542156397282}


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def code(s):
    n = 0
    for c in s:
        n = n * 4 + "ACGT".index(c)
    return n - (1 << 64) if n >= 1 << 63 else n


def kmer_set(spark, rows, k=3, taxid=False, canonical=True):
    return KmerSet(spark.createDataFrame(rows, "code long" + ", taxid long" * taxid), KmerMeta(k, canonical))


def codes(s):
    return sorted(r[0] for r in s.df.select("code").collect())


@pytest.mark.parametrize("text,value", GOLDEN.items())
def test_nthash(text, value):
    for t in (text, rc(text)):
        assert int(S.nthash(S.bases(t.encode()), 23)[0]) == value


@pytest.mark.parametrize("k", [1, 2, 5, 11, 31, 32])
def test_codes(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice("ACGT") for _ in range(k)) for _ in range(20)] + ["T" * k]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    e = codec.encode(F.col("t"))
    for r in df.select("t", e.alias("c"), codec.decode(e, k).alias("back"), codec.bits(e, k).alias("b"), codec.canonical(e, k).alias("can")).collect():
        assert r.c == code(r.t) and r.back == r.t and r.can == code(min(r.t, rc(r.t))) and len(r.b) == 2 * k
    one, other = S.codes(S.bases(texts[0].encode()), k)
    assert one[0].astype(np.int64) == code(texts[0]) and other[0].astype(np.int64) == code(rc(texts[0]))


def test_codes_of_more_bases_keep_the_last_ones(spark):
    longer = spark.createDataFrame([(code("GTACG"),), (code("TACG"),), (code("ACG"),)], "code long")
    assert {(r.t, r.b, r.c) for r in longer.select(codec.decode(F.col("code"), 3).alias("t"), codec.bits(F.col("code"), 3).alias("b"), codec.canonical(F.col("code"), 3).alias("c")).collect()} == {("ACG", "000110", code("ACG"))}
    s = KmerSet(longer, KmerMeta(3))
    assert {r.record for r in writers.view(s, "fasta").collect()} == {f">{code(x)}\nACG" for x in ("GTACG", "TACG", "ACG")}
    q = search.queries_from_text(spark.createDataFrame([("cgt",)], "query string"), 3)
    assert codes(search.grep(s, q)) == [code("ACG")] * 3 and codes(search.grep(s, search.queries_from_set(s), mode="repeated")) == [code("ACG")]


def test_decode_overflow(spark):
    with pytest.raises(Exception, match="too large"):
        spark.createDataFrame([(64,)], "c long").select(codec.checked_decode(F.col("c"), 3)).collect()
    assert spark.createDataFrame([(-1,)], "c long").select(codec.unsigned_text(F.col("c"))).first()[0] == str((1 << 64) - 1)


def test_count_modes(spark):
    df = spark.createDataFrame([("a", "ACGTACGTN"), ("a", "ac"), ("b", None), ("b", "AAAACGT")], "source string, seq string")
    own = ["ACG", "CGT", "GTA", "TAC", "ACG", "CGT", "AAA", "AAA", "AAC", "ACG", "CGT"]
    assert codes(count(df, 3)) == sorted({code(x) for x in own})
    assert codes(count(df, 3, mode="unique")) == sorted(code(x) for x in set(own) if own.count(x) == 1)
    assert codes(count(df, 3, mode="repeated")) == sorted(code(x) for x in set(own) if own.count(x) > 1)
    assert codes(count(df, 3, mode="linear")) == sorted(map(code, own))
    assert codes(count(df, 3, canonical=True)) == sorted({code(min(x, rc(x))) for x in own})
    assert count(df.limit(0), 3).df.count() == 0
    with pytest.raises(ValueError):
        count(df, 3, minimizer=2, syncmer=2)
    with pytest.raises(ValueError):
        count(df, 65)


def test_circular_and_headers(spark):
    df = spark.createDataFrame([("x tax|7|", "AACGT"), ("plasmid Y tax|8|", "AACGT")], "name string, seq string")
    assert codes(count(name_filter(df, ["PLASMID"]), 3, mode="linear", circular=True)) == sorted(code(x) for x in ("AAC", "ACG", "CGT", "GTA", "TAA"))
    assert {r.taxid for r in parse_taxid(df, r"tax\|(\d+)\|").collect()} == {7, 8}
    with pytest.raises(Exception, match="no taxid"):
        parse_taxid(df, r"id=(\d+)").collect()


def test_sketches(spark):
    rng = random.Random(1)
    seq = "".join(rng.choice("ACGT") for _ in range(400))
    df = spark.createDataFrame([(seq,)], "seq string")
    h = S.nthash(S.bases(seq.encode()), 15).tolist()
    signed = lambda xs: sorted(x - (1 << 64) if x >= 1 << 63 else x for x in set(xs))
    assert codes(count(df, 15, minimizer=5)) == signed(min(h[i : i + 5]) for i in range(len(h) - 4))
    assert codes(count(df, 15, scale=4)) == signed(x for x in h if x <= ((1 << 64) - 1) // 4)
    small = S.nthash(S.bases(seq.encode()), 6).tolist()
    assert codes(count(df, 15, syncmer=6)) == signed(x for i, x in enumerate(h) if min(small[i : i + 10]) in (small[i], small[i + 9]))


def test_set_algebra(spark):
    rng = random.Random(3)
    raw = [[rng.randrange(40) for _ in range(30)] for _ in range(3)] + [[]]
    sets = [kmer_set(spark, [(x,) for x in r]) if r else kmer_set(spark, spark.createDataFrame([], "code long").rdd) for r in raw]
    a, b, c, empty = map(set, raw)
    assert codes(setops.union(sets[:3])) == sorted(a | b | c) and codes(setops.inter(sets[:3])) == sorted(a & b & c)
    assert codes(setops.diff(sets[0], sets[1:3])) == sorted(a - b - c) and codes(setops.diff(sets[0], [])) == sorted(a)
    assert codes(setops.diff(sets[0], [sets[0]])) == [] and codes(setops.inter([sets[0], sets[3]])) == [] and codes(setops.diff(sets[3], sets[:1])) == []
    assert codes(setops.common(sets[:3], 2)) == sorted(x for x in a | b | c if (x in a) + (x in b) + (x in c) >= 2)
    assert codes(setops.common(sets[:3], proportion=0.1)) == sorted(a | b | c)
    assert codes(setops.concat(sets[:2])) == sorted(raw[0] + raw[1]) and codes(setops.union(sets[:1])) == sorted(a)
    assert codes(ordering.merge(sets[:2], "repeated")) == sorted(x for x in set(raw[0] + raw[1]) if (raw[0] + raw[1]).count(x) > 1)
    chunks = ordering.split(sets[0], 7).collect()
    assert sorted(r.code for r in chunks) == sorted(raw[0]) and [r.code for r in sorted(chunks, key=lambda r: (r.chunk, r.code))] == sorted(raw[0])
    assert max([r.chunk for r in chunks]) == (len(raw[0]) - 1) // 7
    with pytest.raises(ValueError):
        check_compatible([sets[0], kmer_set(spark, [(1,)], k=4)])
    del empty


TREE = {1: (1, "no rank"), 2: (1, "domain"), 3: (2, "phylum"), 4: (3, "genus"), 5: (4, "species"), 6: (4, "species"), 7: (3, "clade"), 8: (7, "species"), 9: (1, "domain")}


def tree(spark):
    return Taxonomy(spark.createDataFrame([(t, p, r) for t, (p, r) in TREE.items()], "taxid long, parent long, rank string"), spark.createDataFrame([(50, 5)], "old_taxid long, new_taxid long"), 4)


def path(t):
    return [t] if TREE[t][0] == t else path(TREE[t][0]) + [t]


def lca(ts):
    paths = [path(t) for t in ts]
    return [x[0] for x in zip(*paths) if len(set(x)) == 1][-1]


def test_lca_and_diff_by_taxid(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice(list(TREE))) for g in range(40) for _ in range(rng.randrange(1, 4))]
    got = {r.code: r.taxid for r in tree(spark).lca(spark.createDataFrame(rows + [(99, 50), (98, 77), (97, 0), (97, 8)], "code long, taxid long"), ["code"]).collect()}
    assert got == {g: lca([t for x, t in rows if x == g]) for g in range(40)} | {99: 5, 98: None, 97: 8}
    a, b = kmer_set(spark, [(1, 4), (2, 4), (3, 8)], taxid=True), kmer_set(spark, [(1, 5), (2, 8), (3, 3)], taxid=True)
    assert codes(setops.diff(a, [b], tree(spark))) == [1]
    assert codes(setops.diff(kmer_set(spark, [(1,), (2,)]), [kmer_set(spark, [(1,)])], tree(spark))) == [2]


def test_ranks(spark):
    t = tree(spark)
    kept = lambda **how: sorted(r.taxid for r in t.passing(**how).collect())
    assert kept(lower="genus") == [1, 5, 6, 7, 8] and kept(higher="genus") == [2, 3, 9] and kept(equal=("genus",)) == [4]
    assert kept(lower="genus", discard_unordered=True) == [5, 6, 8] and kept(lower="phylum", discard_unordered=True, climb=True) == [4, 5, 6, 7, 8]
    assert kept(black=("species",), discard_root=True) == [2, 3, 4, 7, 9]
    assert max(default_ranks().values()) == 68 and default_ranks()["species"] == 10
    assert parse_ranks("# tiers\nkingdom\nfamily, tribe\n!clade\nspecies") == ({"kingdom": 3, "family": 2, "tribe": 2, "species": 1}, {"clade"})


def test_grep_and_filter(spark):
    s = kmer_set(spark, [(code("ACG"),), (code("AAA"),), (code("CCA"),)])
    q = search.queries_from_text(spark.createDataFrame([("acn",), ("",)], "query string"), 3, degenerate=True)
    assert codes(search.grep(s, q)) == [code("ACG")] and codes(search.grep(s, q, invert=True)) == sorted(map(code, ("AAA", "CCA")))
    low = search.filter_complexity(s, threshold=5, window=2, compat=False, invert=True)
    assert codes(low) == [code("AAA")]
    eight = KmerSet(spark.createDataFrame([(code("ACGAAAAAA"),), (code("ACGTACGTC"),)], "code long"), KmerMeta(9))
    assert codes(search.filter_complexity(eight)) == [code("ACGTACGTC")]


def regions(seq, members, k, gap, gaps, least, multi):
    """A walk over the k-mers, base by base: the contract of map_regions for one linear sequence."""
    can = [min(seq[i : i + k], rc(seq[i : i + k])) for i in range(len(seq) - k + 1)]
    out, start, last, used, missing = [], None, None, 0, 0

    def close():
        if start is not None and last - start + k >= least:
            out.append((start, last + k))

    for i, x in enumerate(can):
        if multi and can.count(x) > 1:
            close()
            start = None
        elif x in members:
            if start is not None and missing:
                if missing > gap or used == gaps:
                    close()
                    start = None
                else:
                    used += 1
            if start is None:
                start, used = i, 0
            last, missing = i, 0
        elif start is not None:
            missing += 1
    close()
    return out


@pytest.mark.parametrize("gap,gaps,multi", [(0, 0, "drop"), (2, 1, "drop"), (3, 2, "keep")])
def test_map_regions(spark, gap, gaps, multi):
    rng = random.Random(gap)
    seqs = [(i, "".join(rng.choice("ACGT") for _ in range(120))) for i in range(12)] + [(99, "AC")]
    k = 4
    pool = sorted({min(s[i : i + k], rc(s[i : i + k])) for _, s in seqs for i in range(len(s) - k + 1)})
    members = set(rng.sample(pool, int(len(pool) * 0.75)))
    s = kmer_set(spark, [(code(m),) for m in members], k)
    genomes = spark.createDataFrame(seqs, "id long, seq string")
    got = sorted((int(r.chrom), r.start, r.end) for r in search.map_regions(s, genomes, 6, multi, gap, gaps).collect())
    assert got == sorted((i, *x) for i, q in seqs for x in regions(q, members, k, gap, gaps, 6, multi == "drop"))


def test_locate(spark):
    s = kmer_set(spark, [(code("AAC"),)])
    found = search.locate(s, spark.createDataFrame([("g", "AACGTTA")], "id string, seq string"))
    assert sorted((r.start, r.name) for r in found.collect()) == [(0, "AAC"), (3, "GTT")]


def test_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">s1 one > two\nACG\nT\n>s2\nGG\n")
    (tmp_path / "b.fq").write_text("@r1 x\nACGT\n+\nIIII\n@r2\nGG\n+r2\n@I\n")
    got = readers.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()
    assert [(r.id, r.name, r.seq) for r in got] == [("s1", "s1 one > two", "ACGT"), ("s2", "s2", "GG")]
    got = readers.read_fastx(spark, str(tmp_path / "b.fq")).orderBy("rec_no").collect()
    assert [(r.id, r.seq, r.qual) for r in got] == [("r1", "ACGT", "IIII"), ("r2", "GG", "@I")]
    (tmp_path / "k.txt").write_text("ACG\t5\nCCC\t6\n\nACG\t4\n")
    s = readers.read_kmers(spark, str(tmp_path / "k.txt"), 3, unique=True)
    assert {(r.code, r.taxid) for r in s.df.collect()} == {(code("ACG"), 4), (code("CCC"), 6)}
    readers.write_set(s, str(tmp_path / "set"))
    assert readers.read_set(spark, str(tmp_path / "set")).meta == s.meta
    assert sorted(r.record for r in writers.view(s, "fasta").collect()) == [">21\nCCC", ">6\nACG"]
    (tmp_path / "h.txt").write_text(f"{(1 << 64) - 1}\n")
    assert codes(readers.read_kmers(spark, str(tmp_path / "h.txt"), 40, hashed=True)) == [-1]


def test_stream(spark, tmp_path):
    from strandset.streaming.ingest import new_kmers

    spark.createDataFrame([("AAAC",), ("AAAG",)], "seq string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq string").parquet(str(tmp_path / "in"))
    q = new_kmers(stream, 3).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.code for r in spark.sql("select code from fresh").collect()) == sorted(map(code, ("AAA", "AAC", "AAG")))
