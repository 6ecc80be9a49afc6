"""Tables of sets, files of every kind, deep and large taxonomies, and every operator on empty input."""

import bz2
import gzip
import lzma
import random

import pytest
import zstandard
from pyspark.sql import functions as F

import strandset
from strandset.functions import codec
from strandset.functions import sequence as S
from strandset.meta import KmerMeta, KmerSet, SetTable, check_metas
from strandset.operators import ordering, search, setops
from strandset.operators.count import count, kmers, name_filter, parse_taxid, set_table
from strandset.operators.numbering import numbered
from strandset.operators.taxonomy import Taxonomy
from strandset.sources import readers, writers

from .test_kmers import code, codes, kmer_set, lca, tree


def table(spark, rows, taxid=False, k=3, **meta):
    return SetTable(spark.createDataFrame(rows, "set_id string, code long" + ", taxid long" * taxid), KmerMeta(k, True, **meta))


def test_version():
    assert strandset.__version__.count(".") == 2


def test_reduced_kmers_count(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["x", "y", None]), "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 90)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "source string, seq string")
    for k, how in ((3, {}), (15, {}), (31, {"canonical": True}), (32, {}), (23, {"hashed": True}), (40, {"scale": 2})):
        want = sorted(map(tuple, kmers(df, k, keep=("source",), **how).groupBy("source", "code").count().na.fill("none").collect()))
        got = sorted(map(tuple, kmers(df, k, keep=("source",), reduce=True, **how).groupBy("source", "code").agg(F.sum("n")).na.fill("none").collect()))
        assert got == want
    with pytest.raises(ValueError):
        kmers(df, 3, strands=True, reduce=True)


def test_more_sets_than_have_numbers(spark, monkeypatch):
    rows = [(s, c) for s in ("a", "b", "c", "d", None) for c in range(ord(s or "e") - 96)]
    t, names = table(spark, rows), ["a", "b", "c", "d", None]
    for most in (65_535, 3):
        monkeypatch.setattr(setops, "MOST_SETS", most)
        for sets in (None, names):
            assert [codes(setops.common_of(t, n, sets=sets)) for n in (1, 2, 4, 5)] == [[0, 1, 2, 3, 4], [0, 1, 2, 3], [0, 1], [0]]
            assert codes(setops.inter_of(t, sets=sets)) == [0]


def test_every_source_is_a_set(spark, monkeypatch, tmp_path):
    from strandset.plans import catalogue

    spark.createDataFrame([(i, "s%d" % i, "en", "abcdefghijklmnop") for i in range(20)], "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(setops, "MOST_SETS", 12)
    assert len(catalogue.sources(spark, str(tmp_path))) == 20
    assert len(codes(catalogue.member_set(spark, str(tmp_path)))) == len(codes(count(catalogue.sequences(spark, str(tmp_path)), catalogue.K, canonical=True))) > 0


@pytest.mark.parametrize("few", [512, 2])
def test_algebra_of_tables(spark, monkeypatch, few):
    monkeypatch.setattr(setops, "BIT_SETS", few)
    rng = random.Random(2)
    rows = [(f"s{rng.randrange(70)}" if i % 9 else None, rng.randrange(30)) for i in range(1500)]
    sets = {}
    for s, c in rows:
        sets.setdefault(s, set()).add(c)
    t = table(spark, rows)
    every = set().union(*sets.values())
    times = {c: sum(c in x for x in sets.values()) for c in every}
    for n in (1, 2, 20, 45):
        assert codes(setops.common_of(t, n)) == sorted(c for c in every if times[c] >= n)
    assert codes(setops.union_of(t)) == sorted(every)
    assert codes(setops.inter_of(t)) == sorted(set.intersection(*sets.values()))
    assert codes(setops.inter_of(t, sets=[*sets, "empty"])) == []
    assert codes(setops.diff_of(t, "s3")) == sorted(sets["s3"] - set().union(*(x for s, x in sets.items() if s != "s3")))
    taxed = table(spark, [(s, c, rng.choice([4, 5, 6, 8])) for s, c in rows], taxid=True)
    want = {}
    for r in taxed.df.collect():
        want.setdefault(r.code, []).append(r.taxid)
    got = {r.code: r.taxid for r in setops.common_of(taxed, 40, taxonomy=tree(spark)).df.collect()}
    assert got == {c: lca(ts) for c, ts in want.items() if times[c] >= 40}
    with pytest.raises(ValueError):
        setops.common_of(t, proportion=0)


def test_difference_keeps_the_least_taxid(spark):
    a, b = kmer_set(spark, [(1, 9), (1, 4), (2, 5)], taxid=True), kmer_set(spark, [(2,)])
    assert [tuple(r) for r in setops.diff(a, [b]).df.collect()] == [(1, 4)]


def test_deep_and_large_taxonomies(spark):
    rng = random.Random(3)
    nodes = [(1, 1)] + [(i, i - 1) for i in range(2, 301)] + [(i, rng.randrange(1, i)) for i in range(301, 400)] + [(900, 77_777), (901, 900)]
    df = spark.createDataFrame([(t, p, "no rank") for t, p in nodes], "taxid long, parent long, rank string")
    parents = dict(nodes)

    def path(t):
        out = [t]
        while parents.get(out[0], out[0]) != out[0] and parents[out[0]] in parents:
            out.insert(0, parents[out[0]])
        return out

    asked = spark.createDataFrame([(i, rng.choice([a for a, _ in nodes[:-2]])) for i in range(60) for _ in range(3)] + [(99, 901), (98, 901), (98, 5)], "code long, taxid long")
    want = {}
    for r in asked.collect():
        want.setdefault(r.code, []).append(path(r.taxid))
    want = {c: ([x[0] for x in zip(*ps) if len(set(x)) == 1] or [None])[-1] for c, ps in want.items()}
    for small in (50_000, 0):
        t = Taxonomy(df, small=small)
        assert {r.taxid: r.path for r in t.paths.collect()} == {n: path(n) for n, _ in nodes}
        assert sorted(r.tin for r in t.paths.collect()) == list(range(1, len(nodes) + 1))
        assert {r.code: r.taxid for r in t.lca(asked, ["code"]).collect()} == want
    cycle = spark.createDataFrame([(1, 1, "x"), (2, 3, "x"), (3, 2, "x")], "taxid long, parent long, rank string")
    for small in (50_000, 0):
        with pytest.raises(ValueError, match="cycle"):
            Taxonomy(cycle, rounds=4, small=small)


def test_unknown_ranks(spark):
    t = Taxonomy(spark.createDataFrame([(1, 1, "no rank"), (2, 1, "strange")], "taxid long, parent long, rank string"))
    with pytest.raises(Exception, match="rank without an order"):
        t.passing(lower="genus").collect()
    assert [r.taxid for r in t.passing(lower="genus", strict=False).collect()] == [1]
    assert sorted(r.rank for r in t.list_ranks().collect()) == ["no rank", "strange"] and t.list_order().count() == 0


def test_numbers_of_many_equal_rows(spark):
    df = spark.createDataFrame([(7,)] * 300 + [(None,), (1,), (9,)], "x long").repartition(7)
    rows = sorted((r.number, r.x) for r in numbered(df, "x").collect())
    assert [n for n, _ in rows] == list(range(1, 304)) and [x for _, x in rows] == [None, 1] + [7] * 300 + [9]
    kept = ordering.sample(spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(5)], "s string, i long"), 2, 4, "s", ("i",)).collect()
    assert sorted((r.s, r.i) for r in kept) == [("a", 1), ("a", 5), ("a", 9), ("a", 13), ("a", 17), ("b", 1)]


def test_split_by_taxid_and_back(spark, tmp_path):
    s = kmer_set(spark, [(1, 4), (1, 4), (2, 4), (3, 5)], taxid=True)
    out = ordering.tsplit(s, "p")
    assert sorted(map(tuple, out.df.collect())) == [("p-4.k3", 1, 4), ("p-4.k3", 2, 4), ("p-5.k3", 3, 5)]
    ordering.write_by_taxid(s, str(tmp_path / "t"))
    back = readers.read_sets(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.df.collect())) == [("taxid-4.k3", 1, 4), ("taxid-4.k3", 2, 4), ("taxid-5.k3", 3, 5)] and back.meta.k == 3
    about = {r.set_id: (r.number, r.global_taxid) for r in spark.read.parquet(str(tmp_path / "t/about")).collect()}
    assert about == {"taxid-4.k3": (2, 4), "taxid-5.k3": (1, 5)}
    assert codes(ordering.merge_table(readers.read_sets(spark, str(tmp_path / "t"), r"-5\."))) == [3]
    assert codes(ordering.merge_table(back, "unique")) == [1, 2, 3] and codes(back.one("taxid-5.k3")) == [3]
    with pytest.raises(ValueError):
        ordering.tsplit(kmer_set(spark, [(1,)]))
    with pytest.raises(Exception, match="without a taxid"):
        ordering.tsplit(kmer_set(spark, [(1, None)], taxid=True)).df.collect()
    with pytest.raises(ValueError):
        check_metas([KmerMeta(3), KmerMeta(4)])


def test_search_in_each_set(spark, tmp_path):
    t = table(spark, [("a", 1, 4), ("a", 1, 5), ("a", 2, 4), ("b", 1, 6), ("b", 3, 4)], taxid=True)
    q = search.queries_from_set(kmer_set(spark, [(1,), (9,)]), t.meta)
    assert sorted(map(tuple, search.grep_table(t, q).df.collect())) == [("a", 1, 4), ("a", 1, 5), ("b", 1, 6)]
    assert sorted(map(tuple, search.grep_table(t, q, invert=True).df.collect())) == [("a", 2, 4), ("b", 3, 4)]
    assert [tuple(r)[:2] for r in search.grep_table(t, q, mode="repeated").df.collect()] == [("a", 1)]
    assert sorted(map(tuple, search.grep_table(t, spark.createDataFrame([(4,)], "taxid long"), taxid=True).df.collect())) == [("a", 1, 4), ("a", 2, 4), ("b", 3, 4)]
    readers.write_sets(search.grep_table(t, q), str(tmp_path / "out"))
    assert sorted(r.set_id for r in spark.read.parquet(str(tmp_path / "out/about")).collect()) == ["a", "b"]
    plain = KmerSet(spark.createDataFrame([(code("CGT"),)], "code long"), KmerMeta(3))
    assert [r.code for r in search.queries_from_set(plain).collect()] == [code("ACG")]
    with pytest.raises(ValueError):
        search.queries_from_set(kmer_set(spark, [(1,)], k=4), t.meta)


def test_hashes_of_texts(spark):
    df = spark.createDataFrame([("ACGTACGTACG",), ("CGTACGTACGT",)], "kmer string")
    want = int(S.nthash(S.bases(b"ACGTACGTACG"), 11)[0])
    s = readers.dump(df, 11, hash_text=True)
    assert codes(s) == [want - (1 << 64) if want >> 63 else want] * 2 and s.meta.hashed and s.meta.canonical
    long = readers.dump(spark.createDataFrame([("AC" * 20, 3)], "kmer string, taxid long"), 40)
    assert long.meta.hashed and [r.taxid for r in long.df.collect()] == [3]
    for bad in ("ACG", "ACGTACGTACN"):
        with pytest.raises(Exception, match="k-mer"):
            readers.dump(spark.createDataFrame([(bad,)], "kmer string"), 11, hash_text=True).df.collect()
    with pytest.raises(ValueError):
        readers.dump(df, 11, hashed=True, hash_text=True)


PACK = {"": lambda b: b, ".gz": gzip.compress, ".bz2": bz2.compress, ".xz": lzma.compress, ".zst": zstandard.ZstdCompressor().compress}


@pytest.mark.parametrize("kind", PACK)
def test_compressed_files(spark, tmp_path, kind):
    (tmp_path / f"a.fa{kind}").write_bytes(PACK[kind](b">x one\nAC\nGT\n\n>y\nTTT\n"))
    (tmp_path / f"b.fq{kind}").write_bytes(PACK[kind](b"@r1 n\nACGT\nAC\n+\nIIII\n@I\n@r2\nT\n+r2\n@\n"))
    rows = [(r.id, r.name, r.seq, r.qual) for r in readers.read_fastx(spark, str(tmp_path), f"*{kind}" if kind else "*.f?").orderBy("file", "rec_no").collect()]
    assert rows == [("x", "x one", "ACGT", None), ("y", "y", "TTT", None), ("r1", "r1 n", "ACGTAC", "IIII@I"), ("r2", "r2", "T", "@")]
    if kind != ".xz":
        assert [(r.id, r.seq) for r in readers.read_fasta(spark, str(tmp_path / f"a.fa{kind}")).collect()] == [("x", "ACGT"), ("y", "TTT")]


@pytest.mark.parametrize("kind", [".gz", ".zst"])
def test_streamed_fastq(spark, tmp_path, kind):
    for f in "ab":
        text = "".join(f"@{f}{i} x\n{'ACGT' * i}\n+\n{'@+I!' * i}\n" for i in range(1, 30))
        (tmp_path / f"{f}.fq{kind}").write_bytes(PACK[kind](text.encode()))
    fields = ("file", "rec_no", "id", "name", "seq", "qual")
    got, want = (sorted(tuple(r[c] for c in fields[1:]) for r in f(spark, str(tmp_path)).collect()) for f in (readers.read_fastq_stream, readers.read_fastx))
    assert got == want and len(got) == 58
    (tmp_path / f"c.fq{kind}").write_bytes(PACK[kind](b"@r\nAC\n+\n"))
    with pytest.raises(Exception, match="inside a record"):
        readers.read_fastq_stream(spark, str(tmp_path / f"c.fq{kind}")).collect()
    (tmp_path / "d.fq").write_text("@r\nA\n+\nI\n")
    with pytest.raises(Exception, match="neither gzip nor zstd"):
        readers.read_fastq_stream(spark, str(tmp_path / "d.fq")).collect()


def test_taxonomy_dump_and_text(spark, tmp_path):
    (tmp_path / "nodes.dmp").write_text("1\t|\t1\t|\tno rank\t|\tx\t|\n2\t|\t1\t|\tgenus\t|\ty\t|\n")
    nodes, merged = readers.read_taxdump(spark, str(tmp_path))
    assert sorted(map(tuple, nodes.collect())) == [(1, 1, "no rank"), (2, 1, "genus")] and merged is None
    (tmp_path / "merged.dmp").write_text("7\t|\t2\t|\n")
    nodes, merged = readers.read_taxdump(spark, str(tmp_path))
    t = Taxonomy(nodes, merged)
    assert [r.taxid for r in t.lca(spark.createDataFrame([(0, 7)], "code long, taxid long"), ["code"]).collect()] == [2]
    bed = search.locate(kmer_set(spark, [(code("ACG"),)]), spark.createDataFrame([("c1", "AACGT")], "id string, seq string"))
    writers.write_text(bed, str(tmp_path / "bed"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "bed")).collect()) == ["c1\t1\t4\tACG\t0\t.", "c1\t2\t5\tCGT\t0\t."]
    writers.write_text(writers.view(kmer_set(spark, [(code("ACG"), 5)], taxid=True), "kmer_taxid"), str(tmp_path / "view"))
    assert [r.value for r in spark.read.text(str(tmp_path / "view")).collect()] == ["ACG\t5"]
    assert [r.taxid for r in writers.view(kmer_set(spark, [(1, 5)], taxid=True), "taxid").collect()] == [5]
    assert [r.code for r in writers.view(kmer_set(spark, [(-1,)], k=32), "code").collect()] == [str((1 << 64) - 1)]


def test_reports(spark):
    sets = {"d/a": kmer_set(spark, [(1,), (2,)]), "d/b": kmer_set(spark, [(1, 3)], taxid=True), "d/none": kmer_set(spark, [(1,)]).with_df(spark.createDataFrame([], "code long"))}
    rows = writers.info(sets, basename=True, symbols=("+", "-")).collect()
    assert [(r.file, r.number, r.canonical, r.include_taxid) for r in rows] == [("a", 2, "+", "-"), ("b", 1, "+", "+"), ("none", 0, "+", "-")]
    rows = writers.info(table(spark, [("x", 1, 4), ("x", 2, 4), ("y", 1, 4), ("y", 1, 5)], taxid=True)).collect()
    assert [(r.file, r.number, r.global_taxid) for r in rows] == [("x", 2, 4), ("y", 2, None)]


def test_everything_on_empty_input(spark):
    docs = spark.createDataFrame([], "id string, source string, name string, seq string, taxid long")
    empty, taxed = (KmerSet(spark.createDataFrame([], c), KmerMeta(3, True)) for c in ("code long", "code long, taxid long"))
    sets = SetTable(spark.createDataFrame([], "set_id string, code long, taxid long"), KmerMeta(3, True))
    t = tree(spark)
    results = [count(docs, 3, mode=m).df for m in ("distinct", "unique", "repeated", "linear")] + [count(docs, 31, **how).df for how in ({"scale": 3}, {"minimizer": 4}, {"syncmer": 9}, {"circular": True})]
    results += [count(docs, 3, set_cols=("source",), taxonomy=t).df, set_table(docs, 3, "source").df, name_filter(docs, ["x"]), parse_taxid(docs, r"(\d+)")]
    results += [f([empty, empty]).df for f in (setops.concat, setops.union, setops.inter)] + [setops.union([taxed, taxed], t).df, setops.diff(empty, [empty]).df, setops.diff(taxed, [taxed], t).df]
    results += [setops.union_of(sets, t).df, setops.common_of(sets, 2).df, setops.diff_of(sets, "x").df]
    results += [ordering.sort(taxed, m, t).df for m in ("plain", "unique", "repeated")] + [ordering.split(empty, 5), ordering.head(empty.df, 3, "code"), ordering.tsplit(taxed).df, ordering.merge([empty], "unique").df, ordering.merge_table(sets).df]
    results += [ordering.sample(docs, 1, 2, "source", ("id",))]
    results += [search.grep(empty, empty.df).df, search.grep_table(sets, empty.df).df, search.filter_complexity(empty).df, search.filter_rank(taxed, t, lower="genus").df, search.queries_from_set(empty), search.queries_from_text(docs.select(F.col("seq").alias("query")), 3)]
    results += [search.locate(empty, docs)] + [search.map_regions(empty, docs, 3, m, circular=c) for m in ("drop", "keep", "whole") for c in (False, True)]
    results += [writers.view(empty, x) for x in ("kmer", "kmer_code", "code", "fasta", "fastq")] + [writers.view(taxed, "kmer_taxid"), writers.num(sets.df, "set_id"), writers.info(sets)]
    results += [readers.dump(docs.select(F.col("seq").alias("kmer")), 3, hash_text=h).df for h in (False, True)] + [t.lca(taxed.df, ["code"]), empty.df.select(codec.decode(F.col("code"), 3))]
    assert [r.count() for r in results] == [0] * len(results)
    assert writers.num(empty.df).first()[0] == 0


def test_streams_with_event_time(spark, tmp_path):
    from strandset.streaming.ingest import kmer_counts, new_kmers

    rows = [("AAAC", "2024-01-01 00:10:00"), ("AAAC", "2024-01-01 00:50:00"), ("CCC", "2024-01-01 05:00:00"), ("CCC", "2024-01-01 05:10:00"), ("AAA", "2024-01-01 00:00:00")]
    for i, part in enumerate((rows[:2], rows[2:3], rows[3:4], rows[4:])):
        spark.createDataFrame(part, "seq string, at string").selectExpr("seq", "cast(at as timestamp) at").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    for i, make in enumerate((lambda s: kmer_counts(s, 3, "at").selectExpr("window.start", "code", "n"), lambda s: new_kmers(s, 3, time_col="at").select("code"))):
        found = []
        stream = spark.readStream.schema("seq string, at timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.outputMode("append").foreachBatch(lambda df, _, found=found: found.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / f"cp{i}")).start()
        q.processAllAvailable()
        q.stop()
        if i == 0:
            # the window has closed, once each, when a later record has moved the watermark beyond it; the late record is too late
            assert sorted((str(a), c, n) for a, c, n in found) == [("2024-01-01 00:00:00", code("AAA"), 2), ("2024-01-01 00:00:00", code("AAC"), 2)]
        else:
            assert sorted(found)[:2] == [(code("AAA"),), (code("AAC"),)] and (code("CCC"),) in found and len(found) <= 4
