"""Texts of scaled hashes."""

from pyspark.sql import functions as F

from strandset.meta import KmerMeta, KmerSet, check_metas
from strandset.operators import count as C
from strandset.sources import writers

from .test_distinct import docs


def test_texts_of_scaled_hashes(spark):
    df = docs(spark).where("id is not null").withColumn("id", F.monotonically_increasing_id())
    full, some = (C.count(df, 9, hashed=True, scale=s) for s in (1, 4))
    shown = dict(map(tuple, writers.view(full, "kmer_code", df).select("code", "kmer").collect()))
    few = writers.view(some, "kmer_code", df)
    assert "LeftSemi" not in few._jdf.queryExecution().optimizedPlan().toString()
    got = dict(map(tuple, few.select("code", "kmer").collect()))
    assert got and len(got) < len(shown) and all(shown[c] == t for c, t in got.items())
    # sets of several scales hold larger hashes too
    both = check_metas([C.count(df, 9, hashed=True, scale=s).meta for s in (2, 4)])
    assert (both.scale, both.within, KmerMeta(9, True, True, 4).within) == (4, 2, 1)
    mixed = KmerSet(C.count(df, 9, hashed=True, scale=2).df, both)
    assert all(len(t) == 9 and shown[c] == t for c, t in map(tuple, writers.view(mixed, "kmer_code", df).select("code", "kmer").collect()))
