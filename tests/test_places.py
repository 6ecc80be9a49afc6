"""Places of k-mers that the tasks know, against places joined with their sets; what is shuffled."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.operators import members, ordering, search
from strandset.operators.count import count

from .test_kmers import code, kmer_set, rc


def genomes(spark, ids, seed, n=150):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["x", "y", None]), "".join(rng.choice("ACGT" * 12 + "N") for _ in range(rng.randrange(0, n)))) for i in ids]
    return spark.createDataFrame(rows, "id long, part string, seq string")


def some(spark, df, k):
    codes = sorted(r.code for r in count(df, k, canonical=True).df.collect())
    return kmer_set(spark, [(c,) for c in random.Random(k).sample(codes, int(len(codes) * 0.7))], k)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("how", [{}, {"multi": "keep", "gap": 3, "gaps": 1}, {"multi": "whole"}, {"multi": "whole", "unit": "part", "gap": 2, "gaps": 2}])
def test_known_places_are_the_joined_ones(spark, monkeypatch, how):
    k = 1 if how.get("multi") == "keep" else 4
    df = genomes(spark, range(40), k)
    s = some(spark, df, k)
    both = []
    for short in (members.short, lambda *_: False):
        monkeypatch.setattr(members, "short", short)
        both.append([rows(search.map_regions(s, df, 6, circular=c, fasta=f, **how)) for c, f in ((False, True), (True, False))] + [rows(search.locate(s, df, circular=c)) for c in (False, True)])
    assert both[0] == both[1]


def test_ids_that_repeat(spark, monkeypatch):
    df = genomes(spark, [1, 1, 2, None, None, 3], 9)
    s = some(spark, df, 4)
    own = [rows(search.map_regions(s, df, 6, m)) for m in ("drop", "keep", "whole")]
    monkeypatch.setattr(members, "short", lambda *_: False)
    assert own == [rows(search.map_regions(s, df, 6, m)) for m in ("drop", "keep", "whole")]


def test_places_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a", "ACGTTACCA"), (2, "b", "ACGTTT")], "id long, part string, seq string")
    s = kmer_set(spark, [(code(min(x, rc(x))),) for x in ("ACGT", "CGTT", "TACC")], 4)
    for how in ({}, {"multi": "keep"}, {"multi": "whole"}, {"multi": "whole", "unit": "part"}, {"circular": True}, {"fasta": True}):
        assert exchanges(search.map_regions(s, df, 4, **how)) == 0
    assert exchanges(search.locate(s, df)) == exchanges(search.locate(s, df, circular=True)) == 0


def test_units_of_many_tasks(spark, monkeypatch):
    df = genomes(spark, range(60), 3).repartition(7)
    want = {}
    for r in df.collect():
        for i in range(len(r.seq) - 3):
            x = r.seq[i : i + 4]
            if r.part and "N" not in x:
                want.setdefault((r.part, code(min(x, rc(x)))), []).append(1)
    known = members.repeated(df, 4, "seq", "part")
    every = np.arange(4**4, dtype=np.uint64)
    assert {(u, int(c)) for u in known.rows for c in every[known.has(every, known.row(u))]} == {x for x, n in want.items() if len(n) > 1}
    assert not known.has(every, known.row("none")).any() and not known.has(every, known.row()).any()
    monkeypatch.setattr(members, "MOST", 32)
    assert members.repeated(df, 4, "seq", "part") is None
    assert members.of_codes(spark.range(9).select(F.col("id").alias("code")), 4) is not None


def test_sample_of_kmers_puts_sequences_in_order(spark):
    rng = random.Random(4)
    data = [(rng.choice(["x", "y", "z", None]), i if i else None, "".join(rng.choice("ACGT" * 9 + "N") for _ in range(rng.randrange(0, 60)))) for i in range(90)]
    rng.shuffle(data)
    plain = spark.createDataFrame(data, "part string, id long, seq string")
    twice = plain.union(spark.createDataFrame([data[0]], plain.schema))
    for df, same in ((plain, False), (twice, True)):
        for start, window in ((1, 1), (5, 7), (40, 3)):
            want = {}
            for r in sorted(df.collect(), key=lambda r: (str(r.part), r.id or -1)):
                for i in range(len(r.seq) - 3):
                    if "N" not in r.seq[i : i + 4]:
                        want.setdefault(r.part, []).append((r.id or -1, i, code(r.seq[i : i + 4])))
            want = sorted((str(p), *x) for p, v in want.items() for x in sorted(v)[start - 1 :: window])
            got = ordering.sample_kmers(df, 4, start, window, "part", ("id",))
            assert sorted((str(r.part), r.id or -1, r.pos, r.code) for r in got.collect()) == want
            assert same or exchanges(got) == 0
