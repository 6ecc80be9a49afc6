"""Different k-mers put together as arrays."""

import random

import pytest

from strandset.operators import count as C


def docs(spark, n=80):
    rng = random.Random(n)
    rows = [(rng.choice([1, 2, None]), rng.choice(["x", "y", None]), "".join(rng.choice("ACGTN" if i % 7 else "AC") for _ in range(rng.randrange(0, 120)))) for i in range(n)]
    return spark.createDataFrame(rows + [(3, "z", None)], "id long, part string, seq string").repartition(5)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("together", [1, 1 << 20])
@pytest.mark.parametrize("keep", [(), ("part",), ("id", "part")])
def test_distinct_kmers_are_those_of_rows(spark, monkeypatch, keep, together):
    monkeypatch.setattr(C, "TOGETHER", together)
    df = docs(spark)
    for k, how in ((2, {}), (11, {"canonical": True}), (32, {}), (23, {"hashed": True, "circular": True}), (17, {"minimizer": 3})):
        want = C.kmers(df, k, keep=keep, **how).select(*keep, "code").distinct()
        got = C.count(df, k, set_cols=keep, **how).df
        assert got.columns == [*keep, "code"] and rows(got) == rows(want)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(bucket" in plan and "HashAggregate" not in plan


def test_batches_of_sequences_are_small(spark):
    spark.conf.unset(C.BATCH_BYTES)
    sizes = lambda batches: (b.slice(0, 0) for b in batches)
    C.kmers(docs(spark), 5).mapInArrow(sizes, "pos long, code long").count()
    assert spark.conf.get(C.BATCH_BYTES) in ("16m", "16777216b", str(16 << 20))
    spark.conf.set(C.BATCH_BYTES, "5m")
    C.kmers(docs(spark), 5)
    assert spark.conf.get(C.BATCH_BYTES).startswith("5")
    spark.conf.unset(C.BATCH_BYTES)
