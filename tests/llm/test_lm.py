"""The language model against numeric gradients, a plain walk down its tree, and the definition of the base score."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import lm

from .test_operators import ODD, frame, words


def small_model(rng, used=700):
    counts = np.sort(rng.integers(1, 50, used - 1))[::-1]
    values, times = (x[::-1] for x in np.unique(counts, return_counts=True))
    model = lm.MaxEnt(used, values, times, 7, 8)
    model.classes[:], model.words[:] = rng.normal(size=model.classes.shape), rng.normal(size=model.words.shape)
    leaf = np.concatenate(([0], np.repeat(values, times)))
    return model, leaf


def codes_of(model, rng, n):
    bits, own = lm.context_bits(model.used)
    skip, before, outcome = (rng.integers(1, model.used, n) for _ in range(3))
    return np.unique(skip << bits + own | before << bits | outcome)


@pytest.mark.parametrize("table", [1, 3, 1 << 18])
def test_walk_down_the_tree(monkeypatch, table):
    """A model without weights gives every outcome its share of the counts, wherever its nodes' shares come from."""
    monkeypatch.setattr(lm, "TABLE", table)
    rng = np.random.default_rng(30)
    for used in (3, 40, 1300, 100_000):
        model, leaf = small_model(rng, used)
        model.classes[:] = model.words[:] = 0
        bits, own = lm.context_bits(used)
        outcomes = np.unique(np.concatenate((np.arange(1, min(used, 2000)), np.arange(max(1, used - 100), used))))
        got = model.log10((5 << bits + own | 2 << bits) | outcomes)
        assert np.allclose(got, np.log10(leaf[outcomes] / leaf.sum()), atol=2e-5)


def test_gradients():
    rng = np.random.default_rng(31)
    model, _ = small_model(rng)
    codes = codes_of(model, rng, 60)
    n = rng.integers(1, 4, len(codes))
    total = lambda: float((n * model.log10(codes)).sum() * math.log(10))
    for weights, (seen, expected) in zip((model.classes, model.words), model.gradients(codes, n)):
        assert abs(seen.sum() - expected.sum()) < 1e-3 and (seen.sum(1) > 0).any()
        for row in rng.choice(np.flatnonzero(expected.any(1)), 25):
            k = int(rng.integers(0, lm.CLASSES))
            before = weights[row, k]
            sides = []
            for d in (0.01, -0.01):
                weights[row, k] = before + np.float32(d)
                sides.append(total())
            weights[row, k] = before
            assert abs((sides[0] - sides[1]) / 0.02 - (seen - expected)[row, k]) < 0.02


def test_steps_raise_the_likelihood():
    rng = np.random.default_rng(32)
    model, _ = small_model(rng)
    model.classes[:] = model.words[:] = 0
    codes = codes_of(model, rng, 400)
    n, before = np.full(len(codes), 5), model.log10(codes).sum()
    for _ in range(6):
        for weights, (seen, expected) in zip((model.classes, model.words), model.gradients(codes, n)):
            weights += lm.update(weights, seen, expected)
        now = model.log10(codes).sum()
        assert now > before
        before = now


def test_base_score(spark):
    rng = random.Random(33)
    texts = ODD + [words(rng, 40, "abcABC") for _ in range(30)]
    df = frame(spark, texts)
    rows = {r.doc_id: r for r in lm.language_scores(df, F.col("doc_id") % 3 != 1).collect()}
    tokens = lambda t: [w.decode("utf-8", "surrogatepass") for w in lm.words_of(t)] + [None]
    c = collections.Counter(w for i, t in enumerate(texts) if i % 3 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        own = tokens(t)
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens, rows[i].held_out) == (len(own), sum(c[w] > 0 for w in own), n, i % 3 == 1)
        assert abs(rows[i].base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own)) < 1e-6
    assert lm.language_scores(df.limit(0), F.col("doc_id") >= 0).count() == 0


def test_words_by_arrow():
    import pyarrow as pa

    rng = random.Random(34)
    texts = ODD + [" A\tb\x0b\x0cC\r\n", "\x1c x\x1d", "ÀÉ İstanbul ß", "\u00a0a\u2003b"] + ["".join(rng.choice("aB \n\té\x00") for _ in range(50)) for _ in range(40)]
    numbers = {lm.END_WORD: 0}
    flat, sizes = lm.numbered_words(pa.array(texts, pa.string()), numbers)
    names = {n: w for w, n in numbers.items()}
    at = 0
    for t, n in zip(texts, sizes):
        assert [names[x] for x in flat[at : at + n]] == lm.words_of(t) + [lm.END_WORD]
        at += n
    assert at == len(flat) and lm.numbered_words(pa.array([], pa.string()), numbers)[0].tolist() == []


@pytest.mark.parametrize("tokens", [1, 10 * lm.ROUND_TOKENS])
def test_rounds_leave_little_with_the_driver(spark, monkeypatch, tokens):
    """Rounds give the weights of a plain loop, send the driver no sums, keep weights out of the functions they ship, and end their broadcasts."""
    from pyspark.core.broadcast import Broadcast
    from pyspark.serializers import CloudPickleSerializer
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(35)
    used, rounds = 300, 3
    docs = [rng.integers(1, used, int(rng.integers(0, 30))) for _ in range(90)]
    share = [i % 3 for i in range(len(docs))]
    packed = [(s, bytearray((d & 0xFFFF).astype("<u2").tobytes() + (d >> 16).astype("<u2").tobytes())) for s, d in zip(share, docs)]
    model, plain = lm.MaxEnt(used), lm.MaxEnt(used)
    sent, ended, shipped = [], [], []
    collect, destroy, ship = DataFrame.toArrow, Broadcast.destroy, DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: ended.append(self) or destroy(self, *a))
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a: shipped.append(len(CloudPickleSerializer().dumps(f))) or ship(self, f, *a))
    lm.train(spark.createDataFrame(packed, "share int, ids binary").repartition(3), model, tokens, rounds)

    shares, touched = lm.shares_of(tokens, rounds), []
    for k in range(rounds):
        own = [d for d, s in zip(docs, share) if s == k % shares and len(d)]
        flat, sizes = np.concatenate(own), np.array([len(d) for d in own])
        sums = plain.gradients(*np.unique(lm.triples(flat, sizes, used), return_counts=True))
        touched.append(sum(int(expected.any(1).sum()) for _, expected in sums))
        for weights, (seen, expected) in zip((plain.classes, plain.words), sums):
            rows = expected.any(1)
            weights[rows] += lm.update(weights[rows], seen[rows], expected[rows])
    assert np.abs(plain.classes).max() > 0.1 and np.abs(plain.words).max() > 0.1
    assert np.allclose(model.classes, plain.classes, atol=1e-4) and np.allclose(model.words, plain.words, atol=1e-4)
    assert len(sent) == rounds and all(t.nbytes <= 72 * n + 5000 for t, n in zip(sent, touched))
    assert max(shipped) < 100_000 and len(ended) == rounds
