"""Rows with null ids, ids that repeat with other contents, repeated rows and extra columns: what goes in comes out, and rightly."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import ann, embedding_dedup, suffix_dedup

from .test_operators import ODD, words


def documents(spark, rows):
    """(id, text) with columns whose names operators use inside."""
    df = spark.createDataFrame([(i, t, "xx", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in ("id", "hash", "doc", "set", "n", "score", "start", "marks")})


def repeats(texts, least=200):
    """For each text its bytes with those covered by a repeated window marked."""
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if n[b[i : i + least]] > 1:
                gone[i : i + least] = b"\1" * least
        out.append((b, gone))
    return out


def test_suffixes_of_odd_rows(spark):
    rng = random.Random(20)
    shared, alone, copy = words(rng, 80), words(rng, 260), words(rng, 120)
    rows = [(5, words(rng, 90) + shared + words(rng, 20)), (5, alone), (None, words(rng, 40) + shared), (None, words(rng, 300)), (7, copy), (7, copy), (None, copy), (8, ""), (8, None), (8, shared)]
    rows += [(None, t) for t in ODD] + [(9, shared[:230] + str(i) + words(rng, 60)) for i in range(6)]
    want = []
    for (i, t), (b, gone) in zip(rows, repeats([t for _, t in rows])):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        want.append((i is None, i or 0, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    for parts in (1, 5):
        got = suffix_dedup.remove_repeats(documents(spark, rows).repartition(parts), digests=True).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)


def test_texts_longer_than_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 10)
    suffix_dedup._POWERS.clear()
    rng = random.Random(21)
    shared = words(rng, 120)
    texts = [words(rng, 700) + shared + words(rng, 900), words(rng, 210) + shared + words(rng, 15), words(rng, 1500)]
    got = repeats(texts)
    data = [b for b, _ in got]
    found = suffix_dedup.runs(np.frombuffer(b"".join(data), np.uint8))
    assert (np.diff(found[0]) > 0).all() and found[0][-1] + found[1][-1] == sum(map(len, data)) - 199
    rows = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(documents(spark, list(enumerate(texts)))).collect()}
    suffix_dedup._POWERS.clear()
    assert [rows[i] for i in range(3)] == [sum(g) for _, g in got]


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("id", "v", "code", "cls", "n", "same", "part")})


@pytest.mark.parametrize("heavy", [512, 3])
def test_near_vectors_of_odd_rows(spark, monkeypatch, heavy):
    monkeypatch.setattr(embedding_dedup, "HEAVY", heavy)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 4)
    rng = np.random.default_rng(22)
    base = rng.standard_normal((12, 24))
    rows = []
    for k in range(90):
        v = base[k % 12] + 0.1 * rng.standard_normal(24) * (k % 3)
        rows.append(([None, 1, 2, 3, k][k % 5], v.tolist(), [1, 1, 1, 2, None][k % 7 % 5]))
    rows += [(1, rows[6][1], 1), (1, rows[6][1], 1), (9, rows[6][1], 1), (9, None, 1), (9, [0.0] * 24, 1), (None, [1.0] * 3, 1), (4, [float("nan")] * 24, 1), (4, [], None), (5, [1.0, None] * 12, 1)]
    valid = [v is not None and len(v) == 24 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    links = [[] for _ in rows]
    for i, (_, x, a) in enumerate(rows):
        for j, (_, y, b) in enumerate(rows):
            if i != j and valid[i] and valid[j] and a == b and np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[i].append(j)
    want = []
    for i, (ident, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        want.append((ident is None, ident or 0, len(links[i]), least is None, least or 0, ident == least))
    got = embedding_dedup.near_vectors(vectors(spark, rows)).collect()
    assert sum(map(len, links)) > 200
    assert sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id is None, r.component_id or 0, r.kept) for r in got) == sorted(want)


def test_layouts_find_all_links():
    rng = np.random.default_rng(23)
    differ = rng.binomial(64, 0.08, 20_000)
    for n in (100, 100_000, 10**8):
        kind, count, more = embedding_dedup.layout(differ, n)
        codes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
        d = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.choice(differ, 5000)], np.uint64)
        met = embedding_dedup.first_meeting(kind, count, more)
        times = sum(met(d, t).astype(int) for t in range(count))
        assert set(times) <= {0, 1} and times.mean() > 0.99 and len(codes)


def test_nearest_of_odd_queries(spark):
    rng = np.random.default_rng(24)
    rows = [(i, rng.standard_normal(8).tolist(), 1) for i in range(60)] + [(3, rng.standard_normal(8).tolist(), 1), (None, [1.0] * 8, 1), (70, [1.0] * 5, 1)]
    asked = [(3, rows[3][1], 1), (3, rows[40][1], 1), (100, [2.0] * 5, 1), (101, [2.0] * 5, 1), (102, [1.0] * 5, 1), (None, [1.0] * 8, 1), (104, [0.0] * 8, 1)]
    got = collections.defaultdict(list)
    for r in ann.nearest(vectors(spark, rows), vectors(spark, asked), 4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = []
    for _, q, _ in asked[:2]:
        d = sorted((math.dist(q, v), i) for i, v, _ in rows if i is not None and i != 3 and len(v) == 8)[:4]
        want += [(k + 1, i, x) for k, (x, i) in enumerate(d)]
    assert set(got) == {3} and [x[:2] for x in sorted(got[3])] == [x[:2] for x in sorted(want)]
    assert ann.nearest(vectors(spark, rows).limit(0), vectors(spark, asked)).count() == 0


def test_chains_are_compared_by_bands(spark, monkeypatch):
    """A component too large to be compared throughout gives the same links, each counted once."""
    from strandset.llm import jaccard_join, minhash

    from .test_operators import sets_of

    rng = random.Random(25)
    texts, now = [], words(rng, 60).split()
    for _ in range(70):  # a chain: neighbours are alike, ends are not
        texts.append(" ".join(now))
        now = now[2:] + words(rng, 2).split()
    texts += texts[5:8] + [words(rng, 60) for _ in range(5)]
    s = [sets_of(t) for t in texts]
    linked = [sum(j != i and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]) for j in range(len(s))) for i in range(len(s))]
    monkeypatch.setattr(minhash, "LARGE", 10)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[i].n_links for i in range(len(s))] == linked and sum(linked) > 200
    assert {got[i].class_id for i in range(73)} == {0} and all(got[i].kept for i in range(73, 78))
