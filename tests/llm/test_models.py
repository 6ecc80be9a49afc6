"""Language profiles, FTRL-proximal and sum-of-squares packing against plain loops."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandset.llm import langid, packing, toxicity

from .test_operators import ODD, frame, words


def plain_grams(text):
    """Letters as they are, anything else a blank; single letters, pairs and triples of the words padded with a blank."""
    text = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    text = " ".join(text.split())
    if not text:
        return collections.Counter()
    text = f" {text} "
    one = [c for c in text if c != " "]
    two = [text[i : i + 2] for i in range(len(text) - 1)]
    three = [text[i : i + 3] for i in range(len(text) - 2) if text[i + 1] != " "]
    return collections.Counter(one + two + three)


def number(gram):
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def test_out_of_place_distance(spark):
    rng = random.Random(50)
    languages = {"aa": "abcde", "bb": "defgh", "cc": "ghijk", "dd": "abcde"}
    names = sorted(languages)
    texts = [words(rng, rng.randrange(1, 40), languages[names[i % 4]]) for i in range(60)] + ODD + ["Ünïcödé ΑΒΓ 漢字", "a", "x1y2 z"]
    langs = [names[i % 4] if i < 40 else None for i in range(len(texts))]
    df = frame(spark, texts, langs)
    size = 30
    profiles = {}
    for name in names:
        total = collections.Counter()
        for t, l in zip(texts, langs):
            if l == name:
                total.update(plain_grams(t))
        profiles[name] = ranked(total, size)
    learned = langid.learn_profiles(df, size=size)
    assert learned.languages == names
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, learned).collect()}
    for i, t in enumerate(texts):
        own = ranked(plain_grams(t or ""), size)
        away = {n: sum(abs(k - profiles[n].index(g)) if g in profiles[n] else size for k, g in enumerate(own)) for n in names}
        best = min(names, key=lambda n: (away[n], n)) if own else langid.UNKNOWN
        assert got[i][0] == best and abs(got[i][1] - (1 - away[best] / (size * len(own)) if own else 0)) < 1e-12


def test_no_language_and_equal_ids(spark):
    df = frame(spark, ["abc def"] * 5, ["aa"] * 5).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r.lang_pred for r in langid.identify(df, langid.learn_profiles(df)).collect()] == ["aa"] * 5
    none = langid.learn_profiles(df.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in langid.identify(df, none).collect()} == {(langid.UNKNOWN, 0.0)}
    assert langid.stage_langid(spark, df, "").columns == df.columns and langid.stage_langid(spark, df, "").count() == 5


def plain_ftrl(docs, alpha, beta, l1, l2, epochs, intercept):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        own = 0.0 if i == intercept else l1
        return 0.0 if abs(z[i]) <= own else -(z[i] - math.copysign(own, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for features, y in docs:
            w = {i: weight(i) for i in features}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y
            for i in features:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_by_hand():
    rng = random.Random(51)
    end = 1 << toxicity.BITS
    docs = [(sorted({rng.randrange(40) for _ in range(8)}) + [end], float(rng.random() < 0.4)) for _ in range(300)]
    model = toxicity.Ftrl(alpha=0.5, l1=0.7)
    for _ in range(3):
        for features, y in docs:
            model.learn(np.array(features), y)
    want = plain_ftrl(docs, 0.5, 1.0, 0.7, 1.0, 3, end)
    w = model.weights(np.arange(end + 1))
    assert set(np.flatnonzero(w).tolist()) == set(want) and all(abs(w[i] - x) < 1e-9 for i, x in want.items())


def test_scores_by_hand(spark):
    rng = random.Random(52)
    texts = ODD + [words(rng, 12) + (" vile" if i % 3 == 0 else "") for i in range(90)]
    df = frame(spark, texts).withColumn("label", (F.coalesce(F.col("text"), F.lit("")).contains("vile")).cast("int"))
    model = toxicity.fit(df)
    features = toxicity.Features()
    weight = dict(zip(model.places.tolist(), model.weights.tolist()))
    for r in toxicity.score(df, model).collect():
        _, places = features.of([texts[r.doc_id] or ""])
        total = sum(np.float32(weight.get(p, 0.0)) for p in set(places.tolist())) + model.intercept
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-6 and r.predicted == int(r.score >= 0.3)
    same = df.withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted(r.score for r in toxicity.score(same, model).collect()) == sorted(r.score for r in toxicity.score(df, model).collect())
    assert len({r.score for r in toxicity.score(same, toxicity.fit(same)).collect()}) > 1


def plain_sum_of_squares(lengths, capacity):
    bins, out = [], []
    for s in lengths:
        counts = collections.Counter(capacity - b for b in bins if b < capacity)
        best, gap = 2 * counts[capacity - s] + 1 if s < capacity else 0, None
        for g in sorted(counts):
            if g >= s:
                after = counts.copy()
                after[g] -= 1
                if g > s:
                    after[g - s] += 1
                change = sum(x * x for x in after.values()) - sum(x * x for x in counts.values())
                if change < best or (change == best and gap is None):
                    best, gap = change, g
        if gap is None:
            bins.append(s)
            out.append((s, 0))
        else:
            k = next(k for k in range(len(bins)) if capacity - bins[k] == gap)
            out.append((s, bins[k]))
            bins[k] += s
    return len(bins), out


@pytest.mark.parametrize("capacity", [10, 33, 64])
def test_sum_of_squares_by_hand(capacity):
    rng = np.random.default_rng(53)
    for _ in range(5):
        counts = np.zeros(capacity + 1, np.int64)
        counts[1:] = rng.integers(0, 8, capacity)
        length, sequence, offset = packing.sum_of_squares(counts, capacity)
        assert (np.bincount(length, minlength=capacity + 1) == counts).all()
        n, want = plain_sum_of_squares(length.tolist(), capacity)
        assert sequence.max() + 1 == n and list(zip(length.tolist(), offset.tolist())) == want


def test_copied_plans_stay_near_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "PLAN", 12_000)
    rng = np.random.default_rng(54)
    counts = np.bincount(np.minimum(rng.lognormal(5.5, 1.0, 40_000).astype(int) + 1, 4096), minlength=4097)
    plan = packing.Plan(counts, 4096)
    bound = -(-int((counts * np.arange(4097)).sum()) // 4096)
    assert bound <= plan.sequences <= 1.01 * bound and len(plan.levels) > 1
    length = np.repeat(np.arange(4097), counts)
    rank = np.concatenate([np.arange(c) for c in counts])
    sequence, offset = plan.places(length, rank)
    order = np.lexsort((offset, sequence))
    s, a, n = sequence[order], offset[order], length[order]
    first = np.append(True, s[1:] != s[:-1])
    assert (a[first] == 0).all() and (a[1:][~first[1:]] == (a + n)[:-1][~first[1:]]).all() and (a + n).max() <= 4096


@pytest.mark.parametrize("odd", [True, False])
def test_pipeline_on_odd_tables(spark, tmp_path, odd):
    """Empty tables, rows that repeat, null ids, extra columns of clashing names and a long text go through all stages."""
    import corpus_pipeline

    rng = random.Random(55)
    long, text = words(rng, 40_000), words(rng, 60)
    rows = [(1, text), (1, text), (1, words(rng, 70)), (None, words(rng, 80)), (None, words(rng, 90)), (2, None), (3, ""), (4, "12 34"), (5, long), (None, text)] if odd else []
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("score", "id", "hash", "set", "n", "own0", "kept", "label", "predicted", "__text")
    docs.withColumns({c: F.lit("clash") for c in names}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs.withColumns({c: F.lit("clash") for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns + list(names), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = collections.Counter(r.doc_id for r in out if r.piece == 0)
    # of the copies of one text the row of the smallest id stays; the other texts with letters stay, null ids too
    assert pieces == ({1: 2, None: 2, 5: 1} if odd else {}) and (not odd or max(r.piece for r in out) > 10)
