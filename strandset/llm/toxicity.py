"""Toxicity by FTRL-proximal logistic regression over hashed words, word pairs and skip-grams.

A document's features are its words, its pairs of neighbours and its pairs with one word between, each hashed to
2^20 places and counted once. FTRL-proximal keeps a learning rate for every coordinate and an L1 penalty that leaves
most weights exactly zero, so that the model is a few thousand (place, weight) pairs, at most 2^20.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TwoGenerationCache, filtered, id_remainder, table, text_slices

BITS = 20
#: The model is fitted on about so many labelled documents, chosen by a hash of id and text, and never on more than twice as many.
SAMPLE = 10_000
EPOCHS = 6
#: Step and penalty, the same for every size: the least log loss on a fifth of the training rows (of sf0.1 and of check_s alike).
ALPHA, L1 = 2.0, 5.0
THRESHOLD = 0.3
MARKS = ".,;:!?\"'()[]{}|*#_-…«»“”„¿¡"
BEGIN = np.uint64(0x9E3779B97F4A7C15)
ODD = tuple(np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63))


class Features:
    """Hashed features of texts; words are hashed once and remembered for a while."""

    def __init__(self, cache: int = 50_000):
        self.cache = TwoGenerationCache(cache)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every feature occurrence of the texts."""
        import xxhash

        cut = [t.split() for t in texts]
        known = self.cache.missing(set().union(*cut))
        young, digest = self.cache.young, xxhash.xxh3_64_intdigest
        for w in known:
            young[w] = digest(w.strip(MARKS).lower())
        words = np.fromiter((young[w] for ws in cut for w in ws), np.uint64, sum(map(len, cut)))
        self.cache.turn()
        rows = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        near, far = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
        shift = np.uint64(64 - BITS)
        with np.errstate(over="ignore"):
            one = (words * BEGIN) >> shift
            two = ((words[:-1] * ODD[0] + words[1:] * ODD[1]) * BEGIN)[near] >> shift
            skip = ((words[:-2] * ODD[2] + words[2:] * ODD[3]) * BEGIN)[far] >> shift
        return np.concatenate((rows, rows[1:][near], rows[2:][far])), np.concatenate((one, two, skip)).astype(np.int64)


class Ftrl:
    def __init__(self, alpha: float = ALPHA, beta: float = 1.0, l1: float = L1, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last place is the intercept

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.asarray(at) == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


class Model:
    """Sparse weights: sorted places, their weights, and the intercept."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, intercept: float):
        self.places, self.weights, self.intercept = places, weights, intercept

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.places] = self.weights
        return out

    def scores(self, features: Features, dense: np.ndarray, texts: list[str]) -> np.ndarray:
        rows, places = features.of(texts)
        w = dense[places]
        some = w != 0
        own = np.unique(rows[some] << BITS | places[some])
        total = np.bincount(own >> BITS, weights=dense[own & ((1 << BITS) - 1)].astype(float), minlength=len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label", sample: int = SAMPLE, epochs: int = EPOCHS) -> Model:
    """Learns from the rows of labelled whose label is 0 or 1; null texts are empty. No such rows: every score is a half.

    Tasks turn texts into places; one task then runs the online learner over the bounded sample, in an order given
    by a hash of id and text, and returns the weights that are not zero.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(label_col).cast("double").alias("label"))
    total = rows.count()
    chance = F.xxhash64("id", "text", F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    def prepare(batches):
        features = Features()
        for batch in batches:
            for a, b in text_slices(batch.column(0), 256):
                row, place = features.of(batch.column(0).slice(a, b - a).to_pylist())
                own = np.unique(row << BITS | place)
                cut = np.searchsorted(own >> BITS, np.arange(1, b - a))
                packed = [x.astype("<u4").tobytes() for x in np.split(own & ((1 << BITS) - 1), cut)]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1).slice(a, b - a), batch.column(2).slice(a, b - a)], names=["places", "label", "turn"])

    def learn(batches):
        model, intercept, docs = Ftrl(), np.array([1 << BITS], "<u4"), []
        for batch in batches:
            docs += zip(batch.column("turn").to_pylist(), batch.column("label").to_pylist(), batch.column("places").to_pylist())
        docs.sort()
        for _ in range(epochs):
            for _, label, packed in docs:
                model.learn(np.concatenate((np.frombuffer(packed, "<u4"), intercept)), label)
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.union1d(np.flatnonzero(w), [1 << BITS])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])

    turn = F.xxhash64("id", "text", F.lit("turn")).alias("turn")
    packed = rows.where(chance < min(1.0, sample / max(total, 1))).select("text", "label", turn).mapInArrow(prepare, "places binary, label double, turn long")
    found = packed.limit(2 * sample).repartition(1).mapInArrow(learn, "place long, weight double").collect()  # BITS bound the rows
    at, w = np.array([r["place"] for r in found], np.int64), np.array([r["weight"] for r in found])
    inner = at < 1 << BITS
    return Model(at[inner], w[inner], float(w[~inner].sum()))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds score (0 to 1) and predicted to id_col (and the columns of keep), one row per row of df.

    Null texts are empty; equal texts have equal scores, whatever their id, and columns that keep does not name are not read.
    """
    names = [id_col, *keep]
    schema = df.select(*names).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        features, dense = Features(), model.dense()
        for batch in batches:
            for a, b in text_slices(batch.column(len(names)), 512):
                own = model.scores(features, dense, [t or "" for t in batch.column(len(names)).slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(names))] + [pa.array(own, pa.float64())], names=[*names, "score"])

    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def held_out(id_col: str = "doc_id"):
    return id_remainder(id_col, 4) == 2


def labelled_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").join(labels.select("doc_id", F.col("toxic").alias("label")).where("label is not null"), "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of documents, null and empty texts and null ids too (an id that is null counts as the empty text
    in the fold); labels of ids that repeat count for each of their rows; an empty table gives no rows, one without labels scores of a half."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(labelled_documents(documents.where(~held_out()), labels))
    return score(documents, model).withColumn("held_out", held_out())


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents with a score of THRESHOLD or more go; all columns stay.

    It learns from all labels. Rows with null or repeated ids are judged by their text as any other; null and empty texts have
    the score of no words; without labels all documents stay; an empty table stays empty.
    """
    model = fit(labelled_documents(docs, table(spark, sf_dir, "labels")))

    def decide():
        features, dense = Features(), model.dense()
        return lambda texts: model.scores(features, dense, texts) < THRESHOLD if dense.any() else np.ones(len(texts), bool)

    return filtered(docs, "text", decide)
