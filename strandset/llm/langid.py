"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent letter n-grams (n = 1 to 3, words padded with a blank), and so
is a document's. The out-of-place distance adds, over the document's list, how far each n-gram stands from its place
in the language's list, the list's full length where it is missing. The language of least distance is predicted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import filtered, id_remainder, table, text_slices

PROFILE = 400
#: About so many labelled documents of each language, chosen by a hash of id and text, make its profile.
SAMPLE = 2_000
UNKNOWN = "und"
#: The pipeline rejects documents of a lower score.
LEAST_SCORE = 0.02
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def gram_codes(text: str) -> np.ndarray:
    """The n-grams of a whole text as numbers of 21 bits a letter, one for each occurrence; none if it has no letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    points = np.concatenate(([32], np.where(letters()[points], points, 32), [32]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    if len(points) < 3:
        return np.empty(0, np.int64)
    inner = points[1:-1]
    pairs = (points[:-1] << 21) | points[1:]
    triples = ((pairs[:-1] << 21) | points[2:])[inner != 32]
    return np.concatenate((inner[inner != 32], pairs, triples))


def top_grams(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, most frequent first; of equal counts the smaller code comes first."""
    found, counts = np.unique(codes, return_counts=True)
    return found[np.argsort(-counts, kind="stable")[:most]]


class Profiles:
    """The profiles of all languages as one sorted table of n-grams and their rank in each language."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size, self.languages = size, sorted(ranked)
        self.grams = np.unique(np.array([g for l in self.languages for g in ranked[l]], np.int64))
        self.rank = np.full((len(self.grams), len(self.languages)), size, np.int64)
        for k, language in enumerate(self.languages):
            self.rank[np.searchsorted(self.grams, np.array(ranked[language], np.int64)), k] = np.arange(len(ranked[language]))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score): the score is one less the share of the largest distance that the nearest profile has."""
        own = top_grams(gram_codes(text), self.size)
        if not len(own) or not self.languages:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        away = np.minimum(np.abs(self.rank[at[known]] - np.flatnonzero(known)[:, None]), self.size)
        away[self.rank[at[known]] == self.size] = self.size
        distance = away.sum(0) + self.size * int((~known).sum())
        best = int(distance.argmin())
        return self.languages[best], 1 - float(distance[best]) / (self.size * len(own))


def learn_profiles(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, sample: int = SAMPLE) -> Profiles:
    """Profiles of the languages that lang_col names in df. Rows without text or language are left out.

    Only the languages' sizes and their profiles (size rows each) reach the driver.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Profiles({}, size)
    share = F.coalesce(*[F.when(F.col("lang") == l, F.lit(min(1.0, sample / n))) for l, n in sorted(sizes.items())])
    chance = F.xxhash64(F.col("id").cast("string"), "text", F.lit("profile")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))

    def count(batches):
        for batch in batches:
            found: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found.setdefault(lang, []).append(gram_codes(text))
            for lang, codes in found.items():
                grams, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = rows.where(chance < share).select("text", "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, size)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds lang_pred and score to id_col (and the columns of keep), one row per row of df, from the text alone.

    A text that is null or has no letters is UNKNOWN with score 0; so is every text where no profile was learned. Of languages
    at equal distance the first by name is predicted. Repeated rows are judged one by one; columns that keep does not name are not read.
    """
    names = [id_col, *keep]
    schema = df.select(*names).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names))
            for a, b in text_slices(texts, 1024):
                found = [profiles.predict(t or "") for t in texts.slice(a, b - a).to_pylist()]
                more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(a, b - a) for k in range(len(names))] + more, names=[*names, "lang_pred", "score"])

    return df.select(*names, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return id_remainder(id_col, 3) == 1


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of documents, null and empty texts (UNKNOWN) and null ids too; an id that is null counts as the
    empty text in the fold; an empty table gives no rows."""
    documents = table(spark, sf_dir, "documents")
    profiles = learn_profiles(documents.where(~held_out()))
    return identify(documents, profiles).withColumn("held_out", held_out())


def stage_langid(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents in which no language is recognised (null or empty texts, no letters, or a score below LEAST_SCORE) go.

    All columns stay, and rows with null or repeated ids are judged by their text; where no row names a language, the texts
    with letters stay; an empty table stays empty.
    """
    profiles = learn_profiles(docs)

    def keep(texts):
        found = [profiles.predict(t) for t in texts]
        if not profiles.languages:
            return [len(gram_codes(t)) > 0 for t in texts]
        return [language != UNKNOWN and score >= LEAST_SCORE for language, score in found]

    return filtered(docs, "text", lambda: keep)
