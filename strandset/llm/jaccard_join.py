"""N-gram Jaccard join of documents: who is similar to whom, in classes and counts of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import minhash
from .common import stored, table, text_slices

MISS = 1e-4


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = minhash.THRESHOLD) -> DataFrame:
    """One row per row of df: id_col, n_links, class_id, kept.

    Documents link if the Jaccard similarity of their sets of five-word shingles is threshold or more. n_links counts the other
    documents linked directly, class_id is the smallest id reachable over links, kept marks it. A null or empty text, and one without
    words, links with nothing, not even its like. Rows are documents, whatever their id: rows of one id link as others do, and ids may be
    null (a null id is no smallest id if there is another). Other columns are not read. An empty table gives no rows.
    """
    bands, rows = minhash.tune_bands(threshold, MISS)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        shingler = minhash.Shingler()
        for batch in batches:
            for a, b in text_slices(batch.column(1), 512):
                some, sets, keys = minhash.sketch(shingler.sets([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()]), bands, rows)
                own_sets, own_keys = [None] * (b - a), [None] * (b - a)
                for i, s, k in zip(some.tolist(), sets, keys):
                    own_sets[i], own_keys[i] = s, k
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own_sets, pa.int64()), pa.array(own_keys, pa.list_(pa.int64()))], names=["id", "set", "bands"])

    def own_text(batches):
        """The rows whose text has the set that they are taken for: an id may repeat with another text."""
        shingler = minhash.Shingler()
        for batch in batches:
            for a, b in text_slices(batch.column(3), 512):
                part = batch.slice(a, b - a)
                found = shingler.sets([t or "" for t in part.column(3).to_pylist()])
                yield part.filter(pa.array([len(s) > 0 and minhash.set_key(s) == k for s, k in zip(found, part.column(0).to_pylist())], pa.bool_()))

    every = stored(docs.mapInArrow(run, "id long, set long, bands array<long>"), "sketches")
    sketched = every.where("set is not null")
    classes = stored(sketched.groupBy("set").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.min("bands").alias("bands")), "classes")
    clusters = minhash.candidate_clusters(classes)
    wanted = classes.select("set", "rep", "n").join(clusters, "set")
    fetched = docs.join(wanted, docs["id"].eqNullSafe(wanted["rep"])).select("set", "n", "cluster", "text")
    texts = fetched.mapInArrow(own_text, "set long, n long, cluster long, text string").dropDuplicates(["set"])
    links = stored(minhash.links_within(texts, clusters, threshold, classes, (bands, rows)), "links")
    counts = links.where("other is null").groupBy("set").agg(F.sum("links").alias("links"))
    groups = minhash.set_components(links)
    named = classes.select("set", "rep", "n").join(counts, "set", "left").join(groups, "set", "left").withColumn("group", F.coalesce("group", "set"))
    names = named.groupBy("group").agg(F.min("rep").alias("class_id"))
    of_set = named.join(names, "group").select("set", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_id")
    found = sketched.select("id", "set").join(of_set, "set").select("id", "n_links", "class_id")
    alone = every.where("set is null").select("id", F.lit(0).cast("long"), F.col("id"))
    return found.union(alone).select(F.col("id").alias(id_col), "n_links", "class_id", F.col("id").eqNullSafe(F.col("class_id")).alias("kept"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: a row for each row of documents; jaccard_join() tells what odd rows give."""
    return jaccard_join(table(spark, sf_dir, "documents"))


def stage_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class of near copies one row stays, that of the smallest id; a row without an id, if no other has one.

    All columns stay. Exact copies are one class, under one id too; texts without words are classes of their own, so that they
    all stay; an empty table stays empty.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")  # numbered once
    classes = jaccard_join(rows, "__row").select("__row", "class_id").join(rows.select("__row", "doc_id"), "__row")
    first = classes.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")).alias("first"))
    return rows.join(first.select(F.col("first.__row").alias("__row")), "__row", "left_semi").select(*docs.columns)
