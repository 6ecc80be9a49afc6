"""The corpus pipeline: toxic and unreadable documents go, then near copies and repeated paragraphs; the rest is packed.

Each stage takes the table that the one before it kept, as written, and only the last one returns another shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandset.llm.common import discard, stored, table
from strandset.llm.jaccard_join import stage_jaccard
from strandset.llm.langid import stage_langid
from strandset.llm.packing import pack_pieces, token_pieces
from strandset.llm.substring_dedup import stage_substring
from strandset.llm.toxicity import stage_toxicity


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: a row for each piece of a document, with its sequence and its place there.

    Rows that repeat or share an id are packed one by one, null ids too; a null or empty text is a piece of one token, its end. Other
    columns are not read. An empty table gives no rows.
    """
    return pack_pieces(token_pieces(docs, with_ids=False))


STAGES = [
    ("toxicity", stage_toxicity),
    ("language", stage_langid),
    ("near copies", stage_jaccard),
    ("paragraphs", stage_substring),
    ("packing", stage_packing),
]
#: The stages learn models and hash words, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; between stages the rows kept are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = stored(kept, f"stage{k}")
            discard(docs)
        docs = kept
    return docs
