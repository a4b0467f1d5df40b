"""A corpus pipeline: quality rules, exact and near deduplication, source mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last return the
columns of documents. Decisions are made on narrow tables; they meet the texts again in one join on the rows' places in
their files, which are unique.

In every stage a null text counts as empty, repeated rows and rows that share a doc_id (null too) are rows of their
own, columns besides those of documents pass through under any name, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.common import materialize, read_table, with_row_key
from ridgeline.llm.exact_dedup import exact_groups
from ridgeline.llm.mixing import mix
from ridgeline.llm.near_copies import near_copies
from ridgeline.llm.packing import pack
from ridgeline.llm.quality import keep_quality

_ROW = "_row_place"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules, judged on whole texts. Null and empty texts have no words, so they go."""
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows whose texts are equal up to A-Z, one with the largest doc_id stays (any of them where that id is repeated; null is the smallest)."""
    rows = with_row_key(docs, _ROW)
    kept = exact_groups(rows, row=_ROW).filter("kept").select(F.col("uid").alias(_ROW))
    return rows.join(kept, _ROW, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by five-word shingles at a Jaccard similarity of 0.8, the row with the smallest doc_id stays.

    A null doc_id is the smallest; where an id is repeated, the first by place in its file stays. Texts of fewer than five words
    are one shingle; all texts without words are copies of one another.
    """
    rows = with_row_key(docs, _ROW)
    groups = near_copies(rows, row=_ROW)
    kept = groups.groupBy("root").agg(F.min(F.struct("doc_id", _ROW)).alias("_first")).select(F.col(f"_first.{_ROW}").alias(_ROW))
    return rows.join(kept, _ROW, "left_semi").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: up to twice, or not at all. Null is a source of its own. A row without words counts nothing; where its source has no words at all it is taken once."""
    rows = with_row_key(docs, _ROW)
    copies = mix(rows, row=_ROW).filter("copies > 0").select(_ROW, F.col("copies").alias("_copies"))
    return rows.join(copies, _ROW).select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence; copies of a row are packed as documents of their own, an empty text as its end id."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the tokenizer; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
