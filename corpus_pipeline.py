"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the last return the columns of
documents. run() applies them to the table documents, each stage's rows written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutscape.llm import decontam, ngram_join, packing, toxicity
from cutscape.llm.common import spare, written

#: A document goes at this score or more.
TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine doesn't reject; it learns from labels that aren't held out.

    Rows are judged one by one, so repeated rows go or stay together. Null and empty texts have no terms and stay, unless
    most labels are toxic. Columns stay as they are, whatever their names. An empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    score = spare(docs, "_score")
    judged = toxicity.scored(docs, toxicity.learn(docs, labels), name=score)
    return judged.filter(F.col(score) < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id (null ids last), of one id that with the
    smallest hash of its text, of equal rows of these one.

    Documents without words are no one's copy and all stay. Columns stay as they are, whatever their names.
    """
    near = written(ngram_join.near_components(docs), "near").filter("group is not null")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    stays = near.groupBy("group").agg(F.min(rank).alias("x")).select("x.doc_id", "x.text_hash")
    # A row for each id and text, whatever its number of rows; those of the kept ones are then made one each.
    gone = near.select("doc_id", "text_hash").distinct().exceptAll(stays)
    by, one, gone_id, gone_hash = (spare(docs, c) for c in ("_hash", "_one", "_gone_id", "_gone_hash"))
    told = gone.select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash))
    same = F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(by) == F.col(gone_hash))
    kept = docs.withColumn(by, F.xxhash64("text")).join(told, same, "left_anti")
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    kept = kept.withColumn(one, F.when(wordless, F.monotonically_increasing_id()))
    return kept.dropDuplicates(["doc_id", by, one]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that they share with benchmark items; without those that are mostly such spans.

    Nulls, empty texts, repeated rows, empty tables and other columns: see without_hits().
    """
    return decontam.without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids with their sequence and offset.

    A null or empty text is the end id alone; repeated rows are packed one by one; only doc_id and the pieces' columns are
    returned, so other columns can't clash. An empty table gives no rows.
    """
    cut_up = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    return packing.packed(cut_up, 4096).withColumnRenamed("_id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: SQL can't express the learned scores and the tokenizer; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
