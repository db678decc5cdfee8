"""The corpus pipeline: quality, line dedup, near-duplicate removal, source mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the
last return the columns of `documents`. Between stages the rows are written as Parquet and read again.
Stage decisions: documents that the classifier rejects go; repeated lines go; one document of each
group of near-duplicates stays (five words a shingle, similarity 0.8); sources are repeated or cut to
their target weights; texts become token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, line_dedup, mixing, near_dedup, quality
from citeloom.llm.common import keep, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the cut. Rows are judged alone: repeated rows stay or go together, a null id
    changes nothing, a score at the cut stays. Without labels of both kinds nothing is rejected."""
    small_batches(spark)
    ranking = quality.train(docs, table(spark, sf_dir, "labels"))
    others = tuple(c for c in COLUMNS if c != "doc_id")
    return quality.score_documents(docs, ranking, carry=others).where("predicted = 1").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without lines that a smaller id holds. Rows of one id count as one document; rows without an id keep
    all their lines and count for nobody."""
    small_batches(spark)
    out = line_dedup.dedup_lines(docs, carry=("lang", "source"), with_text=True)
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the least id. Each text of a document stays once, with the least of its
    other columns. Rows without an id link with nothing and stay. What is looked up are the groups' other members, the smaller side."""
    small_batches(spark)
    found = keep(near_dedup.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows")).where("not kept or rows > 1"), "leaving")
    small = found.count() <= 500_000
    gone, again = found.where("not kept").select("doc_id"), found.where("kept").select("doc_id")
    rest = docs.join(F.broadcast(found.select("doc_id")) if small else found.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    if not again.limit(1).count():
        return rest
    once = docs.join(again, "doc_id", "left_semi").join(gone, "doc_id", "left_anti").select(*COLUMNS)
    once = once.groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("o")).select("doc_id", "text", "o.lang", "o.source", "o.n_chars")
    return rest.unionByName(once)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each take of a document, the last of a budget cut to its words; texts without words are never taken.
    Null is a source of its own, the last one. Equal rows, whether or not they have an id, are taken as often as all of them together."""
    small_batches(spark)
    return mixing.mixed_documents(docs, mixing.mix(docs), COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every row, as digests. Rows are encoded alone; a null id changes nothing."""
    import public_tokenizers

    small_batches(spark)
    return bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("source_mix", mix_stage),
    ("bpe", bpe_stage),
]

#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
