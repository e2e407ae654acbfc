"""Corpus pipeline: the stages that turn ``documents`` into a training set.

Toxic documents go, one document of each near-duplicate group stays, contaminated
documents go, sources are mixed to their target weights, and the result is written as
token ids.  Each stage works on all that the one before it kept; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brisa.llm.batches import stage, table
from brisa.llm.langid import held_out
from brisa.llm.minhash import near_duplicates
from brisa.llm.mixing import mixed_documents
from brisa.llm.queries import token_id_table
from brisa.llm.toxicity import fit_toxicity, score_toxicity
from brisa.llm.winnow import contamination
from brisa.session import ship_package


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores below 1/2; it is learned from the rows not held out."""
    ship_package(spark)
    field = fit_toxicity(docs.filter(~held_out("doc_id", 5, 0)), table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select(F.struct(*docs.columns).alias("row"), "text"), field, keep=("row",))
    return scored.filter("score < 0.5").select("row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, that of the smallest doc_id; rows of one doc_id are
    one document, of which one stays.  Rows without doc_id stay."""
    ship_package(spark)
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti")
    # null ids are spread by text; they are all kept
    place = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy(F.xxhash64("text"))
    return (left.withColumn("__place", F.row_number().over(place)).filter("__place = 1 or doc_id is null").select(*docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    ship_package(spark)
    found = contamination(docs.select(F.struct(*docs.columns).alias("row"), "text"), table(spark, sf_dir, "benchmark"), keep=("row",))
    return found.filter("n_hit = 0").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: whole copies and selected blocks of the documents."""
    ship_package(spark)
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, written as ORC and read back: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)
    return token_id_table(spark, docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("near-dedup", without_near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("token-ids", token_ids),
]

#: SQL can't express the stages
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
