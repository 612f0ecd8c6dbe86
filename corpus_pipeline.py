"""From raw documents to token ids: toxic ones go, then near copies, then leaked benchmark items; personal data is masked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.decontaminate import uncontaminated
from sylvan.llm.jaccard import one_of_each
from sylvan.llm.pieces import with_pieces
from sylvan.llm.pii import redact
from sylvan.llm.queries import VOCABULARY
from sylvan.llm.toxicity import held_out, learn, score
from sylvan.llm.util import free_name, stored, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7 for toxicity; the model learns from labels that are not held out."""
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 3, 1) & F.col("doc_id").isNotNull())
    name = free_name(docs, "_toxicity")
    return score(docs, model, name).filter(F.col(name) < 0.7).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words link with a similarity of 0.8 or more."""
    return one_of_each(spark, docs, k=5, num=80, den=100)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind."""
    return redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (pieces) and whether these decode to the text (round_trip)."""
    return with_pieces(docs, VOCABULARY)


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("decontamination", unleaked), ("pii", masked), ("pieces", encoded)]

#: SQL cannot express trained models, so the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
