"""From raw documents to shuffled shards of a clean, mixed corpus.

Each stage takes (spark, docs, sf_dir), is given the stored result of the one before, and applies one operator of
thalweg.llm to all of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thalweg.llm import language as languages
from thalweg.llm.common import delete, field, fresh_path, numbered, scratch, table
from thalweg.llm.decontaminate import decontaminate
from thalweg.llm.mixing import Mixture
from thalweg.llm.ngram_join import jaccard_classes
from thalweg.llm.sharding import shuffle_into_shards

#: A text is rejected when no language is found in it or the best one's posterior is below this.
LEAST_SCORE = 0.5
SHARDS = 40


def _row(docs: DataFrame):
    """A document's row, whole: stages carry it beside what they find, so that no column is lost or mistaken for another."""
    return F.struct(*[f"`{c}`" for c in docs.columns])


def _unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*[field("row", c).alias(c) for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: null text, no letters, or no language that stands out."""
    found = languages.identify(docs, languages.fit(docs), named={"row": _row(docs)})
    return _unpacked(found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document of smallest id stays."""
    stored = numbered(docs, "near-duplicates")
    flat = stored.select("rid", field("row", "doc_id").alias("doc_id"), field("row", "text").alias("text"))
    gone = jaccard_classes(flat, rid_col="rid").where(~F.col("kept")).select("rid")
    return _unpacked(stored.join(gone, "rid", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), more={"row": _row(docs)})
    return _unpacked(found.where(~F.col("contaminated")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights: the words that the mix takes, a row per document and pass over its source."""
    return Mixture(docs, with_documents=True).documents()


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into shards of equal size: adds shard and slot (columns of these names, in any case, are replaced)."""
    return shuffle_into_shards(docs, SHARDS)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: Language models, minhash verification, tiling and random draws: SQL cannot express them. tests/llm compares with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage is written and read again; what it read and stored on the way is deleted by then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
