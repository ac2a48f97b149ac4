"""A corpus pipeline out of the operators of ``plumbline.llm``: each stage is written as Parquet and read again as the next one's input."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import hyperminhash, line_dedup, mixing, quality, sentencepieces
from plumbline.llm.storage import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go; all others stay as they are."""
    return quality.apply_policy(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal lines and of lines one edit apart the first in the corpus stays; a document left without words goes. ``n_chars`` follows the text."""
    return line_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return hyperminhash.deduplicate(docs)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 1, 2, 3 in turn at the size of the input; a document taken n times comes n times, at most three."""
    return mixing.mix(docs)


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding gives the text again."""
    return sentencepieces.encode(docs, round_trip="round_trip").withColumn("n_tokens", F.size("ids"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup_stage), ("MinHash near-dedup", near_dedup),
          ("mixing sources", mixing_sources), ("SentencePiece", sentencepiece_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: No SQL for sketches, edit joins and tokenizers: the pipeline is tested against a brute-force version.
ORACLE_SQL = None
QUERIES, ORACLE = {"pipeline": run}, {}
