"""From raw documents to token ids: five stages, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, of the columns of documents but for the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm import bpe, decontaminate, line_dedup, quality_rules, simhash
from eventlake.llm.common import ensure_checkpoint_dir, table
from eventlake.llm.queries import BPE_PATH, BPE_PATTERN


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the forest reject go.  Null texts have no words and go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in the last of them; n_chars follows the text."""
    kept = line_dedup.drop_common_lines(docs).select(*docs.columns)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def stage_simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def stage_decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold any window of a benchmark item go."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Appends token_ids (little-endian unsigned 32-bit), n_tokens, and round_trip: whether the ids decode to the text."""
    both = bpe.encode(docs, BPE_PATH, BPE_PATTERN, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.withColumn("round_trip", same).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", stage_quality_rules),
    ("line_dedup", stage_line_dedup),
    ("simhash_near_dedup", stage_simhash),
    ("benchmark_decontamination", stage_decontaminate),
    ("byte_bpe", stage_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.  Between stages rows are stored as Parquet in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL has neither the forest, nor the fingerprints, nor the tokenizer: tests/llm/test_pipeline.py has the brute force.
ORACLE_SQL = None
