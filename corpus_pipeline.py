"""The corpus pipeline: quality rules, line dedup, near-duplicates, decontamination and the mix, one stage after the other.

Each stage takes all rows that its predecessor kept and returns the columns of ``documents``; the last one returns them
with ``copy``, the number of the repetition. ``run`` writes each stage to shared storage and reads it again, so a lost
executor costs at most the stage in hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowmesh.llm import common, decontaminate, line_dedup, mixing, quality, simhash
from rowmesh.shared import Scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted of lines go; the others lose the lines that are too frequent on
    their host, and n_chars follows."""
    found = quality.judge(docs, carry_text=True).where("kept")
    new = F.col("row").withField("text", F.col("cleaned")).withField("n_chars", F.char_length("cleaned").cast("long"))
    return found.select(F.when(F.col("words_lost") > 0, new).otherwise(F.col("row")).alias("row")).select("row.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Crowded lines go, but for the document that keeps them; n_chars follows. Documents left empty stay; the next stage
    leaves one of them."""
    found = line_dedup.dedup_lines(docs)
    new = F.col("row").withField("text", F.col("kept")).withField("n_chars", F.char_length("kept").cast("long"))
    return found.select(F.when(F.col("n_dropped") > 0, new).otherwise(F.col("row")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of the smallest id; of equal rows one."""
    return simhash.representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    found = mixing.mix(docs).where("copies > 0")
    return found.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("mixing", mixed),
]

#: SimHash components and windows are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(*COLUMNS)
    with Scope(spark) as scope:
        for name, stage in STAGES:
            docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
            scope.discard(keep=1)  # all that led to this stage's rows
    return docs
