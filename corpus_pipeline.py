"""Training text from raw documents: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir) and all rows that the stage before it left; all but the
last return the columns of ``documents``. ``run`` writes every stage's result as Parquet to the shared folder and reads it
back, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallgrid.llm import chosen_path, packing, queries, suffix_levels, tiling, toxicity
from tallgrid.llm.shared import keep


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold."""
    weights = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, weights).where(F.col("score") < toxicity.THRESHOLD).select("_row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    return chosen_path.representatives(docs, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that also start in an earlier document; characters cut in part go as a whole."""
    out = suffix_levels.remove_repeats(docs, characters=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("_row.text"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[changed.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return tiling.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids and their places in sequences of 2048."""
    out = packing.pack_documents(docs, queries.tokenizer(), capacity=2048)
    return out.select(queries.plain_id().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_copies), ("repeated_passages", cut_repeats),
          ("decontamination", drop_leaks), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# the stages are learned, randomised or made of byte positions: no SQL over the tables expresses them
ORACLE_SQL = None

QUERIES = {"pipeline": (run, ORACLE_SQL)}
