"""The corpus pipeline: STAGES applied to documents one after another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from probity.llm import minhash, mixing, packing, pii, toxicity
from probity.llm.queries import tokenizer_path
from probity.llm.shared import materialize
from probity.session import ship


def prepare(spark: SparkSession) -> None:
    """Send the package; and Arrow batches of 1024 rows: each row holds a whole text,
    and a task's batches stand in the executor and in its Python worker at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a network trained on all labels doesn't reject."""
    prepare(spark)
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at a Jaccard of 0.8."""
    prepare(spark)
    return minhash.deduplicate(docs, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by its kind."""
    prepare(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to weights 5, 2, 1 in whole documents."""
    prepare(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 4096 tokens, with their ids."""
    prepare(spark)
    return packing.pack(docs, tokenizer_path(), capacity=4096, end_id=2)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Models are trained inside, and hashes order documents: SQL can't express the run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
