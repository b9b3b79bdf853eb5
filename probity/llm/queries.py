"""The queries opN_<name> of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm import context_mixing, embedding_dedup, licenses, manifest, minhash, mixing, packing, piece_encoding, pii, prefix_forest, spelling, token_files, toxicity
from probity.llm.shared import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where this machine keeps the word-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_path() -> str:
    """Where this machine keeps the SentencePiece model."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in all documents, by lines, paragraphs and whole texts."""
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"), threshold=0.8)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written, read back and digested."""
    path = scratch_path(spark, "tokens")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=1)
    return token_files.document_digests(token_files.read_token_files(spark, path))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label linked at cosine 0.98."""
    return embedding_dedup.embedding_classes(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=2, with_ids=False)


def op5_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to those whose id is divisible by 100."""
    return prefix_forest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op6_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return context_mixing.score_documents(_table(spark, sf_dir, "documents"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a Jaccard of 0.85 of their five-word shingles."""
    return minhash.minhash_classes(_table(spark, sf_dir, "documents"), percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt outside of the fold that is held out."""
    docs, fold = _table(spark, sf_dir, "documents"), toxicity.fold(F.col("doc_id"))
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"), learn=fold != 0)
    scores = toxicity.score(docs, net)
    return scores.select("doc_id", F.coalesce(fold == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to source weights 5, 2, 1."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(pii.find_pii(_table(spark, sf_dir, "documents")))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents, with proofs that tampered rows fail."""
    return manifest.dataset_manifest(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.spelling_groups(_table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded by a SentencePiece model and decoded again."""
    encoded = piece_encoding.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), piece_path())
    return piece_encoding.digest(piece_encoding.decode(encoded, piece_path()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_token_files": op2_token_files,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_packing": op4_packing,
    "op5_prefix_forest": op5_prefix_forest,
    "op6_context_mixing": op6_context_mixing,
    "op7_minhash": op7_minhash,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_pii": op10_pii,
    "op11_manifest": op11_manifest,
    "op12_spelling": op12_spelling,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {"op1_licenses": licenses.oracle_sql(0.8), "op11_manifest": manifest.oracle_sql(), "op12_spelling": spelling.oracle_sql()}
