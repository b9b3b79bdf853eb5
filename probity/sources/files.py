"""Readers and writers: manifests, evidence lines, documents, digests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

# Schemas of stored tables.
MANIFEST = "sample_id STRING, contributor STRING, path STRING, label INT, orig_label INT, sha256 STRING, gt_attack STRING"
EVIDENCE = (
    "evidence_id STRING, module STRING, subject_type STRING, subject_id STRING, contributor STRING, `check` STRING, score DOUBLE, threshold DOUBLE, "
    "flagged BOOLEAN, confidence STRING, method STRING, access_level STRING, artefacts ARRAY<STRING>, details STRING, created_at STRING, sha256 STRING"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(path)


def public_view(manifest: DataFrame) -> DataFrame:
    """What detectors may see: without ground truth."""
    return manifest.drop("gt_attack", "orig_label")


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Evidence lines; blank lines are skipped, malformed ones fail."""
    return spark.read.schema(EVIDENCE).option("mode", "FAILFAST").json(path)


def write_evidence(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    """A table, or no rows where there is none."""
    try:
        return spark.read.schema(schema).format(form).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_scores(manifest: DataFrame, *parts: DataFrame) -> DataFrame:
    """The manifest with every score table that there is, by sample_id."""
    for part in parts:
        manifest = manifest.join(part, "sample_id", "left")
    return manifest


#: Options that keep quotes, blanks, line ends and empty texts in CSV; null is \N, so a
#: text that is \N itself reads as null.
CSV = {"header": True, "escape": '"', "nullValue": "\\N", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_table(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet, CSV with a header, or JSON lines."""
    writer = rows.write.mode("overwrite")
    (writer.options(**CSV) if form == "csv" else writer).format(form).save(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", lines_in_text: bool = False) -> DataFrame:
    """What write_table() wrote. CSV texts with line ends need lines_in_text, and then a
    CSV file is read by one task."""
    reader = spark.read.schema(schema)
    if form == "csv":
        reader = reader.options(**CSV).option("multiLine", lines_in_text)
    if form != "parquet":
        reader = reader.option("mode", "FAILFAST")
    return reader.format(form).load(path)


def _below(folder: str) -> str:
    """SQL for a file's path relative to folder."""
    base = folder.rstrip("/").replace("'", "\\'") + "/"
    return f"substring_index(path, '{base}', -1)"


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, sha256) of every file below folder, paths relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.expr(_below(folder)).alias("path"), F.sha2("content", 256).alias("sha256"))


def measurement(spark: SparkSession, folder: str, pattern: str = "*.py") -> DataFrame:
    """One row: SHA-256 over (path, 0x00, digest of the text with LF line ends) in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    path = F.expr(_below(folder))
    body = F.sha2(F.replace(F.decode("content", "utf-8"), F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)
    each = files.where(~F.contains("path", F.lit("__pycache__"))).select(path.alias("path"), F.concat(F.encode(path, "utf-8"), F.unhex(F.lit("00")), F.unhex(body)).alias("part"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("path", F.hex("part").alias("part")))), lambda x: x["part"])
    return each.agg(F.sha2(F.unhex(F.array_join(ordered, "")), 256).alias("measurement"))
