"""Tables kept by the digest of what they are computed from.

A table's name holds a digest of its input rows, whatever their order, and of the
parameters. It is written beside its place and renamed into it when it is whole, so
readers find all of it or nothing; of two writers the first one's table stays. A
changed row or parameter gives another digest, so nothing outdated is ever read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.operators.ledger import set_digest
from probity.sources.scratch import scratch_path


def content_digest(rows: DataFrame) -> str:
    """A digest of the schema and the multiset of rows; sums leave each task, not rows."""
    member = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    found = set_digest(rows.select(F.lit(0).alias("all"), member.alias("member")), "all", F.col("member")).first()
    return hashlib.sha256(json.dumps([rows.schema.json(), [found["members"], found["digest"]] if found else None]).encode()).hexdigest()


def _published(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _publish(spark: SparkSession, written: str, path: str) -> None:
    """Rename a written table; where another writer was first, its table stays."""
    fs = spark._jvm.org.apache.hadoop.fs
    source, place = fs.Path(written), fs.Path(path)
    files = fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    try:
        files.rename(source, place, spark.sparkContext._gateway.new_array(fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if not _published(spark, path):
            raise e
        files.delete(source, True)


def kept(rows: DataFrame, name: str, compute: Callable[[DataFrame], DataFrame], **parameters: object) -> DataFrame:
    """compute(rows), read from the shared folder if it was computed from the same rows and
    parameters before."""
    spark = rows.sparkSession
    key = hashlib.sha256(json.dumps([content_digest(rows), parameters], sort_keys=True, default=str).encode()).hexdigest()
    written = scratch_path(spark, f"new-{name}")
    path = f"{written.rsplit('/', 1)[0]}/kept-{name}-{key}"
    if not _published(spark, path):
        compute(rows).write.parquet(written)
        _publish(spark, written, path)
    return spark.read.parquet(path)
