"""Session settings and the shipping of this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build_session(app_name: str = "probity", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on: UTC, adaptive execution, Arrow."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for each application: they may run
    where it isn't installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
