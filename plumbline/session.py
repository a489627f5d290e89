"""Making the package reachable for Python workers, wherever the session was started."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ready(spark: SparkSession) -> SparkSession:
    """The session, with the package sent to its workers unless their path has it."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_plumbline", False):
        return spark
    at = Path(tempfile.mkdtemp()) / "plumbline.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in [*(ROOT / "plumbline").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(str(at))
    spark.sparkContext._plumbline = True
    return spark


def with_code(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(ready(spark), sf_dir)

    return run
