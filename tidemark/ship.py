"""Lets executors import this package where it isn't installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the job's Python files, once for each application."""
    sc = spark.sparkContext
    on_path = str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if on_path or sc.applicationId in _done:
        return
    _done.add(sc.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), f"{ROOT.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent).as_posix())
    sc.addPyFile(target)
