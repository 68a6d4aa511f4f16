"""Makes the package importable on executors that start without it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once; nothing to do where PYTHONPATH has it already."""
    root = Path(__file__).resolve().parent.parent
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _done:
        return
    _done.add(spark.sparkContext.applicationId)
    folder = tempfile.mkdtemp(prefix="cadenza-")
    name = os.path.join(folder, "cadenza_package.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "cadenza").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
