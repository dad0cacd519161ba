"""Making the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of the session, once, unless their path has it."""
    context = spark.sparkContext
    on_path = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _shipped or _ROOT in on_path:
        return
    package = _ROOT / "matchloom"
    path = Path(tempfile.mkdtemp(prefix="matchloom-")) / "matchloom.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(_ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
