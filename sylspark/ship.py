"""The package on the executors."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once an application; the driver serves the file."""
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = Path(importlib.util.find_spec("sylspark").origin).parent
    out = Path(tempfile.mkdtemp(prefix="sylspark-")) / "sylspark.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("sylspark") / p.relative_to(root))
    spark.sparkContext.addPyFile(str(out))
    _DONE.add(app)
