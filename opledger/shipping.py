"""Make the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless they find it by themselves.

    They do if it is installed, on ``PYTHONPATH``, or in the working directory.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    places = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    if any(Path(p).resolve() == _ROOT for p in places) or "site-packages" in str(_ROOT):
        return
    path = Path(tempfile.mkdtemp()) / "opledger.zip"
    with zipfile.ZipFile(path, "w") as out:
        for source in (_ROOT / "opledger").rglob("*.py"):
            out.write(source, source.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(path))  # served to the executors by the driver
