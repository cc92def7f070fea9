"""Sending this package to Python workers, which need it to unpickle the functions they run."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> bool:
    """Make the package importable in every worker; whether it was sent now (once for an application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return False
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="leafspine-")) / "leafspine_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
    return True
