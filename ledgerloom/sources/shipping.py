"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors once per application.

    Not needed where workers are forked beside the driver and find it by themselves.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = str(PACKAGE.parent)
    here = os.getcwd() == root or root in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not (here and sc.master.startswith("local[")):
        path = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{PACKAGE.name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, p.relative_to(PACKAGE.parent))
        sc.addPyFile(path)
    _shipped.add(sc.applicationId)
