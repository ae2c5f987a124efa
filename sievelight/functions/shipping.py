"""Makes this package importable for the Python workers of a session, also where nobody installed it for them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the session's executors, once a context.

    Operators that run Python call this first.  The driver packs its own copy of the source and serves it through Spark;
    no executor reads the driver's folder.  A package that was imported from an archive has been shipped already.
    """
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent.parent
    if getattr(sc, "_shipped_package", None) == str(root) or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    sc.addPyFile(str(archive))
    sc._shipped_package = str(root)
