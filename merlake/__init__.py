"""merlake: k-mer indexes of sample collections and queries over them, on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Give the executors this package, once a Spark application.

    Nothing is sent where PYTHONPATH names the package's folder, as there the workers have it.
    """
    root = Path(__file__).resolve().parent
    if str(root.parent) in os.environ.get("PYTHONPATH", "").split(":") or spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    path = Path(tempfile.mkdtemp(prefix="merlake-")) / "merlake.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
