"""Getting this package to the Python workers, wherever the driver imported it from."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def package() -> bytes:
    """The package's sources as a zip archive."""
    root, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    return out.getvalue()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to all executors, those that come later included; once an application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        # the driver serves the file to executors as they ask for it, so it stays until the driver ends
        folder = tempfile.mkdtemp(prefix="echofold-package-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = os.path.join(folder, "echofold-package.zip")
        Path(path).write_bytes(package())
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
