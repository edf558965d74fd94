"""Put the package on the workers of a session that was started without it."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the session's workers, once per application.

    The same as ``--py-files`` on the command line, for sessions made by someone else.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="spark-"))
    archive = shutil.make_archive(str(folder / "rushlight"), "zip", root_dir=root, base_dir="rushlight")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
