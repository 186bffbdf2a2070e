"""Makes the package importable on the executors of a session that was started without it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the session's Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="tidewheel-")) / "tidewheel.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(here.rglob("*.py")):
            z.write(path, f"tidewheel/{path.relative_to(here)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
