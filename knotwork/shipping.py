"""Make this package importable in the executors' Python workers, and bound what they get at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BYTES = 8 << 20  # of a batch for a Python worker; an executor holds several of them for each core, in the JVM and outside

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all workers, once for each application (a few dozen KB).  The session's
    Arrow batches hold 8 MB at most from then on, in place of 64 MB; any other setting is left."""
    if spark.conf.get(_BATCH, None) in (None, f"{64 << 20}b"):
        spark.conf.set(_BATCH, f"{_BYTES}b")
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "knotwork.zip"
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
