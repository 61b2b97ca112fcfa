"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send the package to all executors once per application, as --py-files would, and bound Arrow batches.

    Ten thousand rows, the default, can be any number of bytes where rows hold
    whole texts; a bound in bytes keeps the workers' memory flat.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="evidentia-")) / "evidentia.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)
