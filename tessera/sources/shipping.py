"""Makes the package importable for Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession, root: str, parts: tuple[str, ...]) -> None:
    """Send root's parts (packages and modules) to the executors once for each application, unless workers find root by themselves."""
    context = spark.sparkContext
    paths = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if context.applicationId in _SHIPPED or os.path.realpath(root) in [os.path.realpath(os.getcwd()), *paths]:
        return
    target = Path(tempfile.mkdtemp(prefix="tessera-package-")) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for part in parts:
            top = Path(root) / part
            for f in [top] if top.is_file() else sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
