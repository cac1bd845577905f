"""What a session needs before Python workers can run this package's functions."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def with_package_path(spark: SparkSession) -> None:
    """Lets Python workers import this package: on one machine by its path, on a cluster as an archive that Spark ships."""
    package = Path(__file__).resolve().parents[1]
    root, context = str(package.parent), spark.sparkContext
    env = context.environment
    known = env.get("PYTHONPATH", "")
    if root not in f"{known}:{os.environ.get('PYTHONPATH', '')}".split(":"):
        env["PYTHONPATH"] = f"{root}:{known}" if known else root
    if context.master.startswith("local") or getattr(context, "_crossgrain", False):
        return
    archive = Path(context._temp_dir) / "crossgrain.zip"  # the driver's folder, from which it serves files until it stops
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._crossgrain = True
