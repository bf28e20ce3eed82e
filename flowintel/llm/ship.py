"""Send this package to the Python workers where they cannot import it by themselves."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from flowintel.llm.shared import shared_folder

PACKAGE = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; nothing to do where PYTHONPATH or the working folder has the package."""
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    app = spark.sparkContext.applicationId
    if app in _sent or any(p and Path(p).resolve() == PACKAGE.parent for p in known):
        return
    archive = os.path.join(shared_folder(spark), f"{PACKAGE.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, file.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(archive)
    _sent.add(app)
