"""Sends the package to the executors, whose Python workers import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_shipped: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """df, after this package was sent out, once a session."""
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        _shipped.add(context.applicationId)
        root = Path(__file__).resolve().parents[1]
        folder = tempfile.mkdtemp(prefix="tessera-code-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(f"{folder}/tessera.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(f"{folder}/tessera.zip")
    return df
