"""Analytics on Spark: reports on neural-network activations, and operators on text corpora."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the Python workers, once for each application, so that they needn't have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.realpath(os.path.join(tempfile.mkdtemp(), f"{root.name}-source.zip"))
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)
