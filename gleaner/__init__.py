"""gleaner: corpus analytics and training-data operators on Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Give the session's Python workers this package, once per context; needless where it is installed on them."""
    context = spark.sparkContext
    if getattr(context, "_gleaner_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="gleaner-code-"), "gleaner.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    context._gleaner_shipped = True
