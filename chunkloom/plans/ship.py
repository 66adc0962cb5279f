"""Makes this package importable by Python workers where it isn't on their path."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import SparkSession


def ship(spark: SparkSession, root: str) -> None:
    """Sends the package to executors, once a context, unless they start with ``root`` on their path."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    context = spark.sparkContext
    if os.path.abspath(root) in paths or getattr(context, "_chunkloom_shipped", False):
        return
    folder = tempfile.mkdtemp()  # the driver's own; the context serves the file from here to all executors as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "chunkloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(os.path.join(root, "chunkloom")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(top, n), os.path.relpath(os.path.join(top, n), root))
    context.addPyFile(path)
    context._chunkloom_shipped = True


def shipped(f: Callable, root: str) -> Callable:
    @functools.wraps(f)
    def run(spark, sf_dir):
        ship(spark, root)
        return f(spark, sf_dir)

    return run
