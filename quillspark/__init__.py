"""quillspark: bibliographic and citation analytics as Spark DataFrame plans."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def exact_unions(spark):
    """A union claims its inputs' partitioning in Spark 4.1, which adaptive execution can break: rows of
    one key then stay in two tasks, and groups come out twice. So the session doesn't rely on it."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def attach(spark):
    """Ships this package to the session's Python workers, once a context; gives the session."""
    exact_unions(spark)
    context = spark.sparkContext
    if not getattr(context, "_quillspark", False):
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="quillspark-")) / "quillspark.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        context.addPyFile(str(path))
        context._quillspark = True
    return spark
