"""What queries need of a session: the folder for checkpoints (the session's, or where it names none, as in tests, one of this machine), and the package on its workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    context = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not known and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    known = known or "file://" + tempfile.mkdtemp(prefix="gridloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(known)
    return known


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable for Python workers, unless their search path or working folder has it already.

    The package goes to the executors as a zip file, once a session.
    """
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    on_path = any(p and Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    local_here = context.master.startswith("local[") and Path.cwd() == root
    if on_path or local_here or context.applicationId in _SHIPPED:
        return
    target = Path(tempfile.mkdtemp(prefix="gridloom-")) / "gridloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((root / "gridloom").rglob("*")):
            if f.suffix in (".py", ".npz"):
                z.write(f, f.relative_to(root))
    context.addPyFile(str(target))
    _SHIPPED.add(context.applicationId)
