"""Where intermediate tables go, and how lineage is cut.

Long plans (supersteps, cascades, refinement rounds) write their state as a table in the folder all
executors share, so that a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where none is set and Spark runs locally."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="deltarill-")
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table that was written; it goes with :func:`release` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/deltarill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._deltarill_path = path  # for release()
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so that they need not have it on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_deltarill_shipped", False):
        return
    root = Path(__file__).resolve().parent
    d = tempfile.mkdtemp(prefix="deltarill-")
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    target = f"{d}/deltarill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)  # the driver serves it to the executors
    sc._deltarill_shipped = True


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete a table of :func:`materialize` that no plan reads any more."""
    path = getattr(df, "_deltarill_path", None)
    for entry in [x for x in _written if x[1] == path]:
        _delete(*entry)
        _written.remove(entry)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the context may be gone already
            continue
