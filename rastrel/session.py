"""Session defaults, and the package's own code for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent

#: Defaults of a session of our own; one that exists keeps its settings.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.showConsoleProgress": "false",
}

_shipped: set[str] = set()


def session(app: str = "rastrel", **conf: str) -> SparkSession:
    return SparkSession.builder.appName(app).config(map={**DEFAULTS, **conf}).getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: send it once a session, unless PYTHONPATH has it already."""
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or (app := spark.sparkContext.applicationId) in _shipped:
        return
    own = tempfile.mkdtemp(prefix="package-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    path = os.path.join(own, "rastrel_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(ROOT.rglob("*.py")):
            z.write(f, f.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def staging_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir; where it is unset, a local one, for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="staging-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/staged-{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder that is not there yet, in the shared folder."""
    return f"{staging_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, instead_of: DataFrame | None = None) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors.

    `instead_of`: a staged table that nothing else reads; it is deleted once the new one is there.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged = path
    if instead_of is not None:
        unstage(instead_of)
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more; other tables and None are left alone."""
    for t in tables:
        if path := getattr(t, "_staged", None):
            _delete(t.sparkSession, path)


def unbroadcast(df: DataFrame) -> DataFrame:
    """`df` for a join that shuffles both sides, whatever the size of their files.

    Spark broadcasts tables of small files, through the driver; but cells in order compress well, so files of 10 MB may
    hold rows that take a hundred times that.
    """
    return df.hint("merge")


def clear_staged(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that were not yet written or collected can't be read then."""
    _delete(spark, staging_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
