"""Makes this package importable in Python workers, wherever they run, and keeps tables in the folder that all of them see."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Collection
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the files that Spark hands to executors; once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessera_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "tessera.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f.relative_to(HERE.parent))
    sc.addPyFile(path)
    sc._tessera_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session may fall back on a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new place in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    spark.sparkContext._tessera_scratch = [*placed(spark), path]
    return path


def placed(spark: SparkSession) -> list[str]:
    """What operators of this application have in the shared folder."""
    return list(getattr(spark.sparkContext, "_tessera_scratch", ()))


def release(spark: SparkSession, keep: Collection[str] = ()) -> int:
    """Deletes what operators of this application have put in the shared folder, but for the paths to keep; results that were not written are lost with it."""
    gone = [path for path in placed(spark) if path not in keep]
    for path in gone:
        remove(spark, path)
    return len(gone)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    spark.sparkContext._tessera_scratch = [x for x in placed(spark) if x != path]


def written_at(df: DataFrame, label: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, and there when executors are lost."""
    return written_at(df, label)[1]


def plain_scan(df: DataFrame) -> bool:
    """Whether df only selects and filters rows of one relation, so that each row of it is a row of the relation."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1 and plan.getClass().getSimpleName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty()
