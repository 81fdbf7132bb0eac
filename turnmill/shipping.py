"""What driver and executors share: this package's code, and the folder for working tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as an archive that Spark's own file server hands out."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    to = os.path.join(tempfile.mkdtemp(prefix="turnmill-"), f"{top.name}-code.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which driver and executors share. Only on one machine (local master, as in tests) a
    temporary one stands in for it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="turnmill-shared-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_folders: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def working_folder(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, under a folder of this application that goes when the driver ends."""
    name = spark.sparkContext.applicationId
    if name not in _folders:
        _folders[name] = path = f"{shared_folder(spark)}/turnmill-work-{name}"
        atexit.register(lambda: spark.sparkContext._jsc is not None and delete(spark, path))
    return f"{_folders[name]}/{what}-{uuid.uuid4().hex[:12]}"


class Working:
    """Written tables of one call, which later steps read instead of making them again."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, working_folder(spark, what)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")
