"""Changes merged into a stored table, partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import Working, delete
from .ingest import upsert


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def merge_into(path: str, changes: DataFrame, keys: tuple[str, ...], part: str, batch: int | None = None) -> bool:
    """Rows of changes replace those of equal keys in a Parquet table in folders by `part`, and new ones are added. Only the folders of
    parts that changes have are read and written; a key's part never changes. Of several rows of a key in changes any one counts, so
    pass one. With a batch number a batch that was merged before changes nothing: it is noted beside the data when all is written. Whether
    anything was written."""
    spark = changes.sparkSession
    note = f"{path}/_batches/{batch}"
    if batch is not None and _exists(spark, note):
        return False
    work = Working(spark, "merge")
    new = work.table("changes", changes)
    touched = [r[0] for r in new.select(part).distinct().collect()]  # as many as there are folders
    merged = new
    if _exists(spark, path):
        there = spark.read.parquet(path)
        null = F.col(part).isNull() if None in touched else F.lit(False)
        old = there.where(F.col(part).isin([x for x in touched if x is not None]) | null).select(*[F.col(f.name).cast(f.dataType) for f in new.schema])
        merged = work.table("merged", upsert(old, new, *keys))  # written apart, as its folders are about to be replaced
    merged.repartition(part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    if batch is not None:
        new.limit(0).write.mode("overwrite").parquet(note)
    delete(spark, work.at)
    return True


def copy_with_retries(source: DataFrame, target: str, keys: tuple[str, ...], valid) -> dict[str, int]:
    """Copy rows into a Parquet table by appends. Rows that `valid`, a condition, refuses are counted as failed and left out, where one
    bad row would undo a whole batch; rows whose keys are there already are skipped. Numbers of rows copied, skipped and failed."""
    spark = source.sparkSession
    checked = source.withColumn("_fine", F.coalesce(valid, F.lit(False)))
    fine = checked.where("_fine").drop("_fine")
    new = fine.join(spark.read.parquet(target).select(*keys), list(keys), "left_anti") if _exists(spark, target) else fine
    work = Working(spark, "copy")
    new = work.table("new", new)
    counts = checked.agg(F.count(F.lit(1)).alias("n"), F.count_if("_fine").alias("fine")).first()
    copied = new.count()
    new.write.mode("append").parquet(target)
    delete(spark, work.at)
    return {"copied": copied, "skipped": counts["fine"] - copied, "failed": counts["n"] - counts["fine"]}
