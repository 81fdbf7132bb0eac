"""A pair of tables in the same buckets of a key, by a tagged-union reduce-side join.

Rows of both tables travel together in one shuffle by the candidate bucket of their key, sales before lines of each key. A scan of
each bucket, which holds no more than one key's counts and the sums of its files, then tells lines whose key no sale has, multiplies
the counts of both sides, and sends every row to its table's file. Only orphans, which meet in one file, move once more."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import shared_folder
from .common import ship

BUCKETS = 150
SALES, LINES, STAT = 0, 1, 2
STAT_TYPE = "struct<side: int, bucket: int, n_rows: bigint, n_joined: bigint, ids_sha256: string, lineage_sha256: string, n_sources: int, source: int>"
RESULT = "table_name string, path string, columns string, ids_sha256 string, lineage_sha256 string, bucket long, n_rows long, n_joined long, rewritten boolean"


def bucket_of(key: Column, buckets: int = BUCKETS, salt: str = "pair") -> Column:
    """The candidate bucket of a key; buckets + 1 for null."""
    return F.coalesce(F.pmod(F.crc32(F.concat(F.lit(salt), key.cast("string"))), F.lit(buckets)), F.lit(buckets + 1)).cast("int")


def file_order(columns: list[str], key: str, inside: str = "") -> list[Column]:
    """The order of a file's rows: key descending, the other columns from left to right ascending, nulls first."""
    at = lambda c: F.col(f"`{inside}`")[c] if inside else F.col(f"`{c}`")
    return [at(key).desc_nulls_first(), *[at(c).asc_nulls_first() for c in columns if c != key]]


class Folder:
    """A folder of numbered Parquet files; a file's number is that of the partition that was written to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._files = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, rows: DataFrame) -> None:
        """A file for each partition, in the order of its rows."""
        rows.write.option("maxRecordsPerFile", 0).parquet(self.path)

    def numbers(self) -> dict[int, str]:
        """The name of each number's file."""
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(self.path))]
        return {int(m[1]): name for name in names if (m := re.match(r"part-(\d+)", name))}

    def keep(self, numbers: set[int]) -> dict[int, str]:
        """Delete all but these files; the paths of those left."""
        left = {}
        for status in self._files.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            m = re.match(r"part-(\d+)", name)
            if m and int(m[1]) in numbers:
                left[int(m[1])] = f"{self.path}/{name}"
            else:
                self._files.delete(status.getPath(), True)
        if not left:
            self._files.delete(self._path(self.path), True)
        return left

    def read(self, schema: T.StructType) -> DataFrame:
        """The rows as struct `row`, and the number of their file as `start`."""
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
        whole = F.struct(*[F.col(f"`{c}`") for c in schema.names]).alias("row")
        return self.spark.read.schema(schema).parquet(self.path).select(whole, number.alias("start"))


def start_files(table: DataFrame, key: str, number: Column, count: int, to: Folder) -> dict[int, int]:
    """Write the table in numbered, sorted files; the rows of each number."""
    cols = table.columns
    whole = table.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), number.cast("int").alias("number"))
    to.write(whole.repartitionById(count, "number").sortWithinPartitions(*file_order(cols, key, "row")).select("row.*"))
    counts = {r.start: r.n for r in to.read(table.schema).groupBy("start").agg(F.count(F.lit(1)).alias("n")).collect()}
    to.keep(set(counts))  # an empty first partition is written too
    return counts


class Digest:
    """Sums over one final file's rows in their order: ids, rows, rows of each starting file."""

    def __init__(self):
        self.ids, self.n, self.of = hashlib.sha256(), 0, np.zeros(1, np.int64)

    def add(self, ids: pa.Array, start: np.ndarray) -> None:
        if not len(ids):
            return
        texts = pc.fill_null(ids.cast(pa.string()), "")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), ",")[0]
        self.ids.update((b"," if self.n else b"") + whole.as_py().encode())
        self.n += len(ids)
        more = np.bincount(start, minlength=len(self.of))
        more[: len(self.of)] += self.of
        self.of = more

    def stat(self, side: int, bucket: int, joined: int) -> dict:
        sources = np.flatnonzero(self.of)
        lineage = ",".join(f"{s}:{self.of[s]}" for s in sources.tolist())
        return dict(side=side, bucket=bucket, n_rows=self.n, n_joined=joined, ids_sha256=self.ids.hexdigest(), lineage_sha256=hashlib.sha256(lineage.encode()).hexdigest(), n_sources=len(sources), source=int(sources[0]))


def scan(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows (tag, bucket, start, key, sale, line) of sorted partitions with a bucket each, their final bucket in place of the candidate one, and for
    each table's part of the bucket a row of sums (tag STAT). With bucket `buckets` lines are known to be orphans."""
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in ("tag", "bucket", "start", "sale", "line")), T.StructField("stat", T._parse_datatype_string(STAT_TYPE))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, bucket, kinds = {SALES: Digest(), LINES: Digest()}, None, None
        last, sales, lines, joined = None, 0, 0, 0  # of the key that the last batch ended in
        names = ["tag", "bucket", "start", "sale", "line", "stat"]
        stats = pa.struct([("side", pa.int32()), ("bucket", pa.int32()), ("n_rows", pa.int64()), ("n_joined", pa.int64()), ("ids_sha256", pa.string()), ("lineage_sha256", pa.string()), ("n_sources", pa.int32()), ("source", pa.int32())])
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tag, start, key = batch.column("tag").to_numpy(), batch.column("start").to_numpy(), batch.column("key")
            bucket, kinds = batch.column("bucket")[0].as_py(), (batch.schema.field("sale").type, batch.schema.field("line").type)
            final = np.full(n, bucket, np.int32)
            if bucket < buckets:  # keys are not null here
                new = np.ones(n, bool)
                new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                new[0] = last is None or key[0].as_py() != last
                group = np.cumsum(new) - new[0]
                n_sales, n_lines = np.bincount(group, tag == SALES).astype(np.int64), np.bincount(group, tag == LINES).astype(np.int64)
                if new[0]:
                    joined += sales * lines
                else:
                    n_sales[0] += sales
                    n_lines[0] += lines
                joined += int((n_sales[:-1] * n_lines[:-1]).sum())
                last, sales, lines = key[n - 1].as_py(), int(n_sales[-1]), int(n_lines[-1])
                final[(tag == LINES) & (n_sales[group] == 0)] = buckets
            for side, digest in digests.items():
                mine = (tag == side) & (final == bucket)
                digest.add(key.filter(pa.array(mine)), start[mine])
            yield pa.RecordBatch.from_arrays([batch.column("tag"), pa.array(final), batch.column("start"), batch.column("sale"), batch.column("line"), pa.nulls(n, stats)], names=names)
        made = [d.stat(side, bucket, joined + sales * lines) for side, d in digests.items() if d.n]
        if made:
            m = len(made)
            yield pa.RecordBatch.from_arrays([pa.array([STAT] * m, pa.int32()), pa.array([bucket] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.nulls(m, kinds[0]), pa.nulls(m, kinds[1]), pa.array(made, stats)], names=names)

    return rows.select("tag", "bucket", "start", "key", "sale", "line").mapInArrow(work, schema)


def co_bucket(sales: DataFrame, lines: DataFrame, key: str = "sale_id", item: str = "item_id", buckets: int = BUCKETS, names: tuple[str, str] = ("sales", "sale_lines"), root: str | None = None) -> DataFrame:
    """Write both tables into a new folder of the shared folder, then rewrite them there in one Parquet file for each table and bucket
    of the key; a row for each final file: table_name, path, columns, ids_sha256, lineage_sha256, bucket, n_rows, n_joined, rewritten.

    The bucket is a salted CRC-32 of the key; lines whose key no sale has are in bucket `buckets`, rows of either table without key in
    the next. Sales start in files by bucket, some of two buckets, lines in files by item (0 for null). A starting file with just a final
    file's rows stays. Files are sorted by key descending, then the other columns ascending, nulls first, and are never empty: an empty table has
    none. Repeated rows stay; n_joined counts every pair of rows with one key, and is 0 in the two last buckets. Further columns, whatever their
    names, stay; a column that Spark can't order (a map) is refused with its error. The folder stays."""
    spark = sales.sparkSession
    ship(spark)
    root = root or f"{shared_folder(spark)}/pair-{uuid.uuid4().hex[:12]}"
    count = buckets + 2
    tables, folders = (sales, lines), [{kind: Folder(spark, f"{root}/{name}/{kind}") for kind in ("start", "bucketed", "orphans")} for name in names]

    b = bucket_of(F.col(f"`{key}`"), buckets)
    item_file = F.coalesce(F.pmod(F.crc32(F.col(f"`{item}`").cast("string")), F.lit(buckets)), F.lit(0))
    started = [start_files(t, key, number, count, f["start"]) for t, number, f in zip(tables, (F.when(b % 5 == 1, b - 1).otherwise(b), item_file), folders)]
    rows = [f["start"].read(t.schema) if n else None for t, f, n in zip(tables, folders, started)]

    # a sale's bucket is known from its key alone, and so are the files that stay: at most two buckets each
    own = bucket_of(F.col("row")[key], buckets)
    found = rows[SALES].groupBy("start", own.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect() if rows[SALES] is not None else []
    stays = {r.bucket: r.start for r in found if sum(x.start == r.start for x in found) == 1 and sum(x.bucket == r.bucket for x in found) == 1}

    kinds = [T.StructField(c, T.StructType([T.StructField(f.name, f.dataType) for f in t.schema.fields])) for c, t in zip(("sale", "line"), tables)]
    none = [F.lit(None).cast(k.dataType) for k in kinds]
    parts = []
    if rows[SALES] is not None:  # of sales that stay only the keys travel
        here = F.when(~F.col("start").isin(list(stays.values())), F.col("row")) if stays else F.col("row")
        parts.append(rows[SALES].select(F.lit(SALES).alias("tag"), own.alias("bucket"), "start", F.col("row")[key].alias("key"), here.cast(kinds[0].dataType).alias("sale"), none[1].alias("line")))
    if rows[LINES] is not None:
        parts.append(rows[LINES].select(F.lit(LINES).alias("tag"), own.alias("bucket"), "start", F.col("row")[key].alias("key"), none[0].alias("sale"), F.col("row").cast(kinds[1].dataType).alias("line")))
    if not parts:
        return spark.createDataFrame([], RESULT)
    union = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    order = [F.col("key").desc_nulls_first(), "tag", *(F.col(kind)[c].asc_nulls_first() for kind, t in zip(("sale", "line"), tables) for c in t.columns if c != key)]
    # on disk, as three writers read it; a lost part is made again from the starting files
    routed = scan(union.repartitionById(count, "bucket").sortWithinPartitions(*order), buckets).persist(StorageLevel.DISK_ONLY)
    folders[SALES]["bucketed"].write(routed.where(f"tag = {SALES} AND sale IS NOT NULL").select("sale.*"))
    folders[LINES]["bucketed"].write(routed.where(f"tag = {LINES} AND bucket <> {buckets}").select("line.*"))
    stats = routed.where(f"tag = {STAT}").select("stat.*").collect()
    orphans = routed.where(f"tag = {LINES} AND bucket = {buckets}").withColumn("key", F.col("line")[key])
    alone = scan(orphans.repartitionById(count, "bucket").sortWithinPartitions(*order), buckets).persist(StorageLevel.DISK_ONLY)
    folders[LINES]["orphans"].write(alone.where(f"tag = {LINES}").select("line.*"))
    stats += alone.where(f"tag = {STAT}").select("stat.*").collect()
    alone.unpersist()
    routed.unpersist()

    # all is written: now what starting files are left to stay, and what goes
    out = []
    for side, name in enumerate(names):
        mine = [s for s in stats if s.side == side]
        still = {s.bucket: s.source for s in mine if s.n_sources == 1 and started[side][s.source] == s.n_rows}
        paths = {kind: folders[side][kind].keep(keep) if kind != "start" or started[side] else {} for kind, keep in (("start", set(still.values())), ("bucketed", {s.bucket for s in mine} - {buckets} - set(still)), ("orphans", {s.bucket for s in mine if s.bucket == buckets} - set(still))) if kind != "orphans" or side == LINES}
        for s in mine:
            path = paths["start"][still[s.bucket]] if s.bucket in still else paths["orphans" if s.bucket == buckets else "bucketed"][s.bucket]
            out.append((name, path, ",".join(tables[side].columns), s.ids_sha256, s.lineage_sha256, s.bucket, s.n_rows, s.n_joined if s.bucket < buckets else 0, s.bucket not in still))
    return spark.createDataFrame(out, RESULT)
