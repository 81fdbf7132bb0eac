"""CSV and JSON readers, and sinks."""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import parse_qsl, quote, unquote, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import REQUIRED
from ..operators.results import uploadable
from ..operators.tables import ENTRIES, conform

BOM = "﻿"


class MissingColumns(ValueError):
    pass


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A CSV with header, quotes doubled, line feeds inside cells, a byte order mark or none; all cells are text."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    df = df.toDF(*[c.removeprefix(BOM).strip() for c in df.columns])
    if missing := [c for c in required if c not in df.columns]:
        raise MissingColumns(", ".join(missing))
    return df


def read_entries_json(spark: SparkSession, path: str, batch: str = "sample_init") -> DataFrame:
    """A JSON array of entries; the dataset is the category or else the source."""
    df = spark.read.option("multiLine", True).json(path)
    return conform(df.withColumn("dataset_name", F.coalesce(F.nullif("category", F.lit("")), "source")).withColumn("import_batch", F.lit(batch)), ENTRIES)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV parts with header; the first column's name carries the byte order mark, so that spreadsheets read UTF-8."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def _sheet(rows: list[list], separator: str) -> str:
    out = io.StringIO()
    csv.writer(out, delimiter=separator, lineterminator="\n").writerows(rows)
    return out.getvalue()


def diagraph_sheet(title: str, grid: list[tuple[int, str, dict[str, str]]], relations: list[dict], scores: list[dict] = (), separator: str = ",") -> str:
    """One pair's grid, relations and scores below each other, for download or the clipboard."""
    columns = sorted({c for _, _, cells in grid for c in cells}, key=lambda c: (len(c), c))
    rows = [[title], [], ["row", "speaker", *columns], *[[n, s, *[cells.get(c, "") for c in columns]] for n, s, cells in grid], []]
    rows += [["column", "mapping", "relation"], *[[r["column"], r["mapping"], r["relation"]] for r in relations], [], ["key", "probability", "threshold", "suggested"]]
    rows += [[x["key"], x.get("probability", ""), x.get("threshold", ""), x.get("suggested", "")] for x in scores]
    return (BOM if separator == "," else "") + _sheet(rows, separator)


def decode(data: bytes | None) -> str:
    """Text in UTF-8, with or without its mark, or else GB 18030; what neither can read is left out."""
    for name in ("utf-8-sig", "gb18030"):
        try:
            return (data or b"").decode(name)
        except UnicodeDecodeError:
            continue
    return (data or b"").decode("utf-8", "ignore")


@F.pandas_udf(T.StringType())
def _decode_rest(content: pd.Series) -> pd.Series:
    return content.map(decode)


def decoded(files: DataFrame) -> DataFrame:
    """path, file_hash (SHA-256) and text of each (path, content). UTF-8 is read in the JVM; only other contents travel to Python."""
    plain = F.col("content").cast("string")
    valid = F.coalesce(F.is_valid_utf8(plain), F.lit(False))
    text = F.when(valid, F.regexp_replace(plain, f"^{BOM}", "")).otherwise(_decode_rest(F.when(~valid, F.col("content"))))
    return files.select("path", F.sha2("content", 256).alias("file_hash"), text.alias("text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    return decoded(spark.read.format("binaryFile").load(path))


def list_objects(spark: SparkSession, path: str, allowed: tuple[str, ...], most: int = 5 << 20) -> DataFrame:
    """path, length and accepted (by extension and size) of stored files; their contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return found.withColumn("accepted", uploadable(F.col("path"), allowed) & (F.col("length") <= most))


def backup(df: DataFrame, path: str) -> None:
    """A copy of a table, unless there is one."""
    df.write.mode("ignore").parquet(path)


def safe_name(name: str | None, extension: str) -> str:
    """A name of plain characters without folders, with the extension."""
    parts = re.sub(r"[^A-Za-z0-9_.-]+", "_", re.split(r"[/\\\\]", name or "")[-1]).strip("._")
    stem = parts.rsplit(".", 1)[0]
    return (stem if stem and stem.lower() != extension.lstrip(".") else "upload") + extension


def redact(url: str | None) -> str:
    """A connection address without its passwords."""
    p = urlsplit(url or "")
    if not p.scheme:
        return url or ""
    user = quote(unquote(p.username or ""), safe="") + (":***" if p.password else "")
    host = f"[{p.hostname}]" if ":" in (p.hostname or "") else p.hostname or ""
    query = "&".join(f"{k}={'***' if 'password' in k.lower() else v}" for k, v in parse_qsl(p.query, keep_blank_values=True))
    return urlunsplit((p.scheme, f"{user}@" * bool(user) + host + (f":{p.port}" if p.port else ""), p.path, query, p.fragment))
