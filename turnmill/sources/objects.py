"""Stored files as a Spark data source: spark.read.format("stored_objects") and df.write.format("stored_objects").

The folder has to be one that all executors reach under the same path. Reading lists it, deals the files to partitions by their sizes, and
reads contents only where they are asked for and the rules for extensions and sizes allow it. Writing puts each task's files into a
hidden folder of its own; they move to their places when all tasks are done, and a job that fails leaves nothing."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .files import safe_name

SCHEMA = "path string, length long, extension string, accepted boolean, content binary"
STAGING = ".staging-"


class Rules:
    """Extensions (comma-separated; none: all) and the greatest size that a file may have."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].removeprefix("file://")
        if "://" in self.root:
            raise ValueError(f"{self.root} is not a folder that workers can open")
        self.extensions = {e.strip().lower().lstrip(".") for e in options.get("extensions", "").split(",") if e.strip()}
        self.most = int(options.get("maxbytes", 5 << 20))

    def allow(self, name: str, size: int) -> bool:
        return (not self.extensions or extension_of(name) in self.extensions) and size <= self.most


def extension_of(name: str) -> str:
    return os.path.splitext(name)[1].lower().lstrip(".")


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


class ObjectsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.rules = Rules(options)
        self.contents = options.get("contents", "true").lower() == "true"
        self.load = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[Files]:
        """Files dealt out so that a partition has about so many bytes; a file counts a little even if it is empty."""
        parts: list[Files] = []
        left = 0
        for folder, below, names in os.walk(self.rules.root):
            below[:] = sorted(d for d in below if not d.startswith(STAGING))
            for name in sorted(names):
                path = os.path.join(folder, name)
                size = os.path.getsize(path)
                if left <= 0:
                    parts.append(Files([]))
                    left = self.load
                parts[-1].found.append((path, size))
                left -= size + 4096
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.found:
            fine = self.rules.allow(path, size)
            content = None
            if fine and self.contents:
                with open(path, "rb") as f:
                    content = f.read()
            yield path, size, extension_of(path), fine, content


@dataclass
class Written(WriterCommitMessage):
    staging: str
    names: list[str]


class ObjectsWriter(DataSourceWriter):
    """Rows of (name, content). A name keeps plain characters only; a file that the rules refuse fails the job."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.rules, self.overwrite, self.job = Rules(options), overwrite, uuid.uuid4().hex[:12]

    def write(self, rows: Iterator) -> Written:
        own = os.path.join(self.rules.root, f"{STAGING}{self.job}", uuid.uuid4().hex)
        os.makedirs(own)
        names = []
        try:
            for row in rows:
                name, content = row["name"], bytes(row["content"] or b"")
                if not self.rules.allow(name or "", len(content)):
                    raise ValueError(f"{name}: {len(content)} bytes are refused")
                names.append(safe_name(name, f".{extension_of(name)}" if extension_of(name) else ""))
                with open(os.path.join(own, names[-1]), "wb") as f:
                    f.write(content)
        except BaseException:
            shutil.rmtree(own, ignore_errors=True)  # the task is tried again in a folder of its own
            raise
        return Written(own, names)

    def commit(self, messages: list[Written | None]) -> None:
        if self.overwrite:
            for name in os.listdir(self.rules.root):
                path = os.path.join(self.rules.root, name)
                if not name.startswith(STAGING):
                    shutil.rmtree(path) if os.path.isdir(path) else os.remove(path)
        for m in messages:
            for name in m.names if m else ():
                os.replace(os.path.join(m.staging, name), os.path.join(self.rules.root, name))
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(os.path.join(self.rules.root, f"{STAGING}{self.job}"), ignore_errors=True)


class StoredObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stored_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ObjectsReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ObjectsWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StoredObjects)
