"""Commits of a corpus: immutable Parquet parts and a log of JSON manifests.

A reader pins the newest manifest and sees exactly its files. A writer stages new parts, then publishes the next manifest
by creating its name exclusively; a second writer that publishes first makes it fail with ConcurrentCommit.
All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from framewright.errors import ConcurrentCommit, CorpusError

TABLES = ("frames", "blobs", "traj_meta", "frames_soa")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._Path(f"{self.path}/_commits"))

    def versions(self) -> list[int]:
        found = self._fs.listStatus(self._Path(f"{self.path}/_commits"))
        return sorted(int(f.getPath().getName()[:-5]) for f in found if f.getPath().getName().endswith(".json"))

    def read_text(self, name: str) -> str:
        stream = self._fs.open(self._Path(f"{self.path}/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._Path(f"{self.path}/{name}"))

    def create(self, name: str, text: str) -> None:
        """Publishes a new file with all its content at once; ConcurrentCommit if the name is taken.

        The content is written under a name of its own, then given the name by a step that cannot replace a file: a hard
        link on a local file system, elsewhere a rename, which distributed file systems refuse onto an existing name.
        """
        temp, target = self._Path(f"{self.path}/_staged-{uuid.uuid4().hex}"), self._Path(f"{self.path}/{name}")
        out = self._fs.create(temp, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                os.link(temp.toUri().getPath(), target.toUri().getPath())
            elif self._fs.exists(target) or not self._fs.rename(temp, target):
                raise FileExistsError(name)
        except FileExistsError:
            raise ConcurrentCommit(name) from None
        finally:
            self._fs.delete(temp, False)

    def manifest(self, version: int | None = None) -> dict:
        versions = self.versions()
        version = version if version is not None else (versions[-1] if versions else 0)
        if not version:
            return {"version": 0, "tables": {t: [] for t in TABLES}}
        if version not in versions:
            raise CorpusError(f"no commit {version}")
        return json.loads(self.read_text(f"_commits/{version:010d}.json"))

    def stage(self, df: DataFrame, name: str, partition: str | None = None) -> str:
        part = f"{name}/part={uuid.uuid4().hex}"
        writer = df.write
        if partition:
            writer = writer.partitionBy(partition)
        if name == "frames":
            writer = writer.option("parquet.bloom.filter.enabled#content_hash", "true").option("parquet.bloom.filter.enabled#formula", "true")
        writer.parquet(f"{self.path}/{part}")
        return part

    def publish(self, base: dict, tables: dict[str, list[str]], **more) -> dict:
        """The next manifest: ``base`` with the given tables' part lists. ConcurrentCommit if ``base`` is no longer the newest."""
        version = base["version"] + 1
        new = {**base, **more, "version": version, "tables": {**base["tables"], **tables}}
        self.create(f"_commits/{version:010d}.json", json.dumps(new))
        return new

    def table(self, manifest: dict, name: str, schema: StructType) -> DataFrame:
        parts = manifest["tables"].get(name, [])
        if not parts:
            return self.spark.createDataFrame([], schema)
        # One scan of all parts, however many commits there are.
        found = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{p}" for p in parts))
        return found.select(*schema.fieldNames())

    def listing(self, folder: str) -> list[str]:
        """Names of the files of a folder of any file system."""
        path = self._Path(folder)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        return sorted(f.getPath().getName() for f in found if f.isFile())

    def remove(self, part: str) -> None:
        """Deletes a staged part that no manifest names."""
        self._fs.delete(self._Path(f"{self.path}/{part}"), True)

    def delete(self) -> None:
        self._fs.delete(self._Path(self.path), True)
