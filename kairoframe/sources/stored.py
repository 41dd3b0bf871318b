"""Tables written once and read by every query after that, in the folder that a cluster shares.

A version is a manifest, a small file that names the folders of every partition. Changes write new
folders first and then a new manifest in one step, so a reader or a failed job never sees half of a
change; untouched partitions are neither read nor written.
"""

from __future__ import annotations

import atexit
import functools
import hashlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; our own only where that is unset and all runs on
    one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{_own_folder()}"
    return root.rstrip("/")


@functools.cache
def _own_folder() -> str:
    """A folder of this process, gone when it ends."""
    folder = tempfile.mkdtemp(prefix="checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


class Files:
    """The few calls on a folder that every filesystem of Spark's has."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self.jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, source: str, target: str) -> None:
        fs, at = self._at(source)
        if not fs.rename(at, self._at(target)[1]):
            raise OSError(f"{source} was not renamed")

    def names(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def write(self, path: str, text: str) -> None:
        fs, at = self._at(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Stored:
    """A table in partitions by ``by`` (one column, or none), sorted by ``sort``, in versions."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)

    def manifest(self) -> dict:
        versions = sorted(int(n[8:]) for n in self.files.names(self.path) if re.fullmatch(r"version-\d+", n))
        if not versions:
            raise FileNotFoundError(self.path)
        return json.loads(self.files.read(f"{self.path}/version-{versions[-1]}"))

    def exists(self) -> bool:
        return any(n.startswith("version-") for n in self.files.names(self.path))

    def _publish(self, manifest: dict) -> None:
        draft = f"{self.path}/draft-{uuid.uuid4().hex}"
        self.files.write(draft, json.dumps(manifest))
        self.files.rename(draft, f"{self.path}/version-{manifest['version']}")

    def _folders(self, rows: DataFrame, by: str | None, sort: Sequence[str]) -> dict[str, list[str]]:
        """Writes rows to a new folder and tells each partition's part of it."""
        name = f"rows-{uuid.uuid4().hex}"
        if by:
            rows.sortWithinPartitions(by, *sort).write.partitionBy(by).parquet(f"{self.path}/{name}")
            return {n.split("=", 1)[1]: [f"{name}/{n}"] for n in self.files.names(f"{self.path}/{name}") if "=" in n}
        (rows.sortWithinPartitions(*sort) if sort else rows).write.parquet(f"{self.path}/{name}")
        return {"": [name]}

    def create(self, rows: DataFrame, by: str | None = None, sort: Sequence[str] = ()) -> Stored:
        """Writes the first version, or a new one in place of all rows."""
        version = self.manifest()["version"] + 1 if self.exists() else 0
        parts = self._folders(rows, by, sort)
        self._publish({"version": version, "schema": rows.schema.json(), "by": by, "sort": list(sort), "parts": parts})
        return self

    def _read(self, manifest: dict, values: Sequence[str] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema, by = StructType.fromJson(json.loads(manifest["schema"])), manifest["by"]
        folders = [f for v, own in manifest["parts"].items() if values is None or v in values for f in own]
        if not folders:
            return self.spark.createDataFrame([], schema)
        if not by:
            return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))
        # Folders of several writes hold one partition column: a file index for each write.
        out = None
        for write in sorted({f.split("/")[0] for f in folders}):
            own = self.spark.read.schema(schema).option("basePath", f"{self.path}/{write}").parquet(*(f"{self.path}/{f}" for f in folders if f.startswith(write + "/")))
            own = own.select(*schema.names)
            out = own if out is None else out.unionByName(own)
        return out

    def rows(self) -> DataFrame:
        """All rows of the latest version. Filters on the partition column prune folders."""
        return self._read(self.manifest())

    def append(self, rows: DataFrame) -> None:
        old = self.manifest()
        names = json.loads(old["schema"])["fields"]
        new = self._folders(rows.select(*(F.col(f["name"]).cast(f["type"]) for f in names)), old["by"], old["sort"])
        parts = {v: old["parts"].get(v, []) + new.get(v, []) for v in {**old["parts"], **new}}
        self._publish(old | {"version": old["version"] + 1, "parts": parts})

    def delete(self, ids: DataFrame, key: str = "rec_id") -> list[str]:
        """Rewrites the partitions that hold one of ``ids`` without them, and tells which."""
        old = self.manifest()
        dead, by = ids.select(key).distinct(), old["by"]
        if by:
            held = self._read(old).select(by, key).join(dead, key, "left_semi").select(F.col(by).cast("string")).distinct()
            touched = sorted(r[0] for r in held.collect())  # at most the number of partitions
        else:
            touched = [""]
        if touched:
            new = self._folders(self._read(old, touched).join(dead, key, "left_anti"), by, old["sort"])
            parts = {v: f for v, f in old["parts"].items() if v not in touched} | new
            self._publish(old | {"version": old["version"] + 1, "parts": parts})
        return touched

    def vacuum(self) -> None:
        """Removes versions before the latest and folders that it does not name."""
        now = self.manifest()
        live = {f.split("/")[0] for own in now["parts"].values() for f in own} | {f"version-{now['version']}"}
        for name in self.files.names(self.path):
            if name not in live:
                self.files.delete(f"{self.path}/{name}")


def place(spark: SparkSession, source: str, name: str) -> str:
    """A path of the application's own for a table derived from the files at ``source``."""
    own = hashlib.md5(f"{source}|{name}".encode()).hexdigest()[:12]
    return f"{shared_root(spark)}/kairoframe/stored/{spark.sparkContext.applicationId}/{re.sub('[^A-Za-z0-9]+', '-', name)}-{own}"


def once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], by: str | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """A derived table that the application's first call writes and all others read."""
    table = Stored(spark, place(spark, source, name))
    return (table if table.exists() else table.create(make(), by, sort)).rows()
