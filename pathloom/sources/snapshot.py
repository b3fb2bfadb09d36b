"""Versioned snapshots: immutable Parquet folders and a pointer that is replaced at once."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators.rank import with_ordinals
from ..schema import FORMAT_VERSION

#: Seconds after which a claim without a version is another writer's to take.
CLAIM_SECONDS = 60


class SnapshotStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        path = self._path(f"{self.root}/{name}")
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _write_text(self, name: str, text: str) -> None:
        """Written aside and renamed over the old file."""
        jvm = self.spark._jvm
        aside, to = self._path(f"{self.root}/{name}.new"), self._path(f"{self.root}/{name}")
        out = self._fs.create(aside, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, to, options)

    def current(self) -> dict | None:
        """The manifest in force; a damaged or foreign one counts as none."""
        try:
            found = json.loads(self._text("CURRENT") or "null")
        except ValueError:
            return None
        except Py4JJavaError as e:
            if "ChecksumException" in str(e.java_exception):
                return None
            raise
        return found if isinstance(found, dict) and found.get("format") == FORMAT_VERSION else None

    def publish(self, rows: DataFrame, *, expected: int | None = None, ordered: bool = True, check: Callable[[DataFrame], dict | None] | None = None, **facts) -> int | None:
        """Writes the next version and points to it; with ``expected``, only if that version is still in force.

        Two writers never mix: each writes a folder of its own, and only one can claim the
        version number, by making a file that must not be there.  ``check`` sees the rows as
        written; it may add facts to the manifest, or raise, and then nothing is published.
        """
        now = self.current()
        version = (now["version"] if now else 0) + 1
        if expected is not None and version != expected + 1:
            return None
        rows = rows if "ord" in rows.columns or not ordered else with_ordinals(rows)
        folder = f"v{version}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.root}/{folder}")
        try:
            facts |= (check(self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}")) or {}) if check else {}
            won = self._claim(version)
        except Exception:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise
        if not won:
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            if expected is None:
                raise RuntimeError("another writer published meanwhile")
            return None
        self._write_text("CURRENT", json.dumps({"format": FORMAT_VERSION, "version": version, "folder": folder, "schema": json.loads(rows.schema.json()), **facts}))
        self._fs.delete(self._path(f"{self.root}/claims/{version - 1}"), False)
        return version

    def _claim(self, version: int) -> bool:
        """Whether the version is this writer's.  A claim whose writer died before it published is void after a while."""
        claim = self._path(f"{self.root}/claims/{version}")
        for _ in range(2):
            try:
                self._fs.create(claim, False).close()
            except Py4JJavaError as e:
                if "AlreadyExists" not in str(e.java_exception):
                    raise
            else:
                now = self.current()  # one may have published and cleared its claim since this writer looked
                return (now["version"] if now else 0) < version
            try:
                age = time.time() - self._fs.getFileStatus(claim).getModificationTime() / 1000
            except Py4JJavaError:
                return False  # published just now
            if age < CLAIM_SECONDS or not self._fs.delete(claim, False):
                return False
        return False

    def _folder(self, manifest: dict, version: int | None) -> str:
        if version is None or version == manifest["version"]:
            return manifest.get("folder") or f"v{manifest['version']}"
        names = (s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)))
        return next((n for n in names if n == f"v{version}" or n.startswith(f"v{version}-")), f"v{version}")

    def load(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version with their stored schema, or None where there is nothing sound to read."""
        manifest = self.current()
        if manifest is None:
            return None
        try:
            rows = self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(f"{self.root}/{self._folder(manifest, version)}")
            rows.take(1)
            return rows
        except Exception as e:  # noqa: BLE001  a damaged version is rebuilt, whatever Spark says of it
            if "PATH_NOT_FOUND" in str(e) or "FAILED_READ_FILE" in str(e) or "CANNOT_READ" in str(e):
                return None
            raise

    def enqueue(self, rows: DataFrame) -> None:
        """Keeps rows beside the versions until ``forget``; they outlive the driver."""
        rows.write.parquet(f"{self.root}/waiting/{uuid.uuid4().hex}")

    def waiting(self) -> list[str]:
        """The whole folders that ``enqueue`` wrote."""
        folder = self._path(f"{self.root}/waiting")
        if not self._fs.exists(folder):
            return []
        each = [str(s.getPath().toString()) for s in self._fs.listStatus(folder)]
        return sorted(f for f in each if self._fs.exists(self._path(f"{f}/_SUCCESS")))

    def forget(self, folders: list[str]) -> None:
        for folder in folders:
            self._fs.delete(self._path(folder), True)

    def load_or_build(self, build) -> DataFrame:
        rows = self.load()
        if rows is None:
            self.publish(build())
            rows = self.load()
        return rows
