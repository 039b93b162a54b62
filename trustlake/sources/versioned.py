"""Tables of immutable versions: rows are merged by whoever commits first, and readers see one version.

A version is a manifest, ``_versions/<number>``, that names the Parquet folders
which make up the table. A writer reads the newest version, writes its result
to a new folder, and commits by renaming its manifest to the next number, which
fails if another writer was faster. It then merges again with what the other
one left, so no row is lost. A reader that has taken a version keeps its
folders, whatever is committed meanwhile; ``vacuum`` removes the folders that
only older versions name.

File systems in which a rename replaces an existing file (plain object stores)
don't give this guarantee; HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from trustlake.sources import sinks

TRIES = 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        at = self._at("_versions")
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def version(self) -> int:
        """Number of the newest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        file = self._fs.open(self._at(f"_versions/{version:012d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """One version, by default the newest; None before the first commit."""
        version = self.version() if version is None else version
        if not version:
            return None
        about = self._manifest(version)
        return self.spark.read.schema(about["schema"]).parquet(*(f"{self.path}/{d}" for d in about["folders"]))

    def commit(self, df: DataFrame, read: int, keep: list[str] = ()) -> int:
        """Write ``df`` as version ``read`` + 1, with the folders ``keep`` of the version read; ``Conflict`` if there is one already."""
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        # The stored schema, as nullable as Parquet makes it.
        schema = self.spark.read.parquet(f"{self.path}/{folder}").schema
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        own = self._at(f"_versions/.{folder}")
        out = self._fs.create(own, False)
        try:
            out.write(bytearray(json.dumps({"schema": ddl, "folders": [*keep, folder]}).encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf)
        plain = getattr(self._jvm.org.apache.hadoop.fs.Options, "Rename").NONE
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = plain
        try:
            context.rename(own, self._at(f"_versions/{read + 1:012d}"), options)
        except Py4JJavaError as e:
            self._fs.delete(own, False)
            self._fs.delete(self._at(folder), True)
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            raise Conflict(f"version {read + 1} is there already") from None
        return read + 1

    def update(self, change: Callable[[DataFrame | None], DataFrame], tries: int = TRIES) -> int:
        """Commit ``change(newest rows)``; made again from the newer rows after a conflict."""
        for _ in range(tries):
            read = self.version()
            try:
                return self.commit(change(self.read(read) if read else None), read)
            except Conflict:
                continue
        raise Conflict(f"{tries} other writers were faster")

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        """Rows of ``new`` replace rows with their keys."""
        return self.update(lambda old: new if old is None else sinks.upsert(old, new, keys))

    def append(self, new: DataFrame) -> int:
        """Rows of ``new`` besides those that are there, whose files stay."""
        for _ in range(TRIES):
            read = self.version()
            try:
                return self.commit(new, read, self._manifest(read)["folders"] if read else [])
            except Conflict:
                continue
        raise Conflict(f"{TRIES} other writers were faster")

    def append_capped(self, new: DataFrame, n: int = 500, ts: str = "ts") -> int:
        """The newest n of both."""
        return self.update(lambda old: sinks.append_capped(new.limit(0) if old is None else old, new, n, ts))

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions and the folders that only they name."""
        versions = self.versions()
        gone, stay = versions[: max(0, len(versions) - keep)], versions[max(0, len(versions) - keep) :]
        named = {d for v in stay for d in self._manifest(v)["folders"]}
        old = {d for v in gone for d in self._manifest(v)["folders"]} - named
        for v in gone:
            self._fs.delete(self._at(f"_versions/{v:012d}"), False)
        for d in old:
            self._fs.delete(self._at(d), True)
