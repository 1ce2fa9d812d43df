"""Registry tables that persist: a pass writes new folders, then switches to them at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


FOLDERS = 64  # of a table, before they are put together


class Conflict(RuntimeError):
    """Another pass has made the version that this one wanted to make; start again from the version that counts now."""


class TableStore:
    """Versions of a set of tables below one folder, in any file system that Spark writes to.

    A version is a file below ``commits`` that lists the folders of each table. It is moved into place in one step, and
    only where no such version is there yet, after all tables are written under names of their own. So a reader sees
    either all tables of a pass or none, a pass that fails leaves nothing that counts, and of two passes that start from
    one version the second gets a ``Conflict``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(folder))
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int | None:
        """The version that counts."""
        return max(self.versions(), default=None)

    def commit(self, version: int | None = None) -> dict:
        """What a version consists of: the folders of each table and the pass's own ``facts``."""
        version = self.version() if version is None else version
        if version is None:
            return {"tables": {}, "facts": {}}
        stream = self._fs.open(self._path(f"{self.root}/commits/{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def facts(self) -> dict:
        return self.commit()["facts"]

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(*self.commit()["tables"][table])

    def write(
        self, tables: dict[str, DataFrame], keep: int = 2, *, append: dict[str, DataFrame] | None = None,
        facts: dict | None = None, base: int | None = None,
    ) -> int:
        """Store the next version and drop all but the last ``keep``.

        ``tables`` are replaced (they may be computed from this version), rows of ``append`` are added to what is there,
        other tables stay as they are. ``base`` is the version that the pass has read, the last one if not given.
        """
        now = self.version() if base is None else base
        new = 0 if now is None else now + 1
        content = self.commit(now)
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        for name, df in (tables | (append or {})).items():
            had = content["tables"].get(name, []) if name not in tables else []
            if len(had) >= FOLDERS:
                df, had = self.spark.read.parquet(*had).unionByName(df), []
            df.write.parquet(f"{folder}/{name}")
            content["tables"][name] = [*had, f"{folder}/{name}"]
        content["facts"] |= facts or {}
        self._publish(new, json.dumps(content))
        self._drop(keep)
        return new

    def _publish(self, version: int, content: str) -> None:
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        draft, target = self._path(f"{self.root}/commits/_{uuid.uuid4().hex}"), self._path(f"{self.root}/commits/{version}")
        out = self._fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise Conflict(f"version {version} of {self.root} is there already") from error
            raise

    def _drop(self, keep: int) -> None:
        """Remove old versions and those of their folders that no kept one lists."""
        versions = self.versions()
        old, kept = versions[:-keep], versions[-keep:]
        used = {f for v in kept for folders in self.commit(v)["tables"].values() for f in folders}
        for v in old:
            folders = {f for own in self.commit(v)["tables"].values() for f in own}
            self._fs.delete(self._path(f"{self.root}/commits/{v}"), False)
            for folder in folders - used:
                self._fs.delete(self._path(folder), True)
