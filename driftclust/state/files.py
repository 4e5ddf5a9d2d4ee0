"""Small files on any file system that Spark can reach."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self.root, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/"), spark.sparkContext._gateway
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False, and nothing changed, if it exists."""
        try:
            stream = self._fs.create(self._at(name), False)
        except Exception as e:  # the JVM's FileAlreadyExistsException, by its name
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def publish(self, name: str, text: str) -> bool:
        """Make a file whole and at once, unless the name is taken: False then, and nothing has changed.

        The text is written under another name first. On a local file system that file is linked to the name, elsewhere renamed without
        overwriting; both are single steps that fail if the name is there, on local disks and HDFS. On a store without such a step
        (plain object stores) two writers must not share a folder.
        """
        folder, _, last = name.rpartition("/")
        draft = f"_new/{last}-{uuid.uuid4().hex}"
        self.create(draft, text)
        try:
            self.make(folder)
            if self._fs.getUri().getScheme() == "file":
                os.link(self._local(draft), self._local(name))
            else:
                self._rename_new(draft, name)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        finally:
            self.delete(draft)

    def _rename_new(self, old: str, new: str) -> None:
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._at(old), self._at(new), self._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))

    def _local(self, name: str) -> str:
        return self._at(name).toUri().getPath()

    def older(self, folder: str, seconds: float) -> list[str]:
        """Entries of a folder that nothing has been put into for so long."""
        if not self._fs.exists(self._at(folder)):
            return []
        limit = (time.time() - seconds) * 1000
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(folder)) if s.getModificationTime() < limit]

    def names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._at(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(folder)))

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._at(folder))
