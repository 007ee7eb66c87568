"""Files in the folder that all executors share, by any URI that pyarrow's file systems know."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import SparkSession

from churnlens.session import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder name of this run below ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it); a plain path is local."""
    if "://" not in uri:
        uri = "file://" + (uri[5:] if uri.startswith("file:") else uri)
    return pafs.FileSystem.from_uri(uri)


class NewFile:
    """A file that appears under its name only when it is whole, so retried tasks are safe."""

    def __init__(self, uri: str):
        self.fs, self.path = file_system(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.tmp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.tmp, self.path)
