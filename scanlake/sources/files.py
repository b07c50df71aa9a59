"""A sink that writes a file a row, such as a PCD a frame, all of them or none.

Tasks write into folders of their own under a staging folder; when all have succeeded,
each folder is renamed into place, one rename a task, and a mark is left. What a failed
or repeated attempt has written is never moved, and goes with the staging folder; what
a straggler writes there later no reader sees, as its name begins with a line below.

    files.register(spark)
    to_pcd(points).write.format("frame_files").mode("append").option("suffix", ".pcd").save(path)
    from_pcd(files.read(spark, path, ".pcd"))
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _opened(path: str):
    """The file system of a path that driver and executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    n_files: int


class _FrameWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix, self.overwrite, self.run = path.rstrip("/"), suffix, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> _Written:
        fs, root = _opened(self.path)
        task = TaskContext.get()
        folder, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{self.run}", 0
        for name, content in iterator:
            if not n:
                fs.create_dir(f"{root}/_staging-{self.run}/{folder}")
            with fs.open_output_stream(f"{root}/_staging-{self.run}/{folder}/{quote(str(name), safe='')}{self.suffix}") as out:
                out.write(bytes(content))
            n += 1
        return _Written(folder, n)

    def commit(self, messages) -> None:
        from pyarrow import fs as arrow

        fs, root = _opened(self.path)
        fs.create_dir(root)
        before = [x.path for x in fs.get_file_info(arrow.FileSelector(root)) if not x.base_name.startswith("_staging-")] if self.overwrite else []
        for m in messages:
            if m is not None and m.n_files:
                fs.move(f"{root}/_staging-{self.run}/{m.folder}", f"{root}/{m.folder}")
        for path in before:
            (fs.delete_dir if fs.get_file_info(path).type == arrow.FileType.Directory else fs.delete_file)(path)
        self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, fs, root) -> None:
        from pyarrow import fs as arrow

        if fs.get_file_info(f"{root}/_staging-{self.run}").type == arrow.FileType.Directory:
            fs.delete_dir(f"{root}/_staging-{self.run}")


class FrameFiles(DataSource):
    """Rows of a name and bytes as files. Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FrameWriter(self.options["path"], self.options.get("suffix", ""), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFiles)


def write_pcd(points: DataFrame, path: str, *fields: str, overwrite: bool = False) -> None:
    """A PCD file a frame."""
    from scanlake.sources.clouds import to_pcd

    register(points.sparkSession)
    rows = to_pcd(points, *fields).select(F.col("frame_id").cast("string").alias("name"), F.col("pcd").alias("content"))
    rows.write.format("frame_files").mode("overwrite" if overwrite else "append").option("path", path).option("suffix", ".pcd").save()


def read(spark: SparkSession, path: str, suffix: str = ".pcd", kind: str = "int") -> DataFrame:
    """frame_id and pcd of the files of a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    name = F.substring_index(F.col("path"), "/", -1)
    name = F.url_decode(F.substr(name, F.lit(1), F.length(name) - len(suffix)))
    return rows.select(name.cast(kind).alias("frame_id"), F.col("content").alias("pcd"))
