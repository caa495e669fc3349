"""Files as rows: a listing that knows empty files and places relative to the root."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "strandcut-files"
SCHEMA = "dir string, name string, path string, length bigint"
#: Most tasks of a listing; each lists its share of the root's folders, whole trees.
LISTINGS = 1024


class Folders(InputPartition):
    """Folders right below the root, to be listed as trees; ``None`` stands for the root's own files."""

    def __init__(self, folders: list[str | None]) -> None:
        self.folders = folders


class FileListing(DataSource):
    """Every file below ``root`` whose name fits ``pattern``, empty ones included.

    Spark's own file sources leave out files without content. Options: ``root``
    (a URI or an absolute path that all executors can reach), ``pattern`` (a
    shell pattern for the name), ``listings`` (most tasks).
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileListingReader(self.options)


class FileListingReader(DataSourceReader):
    """Lists the root itself when planned, the folders below it in tasks."""

    def __init__(self, options) -> None:
        self.root = options["root"].rstrip("/") or "/"
        self.pattern = options.get("pattern", "*")
        self.listings = int(options.get("listings", LISTINGS))

    def _children(self, folder: str, recursive: bool):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(self.root)
        at = f"{base.rstrip('/')}/{folder}" if folder else base
        return base.rstrip("/") + "/", system.get_file_info(fs.FileSelector(at, recursive=recursive))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        _, found = self._children("", recursive=False)
        folders = [None, *sorted(f.base_name for f in found if f.type == fs.FileType.Directory)]
        n = min(self.listings, len(folders))
        return [Folders(folders[i::n]) for i in range(n)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        for folder in partition.folders:
            base, found = self._children(folder or "", recursive=folder is not None)
            for f in found:
                if f.type == fs.FileType.File and fnmatchcase(f.base_name, self.pattern):
                    inside = f.path[len(base):]
                    yield inside.rpartition("/")[0], f.base_name, f"{self.root.rstrip('/')}/{inside}", f.size


def scan_files(spark: SparkSession, root: str, pattern: str = "*", *, listings: int = LISTINGS) -> DataFrame:
    """``dir, name, path, length`` of the files below ``root``; ``dir`` is relative to it (empty for its own files).

    Nothing is read but the folders. A root without files gives no rows, one that is missing an error.
    """
    spark.dataSource.register(FileListing)
    return (
        spark.read.format(FORMAT).option("root", root).option("pattern", pattern).option("listings", listings).load()
    )
