"""Folders of artworks as a data source of its own, which lists what Spark's file sources hide."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EXTENSION = ".procreate"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return (fs.LocalFileSystem(), path.removeprefix("file:"))


def is_artwork(name: str) -> bool:
    return not name.startswith(".") and name.lower().endswith(EXTENSION)


class Folder(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class FolderReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool) -> None:
        self.path, self.recursive = path.rstrip("/") or "/", recursive

    def partitions(self) -> list[Folder]:
        """One for each folder, in the order of a walk. Folders that begin with a dot aren't entered; one that can't be read has no folders."""
        store, root = opened(self.path)
        if store.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no such folder: {self.path}")
        found, ahead = [], [self.path]
        while ahead:
            folder = ahead.pop()
            found.append(Folder(folder))
            if self.recursive:
                try:
                    inside = store.get_file_info(fs.FileSelector(opened(folder)[1]))
                except OSError:
                    continue
                names = sorted((x.base_name for x in inside if x.type == fs.FileType.Directory and not x.base_name.startswith(".")), reverse=True)
                ahead += [f"{folder.rstrip('/')}/{n}" for n in names]
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        store, at = opened(partition.path)
        try:
            inside = store.get_file_info(fs.FileSelector(at))
        except OSError:
            if partition.path == self.path:
                raise
            return
        for x in sorted(inside, key=lambda x: x.base_name.encode()):
            if x.type == fs.FileType.File and is_artwork(x.base_name):
                changed = x.mtime or datetime.fromtimestamp(0, timezone.utc)
                yield partition.path, f"{partition.path.rstrip('/')}/{x.base_name}", x.base_name, x.size, changed


class ArtworkFolders(DataSource):
    """``artworks``: the artworks of a folder, or with the option ``recursive`` of all below it.

    Names that begin with an underscore are listed, those that begin with a dot aren't. A folder is a
    partition, read by the task that has it. Any file system that Arrow opens will do; others, such as
    ``viewfs``, are for Spark's own readers, which hide both kinds of names.
    """

    @classmethod
    def name(cls) -> str:
        return "artworks"

    def schema(self) -> str:
        return "folder string, path string, name string, length long, modificationTime timestamp"

    def reader(self, schema: object) -> FolderReader:
        return FolderReader(self.options["path"], self.options.get("recursive", "false").lower() == "true")


def listed(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """folder, path, name, length and modificationTime of the artworks of a folder; sort by ``archive.walk_key`` for the order of a walk."""
    spark.dataSource.register(ArtworkFolders)
    return spark.read.format("artworks").option("recursive", str(recursive)).load(folder)
