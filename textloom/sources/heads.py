"""A data source of files' first bytes: listing and validation without reading whole files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of one partition where a folder holds them directly, and rows that a task hands on at once.
FILES = 4_096


@dataclass
class Place(InputPartition):
    """Some files of a folder, or all files below one of its folders."""

    folder: str = ""
    files: list[str] = field(default_factory=list)


class FileHeads(DataSource):
    """path, name, length, modified and head (the first ``head`` bytes, 512 unless given) of all files below ``path``, a local path or a URI.

    ``suffixes``, as ``.pdf,.md``, keeps files by their ending in any case. The driver lists one level; deeper folders are listed
    by the tasks, one for each folder, and a file is opened for its first bytes only. Empty folders give no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return "path string, name string, length long, modified timestamp, head binary"

    def reader(self, schema) -> DataSourceReader:
        return HeadReader(dict(self.options))


class HeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.head = options["path"], int(options.get("head", "512"))
        self.suffixes = tuple(x.strip().lower() for x in options.get("suffixes", "").split(",") if x.strip())

    def _listed(self, folder: str | None, recursive: bool) -> list[fs.FileInfo]:
        store, root = fs.FileSystem.from_uri(self.path)
        return sorted(store.get_file_info(fs.FileSelector(folder or root, recursive=recursive)), key=lambda x: x.path)

    def _wanted(self, path: str) -> bool:
        return not self.suffixes or path.lower().endswith(self.suffixes)

    def partitions(self) -> list[Place]:
        found = self._listed(None, False)
        files = [x.path for x in found if x.type == fs.FileType.File and self._wanted(x.path)]
        return [*(Place(files=files[i : i + FILES]) for i in range(0, len(files), FILES)), *(Place(folder=x.path) for x in found if x.type == fs.FileType.Directory)] or [Place()]

    def read(self, partition: Place) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        paths = partition.files or ([x.path for x in self._listed(partition.folder, True) if x.type == fs.FileType.File and self._wanted(x.path)] if partition.folder else [])
        for i in range(0, len(paths), FILES):
            infos, heads = store.get_file_info(paths[i : i + FILES]), []
            for info in infos:
                with store.open_input_file(info.path) as f:
                    heads.append(f.read(self.head))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x.path for x in infos], pa.string()), pa.array([x.base_name for x in infos], pa.string()), pa.array([x.size for x in infos], pa.int64()),
                    pa.array([x.mtime for x in infos], pa.timestamp("us", "UTC")), pa.array(heads, pa.binary()),
                ],
                names=["path", "name", "length", "modified", "head"],
            )


def scan_heads(spark: SparkSession, path: str, head: int = 512, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """The files below a path with their first bytes, as FileHeads gives them."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("head", head).option("suffixes", ",".join(suffixes)).load(path)


def write_files(rows: DataFrame, folder: str) -> None:
    """One file for each row of rows(name, body), a binary column; a repeated task writes the same files again."""

    def write(batch: Iterator) -> None:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        for r in batch:
            with store.open_output_stream(f"{root}/{r['name']}") as f:
                f.write(bytes(r["body"]))

    rows.select("name", "body").foreachPartition(write)
