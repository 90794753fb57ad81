"""File checksums as a Spark data source: files are streamed, never held.

``spark.read.format("filehash").load(path)`` gives ``(path, length, sha256)`` of
every file below a folder, lowercase hex.  A task reads 1 MiB at a time, so its
memory does not grow with the file; small files share a task, a large one has a
task of its own (SHA-256 has no parts that could be hashed apart).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from hourcast.sources.footers import open_input

BLOCK = 1 << 20
TASK_BYTES = 256 << 20


def file_sha256(path: str, block: int = BLOCK) -> str:
    """Lowercase SHA-256 of a file, read ``block`` bytes at a time."""
    digest = hashlib.sha256()
    with open_input(path) as stream:
        while piece := stream.read(block):
            digest.update(piece)
    return digest.hexdigest()


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class FileHashReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "")

    def partitions(self) -> list[Files]:
        """Files by descending size, the small ones packed into shared tasks."""
        from pyarrow import fs
        scheme = ""
        if ":/" in self.path:
            system, root = fs.FileSystem.from_uri(self.path)
            scheme = self.path[:self.path.index(":")] + ":" + ("" if self.path.startswith("file:/") else "//")
        else:
            system, root = fs.LocalFileSystem(), self.path
        listed = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted(((f.size, f.path) for f in listed if f.is_file and f.path.endswith(self.suffix)
                        and not f.base_name.startswith((".", "_"))), reverse=True)
        out, room = [], 0
        for size, path in files:
            if not out or size > room:
                out.append([])
                room = TASK_BYTES
            out[-1].append((scheme + path, size))
            room -= size
        return [Files(part) for part in out] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, size in partition.files:
            yield path, size, file_sha256(path)


class FileHashSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filehash"

    def schema(self) -> str:
        return "path string, length long, sha256 string"

    def reader(self, schema) -> FileHashReader:
        return FileHashReader(self.options)


def file_hashes(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``(path, length, sha256)`` of the files below ``path``."""
    spark.dataSource.register(FileHashSource)
    return spark.read.format("filehash").option("suffix", suffix).load(path)


def verification(local_path: Column, declared: Column, actual: Column) -> Column:
    """No local path: skipped; no file: missing; a declared checksum that differs: mismatch; else ok."""
    return (F.when(local_path.isNull(), "skipped").when(actual.isNull(), "missing_payload")
            .when(declared.isNotNull() & (declared != "") & (declared != actual), "checksum_mismatch").otherwise("ok"))
