"""Files of any size as rows of facts: a data source that plans files and streams their bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 8 << 20
PARTITION_BYTES = 256 << 20
#: Spark's writer puts the codec before the ending.
NAMED_CODEC = r"\.([a-z0-9]+)\.parquet$"
SCHEMES = {"file": "file", "s3": "s3", "s3a": "s3", "gs": "gs", "hdfs": "hdfs"}


def reachable(uri: str) -> bool:
    """Whether tasks can open this URI's file system themselves."""
    return uri.partition(":")[0] in SCHEMES


def open_folder(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{rest}")


@dataclass
class Files(InputPartition):
    """Some files of a partition: (path in the file system, path below the root, size)."""

    files: list[tuple[str, str, int]]

    def __init__(self, files: list[tuple[str, str, int]]) -> None:
        self.files = files


def planned(files: list[tuple[str, str, int]], budget: int) -> list[Files]:
    """Neighbours share a partition up to a budget of bytes; a larger file has one of its own."""
    parts: list[Files] = []
    size = 0
    for f in files:
        if not parts or size + f[2] > budget:
            parts.append(Files([]))
            size = 0
        parts[-1].files.append(f)
        size += f[2]
    return parts


class FileDigests(DataSource):
    """path, local_path, size_bytes and sha256 of the files below a folder.

    Options: `rangeBytes`, how much of a file is in memory at once; `partitionBytes`, how much a task reads unless a
    single file is larger. Files and folders whose names begin with `_` or `.` are left out, as Spark's
    readers do.
    """

    @classmethod
    def name(cls) -> str:
        return "barlake_file_digests"

    def schema(self) -> str:
        return "path string, local_path string, size_bytes long, sha256 string"

    def reader(self, schema) -> FileDigestReader:
        return FileDigestReader(self.options)


class FileDigestReader(DataSourceReader):
    """Plans all files of a folder that its readers take."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, folder = open_folder(self.root)
        found = []
        for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
            local = info.path[len(folder.rstrip("/")) + 1 :]
            hidden = any(n.startswith(".") or (n.startswith("_") and "=" not in n) for n in local.split("/"))
            if info.is_file and not hidden and self.takes(local):
                found.append((info.path, local, info.size))
        return planned(sorted(found), self.partition_bytes) or [Files([])]

    def takes(self, local: str) -> bool:
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = open_folder(self.root)
        for path, local, _ in partition.files:
            digest, size = hashlib.sha256(), 0
            with system.open_input_stream(path) as stream:
                while some := stream.read(self.range_bytes):
                    digest.update(some)
                    size += len(some)
            yield f"{self.root}/{local}", local, size, digest.hexdigest()


class ParquetCodecs(DataSource):
    """path and codec, from the footer, of the Parquet files below a folder whose names do not tell their codec."""

    @classmethod
    def name(cls) -> str:
        return "barlake_parquet_codecs"

    def schema(self) -> str:
        return "path string, codec string"

    def reader(self, schema) -> ParquetCodecReader:
        return ParquetCodecReader(self.options)


class ParquetCodecReader(FileDigestReader):
    def takes(self, local: str) -> bool:
        return local.endswith(".parquet") and re.search(NAMED_CODEC, local) is None

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import parquet

        system, _ = open_folder(self.root)
        for path, local, _ in partition.files:
            with system.open_input_file(path) as file:
                facts = parquet.read_metadata(file)
            chunks = {facts.row_group(g).column(c).compression for g in range(facts.num_row_groups) for c in range(facts.num_columns)}
            # one chunk of another codec is what a gate has to see
            yield f"{self.root}/{local}", min(chunks - {"ZSTD"} or chunks, default=None)
