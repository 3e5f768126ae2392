"""The ends of log files, read by byte range: a Spark data source.

``spark.read.format("log_ends")`` opens each file, reads its first and its last bytes and
nothing between. A gzip file has no ranges and is read as a stream, of which only the ends
are held.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "log_file STRING, byte_start BIGINT, file_size BIGINT, line STRING"
#: Bytes of a compressed log that are unpacked at once.
BLOCK = 1 << 20


class LogEnds(DataSource):
    """Options: ``path`` (a file, or a folder of logs), ``ends`` (bytes of either end) and
    ``files`` (logs read by one task)."""

    @classmethod
    def name(cls) -> str:
        return "log_ends"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "LogEndsReader":
        return LogEndsReader(self.options)


class Logs(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


class LogEndsReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.ends = int(options.get("ends", "0"))
        self.files = int(options.get("files", "16"))

    @staticmethod
    def place(path: str):
        """The file system of a path and the path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, path = self.place(self.path)
        prefix = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            found = [path]
        else:
            entries = system.get_file_info(fs.FileSelector(path, recursive=True))
            found = sorted(e.path for e in entries if e.type == fs.FileType.File)
        return [Logs([prefix + p for p in found[i:i + self.files]]) for i in range(0, len(found), self.files)]

    def read(self, partition) -> Iterator[tuple]:
        for path in partition.paths:
            system, inside = self.place(path)
            if path.endswith(".gz"):
                yield from self.streamed(path, system.open_input_stream(inside))
            else:
                yield from self.ranged(path, system.open_input_file(inside))

    def ranged(self, path: str, file) -> Iterator[tuple]:
        with file:
            size = file.size()
            head = file.read_at(min(size, self.ends + 1), 0)
            while len(head) < size and not head.endswith(b"\n"):  # the last line that begins there, in full
                head += file.read_at(min(BLOCK, size - len(head)), len(head))
                cut = head.find(b"\n", self.ends)
                if cut >= 0:
                    head = head[: cut + 1]
            # One byte more tells whether a line begins at the first byte of the end.
            start = max(0, size - self.ends - 2)
            yield from self.lines(path, size, head, start, file.read_at(size - start, start))

    def streamed(self, path: str, stream) -> Iterator[tuple]:
        head, tail, size, open_head = b"", b"", 0, True
        with stream:
            while block := stream.read(BLOCK):
                if open_head:
                    head += block
                    cut = head.find(b"\n", self.ends)
                    if cut >= 0:
                        head, open_head = head[: cut + 1], False
                size += len(block)
                tail = (tail + block)[-(self.ends + 2):]
        yield from self.lines(path, size, head, size - len(tail), tail)

    def lines(self, path: str, size: int, head: bytes, start: int, tail: bytes) -> Iterator[tuple]:
        """Lines that begin in the first ``ends`` bytes of a log of that size, or in the last."""
        total = size if not size or tail.endswith(b"\n") else size + 1  # a last line without its line feed
        at = 0
        while at < len(head) and at <= self.ends:
            end = head.find(b"\n", at)
            end = len(head) if end < 0 else end
            yield path, at, total, head[at:end].decode("utf-8", "ignore")
            at = end + 1
        done, at = at, start
        if start:
            at = start + tail.find(b"\n") + 1 if b"\n" in tail else size
        while at < size:
            end = tail.find(b"\n", at - start)
            end = len(tail) if end < 0 else end
            if at >= done and at >= total - self.ends:
                yield path, at, total, tail[at - start:end].decode("utf-8", "ignore")
            at = start + end + 1


def read_log_ends(spark: SparkSession, path: str, ends: int, files: int = 16) -> DataFrame:
    """Lines that start in the first or last ``ends`` bytes of each log, as ``head_tail_lines``
    finds them, but without their numbers: log_file, byte_start, file_size, line. A line feed
    ends a line; a last line without one counts as if it had it. Bytes that are not UTF-8 are
    dropped."""
    spark.dataSource.register(LogEnds)
    return spark.read.format("log_ends").option("ends", str(ends)).option("files", str(files)).load(path)
