"""A Python data source: page files of a folder, one row a file, a partition for each share of them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.parts = options["path"], int(options.get("partitions", "8"))
        self.origin = options.get("origin", "http://localhost").rstrip("/")

    def partitions(self) -> list[_Files]:
        paths = sorted(str(p) for p in Path(self.folder).rglob("*.htm*"))
        return [_Files(paths[i :: self.parts]) for i in range(min(self.parts, len(paths)))] or [_Files([])]

    def read(self, partition: _Files):
        for path in partition.paths:
            name = Path(path).relative_to(self.folder).as_posix()
            yield (f"{self.origin}/{name}", 200, "text/html", Path(path).read_text(encoding="utf-8", errors="replace"))


class SavedPages(DataSource):
    """``spark.read.format("saved_pages").option("path", folder)``: url, http_status, content_type, body. The folder must be one that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "url string, http_status int, content_type string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
