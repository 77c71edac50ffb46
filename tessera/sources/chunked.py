"""A data source for solid chunked resources: a partition per chunk, and only the chunks of the asked range are read.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(SolidSource)
    spark.read.format("solid").option("path", file).load().filter("offset >= 1000 and offset < 5000")

Rows are chunks: number, `offset` of the chunk's first plain byte, `plain`, the unpacked bytes. Comparisons of `offset`
are pushed down and prune chunks before anything is unpacked. Options first and last prune by plain bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from tessera.kernels import containers


def _open(path: str):
    from pyarrow import fs

    filesystem, where = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return filesystem.open_input_file(where)


@dataclass
class Chunk(InputPartition):
    number: int
    at: int
    stored: int
    plain: int
    offset: int


class SolidReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.first, self.last = int(options.get("first", 0)), int(options["last"]) if "last" in options else None

    def _layout(self) -> containers.SolidLayout:
        with _open(self.path) as f:
            head = f.read_at(containers.SOLID_HEADER, 0)
            return containers.SolidLayout.parse(f.read_at(containers.SolidLayout.prefix(head), 0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of the offset column; they are also left to Spark, which compares exactly."""
        self.low, self.high = 0, None
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo)) and f.attribute == ("offset",):
                value = int(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = value + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            yield f

    def partitions(self) -> list[Chunk]:
        layout = self._layout()
        low, high = getattr(self, "low", 0), getattr(self, "high", None)
        last = layout.size if self.last is None else min(self.last + 1, layout.size)
        numbers = layout.chunks_for(self.first, last - self.first) if self.first < last else range(0)
        offsets, found = layout.offsets(), []
        for k in numbers:
            offset = k * layout.chunk
            if offset >= low and (high is None or offset < high):
                found.append(Chunk(k, offsets[k], layout.stored[k], layout.plain(k), offset))
        return found

    def read(self, partition: Chunk) -> Iterator[tuple]:
        if partition is None or not isinstance(partition, Chunk):
            return
        with _open(self.path) as f:
            stored = f.read_at(partition.stored, partition.at)
        yield partition.number, partition.offset, containers.expand(stored, partition.plain)


class SolidSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "solid"

    def schema(self) -> str:
        return "number int, offset long, plain binary"

    def reader(self, schema) -> SolidReader:
        return SolidReader(dict(self.options))
