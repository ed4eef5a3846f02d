"""Data sources in Python: a reader of grid cells in windows, and a writer of tiles whose files show only when the whole job has ended.

The reader makes one partition for each tile of the grid that the pushed filters on r and c leave. The writer's tasks put
files aside; the commit on the driver moves them in and then writes the list of files, which readers go by.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

CELLS, TILES = "gridsift_cells", "gridsift_tiles"
MANIFEST = "_files.json"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Window(InputPartition):
    """Cells with r0 <= r < r1 and c0 <= c < c1."""

    r0: int
    r1: int
    c0: int
    c1: int

    def __init__(self, r0: int, r1: int, c0: int, c1: int):
        super().__init__((r0, r1, c0, c1))
        self.r0, self.r1, self.c0, self.c1 = r0, r1, c0, c1


class CellReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.key, self.cols, self.tile = options["path"], options["key"], int(options["cols"]), int(options.get("tile", "256"))
        self.names = [f.name for f in schema.fields if f.name not in ("r", "c")]
        self.box = {"r": [None, None], "c": [0, self.cols - 1]}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on r and c narrow the window and are done with; all other filters are Spark's."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            value = getattr(f, "value", None)
            if name not in self.box or not (isinstance(value, int) or isinstance(f, In)):
                yield f
                continue
            low, high = self.box[name]
            bounds = {EqualTo: (value, value), GreaterThanOrEqual: (value, None), LessThanOrEqual: (None, value)}
            if isinstance(value, int):
                bounds |= {GreaterThan: (value + 1, None), LessThan: (None, value - 1)}
            if type(f) not in bounds:
                yield f
                continue
            a, b = bounds[type(f)]
            self.box[name] = [a if low is None else low if a is None else max(a, low), b if high is None else high if b is None else min(b, high)]

    def _dataset(self):
        import pyarrow.dataset as ds

        system, path = _opened(self.path)
        return ds.dataset(path, filesystem=system, format="parquet")

    def partitions(self) -> list[InputPartition]:
        """Tiles that the window touches; the last row comes from the statistics of the files' key."""
        last = -1
        for fragment in self._dataset().get_fragments():
            at = fragment.physical_schema.get_field_index(self.key)
            for group in range(fragment.metadata.num_row_groups):
                chunk = fragment.metadata.row_group(group).column(at)
                last = max(last, chunk.statistics.max) if chunk.statistics is not None and chunk.statistics.has_min_max else last
        (r_low, r_high), (c_low, c_high) = self.box["r"], self.box["c"]
        r_low, r_high = max(0, r_low or 0), min(last // self.cols, last if r_high is None else r_high)
        c_low, c_high = max(0, c_low), min(self.cols - 1, c_high)
        cut = lambda low, high: [(max(low, k * self.tile), min(high + 1, (k + 1) * self.tile)) for k in range(low // self.tile, high // self.tile + 1)] if low <= high else []
        return [Window(*r, *c) for r in cut(r_low, r_high) for c in cut(c_low, c_high)]

    def read(self, window: Window | None) -> Iterator[pa.RecordBatch]:
        """The window's cells: row groups whose keys lie outside its rows are not read, nor are other columns. Where there are no partitions, Spark asks once, for none."""
        if window is None:
            return
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        key = ds.field(self.key)
        inside = (key >= window.r0 * self.cols) & (key < window.r1 * self.cols)
        for batch in self._dataset().scanner(columns=list(dict.fromkeys([self.key, *self.names])), filter=inside, use_threads=False).to_batches():
            r = pc.divide(batch.column(self.key), self.cols)
            c = pc.subtract(batch.column(self.key), pc.multiply(r, self.cols))
            own = pc.and_(pc.greater_equal(c, window.c0), pc.less(c, window.c1))
            yield pa.RecordBatch.from_arrays([r.cast(pa.int64()), c.cast(pa.int64()), *(batch.column(n) for n in self.names)], ["r", "c", *self.names]).filter(own)


class CellSource(DataSource):
    """spark.read.format("gridsift_cells"): path (a parquet file or folder), key (a column of dense numbers, row * cols + column), cols, tile; the schema is r long, c long and wanted columns."""

    @classmethod
    def name(cls) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return CellReader(self.options, schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class TileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), uuid.uuid4().hex, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """This task's rows in a file put aside; a task that runs twice writes two, of which one is committed."""
        import pyarrow.parquet as pq

        system, root = _opened(self.path)
        system.create_dir(f"{root}/_aside-{self.job}", recursive=True)
        name, writer = f"{uuid.uuid4().hex}.parquet", None
        for batch in batches:
            if writer is None:
                writer = pq.ParquetWriter(f"{root}/_aside-{self.job}/{name}", batch.schema, filesystem=system)
            writer.write_batch(batch)
        if writer is None:
            return Written([])
        writer.close()
        return Written([name])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Move the tasks' files in, then list them with those that are there; the list is replaced in one step."""
        system, root = _opened(self.path)
        system.create_dir(root, recursive=True)
        files = [] if self.overwrite else listed(self.path)
        for name in [n for m in messages if m for n in m.files]:
            system.move(f"{root}/_aside-{self.job}/{name}", f"{root}/{name}")
            files.append(name)
        with system.open_output_stream(f"{root}/_{self.job}") as out:
            out.write(json.dumps(files).encode())
        system.move(f"{root}/_{self.job}", f"{root}/{MANIFEST}")
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/_aside-{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_aside-{self.job}")


class TileSink(DataSource):
    """df.write.format("gridsift_tiles").mode("append" or "overwrite").save(path), on storage that the driver and all executors share."""

    @classmethod
    def name(cls) -> str:
        return TILES

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TileWriter(self.options, overwrite)


def listed(path: str) -> list[str]:
    """The files that committed jobs have written to the folder."""
    system, root = _opened(path)
    if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.NotFound:
        return []
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def read_tiles(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of all committed jobs."""
    files = [f"{path.rstrip('/')}/{n}" for n in listed(path)]
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CellSource)
    spark.dataSource.register(TileSink)
