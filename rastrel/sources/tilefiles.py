"""A raster file source and sink: one binary file a tile, windows read only their tiles, commits are all or nothing."""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "rastrel_tiles"
#: The file that names the committed version and the raster's shape; a version's tiles are not seen before it does.
CURRENT = "_raster.json"
#: First bytes of a tile: a mark, then height and width of the tile as little-endian numbers; single-precision cells follow.
MARK = b"RTL1"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _read(where: fs.FileSystem, path: str) -> bytes | None:
    if where.get_file_info(path).type != fs.FileType.File:
        return None
    with where.open_input_stream(path) as f:
        return f.read()


def _write(where: fs.FileSystem, path: str, data: bytes) -> None:
    """Whole or not at all: under another name first, so attempts of one task don't mix."""
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    other = f"{path}.{uuid.uuid4().hex}"
    with where.open_output_stream(other) as f:
        f.write(data)
    where.move(other, path)


def _name(version: str, tr: int, tc: int) -> str:
    return f"{version}/{tr}/{tc}.tile"


@dataclass
class Tile(InputPartition):
    """One tile of a version, and the window of the raster that is asked for."""

    tr: int
    tc: int
    window: tuple[int, int, int, int]


@dataclass
class Written(WriterCommitMessage):
    tiles: int


class TileReader(DataSourceReader):
    """A partition for each tile that the filters on r and c leave; filters are checked again on the cells."""

    def __init__(self, path: str):
        self.where, self.path = _open(path)
        found = _read(self.where, f"{self.path}/{CURRENT}")
        if found is None:
            raise FileNotFoundError(f"no raster under {path}")
        self.meta = json.loads(found)
        self.window = [0, self.meta["height"], 0, self.meta["width"]]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of r and c become the window; all filters stay, for the cells of the tiles at its edge."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute in (("r",), ("c",)) and isinstance(f.value, int):
                lo = 0 if f.attribute == ("r",) else 2
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.window[lo] = max(self.window[lo], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.window[lo + 1] = min(self.window[lo + 1], f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self) -> Sequence[Tile]:
        (a, b, c, d), size = self.window, self.meta["tile"]
        if a >= b or c >= d:
            return []
        return [Tile(i, j, (a, b, c, d)) for i in range(a // size, (b - 1) // size + 1) for j in range(c // size, (d - 1) // size + 1)]

    def read(self, part: Tile | None) -> Iterator[pa.RecordBatch]:
        data = _read(self.where, f"{self.path}/{_name(self.meta['version'], part.tr, part.tc)}") if part else None
        if data is None:  # a tile without cells
            return
        if data[:4] != MARK:
            raise ValueError(f"not a tile: {part.tr}, {part.tc}")
        h, w = np.frombuffer(data, "<u4", 2, 4).tolist()
        v = np.frombuffer(data, "<f4", h * w, 12).reshape(h, w)
        r0, c0 = part.tr * self.meta["tile"], part.tc * self.meta["tile"]
        a, b, c, d = part.window
        v = v[max(0, a - r0) : b - r0, max(0, c - c0) : d - c0]
        r, q = np.arange(max(a, r0), max(a, r0) + v.shape[0], dtype=np.int32), np.arange(max(c, c0), max(c, c0) + v.shape[1], dtype=np.int32)
        flat = v.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(r, len(q))), pa.array(np.tile(q, len(r))), pa.array(flat, mask=np.isnan(flat))], ["r", "c", "v"])


class TileWriter(DataSourceArrowWriter):
    """Tasks write the tiles of a new version; committing it is one small file. What another version holds stays readable till then."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.where, self.path = _open(options["path"])
        old = _read(self.where, f"{self.path}/{CURRENT}")
        if old is not None and not overwrite:
            raise FileExistsError(f"a raster is there already: {options['path']}")
        self.old = json.loads(old)["version"] if old is not None else None
        self.meta = {k: int(options[k]) for k in ("height", "width", "tile")} | {"version": f"v-{uuid.uuid4().hex}"}

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        for batch in batches:
            at = {k: batch.schema.get_field_index(k) for k in batch.schema.names}
            for k in range(batch.num_rows):
                tr, tc, h, w = (batch.column(at[c])[k].as_py() for c in ("tr", "tc", "h", "w"))
                v = batch.column(at["v"])[k].values.to_numpy(zero_copy_only=False).astype("<f4")
                _write(self.where, f"{self.path}/{_name(self.meta['version'], tr, tc)}", MARK + np.array([h, w], "<u4").tobytes() + v.tobytes())
                n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        _write(self.where, f"{self.path}/{CURRENT}", json.dumps(self.meta).encode())
        if self.old:
            self._drop(self.old)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(self.meta["version"])

    def _drop(self, version: str) -> None:
        if self.where.get_file_info(f"{self.path}/{version}").type == fs.FileType.Directory:
            self.where.delete_dir(f"{self.path}/{version}")


class TileFiles(DataSource):
    """Cells (r, c, v) when read, tiles (tr, tc, h, w, v) when written."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "r int, c int, v float"

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options), overwrite)


register_pickle_by_value(sys.modules[__name__])  # workers need not import the package


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TileFiles)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Cells r, c, v (null: nodata); filters on r and c leave all but their tiles unread."""
    register(spark)
    return spark.read.format(FORMAT).option("path", path).load()


def write(tiles: DataFrame, value: str, path: str, height: int, width: int, tile: int) -> None:
    """Tiles of `tile` cells a side with arrays `value` to files under `path`; replaces what is there when all are written."""
    register(tiles.sparkSession)
    rows = tiles.select("tr", "tc", "h", "w", tiles[value].cast("array<float>").alias("v"))
    rows.write.format(FORMAT).mode("overwrite").option("path", path).option("height", height).option("width", width).option("tile", tile).save()
