"""The run store as a data source: spark.read.format("trajet_runs"), and readStream alike.

A store is root/bench/config/seed/records.ndjson. The source lists the three levels, keeps the cells that pushed filters on
bench, config_id and seed allow, and cuts large files at line ends; Python moves lines only, the JVM parses them. A stream's
offsets are the lengths of the files up to their last line end, so a line that is still being written waits for its rest,
and what was read before is not read again.

The root is a path that all workers reach, local or any URI of pyarrow's file systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, In, InputPartition

from .schemas import RUN_RECORD

NAME, RECORDS = "trajet_runs", "records.ndjson"
SCHEMA = "bench string, config_id string, seed int, position long, value string"
#: Bytes of a partition, and of a record batch.
SPLIT, CHUNK = 64 << 20, 1 << 20
_CELL = ("bench", "config_id", "seed")


class Piece(InputPartition):
    """Lines of one file that begin in [start, end)."""

    def __init__(self, cell: tuple, path: str, start: int, end: int):
        self.cell, self.path, self.start, self.end = cell, path, start, end


def open_store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def cells(root: str, wanted: dict[str, set] | None = None) -> list[tuple[tuple, str, int]]:
    """(cell, path, bytes) of every cell whose folder names pass, in order; a seed must be a number. A store that is not
    there has none. Folders that the filters exclude are not listed."""
    fs, base = open_store(root)
    wanted = wanted or {}

    def inside(path: str) -> list[pafs.FileInfo]:
        return sorted(fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)), key=lambda f: f.base_name)

    out = []
    for bench in inside(base):
        if bench.type != pafs.FileType.Directory or bench.base_name not in wanted.get("bench", {bench.base_name}):
            continue
        for config in inside(bench.path):
            if config.type != pafs.FileType.Directory or config.base_name not in wanted.get("config_id", {config.base_name}):
                continue
            for seed in inside(config.path):
                if seed.base_name.isdecimal() and int(seed.base_name) in wanted.get("seed", {int(seed.base_name)}):
                    records = fs.get_file_info(f"{seed.path}/{RECORDS}")
                    if records.type == pafs.FileType.File:
                        out.append(((bench.base_name, config.base_name, int(seed.base_name)), records.path, records.size))
    return out


def pieces(found: list[tuple[tuple, str, int]], since: dict[str, int], split: int) -> list[Piece]:
    out = []
    for cell, path, size in found:
        start = since.get(path, 0)
        while start < size:
            out.append(Piece(cell, path, start, min(size, start + split)))
            start += split
    return out


def read_lines(root: str, piece: Piece, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Lines that begin inside the piece; the last one is read to its end, the first one is the earlier piece's if it
    began there. Blank lines are no rows; position is a line's first byte."""
    fs, _ = open_store(root)
    with fs.open_input_file(piece.path) as f:
        at = piece.start
        if at:
            # the line that goes on here began before
            f.seek(at - 1)
            behind = f.read(1)
            while behind and behind[-1:] != b"\n":
                behind = f.read(chunk)
                cut = behind.find(b"\n")
                if cut >= 0:
                    at += cut + 1
                    break
                at += len(behind)
        f.seek(at)
        rest, done = b"", False
        while not done and at < piece.end:
            more = f.read(chunk)
            buffer, done, here = rest + more, not more, 0
            positions, values = [], []
            while at < piece.end and here < len(buffer):
                end = buffer.find(b"\n", here)
                if end < 0:
                    if not done:
                        break
                    end = len(buffer)  # the file's last line has no end
                line = buffer[here:end]
                if line.strip():
                    positions.append(at)
                    values.append(line.decode("utf-8", "replace"))
                at, here = at + end + 1 - here, end + 1
            rest = buffer[here:]
            if values:
                n = len(values)
                columns = [pa.array([piece.cell[0]] * n), pa.array([piece.cell[1]] * n), pa.array([piece.cell[2]] * n, pa.int32()), pa.array(positions, pa.int64()), pa.array(values)]
                yield pa.RecordBatch.from_arrays(columns, ["bench", "config_id", "seed", "position", "value"])


class RunReader(DataSourceReader):
    def __init__(self, root: str, split: int):
        self.root, self.split, self.wanted = root, split, {}

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and len(f.attribute) == 1 and f.attribute[0] in _CELL:
                values = set(f.value) if isinstance(f, In) else {f.value}
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Piece]:
        return pieces(cells(self.root, self.wanted), {}, self.split)

    def read(self, partition: Piece | None) -> Iterator[pa.RecordBatch]:
        # a store without files has one partition of nothing
        return read_lines(self.root, partition) if partition else iter(())


class RunStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, split: int):
        self.root, self.split = root, split

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The length of each file up to its last line end."""
        fs, _ = open_store(self.root)
        out = {}
        for cell, path, size in cells(self.root):
            with fs.open_input_file(path) as f:
                end = size
                while end > 0:
                    start = max(0, end - CHUNK)
                    f.seek(start)
                    cut = f.read(end - start).rfind(b"\n")
                    if cut >= 0:
                        end = start + cut + 1
                        break
                    end = start
            if end:
                out[path] = [end, *cell]
        return out

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        found = [(tuple(cell), path, size) for path, (size, *cell) in sorted(end.items())]
        return pieces(found, {path: size for path, (size, *_) in start.items()}, self.split)

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return read_lines(self.root, partition)

    def commit(self, end: dict) -> None:
        pass


class RunSource(DataSource):
    """Options: path, the store's root; split, bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _given(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("split", SPLIT))

    def reader(self, schema) -> RunReader:
        return RunReader(*self._given())

    def streamReader(self, schema) -> RunStreamReader:
        return RunStreamReader(*self._given())


def _registered(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RunSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def _records(lines: DataFrame) -> DataFrame:
    """Lines as run records; the cell's columns are the folder's. Malformed lines and those without a task are no rows."""
    record = F.from_json("value", f"{RUN_RECORD}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    parsed = lines.withColumn("r", record).filter("r._bad is null and r.task_id is not null")
    own = [c for c in lines.sparkSession.createDataFrame([], RUN_RECORD).columns if c not in _CELL]
    return parsed.select(*_CELL, *(F.col(f"r.{c}").alias(c) for c in own))


def read_store(spark: SparkSession, root: str, split: int = SPLIT, **cell) -> DataFrame:
    """The store's records; bench, config_id and seed (a value or a list) choose the cells that are listed and read."""
    lines = _registered(spark).read.format(NAME).option("split", split).load(root)
    for name, value in cell.items():
        lines = lines.filter(F.col(name).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return _records(lines)


def stream_store(spark: SparkSession, root: str, split: int = SPLIT) -> DataFrame:
    """The store's records as they are appended."""
    return _records(_registered(spark).readStream.format(NAME).option("split", split).load(root))
