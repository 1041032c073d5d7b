"""A watched folder of CSV files with different headers, as a streaming source.

The offset counts manifests, small files in a shared folder that list which
files a step found; so a restarted stream knows what was read, and offsets stay
small. Each file is a partition, read in a task by its own header: columns are
placed by name, those it lacks are null and those nobody asked for are left out.
Files are read through the file system of their path, as a stream of lines.
Bytes that are no UTF-8 are replaced, a byte-order mark is skipped; hidden and
empty files give no row.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from dwellframe.session import ship_package

FORMAT = "headed_csv"
ROWS = 4096  # rows of a batch


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class HeadedCsv(DataSource):
    """Options: path, manifests (a shared folder that belongs to one stream), columns (JSON list), suffix."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ", ".join(f"`{c}` string" for c in [*json.loads(self.options["columns"]), "feed_path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return HeadedCsvReader(self.options["path"], self.options["manifests"], json.loads(self.options["columns"]),
                               self.options.get("suffix", ".csv"))


class HeadedCsvReader(DataSourceStreamReader):
    def __init__(self, path: str, manifests: str, columns: list[str], suffix: str):
        self.path, self.manifests, self.columns, self.suffix = path, manifests, columns, suffix
        self.seen: set[str] | None = None
        self.steps = 0

    def _manifest(self, step: int) -> list[str]:
        system, root = _open(self.manifests)
        with system.open_input_stream(f"{root}/{step}.json") as f:
            return json.loads(f.read())

    def _load(self) -> None:
        """What earlier runs of the stream listed."""
        system, root = _open(self.manifests)
        system.create_dir(root, recursive=True)
        found = system.get_file_info(fs.FileSelector(root))
        self.steps = max((int(x.base_name[:-5]) for x in found if x.base_name.endswith(".json")), default=0)
        self.seen = {f for step in range(1, self.steps + 1) for f in self._manifest(step)}

    def _files(self) -> list[str]:
        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        inside = ((x, x.path[len(root):].strip("/").split("/")) for x in found if x.is_file and x.size)
        return sorted(x.path for x, parts in inside if x.path.endswith(self.suffix) and not any(p[0] in "._" for p in parts))

    def initialOffset(self) -> dict:
        return {"step": 0}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self._load()
        new = [f for f in self._files() if f not in self.seen]
        if new:
            system, root = _open(self.manifests)
            self.steps += 1
            with system.open_output_stream(f"{root}/_{self.steps}") as f:
                f.write(json.dumps(new).encode())
            system.move(f"{root}/_{self.steps}", f"{root}/{self.steps}.json")  # a manifest is whole or absent
            self.seen.update(new)
        return {"step": self.steps}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [InputPartition(f) for step in range(start["step"] + 1, end["step"] + 1) for f in self._manifest(step)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        with system.open_input_stream(partition.value) as raw:
            lines = csv.reader(io.TextIOWrapper(io.BufferedReader(raw), "utf-8-sig", errors="replace", newline=""))
            header = next((x for x in lines if any(c.strip() for c in x)), None)
            if header is None:
                return
            at = {c.strip(): i for i, c in reversed(list(enumerate(header)))}
            places, names = [at.get(c) for c in self.columns], [*self.columns, "feed_path"]
            rows: list[list[str | None]] = []

            def batch() -> pa.RecordBatch:
                columns = [list(c) for c in zip(*rows)]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in [*columns, [partition.value] * len(rows)]], names=names)

            for line in lines:
                if line:
                    rows.append([line[i] if i is not None and i < len(line) else None for i in places])
                    if len(rows) == ROWS:
                        yield batch()
                        rows.clear()
            if rows:
                yield batch()

    def commit(self, end: dict) -> None:
        pass


def watch_headed(spark: SparkSession, path: str, columns: list[str], manifests: str, suffix: str = ".csv"):
    """A stream of the folder's files as text columns and their ``feed_path``."""
    ship_package(spark)
    spark.dataSource.register(HeadedCsv)
    return (spark.readStream.format(FORMAT).option("path", path).option("manifests", manifests)
            .option("columns", json.dumps(columns)).option("suffix", suffix).load())
