"""A Python data source over a stored log that prunes runs by the pushed key filters.

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LogSource)
    spark.read.format("tephra").option("path", ...).load().where("key = 5")
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType


class _Run(InputPartition):
    def __init__(self, file: str):
        super().__init__(file)


class LogReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high = path.rstrip("/"), None, None

    def _fs(self, path: str) -> tuple[pa.fs.FileSystem, str]:
        """Of a URI of any shared storage that pyarrow knows, or of a local path."""
        return pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)

    def pushFilters(self, filters) -> Iterable:
        """Bounds of the key are used to skip runs and row groups; Spark still applies every filter."""
        for f in filters:
            if getattr(f, "attribute", None) == ("key",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = f.value if self.low is None else max(self.low, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = f.value if self.high is None else min(self.high, f.value)
                if isinstance(f, In) and f.value:
                    self.low = min(f.value) if self.low is None else max(self.low, min(f.value))
                    self.high = max(f.value) if self.high is None else min(self.high, max(f.value))
            yield f

    def partitions(self) -> list[_Run]:
        fs, base = self._fs(self.path)
        below = lambda sub: fs.get_file_info(pa.fs.FileSelector(f"{base}/{sub}", allow_not_found=True))
        whole = lambda folder: fs.get_file_info(f"{folder}/_SUCCESS").type == pa.fs.FileType.File
        versions = [f.path for f in below("manifest") if "version=" in f.path and whole(f.path)]
        if not versions:
            return []
        newest = max(versions, key=lambda p: int(p.rpartition("=")[2]))
        rows = pa.dataset.dataset(newest, format="parquet", filesystem=fs).to_table().to_pylist()
        rows = [r for r in rows if (self.low is None or r["max_key"] >= self.low) and (self.high is None or r["min_key"] <= self.high)]
        return [_Run(f) for r in rows for f in sorted(x.path for x in below(f"runs/level={r['level']}/run_id={r['run_id']}") if x.path.endswith(".parquet"))]

    def read(self, partition: _Run) -> Iterator[pa.RecordBatch]:
        keep = None
        if self.low is not None:
            keep = pa.dataset.field("key") >= self.low
        if self.high is not None:
            below = pa.dataset.field("key") <= self.high
            keep = below if keep is None else keep & below
        level, run = (int(partition.value.split(f"{n}=")[1].split("/")[0]) for n in ("level", "run_id"))
        for batch in pa.dataset.dataset(partition.value, format="parquet", filesystem=self._fs(self.path)[0]).to_batches(columns=["key", "value", "seq", "is_deleted"], filter=keep):
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([level] * n, pa.int32()), pa.array([run] * n, pa.int64())], names=["key", "value", "seq", "is_deleted", "level", "run_id"])


class LogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tephra"

    def schema(self) -> str:
        return f"key {self.options.get('keytype', 'double')}, value {self.options.get('valuetype', 'string')}, seq long, is_deleted boolean, level int, run_id long"

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"])
