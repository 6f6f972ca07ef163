"""A stored log: sorted Parquet runs in levels, and a manifest that says which count.

<path>/runs/level=L/run_id=R/ hold the rows; <path>/manifest/version=N/ one row for
each run of version N. A version is complete when its folder is committed, which is
the last step of a flush or compaction: a reader sees the runs of one version. One
writer at a time is assumed. Opening changes nothing; old runs go with vacuum().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tephra.operators import reads, stats
from tephra.plans.log import BUFFER_BYTES, BUFFER_LEVEL, ENTRY_BYTES, L0_RUNS, LEVELS, SIZE_RATIO, latest

_MANIFEST = "level int, run_id long, n_rows long, n_pages long, min_key {k}, max_key {k}, min_seq long, max_seq long, size_bytes long"


class KeyValueStore:
    """put, remove, get, range, multi_get, flush, compact over one folder.

    key_type: double (NaN is rejected, -0.0 is 0.0) or long. buffer_rows: unflushed
    writes that trigger a flush. base_fpr: false positive rate of the Bloom filters
    in level 1's Parquet files, ten times more in each next level, a half at most;
    level 0 has none.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "double", value_type: str = "string", buffer_rows: int = BUFFER_BYTES // ENTRY_BYTES, base_fpr: float = 0.01, l0_runs: int = L0_RUNS, auto_compact: bool = True):
        self.spark, self.path = spark, path.rstrip("/")
        self.key_type, self.buffer_rows, self.base_fpr, self.l0_runs, self.auto_compact = key_type, buffer_rows, base_fpr, l0_runs, auto_compact
        self.schema = T._parse_datatype_string(f"key {key_type}, value {value_type}, seq long, is_deleted boolean")
        self.buffer: dict = {}
        self.version, self.runs = self._newest()
        self.seq = max([r["max_seq"] for r in self.runs], default=0)
        self.flushes = self.writes = 0
        self.listeners: list = []  # called with the store after each flush, batch and compaction

    # files

    def _fs(self, sub: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{sub}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _versions(self) -> list[int]:
        fs, p = self._fs("manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p)]
        return sorted(int(n.getName().split("=")[1]) for n in names if n.getName().startswith("version=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))

    def _newest(self) -> tuple[int, list[dict]]:
        versions = self._versions()
        if not versions:
            return 0, []
        rows = self.spark.read.schema(_MANIFEST.format(k=self.key_type)).parquet(f"{self.path}/manifest/version={versions[-1]}").collect()
        return versions[-1], sorted((r.asDict() for r in rows), key=lambda r: (r["level"], r["run_id"]))

    def _commit(self, runs: list[dict]) -> None:
        schema = T._parse_datatype_string(_MANIFEST.format(k=self.key_type))
        rows = [tuple(r[f.name] for f in schema) for r in runs]
        self.version += 1
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={self.version}")
        self.runs = sorted(runs, key=lambda r: (r["level"], r["run_id"]))

    def _folder(self, r: dict) -> str:
        return f"{self.path}/runs/level={r['level']}/run_id={r['run_id']}"

    def _write_run(self, rows: DataFrame, level: int, run_id: int) -> dict | None:
        folder = f"{self.path}/runs/level={level}/run_id={run_id}"
        writer = rows.select("key", "value", "seq", "is_deleted").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite")
        if level:
            fpr = min(self.base_fpr * 10 ** (level - 1), 0.5)
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(fpr))
        writer.parquet(folder)
        stored = self.spark.read.schema(self.schema).parquet(folder).withColumn("level", F.lit(level)).withColumn("run_id", F.lit(run_id).cast("long"))
        made = stats.run_stats(stored).collect()
        return made[0].asDict() if made else None

    def _next_run(self) -> int:
        """Run ids are never used twice: they grow with the manifest version."""
        return self.version + 1

    # writes

    def _canonical(self, key):
        if self.key_type == "double":
            key = float(key)
            if math.isnan(key):
                raise ValueError("NaN is not a key")
            return key + 0.0
        return int(key)

    def put(self, key, value) -> None:
        self.seq += 1
        self.buffer[self._canonical(key)] = (value, self.seq, False)
        self.flush_if_necessary()

    def remove(self, key) -> None:
        self.seq += 1
        self.buffer[self._canonical(key)] = (None, self.seq, True)
        self.flush_if_necessary()

    def put_all(self, rows: DataFrame, order: str | None = None) -> None:
        """A batch (key, value and perhaps is_deleted) as one run.

        With `order` (integers, or timestamps as microseconds), it is the rows' seq: the
        greatest wins, in the batch and against all that the store holds, so a batch that is
        written again changes nothing and one that comes late overwrites nothing newer.
        put() and remove() go on after the greatest seq. Without `order` the batch is newer
        than all before, and a key that occurs twice in it is an error. Rows of a null or
        NaN key are left out; those of a null `order` are an error.
        """
        self.flush()
        rows = rows if "is_deleted" in rows.columns else rows.withColumn("is_deleted", F.lit(False))
        key = F.col("key").cast(self.key_type)
        seq = F.lit(self.seq + 1) if order is None else F.unix_micros(F.col(order).cast("timestamp")) if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order)
        value = F.col("value").cast(self.schema["value"].dataType)
        rows = rows.select(F.when(key == 0, F.lit(0).cast(self.key_type)).otherwise(key).alias("key"), value.alias("value"), seq.cast("long").alias("seq"), F.coalesce(F.col("is_deleted").cast("boolean"), F.lit(False)).alias("is_deleted")).where(F.col("key").isNotNull())
        if self.key_type == "double":
            rows = rows.where(~F.isnan("key"))
        if order is None:
            if not rows.groupBy("key").count().where("count > 1").isEmpty():
                raise ValueError("a key occurs twice in the batch, and no column orders its rows")
            self.seq += 1
        else:
            wrong, last = rows.agg(F.count(F.when(F.col("seq").isNull(), 1)), F.max("seq")).first()
            if wrong:
                raise ValueError(f"{wrong} rows have no {order}")
            self.seq = max(self.seq, last or 0)
            rows = latest(rows).select("key", "value", "seq", "is_deleted")
        self._add(rows)

    def flush_if_necessary(self) -> bool:
        return len(self.buffer) >= self.buffer_rows and self.flush()

    def flush(self) -> bool:
        """Writes the buffer as a run of level 0; false if there is nothing to write."""
        if not self.buffer:
            return False
        self._add(self._buffered())
        self.buffer = {}
        return True

    def _buffered(self) -> DataFrame:
        return self.spark.createDataFrame([(k, *v) for k, v in self.buffer.items()], self.schema)

    def _add(self, rows: DataFrame) -> None:
        made = self._write_run(rows, 0, self._next_run())
        if made:
            self._commit([*self.runs, made])
            self.flushes += 1
            self._written()
        if self.auto_compact:
            level = 0
            while level < LEVELS - 1 and self._full(level):
                self.compact(level)
                level += 1

    def _written(self) -> None:
        self.writes += 1
        for listener in self.listeners:
            listener(self)

    def _full(self, level: int) -> bool:
        own = [r for r in self.runs if r["level"] == level]
        if level == 0:
            return len(own) > self.l0_runs
        return sum(r["size_bytes"] for r in own) > self.buffer_rows * ENTRY_BYTES * SIZE_RATIO**level

    def compact(self, level: int) -> None:
        """Merges a level into the next, newest versions only; deletes go if no lower level holds rows."""
        if level >= LEVELS - 1:
            return
        old = [r for r in self.runs if r["level"] in (level, level + 1)]
        if not old:
            return
        rest = [r for r in self.runs if r["level"] not in (level, level + 1)]
        merged = latest(self._read(old))
        if not any(r["level"] > level + 1 for r in rest):
            merged = merged.where(~F.col("is_deleted"))
        made = self._write_run(merged, level + 1, self._next_run())
        self._commit([*rest, *([made] if made else [])])
        self._written()

    def clear(self) -> None:
        """Empties the table: a new version without runs. Readers of older versions keep theirs until vacuum()."""
        self.buffer = {}
        self._commit([])

    def vacuum(self) -> int:
        """Deletes folders that the newest version doesn't name."""
        wanted, gone = {(r["level"], r["run_id"]) for r in self.runs}, 0
        fs, base = self._fs("runs")
        for lev in fs.listStatus(base) if fs.exists(base) else []:
            for run in fs.listStatus(lev.getPath()):
                at = tuple(int(p.getName().split("=")[1]) for p in (lev.getPath(), run.getPath()))
                if at not in wanted:
                    fs.delete(run.getPath(), True)
                    gone += 1
        return gone

    # reads

    def _read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema).withColumn("level", F.lit(0)).withColumn("run_id", F.lit(0).cast("long"))
        schema = T.StructType([*self.schema.fields, T.StructField("level", T.IntegerType()), T.StructField("run_id", T.LongType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/runs").parquet(*[self._folder(r) for r in runs])

    def log(self, low=None, high=None, level: int | None = None) -> DataFrame:
        """Buffered and stored writes; with bounds, only of runs whose keys meet them."""
        runs = [r for r in self.runs if (level is None or r["level"] == level) and (low is None or r["max_key"] >= low) and (high is None or r["min_key"] <= high)]
        out = self._read(runs)
        if self.buffer and level in (None, BUFFER_LEVEL):
            out = self._buffered().withColumn("level", F.lit(BUFFER_LEVEL)).withColumn("run_id", F.lit(-1).cast("long")).unionByName(out)
        return out

    def get(self, key):
        """The value, or None if absent or deleted."""
        key = self._canonical(key)
        if key in self.buffer:
            value, _, deleted = self.buffer[key]
            return None if deleted else value
        row = reads.get(self.log(key, key), key).first()
        return row["value"] if row else None

    def stored(self) -> DataFrame:
        """The flushed writes with level and run_id."""
        return self._read(self.runs)

    def get_from_run(self, key, run_id: int):
        """(value, is_deleted) of a key in one run, None if the run lacks it."""
        key = self._canonical(key)
        row = reads.get_from_run(self._read([r for r in self.runs if r["run_id"] == run_id and r["min_key"] <= key <= r["max_key"]]), run_id, key).first()
        return (row["value"], row["is_deleted"]) if row else None

    def range_from_run(self, low, high, run_id: int) -> DataFrame:
        return reads.range_from_run(self._read([r for r in self.runs if r["run_id"] == run_id]), run_id, low, high)

    def range_from_level(self, low, high, level: int) -> DataFrame:
        return reads.range_from_level(self.log(low, high, level), level, low, high)

    def range(self, low, high) -> DataFrame:
        return reads.range_scan(self.log(low, high), low, high)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(self.log(), keys)

    def get_from_level(self, key, level: int):
        key = self._canonical(key)
        row = reads.get_from_level(self.log(key, key, level), level, key).first()
        return row["value"] if row else None

    def level_for_key(self, key) -> int | None:
        key = self._canonical(key)
        row = reads.level_for_key(self.log(key, key).where(F.col("key") == F.lit(key))).first()
        return row["level"] if row else None

    def level_stats(self) -> DataFrame:
        return stats.level_stats(self._read(self.runs), self.base_fpr, self.buffer_rows * ENTRY_BYTES)

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.values()) for r in self.runs], _MANIFEST.format(k=self.key_type))

    def views(self, prefix: str = "kv") -> None:
        """The log, its live keys and the manifest as temporary views for SQL."""
        self.log().createOrReplaceTempView(f"{prefix}_log")
        from tephra.plans.log import live

        live(self.log()).createOrReplaceTempView(f"{prefix}_live")
        self.manifest().createOrReplaceTempView(f"{prefix}_manifest")

    def mirror(self, path: str) -> "KeyValueStore":
        """A copy in another folder, of the stored runs' newest version."""
        other = KeyValueStore(self.spark, path, self.key_type, self.schema["value"].dataType.simpleString(), self.buffer_rows, self.base_fpr, self.l0_runs, self.auto_compact)
        made = [other._write_run(self._read([r]), r["level"], r["run_id"]) for r in self.runs]
        other.version = max([other.version, *(r["run_id"] for r in self.runs)])
        other._commit([m for m in made if m])
        other.seq = self.seq
        return other

    def same_as(self, other: "KeyValueStore") -> bool:
        columns = ["key", "value", "seq", "is_deleted", "level", "run_id"]
        a, b = self._read(self.runs).select(columns), other._read(other.runs).select(columns)
        return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
