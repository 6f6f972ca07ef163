"""Ingest: record files, and generated keys and values."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tephra.functions.values import format_value


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, value) from files of records: 8-byte big-endian double, 4-byte little-endian length, UTF-8 bytes.

    A record that is cut off at the end of a file is left out.
    """

    def parse(batches):
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys, values, at = [], [], 0
                while at + 12 <= len(raw):
                    (key,), (n,) = struct.unpack_from(">d", raw, at), struct.unpack_from("<I", raw, at + 8)
                    if at + 12 + n > len(raw):
                        break
                    keys.append(key)
                    values.append(raw[at + 12 : at + 12 + n].decode("utf-8", "replace"))
                    at += 12 + n
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys, pa.float64()), pa.array(values, pa.string())], names=["path", "key", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, "path string, key double, value string")


def write_records(pairs: list[tuple[float, str]], path: str) -> None:
    """One record file, at a local path or a URI, its folder made if need be; the inverse of read_records() for tests and exports of moderate size."""
    fs, name = pa.fs.FileSystem.from_uri(path) if ":/" in path else (pa.fs.LocalFileSystem(), path)
    if folder := name.rpartition("/")[0]:
        fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(name) as out:
        for key, value in pairs:
            raw = value.encode()
            out.write(struct.pack(">d", key) + struct.pack("<I", len(raw)) + raw)


def generated(spark: SparkSession, n: int, distribution: str = "uniform", high: float = 1e9, seed: int = 42, exponent: float = 1.2, ranks: int = 10_000) -> DataFrame:
    """n rows (seq, key, value) with keys that are uniform on 0..high, normal about its half, or Zipf-distributed ranks."""
    ids = spark.range(1, n + 1).withColumnRenamed("id", "seq")
    if distribution == "uniform":
        key: Column = F.rand(seed) * high
    elif distribution == "normal":
        key = F.greatest(F.lit(0.0), F.lit(high / 2) + F.randn(seed) * (high / 6))
    elif distribution == "zipfian":
        # inverse of the distribution function, tabulated for a fixed number of ranks
        mass = np.cumsum(1 / np.arange(1, ranks + 1) ** exponent)
        table = (mass / mass[-1]).tolist()

        @F.pandas_udf("double")
        def rank(u):
            import pandas as pd

            return pd.Series(np.searchsorted(table, u.to_numpy()) + 1.0)

        key = rank(F.rand(seed)) * (high / ranks)
    else:
        raise ValueError(distribution)
    return ids.withColumn("key", key).withColumn("value", format_value(F.col("key")))


def labelled(spark: SparkSession, n: int, high: float = 1e6, seed: int = 42) -> DataFrame:
    """n rows (seq, key, value) whose values name the key and a random number."""
    rows = spark.range(1, n + 1).withColumnRenamed("id", "seq").withColumn("key", F.rand(seed) * high)
    return rows.withColumn("value", F.concat_ws("-", F.lit("value"), F.format_string("%.6f", "key"), F.floor(F.rand(seed + 1) * 1000).cast("string")))
