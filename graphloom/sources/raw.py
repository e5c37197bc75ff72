"""Raw row-major binary files as a splittable source: byte ranges are partitions, rows are numbered by their place in the file.

Files are opened with pyarrow's file systems (local and mounted paths, s3://, gs://, hdfs://). In a store that only Spark
reads, :func:`graphloom.sources.readers.read_matrix` takes whole files instead.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a partition, and rows read at a time.
PART_BYTES, STEP = 64 << 20, 1 << 16


class Range(InputPartition):
    def __init__(self, file: str, start: int, rows: int):
        super().__init__((file, start, rows))
        self.file, self.start, self.rows = file, start, rows


class RawReader(DataSourceReader):
    """Reads (file, place) and either all of a row as an array or the named columns of it."""

    def __init__(self, options: dict):
        self.path, self.width, self.kind = options["path"], int(options["width"]), options["kind"]
        self.bytes, self.columns = int(options.get("part_bytes", PART_BYTES)), [c.split(":") for c in options["columns"].split(",")] if options.get("columns") else []

    def partitions(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [found] if found.type == fs.FileType.File else sorted((i for i in store.get_file_info(fs.FileSelector(path, recursive=True)) if i.type == fs.FileType.File), key=lambda i: i.path)
        row = self.width * np.dtype(self.kind).itemsize
        step, out = max(1, self.bytes // row), []
        for i in infos:
            if i.size % row:
                raise ValueError(f"{i.path} does not hold rows of {self.width}")
            out += [Range(i.path, s, min(step, i.size // row - s)) for s in range(0, i.size // row, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition):
        from pyarrow import fs

        if not partition.rows:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        row = self.width * np.dtype(self.kind).itemsize
        real = np.dtype(self.kind).kind == "f"
        with store.open_input_file(partition.file) as f:
            f.seek(partition.start * row)
            for at in range(partition.start, partition.start + partition.rows, STEP):
                n = min(STEP, partition.start + partition.rows - at)
                m = np.frombuffer(f.read(n * row), self.kind).reshape(n, self.width)
                place = pa.array(np.arange(at, at + n, dtype=np.int64))
                wide = "f8" if real else "i8"
                if self.columns:
                    values, names = [pa.array(np.ascontiguousarray(m[:, int(k)]).astype(wide)) for _, k in self.columns], [c for c, _ in self.columns]
                else:
                    flat = pa.array(m.astype(wide).ravel())
                    values, names = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.width + 1, self.width, dtype=np.int32)), flat)], ["row"]
                yield pa.RecordBatch.from_arrays([pa.array([partition.file] * n), place, *values], names=["file", "place", *names])


class RawMatrix(DataSource):
    """Options: path, width, kind (a numpy type), columns ("name:place,..." for some columns only), part_bytes."""

    @classmethod
    def name(cls):
        return "raw_matrix"

    def schema(self):
        real = np.dtype(self.options["kind"]).kind == "f"
        element = "double" if real else "bigint"
        named = self.options.get("columns")
        return "file string, place bigint, " + (", ".join(f"{c.split(':')[0]} {element}" for c in named.split(",")) if named else f"row array<{element}>")

    def reader(self, schema):
        return RawReader(dict(self.options))


def read_raw(spark: SparkSession, path: str, width: int, dtype: str, columns: dict[str, int] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(file, place, row) of raw files, or (file, place, and the named columns); only those columns leave the reader."""
    from graphloom.sources.readers import DTYPES

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module
    spark.dataSource.register(RawMatrix)
    source = spark.read.format("raw_matrix").option("path", path).option("width", width).option("kind", DTYPES[dtype.upper()]).option("part_bytes", part_bytes)
    if columns:
        if any(not 0 <= k < width for k in columns.values()):
            raise ValueError(f"columns lie in 0 to {width - 1}")
        source = source.option("columns", ",".join(f"{c}:{k}" for c, k in columns.items()))
    return source.load()


def read_edges(spark: SparkSession, path: str, width: int = 3, dtype: str = "INT", part_bytes: int = PART_BYTES) -> DataFrame:
    """(place, src, rel, dst) of a raw edge file; two columns get relation 0."""
    if width not in (2, 3):
        raise ValueError("edges have two or three columns")
    rows = read_raw(spark, path, width, dtype, {"src": 0, "rel": 1, "dst": 2} if width == 3 else {"src": 0, "dst": 1}, part_bytes)
    return rows.select("place", "src", "rel" if width == 3 else F.lit(0).cast("long").alias("rel"), "dst")


def read_features(spark: SparkSession, path: str, width: int, dtype: str = "FLOAT", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, vec): a row for each node, in id order in the file."""
    return read_raw(spark, path, width, dtype, part_bytes=part_bytes).select(F.col("place").alias("id"), F.col("row").cast("array<double>").alias("vec"))


def read_labels(spark: SparkSession, path: str, dtype: str = "INT", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, y): a class for each node; negative ones are null."""
    rows = read_raw(spark, path, 1, dtype, {"y": 0}, part_bytes)
    return rows.select(F.col("place").alias("id"), F.when(F.col("y") >= 0, F.col("y")).alias("y"))


def read_nodes(spark: SparkSession, path: str, dtype: str = "INT", part_bytes: int = PART_BYTES) -> DataFrame:
    """(place, id): a list of nodes, such as those of a split."""
    return read_raw(spark, path, 1, dtype, {"id": 0}, part_bytes).select("place", "id")


#: Names of a dataset's files.
SPLITS = ("train", "validation", "test")


def read_dataset(spark: SparkSession, path: str, width: int = 3, dtype: str = "INT", feature_dim: int = -1, node_splits: bool = False, part_bytes: int = PART_BYTES):
    """The tables of a raw dataset folder: edges/{train,validation,test}_edges.bin as one edge table with a split, and, where
    asked for, nodes/features.bin, nodes/labels.bin and nodes/{train,validation,test}_nodes.bin."""
    from graphloom.operators.tables import GraphTables
    from graphloom.sources.writers import exists

    edges = None
    for split in SPLITS:
        file = f"{path}/edges/{split}_edges.bin"
        if exists(spark, file):
            part = read_edges(spark, file, width, dtype, part_bytes).withColumn("split", F.lit(split))
            edges = part if edges is None else edges.unionByName(part)
    if edges is None:
        raise FileNotFoundError(f"{path}/edges/train_edges.bin")
    place = {s: i for i, s in enumerate(SPLITS)}
    code = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])[F.col("split")]
    edges = edges.withColumn("edge", F.col("place") * F.lit(len(SPLITS)) + code).drop("place")
    tables = GraphTables(edges)
    if feature_dim > 0:
        tables.features = read_features(spark, f"{path}/nodes/features.bin", feature_dim, part_bytes=part_bytes)
    if node_splits:
        labels = read_labels(spark, f"{path}/nodes/labels.bin", part_bytes=part_bytes)
        nodes = None
        for split in SPLITS:
            file = f"{path}/nodes/{split}_nodes.bin"
            if exists(spark, file):
                part = read_nodes(spark, file, dtype, part_bytes).select("id", F.lit(split).alias("split"))
                nodes = part if nodes is None else nodes.unionByName(part)
        tables.labels = labels if nodes is None else labels.join(nodes, "id")
    return tables
