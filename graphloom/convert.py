"""One call from raw edge files to a dataset: read, remap, split, bucket, write. ``python -m graphloom.convert --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.hashing import h48
from graphloom.operators import preprocess as P
from graphloom.runtime import materialize
from graphloom.sources import readers, writers


def convert(
    spark: SparkSession, output: str, edges: list[str], columns: tuple[int, ...] = (0, 1, 2), delimiter: str = "\t", header_rows: int = 0, splits: tuple[float, ...] | None = None, partitions: int = 1,
    partitioned_evaluation: bool = False, remap: bool = True, sequential_train_nodes: bool = False, overwrite: bool = False,
) -> dict:
    """Writes a dataset and returns its description.

    One file is divided by ``splits`` (train, validation, test; or train, test), or is all training edges; three files are
    the three splits. With ``remap`` raw ids of any kind become dense numbers in hash order, nodes of training edges first
    where ``sequential_train_nodes``; without, they are dense numbers already. Training edges are bucketed by
    ``partitions``, the others only with ``partitioned_evaluation`` (their partitions are -1 otherwise).
    """
    if len(edges) not in (1, 3) or len(edges) == 3 and splits:
        raise ValueError("one file, with or without splits, or three files")
    if sequential_train_nodes and not remap:
        raise ValueError("sequential training nodes need remapping")
    if writers.exists(spark, f"{output}/dataset.json"):
        if not overwrite:
            raise FileExistsError(output)
        writers.remove(spark, output)
    names = ("train", "validation", "test")
    tables = {n: readers.read_delimited(spark, path, columns, delimiter, header_rows) for n, path in zip(names, edges, strict=False)}
    if len(columns) == 2:
        tables = {n: t.withColumn("rel", F.lit("0")) for n, t in tables.items()}
    raw: DataFrame | None = None
    for n, t in tables.items():
        part = t.select("src", "rel", "dst", F.lit(n).alias("split"))
        raw = part if raw is None else raw.unionByName(part)
    raw = materialize(raw.where("src is not null and dst is not null and rel is not null"), "raw")
    if splits:
        text = F.concat_ws("\u0001", "src", "rel", "dst")
        raw = materialize(P.split_edges(raw.drop("split"), text, splits), "split")
    if remap:
        ends = P.node_set(raw)
        if sequential_train_nodes:
            train = raw.where("split = 'train'")
            first = train.select(F.col("src").alias("raw")).union(train.select("dst")).distinct()
            nodes = materialize(P.train_first_ids(raw, first), "nodes")
        else:
            nodes = materialize(P.random_ids(ends), "nodes")
        relations = materialize(P.random_ids(raw.select(F.col("rel").alias("raw")).distinct(), "relations"), "relations")
        mapped = P.apply_mapping(raw, nodes)
        mapped = mapped.join(relations.select(F.col("raw").alias("rel"), F.col("id").alias("_rel")), "rel").drop("rel").withColumnRenamed("_rel", "rel")
        num_nodes, num_relations = nodes.count(), relations.count()
    else:
        mapped = raw.select(F.col("src").cast("long").alias("src"), F.col("rel").cast("long").alias("rel"), F.col("dst").cast("long").alias("dst"), "split")
        if not mapped.where("src is null or rel is null or dst is null or src < 0 or rel < 0 or dst < 0").isEmpty():
            raise ValueError("without remapping, ids are non-negative numbers")
        top = mapped.agg(F.max(F.greatest("src", "dst")).alias("n"), F.max("rel").alias("r")).first()
        num_nodes, num_relations, nodes, relations = (top["n"] if top["n"] is not None else -1) + 1, (top["r"] if top["r"] is not None else -1) + 1, None, None
    mapped = mapped.select("src", "rel", "dst", "split").withColumn("edge", h48(F.concat_ws("-", "src", "rel", "dst"), "edge"))
    if partitions > 1:
        mapped = P.with_buckets(mapped, num_nodes, partitions)
        if not partitioned_evaluation:
            own = F.col("split") == "train"
            for c in ("src_part", "dst_part", "bucket_id"):
                mapped = mapped.withColumn(c, F.when(own, F.col(c)).otherwise(F.lit(-1)))
    mapped = materialize(mapped, "edges")
    counts = {r["split"]: r["n"] for r in mapped.groupBy("split").agg(F.count(F.lit(1)).alias("n")).collect()}
    description = {
        "num_edges": sum(counts.values()), "num_nodes": num_nodes, "num_relations": num_relations, "num_train": counts.get("train", 0), "num_valid": counts.get("validation", 0), "num_test": counts.get("test", 0),
        "num_partitions": partitions, "partitioned_evaluation": partitioned_evaluation, "remapped": remap,
    }
    writers.write_dataset(mapped, nodes, relations, output, description)
    return description


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Convert delimited edge files to a dataset.")
    p.add_argument("output")
    p.add_argument("--edges", nargs="+", required=True, help="one file, or the files of the training, validation and test edges")
    p.add_argument("--columns", type=int, nargs="+", default=[0, 1, 2])
    p.add_argument("--delim", default="\t")
    p.add_argument("--header_length", type=int, default=0)
    p.add_argument("--dataset_split", type=float, nargs="+")
    p.add_argument("--num_partitions", type=int, default=1)
    p.add_argument("--partitioned_eval", action="store_true")
    p.add_argument("--no_remap_ids", action="store_true")
    p.add_argument("--sequential_train_nodes", action="store_true")
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    print(convert(spark, a.output, a.edges, tuple(a.columns), a.delim, a.header_length, tuple(a.dataset_split) if a.dataset_split else None, a.num_partitions, a.partitioned_eval, not a.no_remap_ids, a.sequential_train_nodes, a.overwrite))


if __name__ == "__main__":
    main()
