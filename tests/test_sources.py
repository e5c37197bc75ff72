"""Readers, writers, configuration, streaming."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom import config, convert
from graphloom.operators import graph, preprocess
from graphloom.sources import raw, readers, writers
from graphloom.streaming import edges as streaming


def test_delimited(spark, tmp_path):
    (tmp_path / "e.txt").write_text("a\tx\tb\nc\ty\td\n")
    got = readers.read_delimited(spark, str(tmp_path / "e.txt"), (2, 1, 0)).collect()
    assert [tuple(r) for r in got] == [("b", "x", "a"), ("d", "y", "c")]
    (tmp_path / "h.csv").write_text("s,d\n1,2\n")
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "h.csv"), (0, 1), ",", 1, strings=False).collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        readers.read_delimited(spark, str(tmp_path / "e.txt"), (0,))


def test_binary_and_offsets(spark, tmp_path):
    edges = np.array([[0, 1, 2], [3, 4, 5]], "<i4")
    (tmp_path / "e.bin").write_bytes(edges.tobytes())
    got = readers.read_edges_binary(spark, str(tmp_path / "e.bin")).orderBy("place").collect()
    assert [tuple(r)[1:] for r in got] == [(0, 1, 2), (3, 4, 5)]
    (tmp_path / "o.txt").write_text("2\n0\n1\n")
    assert [tuple(r) for r in readers.read_offsets(spark, str(tmp_path / "o.txt")).collect()] == [(0, 2), (1, 0), (2, 1)]
    assert readers.from_numpy(spark, edges[:, [0, 2]]).collect()[1]["rel"] == 0


def test_dataset_and_checkpoint(spark, tmp_path):
    own = spark.createDataFrame([("a", "r", "b"), ("b", "r", "c")], "src string, rel string, dst string")
    mapped, nodes, rels = preprocess.remap({"train": own})
    path = f"file://{tmp_path}/ds"
    writers.write_dataset(preprocess.with_buckets(mapped, 3, 2), nodes, rels, path, {"num_edges": 2})
    assert spark.read.parquet(f"{path}/edges").count() == 2 and readers.read_description(spark, f"{path}/dataset.json") == {"num_edges": 2}
    keeper = writers.Checkpointer(spark, f"file://{tmp_path}/ck")
    keeper.save({"nodes": nodes}, {"epoch": 1})
    keeper.save({"nodes": nodes}, {"epoch": 1})
    tables, meta = keeper.load(1)
    assert tables["nodes"].count() == 3 and meta["epoch"] == 1


def test_headers_of_any_length(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.tsv").write_text("one\ntwo\tlines\n" + "".join(f"{k}{i}\tr\t{i}\n" for i in range(5)))
    got = readers.read_delimited(spark, str(tmp_path), (0, 1, 2), header_rows=2).collect()
    assert sorted(r["src"] for r in got) == sorted(f"{k}{i}" for k in range(3) for i in range(5))


def test_raw_files_are_read_in_ranges(spark, tmp_path):
    rows = np.arange(3000, dtype="<i4").reshape(1000, 3)
    (tmp_path / "e.bin").write_bytes(rows.tobytes())
    found = raw.read_edges(spark, str(tmp_path / "e.bin"), part_bytes=1200)
    assert found.rdd.getNumPartitions() == 10
    assert [tuple(r) for r in found.orderBy("place").collect()] == [(i, *map(int, r)) for i, r in enumerate(rows)]
    only = raw.read_raw(spark, f"file://{tmp_path}/e.bin", 3, "INT", {"dst": 2}, 1200)
    assert only.columns == ["file", "place", "dst"] and only.agg({"dst": "sum"}).first()[0] == int(rows[:, 2].sum())
    whole = readers.read_matrix(spark, str(tmp_path / "e.bin"), 3, "INT")
    assert sorted(map(str, whole.select("place", "row").collect())) == sorted(map(str, raw.read_raw(spark, str(tmp_path / "e.bin"), 3, "INT").select("place", "row").collect()))
    (tmp_path / "bad.bin").write_bytes(b"12345")
    (tmp_path / "none.bin").write_bytes(b"")
    assert raw.read_features(spark, str(tmp_path / "none.bin"), 4).count() == 0
    for wrong in (lambda: raw.read_raw(spark, str(tmp_path / "bad.bin"), 3, "INT").count(), lambda: raw.read_raw(spark, str(tmp_path / "no.bin"), 3, "INT").count(), lambda: raw.read_edges(spark, str(tmp_path / "e.bin"), 4)):
        with pytest.raises(Exception):  # noqa: B017
            wrong()


def test_dataset_folder(spark, tmp_path):
    for folder in ("edges", "nodes"):
        (tmp_path / folder).mkdir()
    for k, split in enumerate(raw.SPLITS):
        np.array([[k, 0, k + 1], [k + 1, 1, k]], "<i4").tofile(tmp_path / "edges" / f"{split}_edges.bin")
        np.array([k], "<i4").tofile(tmp_path / "nodes" / f"{split}_nodes.bin")
    np.arange(8, dtype="<f4").tofile(tmp_path / "nodes" / "features.bin")
    np.array([1, 0, -1, 1], "<i4").tofile(tmp_path / "nodes" / "labels.bin")
    t = raw.read_dataset(spark, str(tmp_path), feature_dim=2, node_splits=True)
    assert sorted(tuple(r) for r in t.split("test").select("src", "rel", "dst").collect()) == [(2, 0, 3), (3, 1, 2)] and t.edges.select("edge").distinct().count() == 6
    assert {r["id"]: r["vec"] for r in t.features.collect()}[3] == [6.0, 7.0]
    assert {(r["id"], r["y"], r["split"]) for r in t.labels.collect()} == {(0, 1, "train"), (1, 0, "validation"), (2, None, "test")}


def test_conversion_in_one_call(spark, tmp_path):
    lines = [f"n{i % 7}\tr{i % 2}\tn{(i * 3 + 1) % 9}" for i in range(40)]
    (tmp_path / "e.tsv").write_text("src\trel\tdst\nx\ty\tz\n" + "\n".join(lines) + "\n")
    out = f"file://{tmp_path}/ds"
    d = convert.convert(spark, out, [str(tmp_path / "e.tsv")], header_rows=2, splits=(0.8, 0.1, 0.1), partitions=3)
    assert (d["num_train"], d["num_valid"], d["num_test"], d["num_nodes"], d["num_relations"]) == (32, 4, 4, 8, 2)
    edges = spark.read.parquet(f"{out}/edges")
    names = {int(r[1]): r[0] for r in spark.read.csv(f"{out}/node_mapping").collect()}
    rels = {int(r[1]): r[0] for r in spark.read.csv(f"{out}/relation_mapping").collect()}
    assert sorted(f"{names[r['src']]}\t{rels[r['rel']]}\t{names[r['dst']]}" for r in edges.collect()) == sorted(lines)
    assert {(r["split"], r["src_part"] >= 0) for r in edges.collect()} == {("train", True), ("validation", False), ("test", False)}
    with pytest.raises(FileExistsError):
        convert.convert(spark, out, [str(tmp_path / "e.tsv")])
    (tmp_path / "n.csv").write_text("0,1\n2,3\n1,0\n")
    d = convert.convert(spark, out, [str(tmp_path / "n.csv")] * 3, (0, 1), ",", partitions=2, partitioned_evaluation=True, remap=False, overwrite=True)
    assert d["num_edges"] == 9 and d["num_nodes"] == 4 and spark.read.parquet(f"{out}/edges").where("src_part < 0").isEmpty()
    for wrong in ({"edges": ["a", "b"]}, {"edges": ["a"] * 3, "splits": (1.0,)}, {"edges": ["a"], "remap": False, "sequential_train_nodes": True}):
        with pytest.raises(ValueError):
            convert.convert(spark, out, **wrong)
    writers.copy(spark, out, f"{out}2")
    assert spark.read.parquet(f"{out}2/edges").count() == 9


def test_documents_of_options():
    text = """
model:
  learning_task: LINK_PREDICTION
  encoder:
    train_neighbor_sampling: [{type: UNIFORM, options: {max_neighbors: 5}}]
    layers:
      - [{type: EMBEDDING, output_dim: 20}]
      - [{type: GNN, output_dim: 12, activation: RELU, bias: true, options: {type: GRAPH_SAGE, aggregator: MEAN}}]
  decoder: {type: DISTMULT, options: {inverse_edges: false}}
  loss: {type: SOFTMAX_CE, options: {reduction: MEAN}}
  dense_optimizer: {type: ADAM, options: {learning_rate: 0.01}}
  sparse_optimizer: {type: ADAGRAD, options: {learning_rate: 1}}
storage:
  device_type: cuda
  dataset: {dataset_dir: ./x, num_nodes: 10}
  edges: {type: HOST_MEMORY, options: {dtype: int}}
  embeddings: {type: MEM_PARTITION_BUFFER, options: {num_partitions: 16, buffer_capacity: 4, prefetching: false, edge_bucket_ordering: CUSTOM}}
training:
  batch_size: 100
  negative_sampling_method: DNS
  negative_sampling_selected_ratio: 0.2
  negative_sampling: {num_chunks: 10, negatives_per_positive: 1000, degree_fraction: 0.5, filtered: false}
  num_epochs: 5
  epochs_per_shuffle: 1
evaluation:
  epochs_per_eval: 5
  negative_sampling: {num_chunks: 1, negatives_per_positive: 10000}
"""
    c = config.load_yaml(text)
    assert c.model.embedding_dim == 20 and c.model.encoder[0].max_neighbors == 5 and c.model.encoder[0].sampler is config.NeighborSampler.UNIFORM and not c.model.inverse_edges
    assert c.storage.partitions.num_partitions == 16 and c.storage.embeddings is config.Backend.MEM_PARTITION_BUFFER and c.model.sparse_optimizer.learning_rate == 1.0
    assert c.training.negatives.method is config.NegativeMethod.DNS and c.training.negatives.ratio == 0.2 and c.training.num_epochs == 5
    assert not c.evaluation.negatives.filtered and c.evaluation.negatives.negatives_per_positive == 10_000
    for bad in ("x: 1", "training: {no_such: 1}", "model: {encoder: {layers: [[{type: POOL, output_dim: 1}]]}}", "model: {decoder: {type: NODE}}", "model: {decoder: {type: DISTMULT, options: {edge_decoder_method: CORRUPT_REL}}}"):
        with pytest.raises(ValueError):
            config.load_yaml(bad)


def test_hubs_are_spread(spark):
    """Nine of ten edges leave one node; the index has no partition much larger than the others, and draws equal those of plain lists."""
    edges = spark.range(4000).selectExpr("if(id % 10 = 0, id, 0) as src", "id % 3 as rel", "id * 7 % 4001 as dst")
    index = graph.adjacency(edges)
    sizes = [r["n"] for r in index.rows.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) >= 3 and max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]
    ids = spark.createDataFrame([(0,), (10,), (11,)], "node long")
    got = sorted((r["node"], r["draw"], r["nbr"], r["rel"]) for r in graph.sample_uniform(ids, edges, 5).collect())
    lists = {}
    for r in edges.collect():
        lists.setdefault(r["src"], []).append((r["dst"], r["rel"]))
    want = []
    for node in (0, 10):
        own = sorted(lists[node])
        places = range(len(own)) if len(own) <= 5 else [int(hashlib.md5(f"{node}-{d}:uniform".encode()).hexdigest()[:12], 16) % len(own) for d in range(5)]
        want += [(node, d, *own[i]) for d, i in enumerate(places)]
    assert got == sorted(want)


def test_config():
    c = config.load_config({"model": {"decoder": "transe", "loss": {"reduction": "mean"}}, "training": {"batch_size": 5}})
    assert c.model.decoder is config.DecoderType.TRANSE and c.training.batch_size == 5 and c.evaluation.negatives.filtered
    assert config.EdgeDecoderMethod.parse("train") is config.EdgeDecoderMethod.CORRUPT_NODE
    for bad in ({"x": 1}, {"training": {"batch_size": 0}}, {"model": {"decoder": "complex", "embedding_dim": 3}}, {"storage": {"embeddings": "partition_buffer"}}):
        with pytest.raises(ValueError):
            config.load_config(bad)


def test_stream_and_table_agree(spark, tmp_path):
    rows = spark.sql("SELECT id % 3 AS user_id, timestamp_seconds(id * 40000) AS ts FROM range(20)")
    rows.write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/ev")
    got = streaming.run_to_memory(streaming.windowed_degrees(stream), "deg")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streaming.windowed_degrees(rows).collect()))


def test_entry_survives_without_llm(monkeypatch):
    import __spark_entry__ as entry

    monkeypatch.setattr(entry, "_optional", lambda name: None if "llm" in name or name == "corpus_pipeline" else __import__("importlib").import_module(name))
    assert not [q for q in entry.queries() if q.startswith("op")]
