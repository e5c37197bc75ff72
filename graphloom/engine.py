"""The Python surface: a model of a graph that can be trained, evaluated, encoded and checkpointed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import DecoderType, GnnType, GraphConfig, LearningTask, NegativeMethod, NeighborSampler
from graphloom.functions import init
from graphloom.operators.encoded import Encoded, EncoderConfig, class_accuracy, train_classes, train_links
from graphloom.operators.encoders import Layer, new_weights
from graphloom.operators.evaluate import link_metrics, rank_edges, rank_sampled
from graphloom.operators.nn import Encoder
from graphloom.operators.scoring import get_decoder
from graphloom.operators.sums import vector_width
from graphloom.operators.tables import GraphTables
from graphloom.operators.preprocess import partition_size
from graphloom.operators.train import Optim, Parameters, TrainConfig, progress_report, train_parameters, train_partitions
from graphloom.plans.rounds import pair_rounds
from graphloom.sources.writers import Checkpointer


def new_embeddings(spark: SparkSession, nodes: int, width: int, salt: str = "init") -> DataFrame:
    """(id, emb, state): Glorot-uniform vectors and zero state for ids 0 to nodes - 1."""
    return spark.range(nodes).select("id", init.glorot_uniform(F.col("id"), width, (nodes, width), salt).alias("emb"), init.constant_init(width, 0.0).alias("state"))


def new_relations(spark: SparkSession, relations: int, width: int, decoder: DecoderType) -> DataFrame:
    """(rel, emb, inv_emb, state, inv_state): ones for DistMult, zeros for TransE, real ones for ComplEx."""
    if decoder is DecoderType.COMPLEX:
        one = F.concat(init.constant_init(width // 2, 1.0), init.constant_init(width // 2, 0.0))
    else:
        one = init.constant_init(width, 0.0 if decoder is DecoderType.TRANSE else 1.0)
    return spark.range(relations).select(F.col("id").alias("rel"), one.alias("emb"), one.alias("inv_emb"), init.constant_init(width, 0.0).alias("state"), init.constant_init(width, 0.0).alias("inv_state"))


@dataclass
class GraphModel:
    """Tables, configuration and the operations on them."""

    spark: SparkSession
    config: GraphConfig
    tables: GraphTables
    #: Epochs and optimiser steps taken, and what each step reported.
    epoch: int = 0
    steps: int = 0
    progress: list[dict] = field(default_factory=list)

    @classmethod
    def create(cls, spark: SparkSession, config: GraphConfig, edges: DataFrame, features: DataFrame | None = None, labels: DataFrame | None = None) -> GraphModel:
        """From edges (edge, src, rel, dst, split) with dense ids, fixed node features (id, vec) and labels (id, y, split) where
        there are any; counts come from the configuration or the data."""
        d, m = config.storage.dataset, config.model
        if d.num_nodes < 0:
            d.num_nodes = edges.agg(F.greatest(F.max("src"), F.max("dst")).alias("n")).first()["n"] + 1
            d.num_relations = edges.agg(F.max("rel").alias("n")).first()["n"] + 1
        width = m.encoder[-1].output_dim if m.encoder else m.embedding_dim
        relations = None if m.decoder is DecoderType.NODE else new_relations(spark, d.num_relations, width, m.decoder)
        if config.storage.edges.storage_level != "NONE":
            edges = edges.persist(StorageLevel.MEMORY_AND_DISK)
        salt = f"init{m.random_seed}" if m.random_seed else "init"
        tables = GraphTables(edges, spark.range(d.num_nodes), new_embeddings(spark, d.num_nodes, m.embedding_dim, salt), relations, features=features, labels=labels)
        model = cls(spark, config, tables)
        if m.encoder:
            tables.weights = new_weights(spark, model.layers(), f"weights{m.random_seed}" if m.random_seed else "weights")
        return model

    def layers(self) -> list[Layer]:
        """The encoder's layers, from the inputs on."""
        m, t, out = self.config.model, self.tables, []
        inputs = m.embedding_dim + (vector_width(t.features, "vec") if t.features is not None else 0)
        for x in m.encoder:
            kind = x.type.name if x.type is GnnType.GCN else f"SAGE_{x.aggregator.name}"
            sampler = {"kind": x.sampler.name} | ({"most": x.max_neighbors} if x.sampler is NeighborSampler.UNIFORM else {"rate": x.rate} if x.sampler is NeighborSampler.DROPOUT else {})
            out.append(Layer(kind, inputs, x.output_dim, x.activation.name, x.bias, tuple(sampler.items())))
            inputs = x.output_dim
        return out

    def _encoded(self) -> tuple[Encoded, EncoderConfig]:
        c, t = self.config, self.tables
        sparse, dense = self.optims()
        settings = EncoderConfig(self.layers(), c.model.use_incoming_nbrs, c.model.use_outgoing_nbrs, c.training.num_epochs, c.training.batch_size, c.model.loss.reduction.name, sparse, dense, self.progress)
        return Encoded(t.node_embeddings, t.weights, t.features, t.relation_embeddings, self.steps), settings

    def optims(self) -> tuple[Optim, Optim]:
        return tuple(Optim(o.type.name, o.learning_rate, None if o.eps == 1e-10 else o.eps, o.weight_decay) for o in (self.config.model.sparse_optimizer, self.config.model.dense_optimizer))

    def settings(self) -> TrainConfig:
        """The training options of the configuration; options that training does not know are errors."""
        c = self.config
        n, m = c.training.negatives, c.model
        sparse, dense = self.optims()
        return TrainConfig(
            c.training.num_epochs, c.training.batch_size, n.num_chunks, n.negatives_per_positive, decoder=m.decoder.name, loss=m.loss.type.name, reduction=m.loss.reduction.name, margin=m.loss.margin, inverse=m.inverse_edges,
            degree_fraction=n.degree_fraction, filtered=n.filtered, method=n.method.name, ratio=n.ratio if n.method is not NegativeMethod.RNS else 1.0, batches_per_step=c.training.batches_per_step,
            sparse=sparse, dense=dense, progress=self.progress,
        )

    def train(self) -> None:
        """The configured number of epochs on top of those taken before; several partitions are trained round by round."""
        c, t = self.config, self.tables
        parts = c.storage.partitions.num_partitions
        if c.model.learning_task is LearningTask.ENCODE:
            raise ValueError("the ENCODE task does not train")
        if c.model.encoder and parts > 1:
            raise ValueError("encoders train on one partition")
        if c.model.learning_task is LearningTask.NODE_CLASSIFICATION:
            if t.labels is None:
                raise ValueError("node classification needs labels")
            p, e = self._encoded()
            self._keep(train_classes(self._labelled("train"), t.edges, p, e, self.epoch))
            return
        settings = self.settings()
        if c.model.encoder:
            p, e = self._encoded()
            self._keep(train_links(t.split("train"), t.split("train"), p, e, settings, self.epoch))
            return
        if settings.method == "GAN" and t.generator_embeddings is None:
            t.generator_embeddings = new_embeddings(self.spark, c.storage.dataset.num_nodes, c.model.embedding_dim, "generator")
        p = Parameters(t.node_embeddings, t.relation_embeddings, t.generator_embeddings, self.steps)
        if parts > 1:
            p = train_partitions(t.split("train"), p, pair_rounds(parts), partition_size(c.storage.dataset.num_nodes, parts), settings, self.epoch)
        else:
            p = train_parameters(t.split("train"), p, settings, self.epoch)
        t.node_embeddings, t.relation_embeddings, t.generator_embeddings = p.nodes, p.relations, p.generator
        self.steps, self.epoch = p.steps, self.epoch + settings.epochs

    def fit(self, path: str | None = None, split: str = "validation") -> list[dict]:
        """The configured epochs one by one: metrics of ``split`` after every ``epochs_per_eval`` of them, a checkpoint under
        ``path`` after every ``epochs_per_checkpoint`` and at the end; returns a row of metrics for each evaluation."""
        c, found = self.config, []
        epochs, last = c.training.num_epochs, self.epoch + c.training.num_epochs
        c.training.num_epochs = 1
        try:
            while self.epoch < last:
                self.train()
                if c.evaluation.epochs_per_eval > 0 and self.epoch % c.evaluation.epochs_per_eval == 0:
                    rows = self.evaluate(split).collect()
                    found.append({"epoch": self.epoch} | ({r["metric"]: r["value"] for r in rows} if "metric" in rows[0] else rows[0].asDict()))
                every = c.training.epochs_per_checkpoint
                if path and (self.epoch == last or every > 0 and self.epoch % every == 0):
                    self.save(path)
        finally:
            c.training.num_epochs = epochs
        return found

    def _keep(self, p: Encoded) -> None:
        t = self.tables
        t.node_embeddings, t.weights, t.relation_embeddings = p.embeddings, p.weights, p.relations
        self.steps, self.epoch = p.steps, self.epoch + self.config.training.num_epochs

    def _labelled(self, split: str) -> DataFrame:
        labels = self.tables.labels
        return (labels.where(F.col("split") == split) if "split" in labels.columns else labels).select("id", "y")

    def report(self) -> DataFrame:
        """Loss and volume of every training step so far."""
        return progress_report(self.spark, self.settings())

    def encodings(self, nodes: DataFrame | None = None) -> DataFrame:
        """(id, emb) that edges are scored by: encodings of the given nodes (node), by default all, or the embeddings as they are."""
        if not self.config.model.encoder:
            return self.tables.node_embeddings.select("id", "emb")
        p, e = self._encoded()
        f, _ = e.run(self.tables.nodes.select(F.col("id").alias("node")) if nodes is None else nodes, self.tables.split("train"), p)
        return f.output.select("id", F.col("g").alias("emb"))

    def ranks(self, split: str = "test") -> DataFrame:
        """Ranks of a split's edges against all nodes, or against ``negatives_per_positive`` sampled candidates where nothing is filtered and that is positive."""
        t, n = self.tables, self.config.evaluation.negatives
        decoder, nodes = get_decoder(self.config.model.decoder.name), self.encodings()
        if not n.filtered and n.negatives_per_positive > 0:
            return rank_sampled(t.split(split), nodes, t.relation_embeddings, decoder, n.negatives_per_positive, self.config.storage.dataset.num_nodes, both=self.config.model.inverse_edges, block=self.config.evaluation.batch_size)
        return rank_edges(t.split(split), nodes, t.relation_embeddings, decoder, t.all_edges() if n.filtered else None, self.config.model.inverse_edges)

    def evaluate(self, split: str = "test") -> DataFrame:
        """Link metrics, or the accuracy of classes."""
        if self.config.model.learning_task is LearningTask.NODE_CLASSIFICATION:
            p, e = self._encoded()
            return class_accuracy(self._labelled(split), self.tables.edges, p, e)
        return link_metrics(self.ranks(split))

    def encode(self, encoder: Encoder) -> DataFrame:
        self.tables.encoded = encoder.forward([self.tables.node_embeddings.select("id", F.col("emb").alias("vec"))])
        return self.tables.encoded

    def save(self, path: str, epoch: int | None = None) -> str:
        """Parameters with their optimisers' state, and how far training has come."""
        t = self.tables
        named = {"nodes": t.node_embeddings, "relations": t.relation_embeddings, "generator": t.generator_embeddings, "weights": t.weights}
        return Checkpointer(self.spark, path).save({k: v for k, v in named.items() if v is not None}, {"epoch": self.epoch if epoch is None else epoch, "epochs": self.epoch, "steps": self.steps, "dim": self.config.model.embedding_dim})

    def load(self, path: str, epoch: int) -> None:
        tables, meta = Checkpointer(self.spark, path).load(epoch)
        t = self.tables
        t.node_embeddings, t.relation_embeddings, t.generator_embeddings = tables["nodes"], tables.get("relations"), tables.get("generator")
        t.weights = tables.get("weights", t.weights)
        self.epoch, self.steps = meta.get("epochs", meta["epoch"]), meta.get("steps", 0)
