"""Configuration: nested dataclasses with defaults, merged from plain dictionaries (YAML or JSON) and validated."""

from __future__ import annotations

import dataclasses
import enum
from dataclasses import dataclass, field
from typing import Any


class _Named(enum.Enum):
    @classmethod
    def parse(cls, text: str):
        """A member by name, whatever its case."""
        try:
            return cls[text.upper()]
        except KeyError:
            raise ValueError(f"unknown {cls.__name__} {text}") from None


class LearningTask(_Named):
    LINK_PREDICTION = 1
    NODE_CLASSIFICATION = 2
    ENCODE = 3


class DecoderType(_Named):
    DISTMULT = 1
    TRANSE = 2
    COMPLEX = 3
    NODE = 4


class EdgeDecoderMethod(_Named):
    ONLY_POS = 1
    POS_AND_NEG = 2
    CORRUPT_NODE = 3
    CORRUPT_REL = 4
    TRAIN = 3
    INFER = 1


class LossFunction(_Named):
    SOFTMAX_CE = 1
    RANKING = 2
    CROSS_ENTROPY = 3
    BCE_AFTER_SIGMOID = 4
    BCE_WITH_LOGITS = 5
    MSE = 6
    SOFTPLUS = 7


class LossReduction(_Named):
    MEAN = 1
    SUM = 2


class Optimizer(_Named):
    SGD = 1
    ADAGRAD = 2
    ADAM = 3


class NegativeMethod(_Named):
    RNS = 1
    DNS = 2
    GAN = 3
    KBGAN = 3


class NeighborSampler(_Named):
    ALL = 1
    UNIFORM = 2
    DROPOUT = 3


class GnnType(_Named):
    SAGE = 1
    GRAPH_SAGE = 1
    GCN = 2


class Aggregator(_Named):
    MEAN = 1
    GCN = 2


class Activation(_Named):
    NONE = 1
    RELU = 2
    SIGMOID = 3


class BucketOrdering(_Named):
    OLD_BETA = 1
    NEW_BETA = 2
    ALL_BETA = 3
    COMET = 4
    CUSTOM = 5


class Backend(_Named):
    PARTITION_BUFFER = 1
    MEM_PARTITION_BUFFER = 2
    HOST_MEMORY = 3
    DEVICE_MEMORY = 4
    FLAT_FILE = 5

    @property
    def storage_level(self) -> str:
        """All kinds are parquet; the memory kinds are also cached."""
        return "MEMORY_AND_DISK" if self in (Backend.HOST_MEMORY, Backend.DEVICE_MEMORY) else "NONE"


@dataclass
class DatasetConfig:
    dataset_dir: str = ""
    num_edges: int = -1
    num_nodes: int = -1
    num_relations: int = 1
    num_train: int = -1
    num_valid: int = -1
    num_test: int = -1
    feature_dim: int = -1
    num_classes: int = -1


@dataclass
class LossConfig:
    type: LossFunction = LossFunction.SOFTMAX_CE
    reduction: LossReduction = LossReduction.SUM
    margin: float = 0.1


@dataclass
class OptimizerConfig:
    type: Optimizer = Optimizer.ADAGRAD
    learning_rate: float = 0.1
    eps: float = 1e-10
    weight_decay: float = 0.0


@dataclass
class LayerConfig:
    """One graph layer of the encoder and the sampler of its hop."""

    type: GnnType = GnnType.SAGE
    aggregator: Aggregator = Aggregator.MEAN
    output_dim: int = 64
    activation: Activation = Activation.NONE
    bias: bool = True
    sampler: NeighborSampler = NeighborSampler.ALL
    max_neighbors: int = -1
    rate: float = 0.0


@dataclass
class ModelConfig:
    learning_task: LearningTask = LearningTask.LINK_PREDICTION
    decoder: DecoderType = DecoderType.DISTMULT
    inverse_edges: bool = True
    embedding_dim: int = 64
    random_seed: int = 0
    encoder: list[LayerConfig] = field(default_factory=list)
    use_incoming_nbrs: bool = False
    use_outgoing_nbrs: bool = True
    loss: LossConfig = field(default_factory=LossConfig)
    dense_optimizer: OptimizerConfig = field(default_factory=OptimizerConfig)
    sparse_optimizer: OptimizerConfig = field(default_factory=OptimizerConfig)


@dataclass
class PartitionConfig:
    num_partitions: int = 1
    buffer_capacity: int = 1
    fine_to_coarse_ratio: int = 1
    num_cache_partitions: int = 0
    ordering: BucketOrdering = BucketOrdering.NEW_BETA


@dataclass
class StorageConfig:
    dataset: DatasetConfig = field(default_factory=DatasetConfig)
    edges: Backend = Backend.FLAT_FILE
    embeddings: Backend = Backend.HOST_MEMORY
    partitions: PartitionConfig = field(default_factory=PartitionConfig)


@dataclass
class NegativeConfig:
    num_chunks: int = 1
    negatives_per_positive: int = 1000
    degree_fraction: float = 0.0
    filtered: bool = False
    method: NegativeMethod = NegativeMethod.RNS
    ratio: float = 1.0


@dataclass
class TrainingConfig:
    batch_size: int = 10_000
    num_epochs: int = 1
    batches_per_step: int = 1
    epochs_per_checkpoint: int = 0
    negatives: NegativeConfig = field(default_factory=NegativeConfig)


@dataclass
class EvaluationConfig:
    batch_size: int = 1000
    epochs_per_eval: int = 1
    negatives: NegativeConfig = field(default_factory=lambda: NegativeConfig(filtered=True))


@dataclass
class GraphConfig:
    model: ModelConfig = field(default_factory=ModelConfig)
    storage: StorageConfig = field(default_factory=StorageConfig)
    training: TrainingConfig = field(default_factory=TrainingConfig)
    evaluation: EvaluationConfig = field(default_factory=EvaluationConfig)


#: Options that are lists of dataclasses.
LISTS = {(ModelConfig, "encoder"): LayerConfig}


def merge(kind: type, values: dict[str, Any]) -> Any:
    """A dataclass from a dictionary: missing entries keep their defaults, unknown ones are errors, enums are parsed."""
    out = kind()
    names = {f.name for f in dataclasses.fields(kind)}
    for k, v in values.items():
        if k not in names:
            raise ValueError(f"unknown option {k} of {kind.__name__}")
        old = getattr(out, k)
        if dataclasses.is_dataclass(old):
            v = merge(type(old), v)
        elif (kind, k) in LISTS:
            v = [merge(LISTS[kind, k], x) for x in v]
        elif isinstance(old, _Named) and isinstance(v, str):
            v = type(old).parse(v)
        elif isinstance(old, float) and isinstance(v, int):
            v = float(v)
        elif not isinstance(v, type(old)):
            raise ValueError(f"{k} must be {type(old).__name__}")
        setattr(out, k, v)
    return out


def load_config(values: dict[str, Any]) -> GraphConfig:
    config = merge(GraphConfig, values)
    validate(config)
    return config


def _options(node: Any) -> dict[str, Any]:
    return (node or {}).get("options") or {} if isinstance(node, dict) else {}


#: Options of the document form that say where and how another engine runs; Spark decides these.
ENGINE_OPTIONS = {"storage": ("device_type", "device_ids", "prefetch", "save_model", "log_level", "full_graph_evaluation", "export_encoded_nodes", "model_dir", "train_edges_pre_sorted", "gpu_model_average"), "training": ("epochs_per_shuffle", "logs_per_epoch", "save_model", "pipeline", "resume_training", "resume_from_checkpoint", "checkpoint")}


def from_document(doc: dict[str, Any]) -> GraphConfig:
    """A configuration from the nested document form: layer stages, ``type`` with ``options``, and sampling sections.

    Stages: EMBEDDING and FEATURE layers are the encoder's inputs, GNN layers follow, one in a stage, each with the sampler
    of its hop from train_neighbor_sampling. Options that only place work on devices are left to Spark; all others must be
    known, or they raise.
    """
    model, storage, training, evaluation = (dict(doc.get(k) or {}) for k in ("model", "storage", "training", "evaluation"))
    if unknown := set(doc) - {"model", "storage", "training", "evaluation"}:
        raise ValueError(f"unknown sections {sorted(unknown)}")
    out: dict[str, Any] = {"model": {}, "storage": {}, "training": {}, "evaluation": {}}
    m = out["model"]
    encoder, decoder = model.pop("encoder", None) or {}, model.pop("decoder", None) or {}
    samplers = encoder.get("train_neighbor_sampling") or []
    layers: list[dict[str, Any]] = []
    for stage in encoder.get("layers") or []:
        for layer in stage:
            kind, options = str(layer.get("type", "")).upper(), _options(layer)
            if kind == "EMBEDDING":
                m["embedding_dim"] = layer["output_dim"]
            elif kind == "GNN":
                if len(stage) != 1:
                    raise ValueError("a stage has one GNN layer")
                sampler = samplers[len(layers)] if len(layers) < len(samplers) else {"type": "ALL"}
                own = {"type": options.get("type", "SAGE"), "output_dim": layer["output_dim"], "activation": layer.get("activation", "NONE"), "bias": bool(layer.get("bias", False)), "sampler": sampler.get("type", "ALL")}
                if "aggregator" in options:
                    own["aggregator"] = options["aggregator"]
                limits = _options(sampler)
                own |= {a: limits[b] for a, b in (("max_neighbors", "max_neighbors"), ("rate", "rate")) if b in limits}
                layers.append(own)
            elif kind != "FEATURE":
                raise ValueError(f"no layer of type {kind}")
    if layers:
        m["encoder"] = layers
    for k, v in (("use_incoming_nbrs", encoder.get("use_incoming_nbrs")), ("use_outgoing_nbrs", encoder.get("use_outgoing_nbrs"))):
        if v is not None:
            m[k] = v
    if decoder:
        options = _options(decoder)
        m["decoder"] = decoder["type"]
        if "inverse_edges" in options:
            m["inverse_edges"] = options["inverse_edges"]
        if "input_dim" in options and not layers and options["input_dim"] != m.get("embedding_dim", options["input_dim"]):
            raise ValueError("the decoder's input_dim is the encoder's output_dim")
        if EdgeDecoderMethod.parse(options.get("edge_decoder_method", "CORRUPT_NODE")) is not EdgeDecoderMethod.CORRUPT_NODE:
            raise ValueError("training replaces nodes")
    if loss := model.pop("loss", None):
        m["loss"] = {"type": loss["type"]} | {k: v for k, v in _options(loss).items() if k in ("reduction", "margin")}
    for k in ("dense_optimizer", "sparse_optimizer"):
        if o := model.pop(k, None):
            m[k] = {"type": o["type"]} | {a: _options(o)[a] for a in ("learning_rate", "eps", "weight_decay") if a in _options(o)}
    m |= model
    dataset = storage.pop("dataset", None)
    if dataset:
        out["storage"]["dataset"] = {k: v for k, v in dataset.items() if k in {f.name for f in dataclasses.fields(DatasetConfig)}}
    if edges := storage.pop("edges", None):
        out["storage"]["edges"] = edges["type"]
    if embeddings := storage.pop("embeddings", None):
        out["storage"]["embeddings"] = embeddings["type"]
        names = {"num_partitions": "num_partitions", "buffer_capacity": "buffer_capacity", "fine_to_coarse_ratio": "fine_to_coarse_ratio", "num_cache_partitions": "num_cache_partitions", "edge_bucket_ordering": "ordering"}
        if parts := {b: _options(embeddings)[a] for a, b in names.items() if a in _options(embeddings)}:
            out["storage"]["partitions"] = parts
    for section, values in (("storage", storage), ("training", training)):
        for k in ENGINE_OPTIONS[section]:
            values.pop(k, None)
    out["storage"] |= {k: v for k, v in storage.items() if k not in ("features", "nodes")}
    negatives = dict(training.pop("negative_sampling", None) or {})
    if method := training.pop("negative_sampling_method", None):
        negatives["method"] = method
    for k in ("negative_sampling_selected_ratio", "selected_ratio"):
        if k in training:
            negatives["ratio"] = training.pop(k)
    negatives.pop("local_filter_mode", None)
    out["training"] = training | ({"negatives": negatives} if negatives else {})
    sampled = dict(evaluation.pop("negative_sampling", None) or {})
    sampled.pop("local_filter_mode", None)
    for k in ("pipeline", "epochs_per_shuffle"):
        evaluation.pop(k, None)
    out["evaluation"] = evaluation | ({"negatives": {"filtered": False} | sampled} if sampled else {})
    return load_config(out)


def load_yaml(text: str) -> GraphConfig:
    """A configuration from YAML text in the document form."""
    try:
        import yaml
    except ImportError as e:
        raise ImportError("YAML needs the yaml package; from_document takes dictionaries") from e
    return from_document(yaml.safe_load(text) or {})


def validate(c: GraphConfig) -> None:
    """Raises ValueError where options are out of range or do not fit each other."""
    p, n = c.storage.partitions, c.training.negatives
    if c.model.embedding_dim <= 0 or c.training.batch_size <= 0 or c.evaluation.batch_size <= 0:
        raise ValueError("dimensions and batch sizes are positive")
    m = c.model
    if m.decoder is DecoderType.COMPLEX and (m.encoder[-1].output_dim if m.encoder else m.embedding_dim) % 2:
        raise ValueError("ComplEx needs an even dimension")
    if (m.learning_task is LearningTask.NODE_CLASSIFICATION) is not (m.decoder is DecoderType.NODE):
        raise ValueError("node classification and the NODE decoder go together")
    if m.learning_task is LearningTask.NODE_CLASSIFICATION and not m.encoder:
        raise ValueError("node classification needs an encoder")
    if m.learning_task is LearningTask.NODE_CLASSIFICATION and c.storage.dataset.num_classes > 0 and m.encoder[-1].output_dim != c.storage.dataset.num_classes:
        raise ValueError("the encoder's last layer has as many outputs as there are classes")
    if any(x.output_dim <= 0 or x.aggregator is Aggregator.GCN and x.type is not GnnType.SAGE or x.sampler is NeighborSampler.DROPOUT and not 0 <= x.rate < 1 for x in m.encoder):
        raise ValueError("encoder layers are out of range")
    if m.encoder and not (m.use_incoming_nbrs or m.use_outgoing_nbrs):
        raise ValueError("an encoder follows incoming or outgoing neighbours")
    if not 0 <= n.degree_fraction <= 1 or not 0 < n.ratio <= 1 or n.num_chunks < 1:
        raise ValueError("negative sampling options are out of range")
    if c.storage.embeddings in (Backend.PARTITION_BUFFER, Backend.MEM_PARTITION_BUFFER):
        if not 2 <= p.buffer_capacity <= p.num_partitions:
            raise ValueError("a buffer holds from 2 to all partitions")
        if p.ordering is BucketOrdering.COMET and (p.buffer_capacity - p.num_cache_partitions) % p.fine_to_coarse_ratio:
            raise ValueError("groups of partitions must fill the buffer")
    if c.storage.edges in (Backend.PARTITION_BUFFER, Backend.MEM_PARTITION_BUFFER):
        raise ValueError("edges are not buffered by partition")
