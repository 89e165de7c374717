"""Configurations. Names and defaults are part of the interface; unknown keys are ignored by from_dict."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import ClassVar


class Config:
    @classmethod
    def from_dict(cls, values: dict | None):
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known})

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class DataLoaderConfig(Config):
    filepath: str = ""
    log_type: str = "csv"
    dimensions: dict = field(default_factory=dict)
    reader_args: dict = field(default_factory=dict)
    infer_datetime: bool = False
    datetime_format: str = "%Y-%m-%dT%H:%M:%SZ"
    open_dataset: str | None = None


@dataclass
class OpenSetDataLoaderConfig(Config):
    dataset_name: str | None = None
    filepath: str | None = None


@dataclass
class PreprocessorConfig(Config):
    custom_delimiters_regex: list | None = None
    custom_replace_list: list | None = None


@dataclass
class PartitionerConfig(Config):
    group_by_category: list | None = None
    group_by_time: str | None = None
    sliding_window: int = 0
    sep_token: str = "[SEP]"
    exclude_last_window: bool = False
    exclude_smaller_windows: bool = False


@dataclass
class OpenSetPartitionerConfig(Config):
    sliding_window: int = 0
    session_window: bool = True
    logsequence_delim: str = "[SEP]"


@dataclass
class FeatureExtractorConfig(Config):
    group_by_category: list | None = None
    group_by_time: str | None = None
    sliding_window: int = 0
    steps: int = 1
    max_feature_len: int = 100


@dataclass
class LogParserConfig(Config):
    parsing_algorithm: str = "drain"
    parsing_algo_params: dict | None = None
    custom_config: dict | None = None


@dataclass
class VectorizerConfig(Config):
    algo_name: str = "word2vec"
    algo_param: dict | None = None
    custom_param: dict | None = None


@dataclass
class CategoricalEncoderConfig(Config):
    name: str = "label_encoder"
    params: dict | None = None


@dataclass
class AnomalyDetectionConfig(Config):
    algo_name: str = "one_class_svm"
    algo_params: dict | None = None
    custom_params: dict | None = None


@dataclass
class HetAnomalyDetectionConfig(AnomalyDetectionConfig):
    train_test_ratio: float = 0.3


@dataclass
class ClusteringConfig(Config):
    algo_name: str = "dbscan"
    algo_params: dict | None = None
    custom_params: dict | None = None


@dataclass
class WorkFlowConfig(Config):
    data_loader_config: DataLoaderConfig | None = None
    open_set_data_loader_config: OpenSetDataLoaderConfig | None = None
    preprocessor_config: PreprocessorConfig | None = None
    log_parser_config: LogParserConfig | None = None
    log_vectorizer_config: VectorizerConfig | None = None
    partitioner_config: PartitionerConfig | None = None
    open_set_partitioner_config: OpenSetPartitionerConfig | None = None
    categorical_encoder_config: CategoricalEncoderConfig | None = None
    feature_extractor_config: FeatureExtractorConfig | None = None
    anomaly_detection_config: AnomalyDetectionConfig | None = None
    nn_anomaly_detection_config: AnomalyDetectionConfig | None = None
    clustering_config: ClusteringConfig | None = None
    workflow_config: dict | None = None

    PARTS: ClassVar[dict] = {
        "data_loader_config": DataLoaderConfig,
        "open_set_data_loader_config": OpenSetDataLoaderConfig,
        "preprocessor_config": PreprocessorConfig,
        "log_parser_config": LogParserConfig,
        "log_vectorizer_config": VectorizerConfig,
        "partitioner_config": PartitionerConfig,
        "open_set_partitioner_config": OpenSetPartitionerConfig,
        "categorical_encoder_config": CategoricalEncoderConfig,
        "feature_extractor_config": FeatureExtractorConfig,
        "anomaly_detection_config": AnomalyDetectionConfig,
        "nn_anomaly_detection_config": AnomalyDetectionConfig,
        "clustering_config": ClusteringConfig,
    }

    def __post_init__(self):
        for name, kind in self.PARTS.items():
            if isinstance(v := getattr(self, name), dict):
                setattr(self, name, kind.from_dict(v))


@dataclass
class OpenSetADWorkflowConfig(WorkFlowConfig):
    dataset_name: str | None = None
    label_filepath: str | None = None
    output_dir: str | None = None
    parse_logline: bool = False
    training_type: str | None = None
    deduplicate_test: bool = False
    test_data_frac_pos: float = 0.8
    test_data_frac_neg: float = 0.8
    train_test_shuffle: bool = False


def read_config(path: str) -> dict | list[dict]:
    """A JSON or YAML file as a dict, a CSV file with a header as a list of dicts; other suffixes raise ValueError (pickles are not read)."""
    import csv
    import json

    if path.endswith(".csv"):
        with open(path, encoding="utf-8", newline="") as f:
            return list(csv.DictReader(f))

    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ImportError("reading YAML needs the package yaml") from e
        with open(path, encoding="utf-8") as f:
            return yaml.safe_load(f)
    raise ValueError(f"not a JSON, YAML or CSV file: {path}")


def parameter_info(kind: type) -> dict[str, tuple[str, object]]:
    """Names of a parameter class with type and default (None if there is none)."""
    from dataclasses import MISSING

    return {f.name: (str(f.type), f.default if f.default is not MISSING else f.default_factory() if f.default_factory is not MISSING else None) for f in fields(kind)}


def typed_parameters(kind: type, values: dict[str, str]) -> dict:
    """Texts of a form as values of the class's types; empty texts take the default, unknown names raise KeyError."""
    import ast

    info, out = parameter_info(kind), {}
    for name, text in values.items():
        if name not in info:
            raise KeyError(name)
        if text is None or not text.strip():
            continue
        if info[name][0].split("|")[0].strip() == "str":
            out[name] = text
        else:
            try:
                out[name] = ast.literal_eval(text.strip())
            except (ValueError, SyntaxError):
                out[name] = text
    return out
