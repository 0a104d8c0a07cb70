"""Run settings. Unknown keys are an error, as in keyword arguments."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class DatasetSpec:
    path: str
    split: str = "train"
    name: str | None = None
    limit: int | None = None
    field_map: dict = field(default_factory=dict)
    format: str = "auto"


@dataclass(frozen=True)
class SpeechSpec:
    path: str
    name: str | None = None
    train_split: str = "train"
    eval_split: str = "validation"
    text_column: str | None = None
    audio_column: str = "audio"
    streaming: bool = True


@dataclass(frozen=True)
class BuildSpec:
    """A corpus build: sources by role, shares of the mix, and how it is cut."""

    proportions: dict
    proactivity: list = field(default_factory=list)
    function_calling: list = field(default_factory=list)
    replay: list = field(default_factory=list)
    seed: int = 42
    val_ratio: float = 0.05
    target_size: int | None = None
    proactivity_balance: bool = True


# The names and defaults of the settings below, as settings files have them. The memory estimates read them; the runs are others'.
ENGINES = ("unsloth", "hf")
LINEAR_LAYERS = ("q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj")


@dataclass(frozen=True)
class AdapterSpec:
    r: int = 32
    alpha: int = 64
    dropout: float = 0.0
    target_modules: tuple = LINEAR_LAYERS


@dataclass(frozen=True)
class _TrainingSpec:
    base_model: str = "Qwen/Qwen3-8B"
    engine: str = "unsloth"
    max_length: int = 4096
    logging_steps: int = 10
    seed: int = 42
    bf16: bool = True
    gradient_checkpointing: bool = True
    load_in_4bit: bool = False
    lora: AdapterSpec = AdapterSpec()

    def __post_init__(self) -> None:
        if self.engine not in ENGINES:
            raise ValueError(f"engine {self.engine!r} is none of {', '.join(ENGINES)}")


@dataclass(frozen=True)
class TuningSpec(_TrainingSpec):
    """Supervised tuning."""

    train_file: str = "data/processed/train.jsonl"
    val_file: str = "data/processed/val.jsonl"
    output_dir: str = "outputs/adapter-decisions"
    learning_rate: float = 1e-4
    num_epochs: float = 3.0
    per_device_batch_size: int = 4
    gradient_accumulation_steps: int = 4
    warmup_ratio: float = 0.03
    eval_steps: int = 100
    save_steps: int = 200
    save_total_limit: int = 3


@dataclass(frozen=True)
class PreferenceSpec(_TrainingSpec):
    """Preference tuning of an adapter."""

    adapter_path: str = "outputs/adapter-decisions"
    pairs_file: str = "data/processed/preference_pairs.jsonl"
    output_dir: str = "outputs/adapter-decisions-dpo"
    learning_rate: float = 5e-6
    beta: float = 0.1
    num_epochs: float = 1.0
    per_device_batch_size: int = 2
    gradient_accumulation_steps: int = 8
    max_prompt_length: int = 3072


@dataclass(frozen=True)
class SpeechRunSpec:
    """Tuning of a speech model on a stream of examples, so by steps."""

    model: str = "openai/whisper-large-v3-turbo"
    language: str = "kazakh"
    task: str = "transcribe"
    dataset: SpeechSpec = field(default_factory=lambda: SpeechSpec(path=""))
    output_dir: str = "outputs/whisper-kk"
    freeze_encoder: bool = True
    optim: str = "adamw_bnb_8bit"
    learning_rate: float = 6e-6
    warmup_steps: int = 50
    max_steps: int = 1500
    per_device_batch_size: int = 4
    gradient_accumulation_steps: int = 4
    eval_steps: int = 250
    save_steps: int = 500
    save_total_limit: int = 2
    logging_steps: int = 25
    eval_examples: int = 200
    generation_max_length: int = 225
    seed: int = 42
    bf16: bool = True
    gradient_checkpointing: bool = True

    def __post_init__(self) -> None:
        for name in ("max_steps", "per_device_batch_size"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")

    @property
    def eight_bit(self) -> bool:
        return "8bit" in self.optim

    @property
    def effective_batch(self) -> int:
        return self.per_device_batch_size * self.gradient_accumulation_steps


def split_bounds(split: str) -> tuple[int, int | None]:
    """Start and stop of a split's slice, as in train[:3000]; the whole split without one."""
    m = re.fullmatch(r"[\w.-]+(?:\[(\d*):(\d*)\])?", split)
    if m is None:
        raise ValueError(f"split {split!r} is no name with an optional slice of rows")
    return int(m[1] or 0), int(m[2]) if m[2] else None


def is_hub_id(path: str) -> bool:
    """Whether a model's path names one on a hub: it has a slash and isn't absolute."""
    return "/" in path and not path.startswith("/")


def load(kind: type, values: dict):
    """A settings record of a mapping."""
    if unknown := sorted(set(values) - {f.name for f in fields(kind)}):
        raise TypeError(f"{kind.__name__} has no settings {', '.join(unknown)}")
    nested = {"lora": AdapterSpec, "dataset": SpeechSpec, **dict.fromkeys(("proactivity", "function_calling", "replay"), DatasetSpec)}
    made = {k: v if k not in nested or v is None else [load(nested[k], x) for x in v] if isinstance(v, list) else load(nested[k], v) for k, v in values.items()}
    return kind(**{k: v for k, v in made.items() if v is not None or k not in nested})


def load_yaml(kind: type, path: str):
    """A settings record of a YAML file on the driver."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML settings needs the yaml package; pass a mapping to load() instead") from e
    with open(path, encoding="utf-8") as f:
        return load(kind, yaml.safe_load(f) or {})


def load_build(path: str) -> BuildSpec:
    return load_yaml(BuildSpec, path)
