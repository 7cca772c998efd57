"""Configuration of the preparation and evaluation jobs, checked on the driver before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

LANGUAGE_MODELING = "language_modeling"
PROMPT_ONLY = "prompt_only"
PREFERENCE = "preference"

REQUIRED_FIELDS = {
    LANGUAGE_MODELING: ("user_field", "assistant_field"),
    PROMPT_ONLY: ("user_field",),
    PREFERENCE: ("user_field", "chosen_field", "rejected_field"),
}

MAPPING_TYPES = ("column", "template", "image")


@dataclass(frozen=True)
class FieldMapping:
    type: str
    value: str

    def __post_init__(self):
        if self.type not in MAPPING_TYPES:
            raise ValueError(f"mapping type must be one of {MAPPING_TYPES}, got {self.type!r}")


FieldMappings = dict[str, "FieldMapping | list[FieldMapping]"]


def as_mappings(raw: Mapping) -> FieldMappings:
    """Accepts FieldMapping objects or plain ``{"type": …, "value": …}`` dicts."""

    def one(item):
        if isinstance(item, FieldMapping):
            return item
        if isinstance(item, Mapping):
            return FieldMapping(item["type"], item["value"])
        raise ValueError(f"a field mapping must be a dict, got {type(item).__name__}")

    return {
        name: [one(i) for i in item] if isinstance(item, (list, tuple)) else one(item)
        for name, item in raw.items()
    }


def validate_mappings(mappings: FieldMappings, columns: Iterable[str], mode: str | None = None) -> None:
    columns = set(columns)
    if mode is not None:
        if mode not in REQUIRED_FIELDS:
            raise ValueError(f"unsupported processing mode: {mode}")
        missing = [f for f in REQUIRED_FIELDS[mode] if f not in mappings]
        if missing:
            raise ValueError(f"{mode} needs the field mappings {missing}")
    for name, item in mappings.items():
        items = item if isinstance(item, list) else [item]
        if name != "user_field":
            if isinstance(item, list):
                raise ValueError(f"{name!r} cannot be a list; only user_field can")
            if item.type == "image":
                raise ValueError(f"images belong in user_field, not in {name!r}")
        for m in items:
            if m.type != "template" and m.value not in columns:
                raise ValueError(f"{name!r} refers to column {m.value!r}; available: {sorted(columns)}")


def image_columns(mappings: FieldMappings) -> list[str]:
    """The columns that image mappings name."""
    user = mappings.get("user_field")
    items = user if isinstance(user, list) else [user] if user else []
    return [m.value for m in items if m.type == "image"]


def detect_modality(mappings: FieldMappings) -> str:
    return "vision" if image_columns(mappings) else "text"


@dataclass(frozen=True)
class NamedSplits:
    """Two splits that already exist in the source."""

    train_split: str
    test_split: str


@dataclass(frozen=True)
class ManualSplit:
    sample_size: int | None = None
    test_size: float | None = None
    split: str | None = None


@dataclass(frozen=True)
class NoSplit:
    sample_size: int | None = None
    split: str | None = None


@dataclass(frozen=True)
class AugmentationConfig:
    augmentation_factor: float = 1.5
    use_eda: bool = False
    use_back_translation: bool = False
    use_paraphrasing: bool = False
    use_synthesis: bool = False
    synthesis_ratio: float = 0.5
    custom_prompt: str = ""
    system_message: str = ""
    max_batch_size: int = 10
    eda_synonym_rate: float = 0.1
    eda_insert_rate: float = 0.1
    eda_swap_rate: float = 0.1
    eda_delete_rate: float = 0.1
    splits: Sequence[str] | str = ("train",)
    seed: int = 42


@dataclass(frozen=True)
class PreprocessingConfig:
    field_mappings: Mapping = field(default_factory=dict)
    normalize_whitespace: bool = True
    augmentation: AugmentationConfig | None = None
    split: NamedSplits | ManualSplit | NoSplit | None = None
    null_text: str = ""
    include_system: bool = False


@dataclass(frozen=True)
class EvaluationConfig:
    task_type: str | None = None
    metrics: Sequence[str] = ()
    max_samples: int | None = None
    num_sample_results: int = 3
    positive: str | int = 1  # the label that binary precision, recall and F1 are about
