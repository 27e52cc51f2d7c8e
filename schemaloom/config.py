"""Driver-side settings; their values become literals in the plans."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field, fields
from typing import Any

OUTPUT_FORMATS = ("ids", "names")


def _known(cls: type, values: Mapping[str, Any] | None) -> dict[str, Any]:
    names = {f.name for f in fields(cls)}
    return {k: v for k, v in (values or {}).items() if k in names}


@dataclass(frozen=True)
class RetrievalConfig:
    """Budgets of the candidate schema. Unknown keys of a source are dropped."""

    max_tables: int = 10
    max_columns_per_table: int = 18
    min_columns_per_table: int = 4
    include_types: bool = True
    include_keys: bool = True
    include_join_neighbors: bool = True
    join_neighbor_limit: int = 2
    # Accepted for compatibility of stored settings; no operator reads it.
    always_include_table_columns_for_gold: bool = True

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any] | None) -> RetrievalConfig:
        return cls(**_known(cls, values))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @property
    def columns_kept(self) -> int:
        return max(self.min_columns_per_table, self.max_columns_per_table)


# The published budgets.
PRESETS = {
    "default": RetrievalConfig(),
    "grid": RetrievalConfig(max_tables=12, max_columns_per_table=20),
    "targeted": RetrievalConfig(max_tables=16, max_columns_per_table=24, join_neighbor_limit=3),
    "final": RetrievalConfig(max_tables=24, max_columns_per_table=32, join_neighbor_limit=4),
}


@dataclass(frozen=True)
class RunConfig:
    """Settings stored beside a run: answer format, budgets, input length."""

    base_model: str | None = None
    output_format: str = "ids"
    retrieval: RetrievalConfig = field(default_factory=lambda: PRESETS["default"])
    max_input_length: int = 2048
    train_config: Mapping[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.output_format not in OUTPUT_FORMATS:
            raise ValueError(f"unsupported output_format: {self.output_format}")

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any] | None) -> RunConfig:
        known = _known(cls, values)
        if "retrieval" in known:
            known["retrieval"] = RetrievalConfig.from_mapping(known["retrieval"])
        if "output_format" in known:
            known["output_format"] = str(known["output_format"]).lower()
        return cls(**known)

    @classmethod
    def from_json(cls, text: str) -> RunConfig:
        return cls.from_mapping(json.loads(text))

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)
