"""Schemas and settings; everything about languages is data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Columns of the common schema, and the thresholds below (fixed values).
CORPUS = T.StructType(
    [T.StructField(n, T.BooleanType() if n == "is_core" else T.StringType()) for n in ("id", "text", "label", "source", "subcorpus", "group_id", "is_core", "split")]
)
BENCHMARK = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "label", "source", "id")])
PREDICTION = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "label", "source", "true_label", "predicted_label")])
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class Config:
    """Labels, scripts and thresholds of a corpus."""

    core: tuple[str, ...] = ("sinhala", "pali", "sanskrit")
    mixed: str = "mixed"
    script: str = "\\x{0D80}-\\x{0DFF}"
    other_script: str = "\\x{0900}-\\x{097F}"
    least_chars: int = 10
    most_chars: int = 2000
    seed: int = 42
    ratios: tuple[float, float] = (0.8, 0.1)
    router_threshold: float = 0.5
    rates: dict[str, str] = field(default_factory=lambda: {"token": "0.001", "page": "0.1"})
